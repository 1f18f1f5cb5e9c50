"""Problem 7: mixing sources to target shares of the total size in tokens.

The total is the largest at which every source can reach its share without any record being used more often than its
source's max_repeats, or a smaller one that is asked for.  In each source a record's expected number of copies is
``min(max_repeats, c * weight)``; the weight grows with the logarithm of the record's size, and c makes the expected
size the source's target.  The whole part of that number is certain.  The remainder is an inclusion probability, and
Pareto order sampling settles it: with u uniform from a hash of the key, records are ranked by the odds of u over the
odds of the inclusion probability, and taken from the smallest until the source's size is reached.  Where that is, is
found by refining a histogram of ranks, each step over all records, so that nothing is sorted as a whole and no source,
however large, comes into one task.

Defined results: null, empty and blank-only texts without tokens, records of no source and of sources without target
are not used.  A source with a share but without tokens gets nothing, and its share counts as not reached.  Repeated
rows are records of their own; those of one key are taken or left together.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm.tokenize import token_count
from folioloom.session import materialize, spread

MOST_SOURCES = 10_000
_CELLS, _FEW = 4096, 5000


def sized_records(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, tokens) of the records of the sources in `targets`, as a written table."""
    names = [r["source"] for r in targets.select("source").limit(MOST_SOURCES + 1).collect()]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    own = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    own = own.where(F.col("source").isin([n for n in names if n is not None]))
    return materialize(spread(own).select("key", "source", token_count(F.col("text")).alias("tokens")), "sized")


def size_class() -> Column:
    """Binary logarithm of the number of tokens, rounded down; its values number some 60 at most."""
    return F.floor(F.log2(F.col("tokens"))).cast("int")


def expected_copies(classes: dict[int, tuple[int, int]], target: float, most: int) -> dict[int, float]:
    """Expected copies of a record by size class, so that their tokens sum to `target`.  classes: records and tokens."""
    full = sum(t for _, t in classes.values())
    if not full or target <= 0:
        return dict.fromkeys(classes, 0.0)
    if target >= most * full:
        return dict.fromkeys(classes, float(most))
    size = lambda c: sum(min(most, c * (1 + k)) * t for k, (_, t) in classes.items())
    lo, hi = 0.0, float(most)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if size(mid) < target else (lo, mid)
    return {k: min(float(most), hi * (1 + k)) for k in classes}


def _position(seed: int) -> Column:
    """Pareto rank, mapped into [0, 1): odds of u over odds of the inclusion probability, q / (1 + q)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("key")), 11).cast("double")
    u = (bits + 0.5) / F.lit(float(1 << 53))
    q = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    return q / (1 + q)


class Mix:
    """A mixture: the plan by source and size class, the cut by source, and the records with their copies."""

    def __init__(self, sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7):
        spark = sized.sparkSession
        rows = targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows if r["source"] is not None}
        usable = sized.where((F.col("tokens") > 0) & F.col("source").isNotNull()).withColumn("class", size_class())
        classes: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
        # At most sources x 64 rows.
        for r in usable.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect():
            if r["source"] in self.targets:
                classes[r["source"]][r["class"]] = (r["n"], r["t"])
        room = [m * sum(t for _, t in classes[s].values()) / share for s, (share, m) in self.targets.items() if share > 0 and classes.get(s)]
        self.total = min(room) if room else 0.0
        if total_tokens is not None:
            self.total = min(self.total, float(total_tokens))
        plan, rest = [], {}
        for s, (share, most) in self.targets.items():
            left = self.total * share
            for k, copies in expected_copies(classes[s], left, most).items():
                whole = math.floor(copies + 1e-9)
                chance = max(0.0, copies - whole)
                plan.append((s, k, whole, chance if chance > 1e-9 else 0.0))
                left -= whole * classes[s][k][1]
            rest[s] = max(0.0, left)
        kinds = "source string, class int, whole int, chance double"
        # At most sources x 64 rows: bounded, and so broadcast.
        self.plan = spark.createDataFrame(plan, kinds)
        self.planned = usable.join(F.broadcast(self.plan), ["source", "class"]).withColumn(
            "pos", F.when(F.col("chance") > 0, _position(seed))
        )
        self.cuts = self._cut(spark, rest)

    def _cut(self, spark: SparkSession, rest: dict[str, float]) -> dict[str, tuple[float, int | None]]:
        """By source the last rank and key that are taken, so that their tokens come closest to what is left to fill.

        Each step counts ranks in cells, adds the cells up in Spark, and brings back one row a source: the cell in which
        the source is full.  It narrows the place by _CELLS, until that cell holds few records, or records of one rank
        only, which are taken or left together."""
        ranked = self.planned.where(F.col("pos").isNotNull())
        done: dict[str, tuple[float, int | None]] = {s: (-1.0, None) for s in rest}
        open_ = {s: (0.0, r) for s, r in rest.items() if r > 0}  # lowest rank of the cell, tokens to fill from there
        few: dict[str, tuple[float, float]] = {}
        width = 1.0
        while open_:
            goals = spark.createDataFrame([(s, low, r) for s, (low, r) in open_.items()], "source string, low double, goal double")
            met = ranked.join(F.broadcast(goals), "source")  # a row a source, of MOST_SOURCES at most
            cell = F.floor((F.col("pos") - F.col("low")) * (_CELLS / width)).cast("int")
            at = met.withColumn("cell", cell).where((F.col("cell") >= 0) & (F.col("cell") < _CELLS))
            cells = at.groupBy("source", "goal", "cell").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"))
            so_far = F.sum("t").over(Window.partitionBy("source").orderBy("cell"))
            full = F.struct("cell", "t", "n", "a", "b", (so_far - F.col("t")).alias("before"))
            placed = cells.select("source", F.when(so_far > F.col("goal"), full).alias("full"))
            found = {r["source"]: r["full"] for r in placed.groupBy("source").agg(F.min("full").alias("full")).collect()}
            part, still = width / _CELLS, {}
            for s, (low, goal) in open_.items():
                c = found.get(s)
                if c is None:
                    done[s] = (2.0, None)  # all of them
                    continue
                first, left = low + c["cell"] * part, goal - c["before"]
                if c["n"] <= _FEW:
                    few[s] = first, left
                    done[s] = (math.nextafter(c["a"], -1.0), None)
                elif c["a"] == c["b"]:
                    done[s] = (c["b"], None) if left >= c["t"] / 2 else (math.nextafter(c["a"], -1.0), None)
                else:
                    still[s] = first, left
            if few_now := {s: few.pop(s) for s in list(few)}:
                self._finish(spark, ranked, few_now, part, done)
            open_, width = still, part
        return done

    def _finish(self, spark: SparkSession, ranked: DataFrame, few: dict[str, tuple[float, float]], part: float, done: dict) -> None:
        """Cells of at most _FEW records each, record by record, in Spark: one row a source comes back."""
        goals = spark.createDataFrame([(s, first, left) for s, (first, left) in few.items()], "source string, first double, left_ double")
        met = ranked.join(F.broadcast(goals), "source").where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.lit(part)))
        units = met.groupBy("source", "left_", "pos", "key").agg(F.sum("tokens").alias("t"))
        so_far = F.sum("t").over(Window.partitionBy("source").orderBy("pos", "key"))
        # In order, each is taken while at least a half of it is still to fill; the first that is not ends it.
        step = units.withColumn("stop", F.col("left_") - (so_far - F.col("t")) < F.col("t") / 2)
        over = F.max(F.col("stop").cast("int")).over(Window.partitionBy("source").orderBy("pos", "key"))
        last = step.withColumn("over", over).where("over = 0").groupBy("source").agg(F.max(F.struct("pos", "key")).alias("last"))
        for r in last.collect():
            done[r["source"]] = (r["last"]["pos"], r["last"]["key"])

    def records(self) -> DataFrame:
        """(key, source, tokens, copies) of every record that is used."""
        spark = self.plan.sparkSession
        key_kind = self.planned.schema["key"].dataType.simpleString()
        cuts = [(s, pos, key) for s, (pos, key) in self.cuts.items()]
        cut = spark.createDataFrame(cuts, f"source string, last_pos double, last_key {key_kind}")
        # Without a last key all of that rank are taken.
        tie = (F.col("pos") == F.col("last_pos")) & (F.col("last_key").isNull() | (F.col("key") <= F.col("last_key")))
        taken = (F.col("pos") < F.col("last_pos")) | tie
        copies = F.col("whole") + F.when(F.coalesce(taken, F.lit(False)), 1).otherwise(0)
        out = self.planned.join(F.broadcast(cut), "source").select("key", "source", "tokens", copies.cast("int").alias("copies"))
        return out.where(F.col("copies") > 0)

    def shares(self) -> DataFrame:
        """By source: target and reached share of the tokens, records used, copies, most copies of one record."""
        spark = self.plan.sparkSession
        wanted = spark.createDataFrame(
            [(s, share, most) for s, (share, most) in self.targets.items()], "source string, target_share double, max_repeats int"
        )
        sums = self.records().groupBy("source").agg(
            F.count("*").alias("records"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"),
            F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        )
        all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(_everything())
        return (
            wanted.join(sums, "source", "left")
            .withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0)))
            .select(
                "source", "target_share", "reached_share", F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("copies", F.lit(0)).alias("copies"),
                F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
            )
        )


def _everything():
    """A window over a report's rows, one a source."""
    return Window.partitionBy(F.lit(1))


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, **columns: str) -> Mix:
    """The mixture of `docs` by `targets` (source, target_share, max_repeats)."""
    return Mix(sized_records(docs, targets, **columns), targets, total_tokens, seed)
