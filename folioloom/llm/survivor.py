"""Problem 2: the best value of each field in a group of duplicate records.

Two policies say which existing value survives.

``dominant``: a value outweighs all values of lower rank together, which is how a rule of preference such as "the
latest" or "the most complete" weighs.  Whatever the values are aligned to, the value of highest rank wins every column
and is the consensus, so `choose` compares ranks and nothing else: one aggregate in Spark, without alignment and without
the values.  A group with a third of all rows is aggregated in many tasks, and only their best ranks meet.

``additive``: votes decide.  The usable values of a group, as sequences of tokens, are aligned one after another with a
profile (an alignment of most matching columns, by bit-parallel longest common subsequences); a token's votes are the
sum of its values' weights, each column is won by the token, or the gap, with most votes, and the existing value closest
to that consensus survives; ties go to the larger entry.  Parts keep the columns with at least 1 / RARE of their weight,
so a column that more than a half and 1 / RARE of all weight has always wins; the consensus goes back to all values for
the choice.  Rows are parted by group, and partitions that are too large are split whatever groups they hold; a task
reads sorted rows and keeps one profile, never a group.

Defined results: a group without a usable value of a field has no row for it; a null key is a key like any other;
repeated rows are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RARE = 64
# What stands for "no value" when people or models fill in a form; fixed values.
EMPTY_WORDS = ("", "none", "unknown", "not stated", "n/a", "na", "null", "-", "–", "—", "?", "??", "...", "…")
# White space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def usable(text: Column) -> Column:
    """Whether a text says anything."""
    return text.isNotNull() & ~F.lower(_trim(text)).isin(*EMPTY_WORDS)


# ---- alignment ----


def aligned(a: Sequence[set | frozenset], b: Sequence[set | frozenset]) -> list[tuple[int | None, int | None]]:
    """Columns of two sequences in one order, each pair (place in a, place in b), None where a sequence has a gap.  Two
    columns match if they share a token; as many match as can in order."""
    n = len(a)
    where: dict[str, int] = {}
    for i, tokens in enumerate(a):
        for t in tokens:
            where[t] = where.get(t, 0) | 1 << i
    full = (1 << n) - 1
    v, rows = full, []
    for tokens in b:
        m = 0
        for t in tokens:
            m |= where.get(t, 0)
        u = v & m
        v = (v + u | v - u) & full
        rows.append(v)
    out: list[tuple[int | None, int | None]] = []
    i, j = n, len(b)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            if j and not rows[j - 1] >> i - 1 & 1:
                out.append((None, j))
            else:
                i -= 1
                out.append((i, j))
    out += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Tokens to be dropped and added to make one sequence of the other."""
    if a == b:
        return 0
    return sum(i is None or j is None for i, j in aligned([{t} for t in a], [{t} for t in b]))


# ---- the dominant policy by alignment, which tests hold the ranks of `choose` against; no query runs it ----
# A part is (consensus, its rank, closest value, that value's rank and entry).

Part = tuple[list[str], tuple, list[str], tuple]


def as_part(tokens: list[str], rank: tuple) -> Part:
    """A single value; rank ends with the entry."""
    return tokens, rank, tokens, rank


def merged(a: Part, b: Part) -> Part:
    """Two parts as one: profiles aligned, each column voted on, the value kept that is closer to the consensus."""
    (ta, ra, va, ka), (tb, rb, vb, kb) = a, b
    if ta == tb:
        agreed = ta
    else:
        agreed = []
        for i, j in aligned([(t,) for t in ta], [(t,) for t in tb]):
            if j is None:
                if ra >= rb:  # against the gap of the other part; one entry may come twice
                    agreed.append(ta[i])
            elif i is None:
                if rb > ra:
                    agreed.append(tb[j])
            else:
                agreed.append(ta[i])
    far_a, far_b = distance(va, agreed), distance(vb, agreed)
    value, own = (va, ka) if far_a < far_b or far_a == far_b and ka >= kb else (vb, kb)
    return agreed, max(ra, rb), value, own


# ---- the additive policy: a profile is (columns as token -> weight, full weight) ----

Profile = tuple[list[dict[str, float]], float]


def joined(a: Profile, b: Profile) -> Profile:
    """Two profiles as one, rare columns left out."""
    (ca, wa), (cb, wb) = a, b
    total, columns = wa + wb, []
    for i, j in aligned([c.keys() for c in ca], [c.keys() for c in cb]):
        column = dict(ca[i]) if i is not None else {}
        if j is not None:
            for t, w in cb[j].items():
                column[t] = column.get(t, 0.0) + w
        if sum(column.values()) * RARE >= total:
            columns.append(column)
    return columns, total


def consensus(profile: Profile) -> list[str]:
    """The winning token of each column, gaps left out; a token wins a draw with the gap."""
    columns, total = profile
    out = []
    for column in columns:
        token, weight = max(column.items(), key=lambda x: (x[1], x[0]))
        if weight >= total - sum(column.values()):
            out.append(token)
    return out


# ---- both policies over data ----


def _parted(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows sorted by group within tasks; a large group may lie in several."""
    return rows.hint("rebalance", *[F.col(c) for c in group]).sortWithinPartitions(*group)


def _by_group(batches: Iterator[pa.RecordBatch], n: int, add, make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Folds runs of equal keys (the first n columns).  add(state, row) -> state; make(key, state) -> output rows."""
    held, state, out = None, None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            key = row[:n]
            if key != held or state is None:
                if state is not None:
                    out += make(held, state)
                held, state = key, None
            state = add(state, row)
        if len(out) > 5000:
            yield _batch(out, schema)
            out = []
    if state is not None:
        out += make(held, state)
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def choose(values: DataFrame, group: Sequence[str], fields: Sequence[str], rank: Sequence[str] = (), entry: str = "entry") -> DataFrame:
    """(group, records, field, entry): of each group and field the entry whose value survives under the dominant policy.
    records: rows of the group.

    values: the group's columns, `entry`, the columns `rank` (compared in order, null before all), and for each field its
    tokens, ARRAY<STRING> (null or empty: does not compete), and f"{field}_score", compared before `rank`.
    """
    own = [f"k{i}" for i in range(len(group))]
    columns = [F.col(c).alias(k) for c, k in zip(group, own)]
    for i, name in enumerate(fields):
        places = [f"{name}_score", *rank]
        ranked = F.struct(*[F.col(c).alias(f"r{k}") for k, c in enumerate(places)], F.col(entry).cast("bigint").alias("entry"))
        columns.append(F.when(F.size(name) > 0, ranked).alias(f"v{i}"))
    best = values.select(*columns).groupBy(*own).agg(F.count("*").alias("records"), *[F.max(f"v{i}").alias(f"v{i}") for i in range(len(fields))])
    chosen = [F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(name).alias("field"), F.col(f"v{i}.entry").alias("entry"))) for i, name in enumerate(fields)]
    each = best.select(*own, "records", F.explode(F.array_compact(F.array(*chosen))).alias("e"))
    return each.select(*[F.col(k).alias(c) for k, c in zip(own, group)], "records", "e.field", "e.entry")


def choose_by_weight(values: DataFrame, group: Sequence[str], tokens: str = "tokens", weight: str = "weight", entry: str = "entry") -> DataFrame:
    """(group, entry): of each group the entry whose value is closest to the consensus under the additive policy; ties
    go to the larger entry."""
    kinds = [values.schema[c] for c in group]
    n = len(group)
    own = [f"k{i}" for i in range(n)]
    keys = [T.StructField(k, s.dataType) for k, s in zip(own, kinds)]
    packed = T.StructType([*keys, T.StructField("profile", T.BinaryType())])
    agreed = T.StructType([*keys, T.StructField("agreed", T.ArrayType(T.StringType()))])
    chosen = T.StructType([*keys, T.StructField("far", T.IntegerType()), T.StructField("entry", T.LongType())])
    p_arrow, a_arrow, c_arrow = map(to_arrow_schema, (packed, agreed, chosen))

    def single(state, row):
        new = [{t: row[n + 1]} for t in row[n]], row[n + 1]
        return new if state is None else joined(state, new)

    def whole(state, row):
        new = pickle.loads(row[n])
        return new if state is None else joined(state, new)

    def first(batches):
        return _by_group(batches, n, single, lambda k, s: [(*k, pickle.dumps(s))], p_arrow)

    def second(batches):
        return _by_group(batches, n, whole, lambda k, s: [(*k, consensus(s))], a_arrow)

    def pick(batches):
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            if rows:
                yield _batch([(*r[:n], distance(r[n], r[n + 2]), r[n + 1]) for r in rows], c_arrow)

    said = values.where(F.size(tokens) > 0).select(
        *[F.col(c).alias(k) for c, k in zip(group, own)], F.col(tokens).alias("tokens"), F.col(weight).cast("double").alias("weight"), F.col(entry).cast("bigint").alias("entry")
    )
    # Equal values are one, with all their weight.
    single_values = said.groupBy(*own, "tokens").agg(F.sum("weight").alias("weight"), F.max("entry").alias("entry"))
    parts = _parted(single_values.select(*own, "tokens", "weight"), own).mapInArrow(first, packed)
    goals = parts.repartition(*own).sortWithinPartitions(*own).mapInArrow(second, agreed)
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"g.{k}")) for k in own]
    met = single_values.alias("v").join(goals.alias("g"), same).select(*[F.col(f"v.{k}").alias(k) for k in own], "tokens", "entry", "agreed")
    best = F.min_by("entry", F.struct(F.col("far"), (-F.col("entry")).alias("last"))).alias("entry")
    return met.mapInArrow(pick, chosen).groupBy(*own).agg(best).select(*[F.col(k).alias(c) for k, c in zip(own, group)], "entry")


# ---- the fields of a cast's entries ----

FIELDS = ("aliases", "evidence", "notes", "persona")
_NONE = "array<string>"


def cast_values(cast: DataFrame, trust: DataFrame, most_profiles: int = 10_000) -> DataFrame:
    """(book_id, id, entry, at) and, for aliases, evidence, notes and persona, the tokens and the score that the field is
    chosen by.

    A field's tokens are what can be read in it and says something: the distinct aliases; the pieces of evidence
    without their chapter; notes as key=entry; a persona's members, if it is a JSON object, as key=value.  The scores
    are: aliases and keys counted, nothing for evidence, the trust of the profile (a null profile or one without trust
    ranks last).  at: updated_at as it is, so that no time zone changes the order.
    """
    found = trust.select("profile", "trust").limit(most_profiles + 1)
    if found.count() > most_profiles:
        raise ValueError(f"more than {most_profiles} profiles")
    profiles = found.where(F.col("profile").isNotNull()).groupBy("profile").agg(F.max("trust").alias("trust"))
    rows = cast.select("book_id", "id", "entry_id", "aliases", "evidence", "notes", "persona", "profile", "updated_at").join(
        F.broadcast(profiles), "profile", "left"
    )
    told = lambda x: x.isNotNull() & ~F.lower(x).isin(*EMPTY_WORDS)  # noqa: E731  of trimmed texts
    said = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast(_NONE)), _trim), told)
    bare = F.transform("evidence", lambda x: F.regexp_replace(x, r"(?U)^\s*ch\d+:\s*", ""))
    noted = F.filter(
        F.transform(F.array_sort(F.map_keys("notes")), lambda k: F.struct(k.alias("k"), F.array_join(said(F.element_at("notes", k)), "|").alias("v"))),
        lambda e: e["v"] != "",
    )
    read = F.try_variant_get(F.try_parse_json("persona"), "$", "map<string,variant>")
    first = rows.withColumns({"_read": read, "aliases": F.array_distinct(said(F.col("aliases"))), "evidence": said(bare), "_noted": noted})
    members = F.transform(
        F.array_sort(F.map_keys("_read")), lambda k: F.struct(k.alias("k"), _trim(F.try_variant_get(F.element_at("_read", k), "$", "string")).alias("v"))
    )
    kept = F.filter(members, lambda e: told(e["v"]) & ~e["v"].isin("[]", "{}"))
    equal = lambda e: F.concat(e["k"], F.lit("="), e["v"])
    out = first.withColumns({"notes": F.transform("_noted", equal), "persona": F.transform(kept, equal)})
    return out.select(
        "book_id", "id", F.col("entry_id").cast("bigint").alias("entry"), F.col("updated_at").alias("at"), "aliases", "evidence", "notes", "persona",
        F.size("aliases").cast("bigint").alias("aliases_score"), F.lit(0).cast("bigint").alias("evidence_score"),
        F.size(F.coalesce("notes", F.array().cast(_NONE))).cast("bigint").alias("notes_score"), F.coalesce(F.col("trust").cast("bigint"), F.lit(-1)).alias("persona_score"),
    )


def cast_survivors(cast: DataFrame, trust: DataFrame) -> DataFrame:
    """(book_id, id, field, entry_id): of each id with several rows, for each field, the row whose value survives."""
    kept = choose(cast_values(cast, trust), ["book_id", "id"], FIELDS, ["at"])
    return kept.where("records > 1").select("book_id", "id", "field", F.col("entry").alias("entry_id"))


def cast_by_weight(cast: DataFrame, trust: DataFrame) -> DataFrame:
    """(book_id, id, field, entry_id): as `cast_survivors`, but each row's value has one vote, so that what most rows
    say survives, whatever their completeness, time or trust."""
    values = cast_values(cast, trust)
    field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.array().cast(_NONE)).alias("tokens")) for f in FIELDS]))
    each = values.select("book_id", "id", "entry", field.alias("f")).select("book_id", "id", "f.field", "f.tokens", F.lit(1.0).alias("weight"), "entry")
    several = cast.groupBy("book_id", "id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    kept = choose_by_weight(each, ["book_id", "id", "field"])
    same = F.col("k.book_id").eqNullSafe(F.col("s.book_id")) & F.col("k.id").eqNullSafe(F.col("s.id"))
    return kept.alias("k").join(several.alias("s"), same, "left_semi").select("book_id", "id", "field", F.col("entry").alias("entry_id"))


def surviving_records(cast: DataFrame, trust: DataFrame) -> DataFrame:
    """One row for each (book_id, id): aliases, evidence, notes and persona, each from the row that serves it best;
    null where no row has a usable value."""
    kept = choose(cast_values(cast, trust), ["book_id", "id"], FIELDS, ["at"])
    source = cast.select(F.col("entry_id").cast("bigint").alias("entry"), *FIELDS)
    value = kept.join(source.dropDuplicates(["entry"]), "entry")
    ids = cast.groupBy("book_id", "id").agg(F.count("*").alias("rows_merged"))
    picked = value.groupBy("book_id", "id").agg(
        *[F.max_by(F.when(F.col("field") == f, F.col(f)), F.when(F.col("field") == f, 1)).alias(f) for f in FIELDS],
        *[F.max(F.when(F.col("field") == f, F.col("entry"))).alias(f"{f}_entry") for f in FIELDS],
    )
    same = F.col("i.book_id").eqNullSafe(F.col("p.book_id")) & F.col("i.id").eqNullSafe(F.col("p.id"))
    return ids.alias("i").join(picked.alias("p"), same, "left").select(
        "i.book_id", "i.id", "rows_merged", *FIELDS, *[f"{f}_entry" for f in FIELDS]
    )
