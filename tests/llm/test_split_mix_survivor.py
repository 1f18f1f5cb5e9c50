"""Splitting, mixing and surviving values against brute force."""

import functools
import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.llm import mixing, split, survivor


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n.!?,天。́-", max_size=400), st.integers(5, 60), st.integers(0, 30))
def test_pieces_cover_and_share(text, most, overlap):
    overlap = min(overlap, most - 1)
    if len(text) <= most:
        return
    pieces = split.split_text(text, most, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert s2 == e - overlap and e2 > e
    assert all(0 < e - s <= most for s, e in pieces)


def cost(text, ends, most, overlap):
    penalty = split.cut_penalties(text)
    step = most - overlap
    fewest = -(-(len(text) - overlap) // step)
    even = (len(text) + (fewest - 1) * overlap) / fewest
    total, last = 0.0, None
    for e in ends:
        s = 0 if last is None else last - overlap
        lead = 0.0 if last is None else 4.0 if penalty[s] >= split.NEVER else 0.0 if penalty[s] <= split.WORD + 0.5 else split._START
        total += split._PIECE + lead + split._EVEN * ((e - s - even) / most) ** 2 + (0 if e == len(text) else penalty[e])
        last = e
    return total


def brute_force(text, most, overlap):
    """Cost of the cheapest plan over the boundary positions, by trying them all."""
    at = [int(x) for x in split.boundary_positions(split.cut_penalties(text), overlap, most - overlap)]
    best: dict[int, list] = {0: []}
    for e in at[1:]:
        reach = [p for p in at if p < e and p in best and (e <= most if p == 0 else e - p <= most - overlap)]
        if reach:
            best[e] = min(([*best[p], e] for p in reach), key=lambda plan: partial_cost(text, plan, most, overlap))
    return cost(text, best[len(text)], most, overlap) if len(text) in best else None


def partial_cost(text, ends, most, overlap):
    """As `cost`, and what the next piece has to pay for where it begins; the last cut counts in full."""
    penalty = split.cut_penalties(text)
    s = ends[-1] - overlap
    lead = 4.0 if penalty[s] >= split.NEVER else 0.0 if penalty[s] <= split.WORD + 0.5 else split._START
    return cost(text, ends, most, overlap) + (penalty[ends[-1]] + lead if ends[-1] != len(text) else 0) - (0 if ends[-1] == len(text) else penalty[ends[-1]])


def test_plan_is_the_cheapest():
    random.seed(2)
    for k in range(150):
        text = "".join(random.choice(("ab ,.", "abcdefghij .", "abcdefghijklmnopqrst", "天地。玄")[k % 4]) for _ in range(random.randint(70, 160)))
        most, overlap = random.choice(((20, 0), (30, 6), (24, 10)))
        want = brute_force(text, most, overlap)
        assert want is None or abs(cost(text, split.plan_cuts(text, most, overlap), most, overlap) - want) < 1e-9


def test_limits_of_tables(spark):
    df = spark.createDataFrame([(1, "a" * 9)], "k long, text string")
    kinds = "tbl string, max_chars int, overlap_chars int"
    found = lambda rows: split.split_long(split.limited({"t": (df, "k")}, spark.createDataFrame(rows, kinds)), ["tbl", "row_key"])
    assert found([]).count() == 0 and found([("other", 5, 1), (None, 1, 1)]).count() == 0 and found([("t", 5, 1), ("t", 5, 1)]).count() == 2
    with pytest.raises(ValueError):
        found([("t", 5, 1), ("t", 6, 1)])


def test_split_rows(spark):
    rows = [("t", 1, "a" * 10, 10, 3, "x"), ("t", 2, "a" * 11, 10, 3, "y"), ("t", 3, None, 10, 3, "z"), ("t", 4, "", 10, 3, "z"), ("t", 2, "a" * 11, 10, 99, "w"), ("t", 5, "é́" * 30, 10, 0, None)]
    df = spark.createDataFrame(rows, "tbl string, row_key long, text string, max_chars int, overlap_chars int, piece string")
    got = split.split_long(df, ["tbl", "row_key"]).collect()
    assert {r["row_key"] for r in got} == {2, 5} and all(len(r["piece"]) <= 10 for r in got)
    assert split.split_long(df.limit(0), ["tbl", "row_key"]).count() == 0
    with pytest.raises(ValueError):
        split.plan_cuts("abc", 3, 3)


def documents(spark, n=600, seed=1):
    random.seed(seed)
    rows = [(i, random.choice(["big"] * 8 + ["mid", "mid", "small"]), " ".join(["word"] * random.randint(0, 60)) or None) for i in range(n)]
    rows += [(n, None, "word"), (n + 1, "other", "word"), (n + 2, "big", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_mix_reaches_shares(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(documents(spark), targets)
    rows = mix.records().collect()
    most = {"big": 1, "mid": 2, "small": 4}
    assert all(0 < r["copies"] <= most[r["source"]] for r in rows) and len({r["key"] for r in rows}) == len(rows)
    shares = {r["source"]: r for r in mix.shares().collect()}
    total = sum(r["tokens"] * r["copies"] for r in rows)
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        own = sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
        assert shares[s]["tokens"] == own and abs(own / total - want) < 0.01
        assert abs(own - mix.total * want) <= 31  # within half of the largest record
    again = mixing.mix_sources(documents(spark), targets)
    assert Counter((r["key"], r["copies"]) for r in again.records().collect()) == Counter((r["key"], r["copies"]) for r in rows)


def test_mix_smaller_total_and_missing_source(spark):
    targets = spark.createDataFrame([("big", 0.6, 1), ("none", 0.4, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(documents(spark), targets, total_tokens=1000)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert abs(shares["big"]["tokens"] - 600) <= 31 and shares["none"]["tokens"] == 0 and shares["none"]["reached_share"] == 0
    empty = mixing.mix_sources(documents(spark).limit(0), targets)
    assert empty.records().count() == 0 and {r["tokens"] for r in empty.shares().collect()} == {0}


def test_pareto_cut_is_the_cheapest_ranks(spark):
    """The records taken are those of the smallest ranks, as a sort would take them."""
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(documents(spark), targets, total_tokens=3000)
    taken = {r["key"] for r in mix.records().collect()}
    ranked = sorted((r["pos"], r["key"], r["tokens"]) for r in mix.planned.collect() if r["pos"] is not None)
    assert [k for _, k, _ in ranked[: len(taken)]] == [k for _, k, _ in ranked if k in taken]


def value(tokens, rank, entry, weight=1.0, g="g"):
    return (g, tokens, [float(x) for x in rank], weight, entry)


KINDS = "g string, tokens array<string>, rank array<double>, weight double, entry long"


def _dominant(df):
    ranked = df.withColumns({"tokens_score": F.get("rank", F.lit(0)), "second": F.get("rank", F.lit(1)), "third": F.get("rank", F.lit(2))})
    return survivor.choose(ranked, ["g"], ["tokens"], ["second", "third"])


def test_dominant_follows_the_rule(spark):
    random.seed(6)
    rows, want = [], {}
    for g in range(40):
        for e in range(random.randint(1, 6)):
            tokens = random.sample("abcdefg", random.randint(0, 4))
            rows.append(value(tokens, (len(tokens), random.randint(0, 2), 10 * g + e), 10 * g + e, g=f"g{g}"))
        best = max(((r[2], r[4]) for r in rows if r[0] == f"g{g}" and r[1]), default=None)
        if best:
            want[f"g{g}"] = best[1]
    random.shuffle(rows)
    got = {r["g"]: r["entry"] for r in _dominant(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == want


def test_additive_takes_the_middle(spark):
    rows = [value(list("abc"), (3,), 1), value(list("abd"), (2,), 2), value(list("abe"), (1,), 3), value(list("ab"), (0,), 4), value(list("ab"), (0,), 5)]
    assert survivor.choose_by_weight(spark.createDataFrame(rows, KINDS), ["g"]).first()["entry"] == 5
    heavy = [*rows, value(list("xyz"), (0,), 6, 50.0)]
    assert survivor.choose_by_weight(spark.createDataFrame(heavy, KINDS), ["g"]).first()["entry"] == 6


def test_alignment():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = survivor.aligned([{t} for t in a], [{t} for t in b])
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(i is not None and j is not None for i, j in pairs) == table[-1][-1]
        assert survivor.distance(a, b) == len(a) + len(b) - 2 * table[-1][-1]
    profile = survivor.joined(([{"a": 1.0}, {"b": 1.0}], 1.0), ([{"a": 2.0}, {"c": 2.0}], 2.0))
    assert survivor.consensus(profile) == ["a", "c"]


def test_parts_merge_in_any_order():
    rng = random.Random(9)
    for _ in range(50):
        values = [([rng.choice("abcdef") for _ in range(rng.randint(1, 6))], (rng.randint(0, 3), k)) for k in range(12)]
        best = max(values, key=lambda v: v[1])
        for _ in range(3):
            parts = [survivor.as_part(*v) for v in values]
            while len(parts) > 1:
                rng.shuffle(parts)
                parts = [survivor.merged(parts[0], parts[1]), *parts[2:]]
            agreed, rank, value, own = parts[0]
            assert agreed == value == best[0] and rank == own == best[1]


def test_large_group_of_distinct_values(spark):
    rows = spark.range(50_000).select(
        F.lit("g").alias("g"), F.array(*[F.concat(F.lit(f"t{k}-"), (F.col("id") * 7919 % (1000 * (k + 1))).cast("string")) for k in range(5)]).alias("tokens"),
        F.array(F.col("id").cast("double")).alias("rank"), F.lit(1.0).alias("weight"), F.col("id").alias("entry"),
    )
    began = time.time()
    assert [r["entry"] for r in _dominant(rows).collect()] == [49_999]
    assert time.time() - began < 60
    began = time.time()
    assert survivor.choose_by_weight(rows, ["g"]).count() == 1
    assert time.time() - began < 120


def test_hot_group_and_nulls(spark):
    rows = [value(["t%d" % (i % 50)], (i % 7, i), i, g=None) for i in range(3000)] + [value([], (1,), 1, g="e")]
    got = _dominant(spark.createDataFrame(rows, KINDS)).collect()
    assert [(r["g"], r["entry"]) for r in got] == [(None, max((r[2], r[4]) for r in rows if r[0] is None)[1])]
    assert _dominant(spark.createDataFrame([], KINDS)).count() == 0


CAST = "book_id string, id string, entry_id long, aliases array<string>, evidence array<string>, notes map<string,array<string>>, persona string, profile string, updated_at timestamp_ntz, f string"


def test_cast_fields(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, i) for i in range(1, 5)]
    rows = [
        ("b", "x", 1, ["A", "A", "?"], ["ch1: "], {"gender": ["male"], "age": ["n/a"]}, '{"voice": "low"}', "hand", t[0], None),
        ("b", "x", 2, ["A", "B"], ["ch1: bows"], {"gender": ["male"]}, '{"voice": "lo', "24gb", t[1], None),
        ("b", "x", 3, None, ["none", None], None, '{"voice": null}', "16gb", None, None), ("b", "x", 4, ["A", "B"], [], {}, "[]", None, t[1], None),
        ("b", "y", 5, ["A"], ["x"], {"gender": ["m"]}, '{"a": "b"}', "hand", t[0], None), ("b", "z", 6, [], None, {"gender": []}, "null", "hand", t[0], None), ("b", "z", 7, ["N/A "], [""], None, None, "hand", t[0], None),
    ]
    df = spark.createDataFrame(rows, CAST)
    trust = spark.createDataFrame([("hand", 4), ("24gb", 3), ("16gb", 2), (None, 9)], "profile string, trust int")
    got = {(r["id"], r["field"]): r["entry_id"] for r in survivor.cast_survivors(df, trust).collect()}
    assert got == {("x", "aliases"): 4, ("x", "evidence"): 2, ("x", "notes"): 2, ("x", "persona"): 1}
    whole = {r["id"]: r for r in survivor.surviving_records(df, trust).collect()}
    assert whole["x"]["aliases"] == ["A", "B"] and whole["x"]["persona"] == '{"voice": "low"}' and whole["z"]["aliases"] is None and set(whole) == {"x", "y", "z"}
    assert survivor.cast_survivors(df.limit(0), trust).count() == 0


def test_rank_alone_decides(spark):
    """No alignment runs where it cannot decide, and an entry that comes twice does not lose to an older one."""
    rows = [value(["x", "y"], (0, 9), 5), value(["y", "z"], (0, 9), 5), value(["y"], (0, 1), 4), value(["y"], (0, 9), None)]
    got = _dominant(spark.createDataFrame(rows, KINDS))
    assert [r["entry"] for r in got.collect()] == [5]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "InArrow" not in plan and "Python" not in plan


def test_ranks_choose_as_alignment_would(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(60):
        own = [([rng.choice("abcdef") for _ in range(rng.randint(1, 6))], (float(rng.randint(0, 2)), rng.randint(0, 8) + 10 * g)) for _ in range(rng.randint(1, 8))]
        rows += [(f"g{g}", tokens, [rank[0]], 1.0, rank[1]) for tokens, rank in own]
        want[f"g{g}"] = functools.reduce(survivor.merged, [survivor.as_part(*v) for v in own])[3][1]
    rng.shuffle(rows)
    assert {r["g"]: r["entry"] for r in _dominant(spark.createDataFrame(rows, KINDS)).collect()} == want


def test_odd_cast_as_in_sql(spark):
    """Null keys, entries and times, entries that come twice, and times that a session's zone skips, or has twice."""
    import datetime as dt

    import duckdb

    from folioloom.llm import queries

    rng = random.Random(5)
    times = [None, dt.datetime(2025, 3, 9, 2, 30), dt.datetime(2025, 3, 9, 3, 10), dt.datetime(2025, 11, 2, 1, 30)]
    said = [[None, [], ["A"], ["A", "B"], ["A", None], ["n/a"]], [None, [], ["ch1: x"], ["ch2: "], ["y", "z"], ["z"]]]
    notes, persona = [None, {}, {"gender": ["m"]}, {"gender": ["m"], "age": ["9"]}, {"age": ["?"]}], [None, "{}", '{"a": "b"}', '{"a": null}', "[]", '{"a']
    rows = []
    for e in range(900):
        entry = rng.choice([e, e // 3, None]) if e % 4 == 0 else e
        rows.append((rng.choice([None, "b"]), rng.choice([None, *"abcdefghijkl"]), entry, *map(rng.choice, said), rng.choice(notes), rng.choice(persona), rng.choice([None, "p", "q"]), rng.choice(times), None))
    cast = spark.createDataFrame(rows, CAST)
    trust = spark.createDataFrame([("p", 5), ("q", None), (None, 9)], "profile string, trust int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = Counter(tuple(r) for r in survivor.cast_survivors(cast, trust).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    db = duckdb.connect()
    cast_members, profile_trust = cast.drop("f").toArrow(), trust.toArrow()
    db.register("cast_members", cast_members)
    db.register("profile_trust", profile_trust)
    assert got == Counter(db.execute(queries.ORACLE["p2_found"]).fetchall())
