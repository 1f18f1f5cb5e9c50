"""Very long texts, repeated rows, hot groups and columns of clashing names, for every operator."""

from pyspark.sql import functions as F

from folioloom.llm import equal_looking, mixing, mojibake, names, sentences, split, survivor, tokenize

LONG = "The bell rang. Nobody came, and the tide settled — “Go,” said Zoé.\n\n" * 6000


def test_long_texts(spark):
    df = spark.createDataFrame([(1, LONG), (2, "x" * 300_000)], "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in sentences.sentences(df, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 12000, 2: 1}
    ids = {r["doc_id"]: r["ids"] for r in tokenize.encode_documents(df).collect()}
    bpe = tokenize.load(tokenize.vocabulary_path())
    assert all(bpe.decode(ids[k]) == t for k, t in ((1, LONG), (2, "x" * 300_000)))
    limits = df.withColumns({"max_chars": F.lit(2400), "overlap_chars": F.lit(200)})
    pieces = split.split_long(limits, ["doc_id"]).orderBy("doc_id", "piece_no").collect()
    for k, t in ((1, LONG), (2, "x" * 300_000)):
        own = [r for r in pieces if r["doc_id"] == k]
        assert own[0]["piece"] + "".join(r["piece"][200:] for r in own[1:]) == t and all(len(r["piece"]) <= 2400 for r in own)
    garbled = LONG.encode().decode("latin_1")
    found = mojibake.find_garbled(spark.createDataFrame([(1, LONG), (2, garbled)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["restored"]) for r in found] == [(2, LONG)]
    values = spark.createDataFrame([(1, "en", LONG), (2, "en", LONG.replace("Zoé", "Zoе́"))], "k int, lang string, value string")
    assert [r["k"] for r in equal_looking.with_canonical(values, ["k"]).collect()] == [2]


def test_hot_key(spark):
    """A third of all rows under one key, and one value a third of all."""
    rows = [("hot", "id", i, f"Thomas Wexmont{'s' * (i % 2)}") for i in range(3000)] + [(f"b{i}", f"i{i}", 5000 + i, f"Anna Number{i}") for i in range(600)]
    cast = spark.createDataFrame(rows, "book_id string, id string, entry_id long, name string").withColumns(
        {"aliases": F.array(F.lit("Tom")), "notes": F.expr("map('gender', array('male'))")}
    )
    assert names.same_person_pairs(cast).count() == 0
    assert names.same_persons(cast).count() == 601
    values = spark.createDataFrame([(i, "en", "Nо.") for i in range(2000)] + [(9000 + i, "en", f"v{i}") for i in range(500)], "k long, lang string, value string")
    assert equal_looking.with_canonical(values, ["k"]).count() == 2000


def test_clashing_columns(spark):
    odd = {c: F.lit("x") for c in ("n", "id", "key", "ids", "tokens", "class", "pos", "block", "rank", "chance", "restored", "start_pos", "k0", "paras", "e")}
    docs = spark.createDataFrame([(i, "a b c " * i, "s") for i in range(20)], "doc_id long, text string, source string").withColumns(odd)
    assert tokenize.encode_documents(docs).count() == 20
    assert sentences.sentences(docs.withColumn("text", F.lit("Yes. No.")), ["doc_id"]).count() == 40
    assert mojibake.find_garbled(docs).count() == 0
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert {r["copies"] for r in mixing.mix_sources(docs, targets).records().collect()} == {2}
    values = spark.createDataFrame([("a", ["t"], 1.0, 1.0, 7)], "k0 string, t0 array<string>, t0_score double, r0_0 double, entry long")
    assert survivor.choose(values, ["k0"], ["t0"], ["r0_0"]).first()["entry"] == 7
