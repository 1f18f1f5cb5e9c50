"""Files in and out, providers, resuming, streams."""

import zipfile

from pyspark.sql import functions as F

from folioloom import providers
from folioloom.operators import incremental
from folioloom.sources import epub, files
from folioloom.streaming import scripts

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>The Loft</dc:title>
<dc:creator>A. Writer and B. Other</dc:creator></metadata><manifest><item id="b" href="two.xhtml"/><item id="a" href="one%20x.xhtml"/></manifest>
<spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", OPF)
        z.writestr("O/one x.xhtml", "<html><body><h1>Preface</h1></body></html>")
        z.writestr("O/two.xhtml", "<html><body><h1>Chapter 1</h1><p>Text.</p></body></html>")
    pages = epub.read_epubs(spark, str(tmp_path))
    assert [r["page"] for r in pages.orderBy("pos").collect()] == ["O/one x.xhtml", "O/two.xhtml"]
    about = pages.select(*epub.metadata(F.col("package"))).first()
    assert (about["title"], about["author"], about["language"]) == ("The Loft", "A. Writer", "")
    assert [(r["n"], r["title"], r["text"]) for r in epub.chapters(pages).collect()] == [(1, "Chapter 1", "Chapter 1\n\nText.")]


def test_scripts_and_texts(spark, tmp_path):
    (tmp_path / "001.script.json").write_text('{"segments": [{"id": 0, "para": 0, "kind": "quote", "text": "x", "speaker": "a", "emotion": "calm"}]}')
    (tmp_path / "1001.script.json").write_text('{"segments": []}')
    (tmp_path / "007.txt").write_text("a\n\nb")
    assert [(r["n"], r["speaker"], r["tag_override"]) for r in files.read_scripts(spark, str(tmp_path)).collect()] == [(1, "a", None)]
    assert [(r["n"], r["text"]) for r in files.read_texts(spark, str(tmp_path)).collect()] == [(7, "a\n\nb")]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('profile = "p"\n[llm]\nurl = "u"\nn = 1\n[profiles.p]\nn = 2\n[publish]\na = 1\nb = 2\n')
    (tmp_path / "l.toml").write_text("[publish]\nb = 3\n")
    got = files.load_settings(str(tmp_path / "c.toml"), str(tmp_path / "l.toml"))
    assert got["n"] == 2 and got["url"] == "u" and got["publish"] == {"a": 1, "b": 3}


class Sometimes(providers.Provider):
    def __init__(self):
        self.calls = 0

    def answer(self, prompt, max_tokens):
        self.calls += 1
        if prompt == "bad" or self.calls == 1:
            raise providers.Truncated("cut")
        return prompt.upper()


def test_provider_tries_again(spark):
    df = spark.createDataFrame([(1, "x"), (2, "bad")], "key int, prompt string").coalesce(1)
    got = {r["key"]: (r["raw"], r["attempts"]) for r in providers.ask(df, Sometimes).collect()}
    assert got == {1: ("X", 2), 2: (None, 3)}


def test_resume_and_overwrite(spark, tmp_path):
    work = spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, n int")
    assert [r["book_id"] for r in incremental.not_done(work, work.where("n = 1"), ["book_id"]).collect()] == ["b"]
    path = str(tmp_path / "t")
    incremental.write_parts(work, path)
    incremental.write_parts(spark.createDataFrame([("b", 3)], "book_id string, n int"), path)
    assert sorted((r["book_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    old = spark.createDataFrame([("a", 5), ("b", 1)], "book_id string, modified_at int")
    new = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "book_id string, modified_at int")
    assert sorted(r["book_id"] for r in incremental.stale(old, new, ["book_id"]).collect()) == ["b", "c"]


def test_stream(spark, tmp_path):
    rows = [("b", 1, i, "quote", None, f"2025-01-{1 + i:02d} 00:00:00") for i in range(20)] + [("b", 1, 0, "quote", True, "2025-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "book_id string, n int, id int, kind string, tag_override boolean, at string")
    df.withColumn("loaded_at", F.col("at").cast("timestamp")).drop("at").write.parquet(str(tmp_path / "in"))
    stream = scripts.script_stream(spark, str(tmp_path / "in"))
    scripts.run_to_end(scripts.lines_by_window(stream, late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("quotes")).first()[0] >= 18 and got.agg(F.max("overrides")).first()[0] == 1
