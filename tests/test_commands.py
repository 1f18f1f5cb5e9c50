"""All stages over a small book, then parts of them again."""

import json
import zipfile

import pytest

from folioloom import providers
from folioloom.__main__ import main

from .test_sources import OPF


class Everything(providers.Provider):
    """Answers each kind of prompt by rule."""

    def answer(self, prompt, max_tokens):
        if prompt.startswith("Note who speaks"):
            return json.dumps({"characters": [{"name": "Tobias Kerr", "speaks": True, "lines": "6", "gender": "male"}]})
        if prompt.startswith("The people of a book"):
            return '{"merges": []}'
        if prompt.startswith("Write the casting brief"):
            return '{"gender": "male"}'
        if prompt.startswith("Describe the voice"):
            return '{"instruct": "A calm man."}'
        return providers.StubProvider().answer(prompt, max_tokens)


def test_from_epub_to_sound(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "loft.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", OPF)
        z.writestr("O/one x.xhtml", "<html><body><h1>Preface</h1></body></html>")
        z.writestr("O/two.xhtml", "<html><body><h1>Chapter 1</h1><p>" + "“Yes,” said Kerr. " * 6 + "</p></body></html>")
    folder = str(tmp_path / "shelf")
    (tmp_path / "shelf").mkdir()
    main(["run", folder, "--epubs", str(tmp_path / "in")], spark, Everything)
    state = json.loads((tmp_path / "shelf" / "manifest.json").read_text())
    assert all(state[s]["done"] for s in ("extract", "cast", "attribute", "voices", "design", "render", "encode", "publish"))
    read = lambda t: spark.read.parquet(f"{folder}/{t}").collect()
    assert [r["id"] for r in read("cast")] == ["tobias_kerr"] and read("briefs")[0]["persona"] == '{"gender": "male"}'
    assert {(r["kind"], r["speaker"]) for r in read("script")} == {("quote", "tobias_kerr"), ("narration", "narrator")}
    assert {(r["speaker"], r["voice"]) for r in read("voice_map")} == {("tobias_kerr", "tobias_kerr")} and len(read("clips")) == 2
    assert len(read("sound")) == 1 and (tmp_path / "shelf" / "books" / "loft" / "001.wav").exists()
    assert "The Loft (Full Cast)" in read("playlists")[0]["playlist"]
    # Again: nothing is done twice; a chapter that is asked for is.
    main(["run", folder, "--epubs", "nowhere"], spark, lambda: None)
    main(["attribute", folder, "--chapters", "1"], spark, Everything)
    assert len(read("script")) == len({(r["n"], r["id"]) for r in read("script")})
    (tmp_path / "o.json").write_text('{"loft": {"Kerr": ["KUR", "Kerr"]}}')
    main(["names", folder, str(tmp_path / "o.json")], spark, Everything)
    assert sorted(r["recognised"] for r in read("name_report")) == [False, True]
    spark.read.parquet(f"{folder}/script").where("kind = 'quote'").selectExpr("book_id", "n", "id", "speaker AS gold").write.parquet(str(tmp_path / "gold"))
    main(["score", folder, str(tmp_path / "gold"), "rule"], spark, Everything)
    assert [(r["profile"], r["quotes"], r["with_tag_override"]) for r in read("scores")] == [("rule", 6, 6)]


def test_bad_commands():
    with pytest.raises(SystemExit):
        main(["run"])
    with pytest.raises(SystemExit):
        main(["dance", "x"])
    with pytest.raises(SystemExit):
        main(["fetch"])
