"""Models asked about casts, voices and sound, by providers that answer by rule."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom import providers
from folioloom.operators import reading, sound, voices
from folioloom.sources import books, files

CAST = "book_id string, id string, ord int, entry_id long, name string, aliases array<string>, epithets array<string>, chapters array<int>, lines int, evidence array<string>, notes map<string,array<string>>, disguises array<string>, persona string"


class Notes(providers.Provider):
    """Tells of whom the chapter names, and checks what it is told of the cast so far."""

    def answer(self, prompt, max_tokens):
        chapter = prompt.split("\nCHAPTER ")[1].split(":\n", 1)[1]
        if chapter.startswith("bad"):
            return "no JSON"
        who, known = chapter.split("/")
        if json.loads(known) != prompt.split("other names):\n")[1].split("\n\n")[0]:
            raise AssertionError(prompt)
        return "<think>{</think>" + json.dumps({"characters": [{"name": who, "speaks": True, "lines": "2"}, "odd", {}], "disguises": [{"id": "orla_brandt", "as": "Heron"}, 5]})


def test_collect_knows_who_came_before(spark):
    rows = [
        ("b", 1, 'Orla Brandt/"(empty)"'), ("b", 2, "bad"), ("b", 3, 'Kerr/"Orla Brandt | "'), ("b", 5, 'Orla Brandt/"Orla Brandt | \\nKerr | "'), ("c", 1, 'Kerr/"(empty)"'), ("c", 2, None),
    ]
    df = spark.createDataFrame(rows, "book_id string, n int, text string")
    got = reading.collect(df, Notes).orderBy("book_id", "n")
    assert [(r["n"], r["known"], r["delta"] is None, r["attempts"]) for r in got.collect()] == [(1, 0, False, 1), (2, 1, True, 3), (3, 1, False, 1), (5, 2, False, 1), (1, 0, False, 1), (2, 1, True, 0)]
    cast = {(r["book_id"], r["id"]): r for r in reading.cast_of(got).collect()}
    assert cast["b", "orla_brandt"]["chapters"] == [1, 5] and cast["b", "orla_brandt"]["disguises"] == ["Heron"] and ("c", "kerr") in cast
    # A run again asks for what is missing only.
    again = reading.collect(df.where("n != 2"), providers.Provider, got.where("delta IS NOT NULL"))
    assert again.where("attempts > 0").count() == 0 and again.count() == 4


class Says(providers.Provider):
    def __init__(self, text):
        self.text = text

    def answer(self, prompt, max_tokens):
        return self.text


def test_merges_are_suggested_only(spark):
    rows = [("b", "a", 1, 1, "Ann", ["A."], [], [1, 2, 3, 4], 1, ["x" * 99], {}, [], None), ("b", "b", 2, 2, None, None, [], [1], 1, None, {}, [], None)]
    cast = spark.createDataFrame(rows, CAST)
    prompt = reading.merge_prompts(cast).first()["prompt"]
    assert "a | Ann | A. | [1, 2, 3] | " + "x" * 80 + "\nb |  |  | [1] | \n" in prompt
    got = reading.suggested_merges(cast, lambda: Says('{"merges": [{"keep": "a", "drop": ["b", "c"]}, {"keep": 1}, "odd"]}')).collect()
    assert sorted((r["keep"], r["drop"]) for r in got if r["keep"] == "a") == [("a", "b"), ("a", "c")]
    assert reading.suggested_merges(cast, lambda: Says("none")).count() == 0


def test_personas(spark):
    rows = [
        ("b", "a", 1, 1, "Ann", [], [], [3], 4, ["e"] * 50, {"gender": ["female", "f"]}, [], None), ("b", "b", 2, 2, "Bo", ["B"], [], [1, 2], 4, [], {}, ["Heron"], None),
        ("b", "c", 3, 3, "Cy", [], [], [1], 1, [], {}, [], "{}"), ("b", "d", 4, 4, "Di", [], [], [], 0, [], {}, [], None),
    ]
    cast, about = spark.createDataFrame(rows, CAST), spark.createDataFrame([("b", "A Book")], "book_id string, title string")
    asked = {r["id"]: (r["place"], r["prompt"]) for r in reading.brief_prompts(cast, about).collect()}
    assert {k: v[0] for k, v in asked.items()} == {"b": 1, "a": 2}
    assert asked["a"][1].count("\ne") == reading.BRIEF_EVIDENCE and "gender female/f; age ?" in asked["a"][1] and "“" not in asked["a"][1] and '"A Book"' in asked["a"][1]
    assert "also called B;" in asked["b"][1] and "Disguises: Heron." in asked["b"][1] and "(no evidence)" in asked["b"][1]
    done = {r["id"]: r["persona"] for r in reading.personas(cast, about, lambda: Says('Well: {"tier": "lead"}')).collect()}
    assert done == {"a": '{"tier": "lead"}', "b": '{"tier": "lead"}'}
    assert [r["error"] is None for r in reading.personas(cast, about, lambda: Says("x")).collect()] == [False, False]


def test_designed_answers():
    assert json.loads(voices.designed('{"instruct": "low", "why": "w"}')) == {"instruct": "low", "why": "w"}
    assert json.loads(voices.designed('{"instruct": "a \\"low\\" voice", "why": "as "he" says"}'))["instruct"] == 'a "low" voice'
    for bad in ("", "{}", '{"instruct": ""}', '{"instruct": 5}', '{"instruct": "never ends'):
        with pytest.raises(ValueError):
            voices.designed(bad)


def test_voices_held_and_failed(spark):
    """StubDesigner fails for names whose length is a multiple of three, and breaks its JSON off for the next length."""
    members = [("good", "Tobi"), ("bad", "Ann"), ("held", "Ida"), ("small", "Lo"), ("mapped", "Vi")]
    cast = spark.createDataFrame([("b", i, k, k, n, [], [], [1], 1, [], {"gender": ["female"]}, [], None) for k, (i, n) in enumerate(members)], CAST)
    said = [("good", 6), ("bad", 7), ("held", 5), ("small", 2), ("mapped", 1), ("stranger", 9)]
    rows = [("b", 1, k * 100 + j, 0, "quote", f"{i} says a thing {j}.", i) for k, (i, n) in enumerate(said) for j in range(n)]
    script = spark.createDataFrame(rows, "book_id string, n int, id int, para int, kind string, text string, speaker string")
    about = spark.createDataFrame([("b", "A Book")], "book_id string, title string")
    held = spark.createDataFrame([("b", "held", "soft", "", "line")], "book_id string, id string, instruct string, why string, line string")
    held_map = spark.createDataFrame([("b", "mapped", "extra_male_3"), ("b", "bad", "bad")], "book_id string, speaker string, voice string")
    made, mapped = voices.assigned_voices(script, cast, about, providers.StubDesigner, held, held_map)
    assert {r["speaker"]: r["voice"] for r in mapped.collect()} == {
        "good": "good", "held": "held", "mapped": "extra_male_3", "bad": "extra_female_1", "small": "extra_female_2",
    }
    got = {r["id"]: r["instruct"] for r in made.collect()}
    assert sorted(got) == ["extra_female_1", "extra_female_2", "extra_male_3", "good", "held", "narrator"]
    assert got["good"] == "The voice of Tobi" and got["held"] == "soft"


def test_chapters_are_read_aloud(spark):
    script = spark.createDataFrame(
        [("b", 1, 0, 0, "narration", "It rained. " * 60, "narrator"), ("b", 1, 1, 0, "quote", "So it did.", "a"), ("b", 1, 2, 1, "quote", " ", "a"), ("b", 2, 0, 0, "quote", "Yes.", "x")],
        "book_id string, n int, id int, para int, kind string, text string, speaker string",
    )
    vs = spark.createDataFrame([("b", "narrator", "warm", "", "I tell."), ("b", "a", "low", "", "I speak.")], "book_id string, id string, instruct string, why string, line string")
    clips = sound.design_clips(vs)
    assert clips.count() == 2 and sound.design_clips(vs, held=clips.where("id = 'a'")).count() == 1
    assert sorted(r["n"] for r in sound.chapters_to_render(script, script.where("n = 1")).collect()) == [2]
    assert [r["n"] for r in sound.chapters_to_render(script, script, [1]).collect()] == [1]
    voice_map = spark.createDataFrame([("b", "a", "a"), ("b", "x", "gone")], "book_id string, speaker string, voice string")
    plan = sound.reading_plan(script, voice_map, vs)
    got = {r["n"]: r for r in sound.render(plan, clips, vs).collect()}
    assert set(got) == {1, 2} and max(map(abs, got[1]["samples"])) < 1 and got[1]["rate"] == 1000
    assert {r["voice"] for r in plan.where("n = 2").collect()} == {"narrator"}
    # Silence between pieces: 0.25 s within the paragraph and 0.4 s where the voice changes.
    a = np.asarray(got[1]["samples"])
    runs = np.diff(np.flatnonzero(np.concatenate([[1], np.abs(a) > 1e-9, [1]])))
    assert (runs >= 400).sum() == 1 and (runs >= 250).sum() == 2


def test_references():
    class Looped(sound.Hum):
        kind = "looped"

    class Coded(sound.Hum):
        kind = "coded"

        def encode(self, clip):
            return "codes"

    clip = np.arange(100, dtype=np.float32)
    assert len(sound.reference(Looped(), clip)) == 6000 and sound.reference(Coded(), clip) == "codes" and len(sound.reference(sound.Hum(), clip)) == 100
    assert len(sound.reference(Looped(), np.zeros(0))) == 0
    with pytest.raises(RuntimeError):
        sound.whole(iter(()))
    assert sound.from_settings({}) is sound.Hum
    with pytest.raises(ValueError):
        sound.from_settings({"tts": "x"}, {})


def test_names_are_heard(spark):
    class Deaf(sound.Listener):
        def heard(self, samples, rate, said):
            return "nothing"

    df = spark.createDataFrame([("b", "Zoé", ["ZOH-ay", "Zoe"])], "book_id string, name string, variants array<string>")
    assert [(r["option"], r["recognised"]) for r in sound.score_names(df).orderBy("option").collect()] == [(1, False), (2, True)]
    assert not any(r["recognised"] for r in sound.score_names(df, listen=Deaf).collect())


def test_providers_by_settings(tmp_path):
    assert providers.from_settings({}) is providers.StubProvider
    made = providers.from_settings({"llm_backend": "server", "llm_base_url": "http://h/v1/", "llm_model": "m", "api_key": "k", "temperature": 0.2})()
    assert (made.url, made.model, made.api_key, made.extra) == ("http://h/v1/chat/completions", "m", "k", {"temperature": 0.2})
    loads = []
    local = providers.from_settings({"llm_backend": "local", "llm_model": "m"}, lambda m: loads.append(m) or (lambda p, n, r: (p.upper(), 3)))()
    assert local.answer("a", 100) == "A" and local.answer("b", 100) == "B" and loads == ["m"]
    with pytest.raises(providers.Truncated):
        local.answer("a", 8)
    local.free()
    assert local.answer("a", 100) == "A" and loads == ["m", "m"]
    for bad in ({"llm_backend": "x"}, {"llm_backend": "local", "llm_model": "m"}):
        with pytest.raises(ValueError):
            providers.from_settings(bad)


def test_a_server_is_asked(monkeypatch):
    import io
    import urllib.error

    seen, waits = [], []

    def opened(request, timeout):
        seen.append((request.get_header("Authorization"), json.loads(request.data)["max_tokens"]))
        if len(seen) < 3:
            raise urllib.error.HTTPError("u", 507, "full", {}, None)
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "yes"}}], "usage": {"completion_tokens": 9}}).encode())

    monkeypatch.setattr(providers.urllib.request, "urlopen", opened)
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    server = providers.ServerProvider("u://x", "m", "key")
    assert server.answer("p", 50) == "yes" and seen == [("Bearer key", 50)] * 3 and waits == [30.0, 60.0]
    with pytest.raises(providers.Truncated):
        server.answer("p", 14)


def test_settings_layers(tmp_path):
    assert files.overlaid({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 4}, "d": {"e": 5}}, {"f": {}}) == {"a": {"b": 4, "c": 2}, "d": {"e": 5}, "f": {}}
    assert files.overlaid({"a": {"b": 1}}, {"a": 2}) == {"a": 2} and files.overlaid({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}}
    (tmp_path / "k").write_text(" secret\n")
    (tmp_path / "c.toml").write_text(f'profile = "p"\n[profiles.p]\napi_key_file = "{tmp_path}/k"\n')
    assert files.load_settings(str(tmp_path / "c.toml"))["api_key"] == "secret"
    with pytest.raises(KeyError):
        files.load_settings(str(tmp_path / "c.toml"), profile="none")


def test_books_out(spark, tmp_path):
    assert books.codec_arguments("mp3", "64k") == ["-b:a", "64k", "-ac", "1", "-c:a", "libmp3lame"]
    with pytest.raises(ValueError):
        books.codec_arguments("ogg")
    books.write_wav(tmp_path / "a.wav", np.sin(np.arange(100)), 8000)
    samples, rate = books.read_wav(tmp_path / "a.wav")
    assert rate == 8000 and np.allclose(samples, np.sin(np.arange(100)), atol=1e-4)
    ran = []
    assert books.encode_chapter(str(tmp_path / "a.wav"), str(tmp_path / "a.m4a"), "m4a", {"title": "T"}, run=ran.append)
    assert ran[0][-3:] == ["-metadata", "title=T", str(tmp_path / "a.m4a")] and "-i" in ran[0]
    (tmp_path / "b.m4a").write_text("x")
    import os

    os.utime(tmp_path / "a.wav", (1, 1))
    assert not books.encode_chapter(str(tmp_path / "a.wav"), str(tmp_path / "b.m4a"), "m4a", {}, run=ran.append)
    books.encode_book("file 'x'\n", ";FFMETADATA1\n", "o.m4b", {}, run=ran.append)
    assert ran[1][-1] == "o.m4b" and "concat" in ran[1]
    parts = spark.createDataFrame([("b", 2, "/x/it's.wav"), ("b", 1, "/x/1.wav")], "book_id string, n int, path string")
    assert books.concat_listing(parts).first()["listing"] == "file '/x/1.wav'\nfile '/x/it'\\''s.wav'\n"
    assert books.publish(str(tmp_path), "", "A", "B") is None
    books.write_book(str(tmp_path / "book"), [("x/list.m3u8", "#EXTM3U\n")])
    where = books.publish(str(tmp_path / "book"), str(tmp_path / "out"), "A", "B (Full Cast)")
    assert open(f"{where}/x/list.m3u8").read() == "#EXTM3U\n"
    pipes = []
    books.publish("f", "host:/lib", "A", "B (Full Cast, o'k)", lambda a, b: pipes.append((a, b)))
    quoted = "'/lib/A/B (Full Cast, o'\"'\"'k)'"
    assert pipes == [(["tar", "-C", "f", "-cf", "-", "."], ["ssh", "host", f"mkdir -p {quoted} && tar -C {quoted} -xf -"])]
    settings = {"llm_backend": "local", "llm_model": "l", "tts_model": "t"}
    assert books.models_of(settings) == ["l", "t"] and books.fetch(settings, str.upper) == {"l": "L", "t": "T"}


def test_functions_for_sql(spark):
    from folioloom.functions import arrow

    arrow.register(spark)
    r = spark.sql("SELECT slug('Zoé Ås') AS s, fold('Zoé-Ås 2') AS f, slug('渡瀬') AS t, slug(NULL) AS n").first()
    assert tuple(r) == ("zoe_as", "zoeas ", "someone", None)
    assert spark.range(0).select(F.lit(1)).count() == 0
