"""The core's queries over the test tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom import providers
from folioloom.functions import text as tx
from folioloom.functions.arrow import ascii_fold, html_text
from folioloom.operators import attribution, audio, casting, incremental, reading, roster, scoring, segmentation, sound, timeline, voices
from folioloom.plans import sql
from folioloom.plans.headings import HEADINGS
from folioloom.session import spread, table
from folioloom.sources import books as shelf
from folioloom.sources import epub

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = dict(sql.ORACLE)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- inputs that several queries share ----


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters")


def _script(spark: SparkSession, d: str) -> DataFrame:
    return attribution.current_script(table(spark, d, "script_segments"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The current script without segments of null text."""
    return _script(spark, d).where("text IS NOT NULL")


def _cast(spark: SparkSession, d: str) -> DataFrame:
    return roster.current_cast(table(spark, d, "cast_members"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books")
    return b.groupBy("book_id").agg(F.max_by(F.struct("title", "author", "language"), F.struct("loaded_at", "title", "author")).alias("b")).select("book_id", "b.*")


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for rendered sound: 15 characters a second, chapters that are read."""
    chars = F.sum(F.char_length("text")).cast("bigint")
    return _texts(spark, d).groupBy("book_id", "n").agg((F.floor(chars * 1000 / 15)).cast("bigint").alias("ms"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters")
    return c.groupBy("book_id", "n").agg(F.max_by("title", F.struct("loaded_at", "chapter_id")).alias("title"))


# ---- extraction ----


@query
def html_to_text(spark, d):
    """Pages made of the chapters, read back as text."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h2>Chapter  "), F.col("n").cast("string"), F.lit("</h2><script>var p='</p>'</script>"), body, F.lit("</body></html>"))
    pages = spread(_chapters(spark, d).where("text IS NOT NULL").select("chapter_id", page.alias("html")))
    read = pages.select("chapter_id", html_text(F.col("html")).alias("r"))
    return read.select("chapter_id", "r.heading", F.md5("r.text").alias("text_md5"), F.char_length("r.text").alias("chars"))


@query
def chapter_filter(spark, d):
    """Pages with a chapter's heading, in any of the nine languages, numbered anew in the order of their book."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = escaped(F.regexp_extract("text", r"^[^\n]*", 0))
    page = F.concat(F.lit("<html><body><h2>"), first, F.lit("</h2><p>"), escaped(F.substring("text", 1, 50)), F.lit("</p></body></html>"))
    pages = _chapters(spark, d).where("text IS NOT NULL").select("book_id", F.struct("n", "chapter_id").alias("pos"), page.alias("html"))
    # The operator keeps the heading and numbers the pages; n and chapter_id tell which page it was.
    read = epub.chapters(pages, "book_id", HEADINGS, ["pos"])
    return read.select(F.col("pos.chapter_id").alias("chapter_id"), "book_id", F.col("n").alias("number"), F.col("title").alias("heading"))


@query
def chapter_index(spark, d):
    return segmentation.chapter_index(_chapters(spark, d), ["chapter_id"])


@query
def spine_join(spark, d):
    """Reading order of pages, over a manifest made of the chapters."""
    c = _chapters(spark, d).select("book_id", "n", F.concat(F.lit("item"), "chapter_id").alias("item"))
    manifest = c.select("book_id", "item", F.concat(F.lit("OEBPS/"), "item", F.lit(".xhtml")).alias("href"))
    return epub.spine(manifest, c.select("book_id", F.col("n").alias("pos"), "item"))


@query
def book_metadata(spark, d):
    """Title, author and language read from package documents made of the books."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[<>&]", " ")
    dc = F.concat(
        F.lit('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>'), clean("title"), F.lit("</dc:title><dc:creator>"),
        clean("author"), F.lit(" and Others</dc:creator><dc:language>"), clean("language"), F.lit("</dc:language></metadata></package>"),
    )
    return table(spark, d, "books").select("book_id", "loaded_at", *epub.metadata(dc))


# ---- segmentation and batches ----


@query
def segments(spark, d):
    """Narration and quotations of all chapters."""
    return segmentation.segments(_chapters(spark, d), ["chapter_id"])


@query
def segment_counts(spark, d):
    s = segmentation.segments(_chapters(spark, d), ["chapter_id"])
    return s.groupBy("chapter_id", "kind").agg(F.count("*").alias("segments"), F.sum(F.char_length("text")).alias("chars"))


@query
def batches(spark, d):
    return segmentation.batches(_script(spark, d), ["book_id", "n"], 12).select("book_id", "n", "id", "batch")


@query
def batch_bounds(spark, d):
    return segmentation.batch_bounds(segmentation.batches(_script(spark, d), ["book_id", "n"], 12), ["book_id", "n"])


@query
def batch_prompts(spark, d):
    made = segmentation.batch_prompts(segmentation.batches(_texts(spark, d), ["book_id", "n"], 12), ["book_id", "n"])
    return made.select("book_id", "n", "batch", F.md5("earlier").alias("earlier_md5"), F.md5("body").alias("body_md5"))


@query
def label_prompts(spark, d):
    """What a model is asked: the cast, the text before the batch, the batch; only of chapters with quotations."""
    made = attribution.label_prompts(_texts(spark, d), _cast(spark, d), ["book_id", "n"])
    body = F.regexp_extract("prompt", r"(?s)CHARACTERS, one a line as id \| name \| other names:\n(.*)", 1)
    return made.select("book_id", "n", "batch", F.md5(body).alias("prompt_md5"))


@query
def label_batches(spark, d):
    """Labels of the default provider, by number; 120 quotations a batch."""
    prompts = attribution.label_prompts(_texts(spark, d), _cast(spark, d), ["book_id", "n"])
    answers = providers.ask(prompts, keys=["book_id", "n", "batch"], accept=providers.any_object)
    return attribution.labels_of(answers, ["book_id", "n"])


# ---- the cast ----


@query
def current_cast(spark, d):
    return _cast(spark, d).select("book_id", "id", "entry_id", "name", "lines")


@query
def proper_alias(spark, d):
    """Which names and aliases are proper ones."""
    c = table(spark, d, "cast_members")
    said = c.select("entry_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("said"))
    return said.where("said IS NOT NULL").select("entry_id", "said", tx.proper_alias(F.col("said")).alias("proper")).distinct()


@query
def name_genders(spark, d):
    c = table(spark, d, "cast_members")
    return c.select("entry_id", tx.title_gender(F.col("name")).alias("by_title"), tx.gender(F.col("name"), F.col("notes")).alias("gender"))


@query
def slugs(spark, d):
    """Ids and folded forms of names; letters outside ASCII are decomposed or dropped."""
    c = spread(table(spark, d, "cast_members").where("name IS NOT NULL").select("entry_id", "name"))
    folded = c.withColumn("ascii", ascii_fold(F.col("name")))
    return folded.select("entry_id", tx.slug(F.col("ascii")).alias("slug"), tx.fold(F.col("ascii")).alias("folded"))


@query
def name_index(spark, d):
    return roster.name_index(_cast(spark, d))


@query
def cast_summary(spark, d):
    return roster.cast_summary(_cast(spark, d))


@query
def first_names_once(spark, d):
    return roster.first_names_once(_cast(spark, d))


@query
def shares_name(spark, d):
    """Whether each alias fits the character that it is filed under, by the name and the other aliases."""
    c = _cast(spark, d).where("name IS NOT NULL")
    pairs = c.select("book_id", "id", "name", "notes", F.col("aliases").alias("all"), F.explode("aliases").alias("alias")).where("alias IS NOT NULL")
    others = pairs.withColumn("aliases", F.filter("all", lambda a: a.isNotNull() & (a != F.col("alias"))))
    return roster.shares_name(others).select("book_id", "id", "alias", "shares_name").distinct()


@query
def cast_listing(spark, d):
    """The cast of every book as prompts show it; books without a cast too."""
    c = _cast(spark, d).where("ord % 5 != 0")
    return roster.cast_listing(c.where(F.col("book_id").substr(-1, 1) != "7"), table(spark, d, "books"))


@query
def merge_prompts(spark, d):
    """The lines on people that a model is shown to find those noted twice."""
    c = _cast(spark, d).where(F.size("chapters") > 0)
    return reading.person_lines(c).select("book_id", "id", "line")


@query
def brief_prompts(spark, d):
    """What casting briefs are asked with, for speaking characters without one, those of most chapters first."""
    made = reading.brief_prompts(_cast(spark, d), _books(spark, d))
    body = F.regexp_extract("prompt", r"(?s)throughout\.\n\n(.*)\n\nAnswer", 1)
    return made.select("book_id", "id", "place", F.md5(body).alias("body_md5"))


@query
def collect_notes(spark, d):
    """Chapters noted one after another, each with the cast so far; how many were known, and what each book has at last."""
    c = _chapters(spark, d).groupBy("book_id", "n").agg(F.max_by("text", F.struct("loaded_at", "chapter_id")).alias("text"))
    return reading.collect(c, providers.StubNoter).select("book_id", "n", "known", "attempts")


@query
def collected_cast(spark, d):
    """The cast that those notes give."""
    c = _chapters(spark, d).groupBy("book_id", "n").agg(F.max_by("text", F.struct("loaded_at", "chapter_id")).alias("text"))
    cast = reading.cast_of(reading.collect(c, providers.StubNoter))
    return cast.select("book_id", "id", "name", F.size("chapters").alias("chapters"), F.col("lines").cast("bigint").alias("lines"))


@query
def dedupe_pairs(spark, d):
    return roster.dedupe_pairs(_cast(spark, d))


@query
def cast_ranked(spark, d):
    return roster.ranked_cast(_cast(spark, d))


@query
def cast_totals(spark, d):
    c = _cast(spark, d)
    return c.groupBy("book_id").agg(F.count("*").alias("characters"), F.count_if(F.size("chapters") > 0).alias("speaking"))


@query
def cast_notes(spark, d):
    """What all saved rows of a character say, each once."""
    c = table(spark, d, "cast_members").select("book_id", "id", F.explode("notes").alias("note", "said"))
    each = c.select("book_id", "id", "note", F.explode("said").alias("value")).where("value IS NOT NULL AND trim(value) != ''")
    return each.groupBy("book_id", "id", "note").agg(F.array_sort(F.collect_set("value")).alias("values"))


@query
def dedupe_fold(spark, d):
    """Casts after the merges that names tell."""
    c = _cast(spark, d)
    return casting.merge_cast(c, roster.dedupe_pairs(c))


@query
def cast_merge(spark, d):
    """Casts folded from chapters' notes, made of what was saved of each character by chapter."""
    c = table(spark, d, "cast_members").where("name IS NOT NULL")
    first = lambda k: F.get(F.filter(F.coalesce(F.try_element_at("notes", F.lit(k)), F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lit(0))
    notes = c.select(
        "book_id", F.explode("chapters").alias("n"), F.col("entry_id").alias("ord"), "name", F.col("aliases").alias("new_aliases"), F.lit(True).alias("speaks"),
        F.lit("1 line").alias("lines"), *[first(k).alias(k) for k in casting.NOTES], "evidence", F.lit(None).cast("string").alias("disguise_of"), F.lit(None).cast("string").alias("disguise_as"),
    )
    return casting.merge_notes(notes.unionByName(_disguises(c)))


def _disguises(cast):
    """What the saved disguises tell, after the last chapter."""
    told = cast.select("book_id", F.lit(100_000).alias("n"), F.col("entry_id").alias("ord"), F.col("name").alias("disguise_of"), F.explode("disguises").alias("disguise_as"))
    none = {k: F.lit(None).cast("string") for k in ("name", "lines", *casting.NOTES)}
    empty = {k: F.lit(None).cast("array<string>") for k in ("new_aliases", "evidence")}
    return told.where("disguise_as IS NOT NULL").withColumns({**none, **empty, "speaks": F.lit(False)})


# ---- attribution ----


@query
def tag_names(spark, d):
    """Names in dialogue tags that begin narration."""
    n = _texts(spark, d).where("kind = 'narration'").select("book_id", "n", "id", tx.tag_name(F.col("text")).alias("name"))
    return n.where("name != ''")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """The current script as the dialogue tags have it; texts are read for their tags and go no further."""
    lean = attribution.with_tag(table(spark, d, "script_segments")).drop("emotion", "labelled_at")
    return attribution.tag_override(attribution.current_script(lean), roster.name_index(_cast(spark, d)))


@query
def tag_override(spark, d):
    done = _tagged(spark, d)
    return done.where("overridden_now").select("book_id", "n", "id", "speaker")


@query
def checked_speakers(spark, d):
    done = attribution.checked_speakers(_script(spark, d), _cast(spark, d))
    return done.select("book_id", "n", "id", "speaker")


@query
def attribution_stats(spark, d):
    done = _tagged(spark, d)
    return attribution.chapter_stats(done, ["book_id", "n"])


@query
def speaker_quotes(spark, d):
    """Flagship: quotations by speaker after the dialogue tags had their say."""
    done = _tagged(spark, d)
    return done.where("kind = 'quote'").groupBy("book_id", "speaker").agg(
        F.count("*").alias("quotes"), F.count_if(F.coalesce("overridden_now", F.lit(False))).alias("by_tag")
    )


@query
def read_labels(spark, d):
    """Model labels of all shapes, of every current segment that has an emotion or a speaker."""
    s = _script(spark, d).where("kind = 'quote'")
    e = F.coalesce("emotion", F.lit(""))
    shape = F.pmod("seg_key", F.lit(5))
    as_object = F.to_json(F.struct(F.col("speaker"), e.alias("emotion")))
    nested = F.to_json(F.struct(F.struct(F.col("speaker").alias("name")).alias("speaker"), e.alias("emotion")))
    listed = F.to_json(F.struct(F.array("speaker").alias("speaker"), e.alias("emotion")))
    label = F.when(shape == 0, as_object).when(shape == 1, F.concat(F.lit('"'), "speaker", F.lit('"'))).when(shape == 2, nested).when(shape == 3, listed).otherwise("{}")
    members = table(spark, d, "cast_members").select("book_id", "id")
    # The label names somebody of the next book for every seventh segment: not of this cast.
    other = F.when(F.pmod("seg_key", F.lit(7)) == 6, F.lit("bk00000000")).otherwise(F.col("book_id"))
    return attribution.read_labels(s.select(other.alias("book_id"), "seg_key", label.alias("label")), members, keys=["seg_key"]).select("seg_key", "speaker", "emotion")


@query
def attribute_chapters(spark, d):
    """Chapters from their text to speakers: segments, labels of the default provider in batches of 120, tags."""
    script = segmentation.segments(_chapters(spark, d), ["book_id", "chapter_id"])
    cast = _cast(spark, d)
    done = attribution.attribute(script, cast, roster.name_index(cast), keys=["book_id", "chapter_id"])
    return done.select("chapter_id", "id", "kind", "speaker", "emotion", "overridden_now")


@query
def profile_scores(spark, d):
    """The default provider as a profile, held against the last labels of each chapter."""
    script = _texts(spark, d)
    gold = script.where("kind = 'quote'").select("book_id", "n", "id", F.col("speaker").alias("gold"))
    lean = script.select("book_id", "n", "id", "para", "kind", "text")
    done = scoring.score_profiles(lean, gold, _cast(spark, d), {"rule": providers.StubProvider})
    return done.select("profile", "book_id", "n", "quotes", "model_only", "with_tag_override")


@query
def accuracy(spark, d):
    """Speakers as first delivered, against those of the last delivery."""
    s = table(spark, d, "script_segments").where("kind = 'quote'")
    first = s.groupBy("book_id", "n", "id").agg(F.min_by(F.struct("speaker", "tag_override"), F.struct("loaded_at", "seg_key")).alias("p")).select("book_id", "n", "id", "p.*")
    last = s.groupBy("book_id", "n", "id").agg(F.max_by("speaker", F.struct("loaded_at", "seg_key")).alias("gold"))
    done = scoring.accuracy(first, last, ["book_id", "n", "id"], ["book_id"])
    return done.select("book_id", "quotes", "model_only", "with_tag_override", F.round("share", 6).alias("share"), F.size("wrong").alias("wrong"))


@query
def name_recognised(spark, d):
    """Whether a name is heard in its respelling."""
    p = spread(table(spark, d, "pronunciations").where("name IS NOT NULL AND respelling IS NOT NULL"))
    return p.select("pron_id", scoring.recognised(F.col("name"), F.col("respelling")).alias("recognised"))


# ---- voices ----


@query
def spoken_lines(spark, d):
    s = voices.spoken_lines(_texts(spark, d))
    return s.select("book_id", "speaker", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


@query
def line_counts(spark, d):
    return voices.line_counts(_script(spark, d))


@query
def speakers_by_lines(spark, d):
    return voices.by_lines(voices.line_counts(_script(spark, d)))


@query
def spoken_by_cast(spark, d):
    c = _cast(spark, d).select("book_id", F.col("id").alias("speaker"), "name")
    return voices.line_counts(_script(spark, d)).join(c, ["book_id", "speaker"]).select("book_id", "speaker", "name", "lines")


@query
def pick_line(spark, d):
    return voices.pick_line(_texts(spark, d))


@query
def narration_line(spark, d):
    """A line of each book's first chapter."""
    return voices.narration_line(_chapters(spark, d))


def _assigned(spark: SparkSession, d: str):
    return voices.assigned_voices(_texts(spark, d), _cast(spark, d), _books(spark, d), providers.StubDesigner, narration=voices.narration_line(_chapters(spark, d)))


@query
def voices_mapped(spark, d):
    """Who gets which voice: a designed one, or a stock one for small parts and where the model gave none."""
    return _assigned(spark, d)[1]


@query
def voices_made(spark, d):
    """The voices: designed, stock and the narrator's."""
    return _assigned(spark, d)[0].select("book_id", "id", F.md5(F.concat_ws("|", "instruct", "line")).alias("voice_md5"))


@query
def stock_voices(spark, d):
    return voices.stock_voices(voices.line_counts(_script(spark, d)), _cast(spark, d))


@query
def voice_map(spark, d):
    s = _script(spark, d)
    held = voices.stock_voices(voices.line_counts(s), _cast(spark, d))
    return voices.with_voice(s, held).groupBy("book_id", "voice").agg(F.count("*").alias("segments"))


@query
def first_sightings(spark, d):
    c = _cast(spark, d).where(F.size("chapters") > 0)
    return c.select("book_id", "id", F.get("chapters", F.lit(0)).alias("first_chapter"))


# ---- reading aloud ----


@query
def chunk_text(spark, d):
    return timeline.chunk_rows(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "chunk", "piece")


@query
def lexicon(spark, d):
    return timeline.lexicon_entries(table(spark, d, "pronunciations"))


@query
def respelled(spark, d):
    return timeline.respelled(table(spark, d, "script_segments"), timeline.lexicon_entries(table(spark, d, "pronunciations")))


@query
def lexicon_apply(spark, d):
    """Two fixed respellings in all documents."""
    said = timeline.speakable(F.col("text"), [("Old Isker", "Owld Eye-sker"), ("Isker", "EYE-sker"), ("Mrs", "Missis")])
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(said).alias("spoken_md5"))


@query
def pause_timeline(spark, d):
    s = _texts(spark, d)
    held = voices.stock_voices(voices.line_counts(s), _cast(spark, d))
    voiced = voices.with_voice(s, held).select("book_id", "n", "id", "para", "voice", F.posexplode(tx.chunks(F.col("text"))).alias("chunk", "piece"))
    made = timeline.pauses(voiced, ["book_id", "n"])
    return made.groupBy("book_id", "n").agg(F.count("*").alias("clips"), F.round(F.sum("pause"), 2).alias("silence"), F.sum(F.char_length("piece")).alias("chars"))


@query
def chapter_offsets(spark, d):
    return timeline.offsets(_durations(spark, d))


@query
def chapter_totals(spark, d):
    return timeline.totals(_durations(spark, d))


@query
def titled_clips(spark, d):
    return timeline.titled(_durations(spark, d), _index(spark, d)).select("book_id", "n", "ms", "title")


@query
def short_titles(spark, d):
    c = table(spark, d, "chapters").where("title IS NOT NULL")
    return c.select("chapter_id", timeline.file_name(F.col("n"), F.col("title"), "m4a").alias("file_name"))


@query
def album_folders(spark, d):
    b = _books(spark, d).where("title IS NOT NULL AND author IS NOT NULL")
    return b.select("book_id", timeline.album_folder(F.col("author"), F.col("title")).alias("folder"))


@query
def playlists(spark, d):
    entries = timeline.titled(_durations(spark, d), _index(spark, d)).withColumn("secs", F.col("ms") / 1000)
    return timeline.playlist(entries, _books(spark, d))


@query
def chapter_markers(spark, d):
    ms = _durations(spark, d)
    placed = timeline.offsets(ms).join(timeline.titled(ms, _index(spark, d)).select("book_id", "n", "title"), ["book_id", "n"])
    return timeline.markers(placed)


# ---- sound ----


def _sound(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.pmod(F.col("vec_id"), F.lit(9)))).alias("a"))


def _rounded(a, places: int):
    return F.transform(a, lambda x: F.round(x, places) + F.lit(0.0))


@query
def limit_array(spark, d):
    return _sound(spark, d).select("vec_id", _rounded(audio.limited(F.col("a")), 5).alias("limited"))


@query
def rms_array(spark, d):
    return _sound(spark, d).select("vec_id", F.round(audio.rms(F.col("a")), 6).alias("rms"))


@query
def loop_array(spark, d):
    s = _sound(spark, d).select("vec_id", _rounded(audio.looped(F.col("a"), F.lit(150)), 5).alias("b"))
    return s.select("vec_id", F.size("b").alias("samples"), F.get("b", F.lit(149)).alias("last"))


@query
def resample_array(spark, d):
    s = _sound(spark, d).select("vec_id", audio.resampled(F.col("a"), F.lit(40)).alias("b"))
    return s.select("vec_id", _rounded(F.col("b"), 5).alias("resampled"))


@query
def concat_clips(spark, d):
    """Clips of a label one after another."""
    s = table(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("c"))
    joined = audio.joined(F.transform("c", lambda x: x["embedding"]))
    whole = s.select("label", joined.alias("a"))
    return whole.select("label", _rounded(F.transform("a", lambda x: x.cast("double")), 4).alias("samples"), audio.seconds(F.size("a"), F.lit(24000)).alias("seconds"))


@query
def reading_plan(spark, d):
    """Pieces of each chapter with the samples of silence before them."""
    made, mapped = _assigned(spark, d)
    plan = sound.reading_plan(_texts(spark, d), mapped, made)
    return plan.groupBy("book_id", "n", "voice").agg(F.count("*").alias("pieces"), F.sum(sound.silent_samples(F.col("pause"), 24000)).cast("bigint").alias("silence"))


@query
def file_tags(spark, d):
    """The tags of each chapter's file."""
    return shelf.tag_rows(timeline.titled(_durations(spark, d), _index(spark, d)), _books(spark, d))


@query
def concat_listings(spark, d):
    """The files of each book in order."""
    parts = _durations(spark, d).select("book_id", "n", F.concat(F.lit("/out/"), "book_id", F.lit("/"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".wav")).alias("path"))
    return shelf.concat_listing(parts)


@query
def name_options(spark, d):
    """Respellings said and heard again, by the default provider."""
    p = table(spark, d, "pronunciations").where("name IS NOT NULL AND respelling IS NOT NULL")
    options = p.groupBy("book_id", "name").agg(F.array_sort(F.collect_set("respelling")).alias("variants"))
    return sound.score_names(options).select("book_id", "name", "option", "spoken_as", "recognised")


@query
def tidy_clips(spark, d):
    """Clips trimmed, levelled and faded."""
    s = spread(_sound(spark, d)).select("vec_id", audio.tidy(F.col("a").cast("array<float>"), 100).alias("b"))
    return s.select("vec_id", F.size("b").alias("samples"), F.round(audio.rms(F.col("b")), 4).alias("rms"))


# ---- answers of models ----


@query
def parse_answers(spark, d):
    """Personas as a model would answer them, thoughts before and prose around them."""
    c = table(spark, d, "cast_members").where("persona IS NOT NULL")
    raw = F.concat(F.lit("<think>{not this}\n</think>Here it is:\n"), "persona", F.lit("\nDone."))
    return c.select("entry_id", tx.json_of_answer(raw).alias("json"))


@query
def salvage_instruct(spark, d):
    """The instruction in answers that are broken behind it."""
    c = table(spark, d, "cast_members").where("name IS NOT NULL")
    inside = F.to_json(F.array(F.concat(F.lit('A "calm" voice for '), "name", F.lit("\\"))))
    raw = F.concat(F.lit('{"instruct": '), F.substring(inside, F.lit(2), F.char_length(inside) - 2), F.lit(', "why": "it says "so"}'))
    return c.select("entry_id", tx.salvaged_instruct(raw).alias("instruct"))


@query
def line_number(spark, d):
    c = table(spark, d, "cast_members")
    said = F.when(F.col("lines") % 3 == 0, "several").otherwise(F.concat(F.col("lines").cast("string"), F.lit(" lines")))
    return c.select("entry_id", tx.line_count(said).alias("lines"))


# ---- what is done ----


@query
def stage_state(spark, d):
    return incremental.stage_state(table(spark, d, "stage_manifest")).select("book_id", "stage", "done", "seconds")


@query
def next_stages(spark, d):
    return incremental.next_stages(table(spark, d, "stage_manifest"))


@query
def resume_anti(spark, d):
    """Stages of books that are still to be done."""
    done = incremental.stage_state(table(spark, d, "stage_manifest")).where("done")
    work = table(spark, d, "books").select("book_id").distinct().select("book_id", F.explode(F.array(*map(F.lit, incremental.STAGES))).alias("stage"))
    return incremental.not_done(work, done, ["book_id", "stage"])
