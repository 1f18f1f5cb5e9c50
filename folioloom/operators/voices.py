"""Lines that characters speak, reference lines to design voices from, and who gets which voice."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.text import strip
from folioloom.providers import Provider, ask, json_object
from folioloom.session import materialize

# Stock voices by gender, bounds of a reference line, what is read if there is none.
STOCK = {"male": ("extra_male_1", "extra_male_2", "extra_male_3"), "female": ("extra_female_1", "extra_female_2")}
SHORTEST, LONGEST, IDEAL = 60, 220, 140
NO_LINE = "I have nothing more to say."
NO_NARRATION = "It was a story told many times, and never quite the same way twice."


def spoken(script: DataFrame) -> DataFrame:
    """Quotations with a speaker known by name."""
    return script.where((F.col("kind") == "quote") & ~F.col("speaker").isin("unknown", "narrator"))


def spoken_lines(script: DataFrame) -> DataFrame:
    """(book_id, speaker, lines): all a speaker says, in order of the book.  The list is as long as the part; for
    counting or choosing use the operators below, which keep no lists."""
    said = spoken(script)
    return said.groupBy("book_id", "speaker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "text"))), lambda s: s["text"]).alias("lines")
    )


def line_counts(script: DataFrame) -> DataFrame:
    """(book_id, speaker, lines, first_n, first_id): number of lines and place of the first."""
    return spoken(script).groupBy("book_id", "speaker").agg(F.count("*").alias("lines"), F.min(F.struct("n", "id")).alias("f")).select(
        "book_id", "speaker", "lines", F.col("f.n").alias("first_n"), F.col("f.id").alias("first_id")
    )


def fits_reference(text: Column) -> Column:
    return F.char_length(text).between(SHORTEST, LONGEST)


def pick_line(script: DataFrame) -> DataFrame:
    """(book_id, speaker, line): a line to design a voice from.  Of 60 to 220 characters, rather a whole sentence, and
    near 140; else the longest; first in the book among equals.  One pass, and no list of lines."""
    text = F.col("text")
    length = F.char_length(text)
    whole = F.regexp_replace(text, r"(?U)\s+$", "").rlike(r"[.!?]\z")
    good = fits_reference(text)
    rank = F.struct(
        F.when(good, 0).otherwise(1).alias("tier"), F.when(good & whole, 0).otherwise(1).alias("part"),
        F.when(good, F.abs(length - IDEAL)).otherwise(-length).alias("off"), F.col("n"), F.col("id"),
    )
    return spoken(script).groupBy("book_id", "speaker").agg(F.coalesce(F.min_by("text", rank), F.lit(NO_LINE)).alias("line"))


def narration_line(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, line): the first sentence of each book's first chapter of 60 to 220 characters that is neither speech nor a
    heading.  chapters: book, n, text and, where chapters were read twice, loaded_at and chapter_id: the last counts."""
    late = [F.col(c) for c in ("loaded_at", "chapter_id") if c in chapters.columns]
    first = chapters.where(F.col("text").isNotNull()).groupBy(book).agg(
        F.min_by("text", F.struct("n", *[-(F.unix_micros(c.cast("timestamp")) if k == 0 else c) for k, c in enumerate(late)])).alias("text")
    )
    sentences = F.flatten(F.transform(F.split("text", "\n\n"), lambda p: F.split(p, r"(?U)(?<=[.!?])\s+")))
    fit = F.filter(sentences, lambda s: fits_reference(s) & ~s.contains("“") & ~F.lower(s).startswith("chapter") & ~F.lower(s).startswith("volume"))
    return first.select(book, F.coalesce(strip(F.get(fit, F.lit(0))), F.lit(NO_NARRATION)).alias("line"))


def voice_gender(persona: Column, notes: Column) -> Column:
    """female if the persona's gender, or else the notes', says so; male otherwise."""
    told = F.try_variant_get(F.try_parse_json(persona), "$.gender", "string")
    noted = F.array_join(F.coalesce(F.try_element_at(notes, F.lit("gender")), F.array().cast("array<string>")), "/")
    said = F.lower(F.when(told != "", told).otherwise(noted))
    return F.when(said.contains("female") | said.startswith("f"), "female").otherwise("male")


def stock_voices(counts: DataFrame, cast: DataFrame, voiced: DataFrame | None = None) -> DataFrame:
    """(book_id, speaker, voice): stock voices in turn for each gender, for the cast's speakers by lines, then by first
    appearance; without those in `voiced` (book_id, speaker)."""
    members = cast.select("book_id", F.col("id").alias("speaker"), voice_gender(F.col("persona"), F.col("notes")).alias("gender"))
    todo = counts.join(members, ["book_id", "speaker"])
    if voiced is not None:
        todo = todo.join(voiced.select("book_id", "speaker"), ["book_id", "speaker"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("book_id", "gender").orderBy(F.col("lines").desc(), "first_n", "first_id")) - 1
    pool = lambda g: F.get(F.array(*map(F.lit, STOCK[g])), turn % len(STOCK[g]))
    return todo.withColumn("voice", F.when(F.col("gender") == "female", pool("female")).otherwise(pool("male"))).select("book_id", "speaker", "voice")


def with_voice(script: DataFrame, voices: DataFrame) -> DataFrame:
    """`script` with the voice of each segment; narration and speakers without a voice have the narrator's."""
    met = script.join(voices.select("book_id", "speaker", "voice"), ["book_id", "speaker"], "left")
    return met.withColumn("voice", F.when(F.col("kind") == "quote", F.coalesce("voice", F.lit("narrator"))).otherwise("narrator"))


def by_lines(counts: DataFrame) -> DataFrame:
    """(book_id, speaker, lines, place): speakers by lines, then by first appearance."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("lines").desc(), "first_n", "first_id"))
    return counts.select("book_id", "speaker", "lines", place.alias("place"))


# ---- designed voices ----

MIN_LINES = 5  # fixed value: fewer lines are spoken by a stock voice
MOST_EVIDENCE = 12  # fixed value: pieces of evidence in a prompt
STOCK_LINE = "Certainly. I will look into it this very evening, and you will hear from me."
STOCK_SOUNDS = {
    "extra_male_1": "A grown man, even voice of middle pitch, plain and factual.", "extra_male_2": "An elderly man, low and rough voice, in no hurry.",
    "extra_male_3": "A man of twenty, bright high voice, lively.", "extra_female_1": "A grown woman, clear voice of middle pitch, calm.",
    "extra_female_2": "An elderly woman, low husky voice, kind.",
}
NARRATOR_SOUND = "A woman of middle age, warm low voice, calm and clear, who tells a story as if she had been there."
DESIGN_PROMPT = """Describe the voice of one character of the book "{title}" for a model that makes voices from descriptions. It knows nothing but what you write, so write of the sound only.

Character: {name}
Brief: {brief}
From the text: {evidence}

Answer with JSON alone: {{"instruct": "gender, age, pitch, timbre, pace, a light accent if any, manner, in two sentences at most", "why": "the phrases you go by"}}"""


def designed(raw: str) -> str:
    """What is used of a model's answer, as JSON of instruct and why; the instruction alone where the rest is broken.
    ValueError if there is none."""
    try:
        said = json_object(raw)
        if isinstance(said.get("instruct"), str) and said["instruct"]:
            return json.dumps({"instruct": said["instruct"], "why": said.get("why", "")}, ensure_ascii=False)
    except ValueError:
        pass
    return json.dumps({"instruct": saved_instruct(raw), "why": ""}, ensure_ascii=False)


def saved_instruct(raw: str) -> str:
    """The string "instruct" of an answer that is broken elsewhere; ValueError if there is none."""
    at = re.search(r'"instruct"\s*:\s*(?=")', raw)
    if at:
        text, _ = json.JSONDecoder().raw_decode(raw, at.end())
        if isinstance(text, str) and text.strip():
            return text.strip()
    raise ValueError("no instruction in the answer")


def design_prompts(todo: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, speaker, prompt) for the speakers in `todo` (with the columns of the cast)."""
    notes = F.to_json(F.coalesce("notes", F.create_map().cast("map<string,array<string>>")))
    evidence = F.array_join(F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, MOST_EVIDENCE), "; ")
    head, a, b, c, tail = re.split(r"\{\w+\}", DESIGN_PROMPT.replace("{{", "\1").replace("}}", "\2"))
    tail = tail.replace("\1", "{").replace("\2", "}")
    prompt = F.concat(
        F.lit(head), F.coalesce("title", F.lit("")), F.lit(a), F.coalesce("name", F.lit("")), F.lit(b), F.coalesce("persona", notes), F.lit(c), evidence, F.lit(tail)
    )
    return todo.join(books.select("book_id", "title"), "book_id", "left").select("book_id", "speaker", prompt.alias("prompt"))


def assigned_voices(
    script: DataFrame, cast: DataFrame, books: DataFrame, make: Callable[[], Provider], held: DataFrame | None = None, held_map: DataFrame | None = None,
    min_lines: int = MIN_LINES, narration: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Voices (book_id, id, instruct, why, line) that a model designs, and the map (book_id, speaker, voice).

    Speakers of the cast with at least `min_lines` lines have a voice of their own: one that is held (book_id, id, ...),
    or one designed in three attempts; where that fails, a stock voice of their gender.  The others keep what the held
    map (book_id, speaker, voice) gives them, or get a stock voice.  Stock voices go by turns, for each gender, in order
    of lines.  The narrator, who
    reads the line of `narration` (book_id, line), and the stock voices in use are among the voices.  The model is asked once: its answers are
    written before they are used."""
    spark = script.sparkSession
    if held is None:
        held = spark.createDataFrame([], "book_id string, id string, instruct string, why string, line string")
    if held_map is None:
        held_map = spark.createDataFrame([], "book_id string, speaker string, voice string")
    counts = line_counts(script)
    members = cast.withColumnRenamed("id", "speaker").drop("lines")
    speaking = counts.join(members, ["book_id", "speaker"])
    main = speaking.where(F.col("lines") >= min_lines)
    has = held.select("book_id", F.col("id").alias("speaker")).distinct()
    todo = main.join(has, ["book_id", "speaker"], "left_anti")
    made = materialize(ask(design_prompts(todo, books), make, ["book_id", "speaker"], accept=designed), "designed").where("raw IS NOT NULL")
    own = main.join(has, ["book_id", "speaker"], "left_semi").select("book_id", "speaker").unionByName(made.select("book_id", "speaker"))
    small = speaking.where(F.col("lines") < min_lines).select("book_id", "speaker")
    kept = held_map.join(own, ["book_id", "speaker"], "left_anti").join(todo.select("book_id", "speaker"), ["book_id", "speaker"], "left_anti")
    served = own.unionByName(small.join(held_map, ["book_id", "speaker"], "left_semi"))
    stock = stock_voices(counts, cast, served)
    mapped = own.withColumn("voice", F.col("speaker")).unionByName(kept.select("book_id", "speaker", "voice")).unionByName(stock)

    said = F.try_parse_json("raw")
    text = lambda k: F.try_variant_get(said, k, "string")
    lines = pick_line(script)
    new = made.join(lines, ["book_id", "speaker"], "left").select(
        "book_id", F.col("speaker").alias("id"), text("$.instruct").alias("instruct"), F.coalesce(text("$.why"), F.lit("")).alias("why"), "line"
    )
    sounds = spark.createDataFrame([*STOCK_SOUNDS.items()], "id string, instruct string").withColumns({"why": F.lit(""), "line": F.lit(STOCK_LINE)})
    used = mapped.select("book_id", F.col("voice").alias("id")).distinct().join(F.broadcast(sounds), "id").select("book_id", "id", "instruct", "why", "line")
    books_read = script.select("book_id").distinct()
    told = books_read.withColumn("line", F.lit(None).cast("string")) if narration is None else books_read.join(narration.select("book_id", "line"), "book_id", "left")
    told = told.select("book_id", F.lit("narrator").alias("id"), F.lit(NARRATOR_SOUND).alias("instruct"), F.lit("").alias("why"), F.coalesce("line", F.lit(NO_NARRATION)).alias("line"))
    extra = used.unionByName(told).join(held.select("book_id", "id"), ["book_id", "id"], "left_anti")
    return held.select("book_id", "id", "instruct", "why", "line").unionByName(new).unionByName(extra), mapped
