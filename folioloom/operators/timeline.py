"""What is read when: chunks, respellings, pauses, offsets of chapters, playlists and markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.text import BOUND, WORD, all_matches, chunks, short_title

# Seconds of silence.
SAME_PARAGRAPH, NEW_PARAGRAPH, OTHER_VOICE = 0.25, 0.7, 0.4


def chunk_rows(texts: DataFrame, keys: Sequence[str], text: str = "text", most: int = 400) -> DataFrame:
    """(keys, chunk, piece): the pieces a text is read in."""
    return texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(chunks(F.col(text), most)).alias("chunk", "piece"))


def speakable(text: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """A text as it is to be read: names replaced by their respellings, the longest first; a later one may change what
    an earlier one put in.  The lexicon is one book's, made by hand, and becomes part of the plan."""

    def put(t: Column, entry: tuple[str, str]) -> Column:
        name, said = entry
        quoted = "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.regexp_replace(t, F.lit(BOUND + quoted + BOUND), F.lit(said.replace("\\", "\\\\").replace("$", "\\$")))

    return reduce(put, sorted(lexicon, key=lambda e: -len(e[0])), text)


def lexicon_entries(saved: DataFrame) -> DataFrame:
    """(book_id, name, respelling, place): the entry of each name loaded last, the longest names first, then as saved."""
    last = saved.where(F.col("name").isNotNull() & F.col("respelling").isNotNull()).groupBy("book_id", "name").agg(
        F.max_by(F.struct("respelling", "ord", "pron_id"), F.struct("loaded_at", "pron_id")).alias("e")
    )
    order = Window.partitionBy("book_id").orderBy(F.char_length("name").desc(), "ord", "pron_id")
    flat = last.select("book_id", "name", "e.respelling", "e.ord", "e.pron_id")
    return flat.select("book_id", "name", "respelling", F.row_number().over(order).alias("place"))


def respelled(script: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seg_key, spoken): segments in which a name of the book's lexicon stands as a word, with the respellings.

    Words of segments meet names' first words on (book_id, word), without the text; what was found is joined to the
    segments' texts once and applied in the lexicon's order.  A book's lexicon is not collected: a segment gets only the
    entries that it may have."""
    word = lambda t: all_matches(t, f"[{WORD}]+")
    names = lexicon.withColumn("word", F.get(word(F.col("name")), F.lit(0))).where("word IS NOT NULL")
    texts = script.where(F.col("text").isNotNull()).select("book_id", "seg_key", "text")
    words = texts.select("book_id", "seg_key", F.explode(F.array_distinct(word(F.col("text")))).alias("word"))
    met = words.join(names, ["book_id", "word"])
    held = met.groupBy("seg_key").agg(F.array_sort(F.collect_set(F.struct("place", "name", "respelling"))).alias("entries"))

    def put(t: Column, e: Column) -> Column:
        quoted = F.concat(F.lit(BOUND), F.regexp_replace(e["name"], r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(BOUND))
        said = F.replace(F.replace(e["respelling"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(t, quoted, said)

    spoken = texts.join(held, "seg_key").select("seg_key", "text", F.aggregate("entries", F.col("text"), put).alias("spoken"))
    return spoken.where("spoken != text").select("seg_key", "spoken")


def pauses(clips: DataFrame, keys: Sequence[str], order: Sequence[str] = ("id", "chunk")) -> DataFrame:
    """`clips` (para, voice) with the silence before each, in seconds: none before the first; longer at a paragraph and
    where the voice changes."""
    chapter = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct("para", "voice")).over(chapter)
    met = clips.withColumn("_before", before)
    gap = F.when(F.col("_before.para") != F.col("para"), NEW_PARAGRAPH).otherwise(SAME_PARAGRAPH)
    gap = F.when(F.col("_before.voice") != F.col("voice"), F.greatest(gap, F.lit(OTHER_VOICE))).otherwise(gap)
    return met.withColumn("pause", F.when(F.col("_before").isNull(), 0.0).otherwise(gap).cast("double")).drop("_before")


def offsets(durations: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """(keys, n, start_ms, end_ms) of chapters with a length in ms."""
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ms").over(before), F.lit(0))
    return durations.select(*keys, "n", start.cast("bigint").alias("start_ms"), (start + F.col("ms")).cast("bigint").alias("end_ms"))


def titled(durations: DataFrame, index: DataFrame) -> DataFrame:
    """`durations` (book_id, n, ...) with titles; "Chapter n" where the index has none."""
    met = durations.join(index.select("book_id", "n", "title"), ["book_id", "n"], "left")
    return met.withColumn("title", F.coalesce("title", F.concat(F.lit("Chapter "), F.col("n").cast("string"))))


def file_name(n: Column, title: Column, kind: str) -> Column:
    return F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit(" - "), short_title(title), F.lit(f".{kind}"))


def album(title: Column, label: str = "Full Cast") -> Column:
    """A book's album."""
    return F.concat(title, F.lit(f" ({label})"))


def album_folder(author: Column, title: Column, label: str = "Full Cast") -> Column:
    return F.concat(author, F.lit("/"), album(title, label))


def playlist(entries: DataFrame, books: DataFrame, kind: str = "m4a") -> DataFrame:
    """(book_id, playlist): an extended M3U text of each book.  entries: book_id, n, title, secs."""
    line = F.concat(
        F.lit("#EXTINF:"), F.bround("secs").cast("bigint").cast("string"), F.lit(","), F.col("author"), F.lit(" - "), F.col("title"), F.lit("\n"),
        file_name(F.col("n"), F.col("title"), kind),
    )
    about = books.select("book_id", F.coalesce("author", F.lit("")).alias("author"), F.coalesce(F.col("title"), F.lit("")).alias("book_title"))
    met = entries.join(about, "book_id").select("book_id", "author", "book_title", "n", line.alias("line"))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n")
    made = met.groupBy("book_id", "author", "book_title").agg(rest.alias("rest"))
    name = album(F.col("book_title"))
    head = F.concat(F.lit("#EXTM3U\n#PLAYLIST:"), name, F.lit("\n#EXTART:"), F.col("author"), F.lit("\n#EXTALB:"), name, F.lit("\n"))
    return made.select("book_id", F.concat(head, F.col("rest"), F.lit("\n")).alias("playlist"))


def markers(placed: DataFrame) -> DataFrame:
    """(book_id, metadata): chapter markers of each book in FFMETADATA.  placed: book_id, n, title, start_ms, end_ms."""
    mark = F.concat(
        F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"),
        F.lit("\ntitle="), F.col("title"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", mark.alias("m")))), lambda s: s["m"]), "\n")
    return placed.groupBy("book_id").agg(F.concat(F.lit(";FFMETADATA1\n"), body, F.lit("\n")).alias("metadata"))


def totals(durations: DataFrame) -> DataFrame:
    """(book_id, chapters, ms)."""
    return durations.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("ms").alias("ms"))
