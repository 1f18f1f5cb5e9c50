"""Chapters to narration and quotations, and to even batches of quotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.text import all_matches, quote_marks, strip


def _tokens(paragraph: Column, opening: str, closing: str) -> Column:
    """Quotations, open ones up to the end, and what stands between them."""
    return all_matches(paragraph, rf"{opening}[^{closing}]*(?:{closing}|\z)|[^{opening}]+")


def segment_array(text: Column) -> Column:
    """Segments (para, kind, text) of a chapter.  Curly quotes count if the chapter has any, else straight ones."""

    def of_paragraph(opening: str, closing: str):
        def make(p: Column, i: Column) -> Column:
            def one(t: Column) -> Column:
                quote = t.startswith(opening)
                bare = F.regexp_replace(t, f"^[{opening}{closing}]+|[{opening}{closing}]+$", "")
                return F.struct(
                    i.alias("para"), F.when(quote, "quote").otherwise("narration").alias("kind"), strip(F.when(quote, bare).otherwise(t)).alias("text")
                )

            return F.transform(_tokens(p, opening, closing), one)

        return make

    paragraphs = F.split(text, "\n\n")
    curly = F.flatten(F.transform(paragraphs, of_paragraph("“", "”")))
    straight = F.flatten(F.transform(paragraphs, of_paragraph('"', '"')))
    return F.filter(F.when(text.contains("“"), curly).otherwise(straight), lambda s: s["text"] != "")


def segments(chapters: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, id, para, kind, text) of every chapter; ids count from 0 in order.  No shuffle: a chapter's segments come
    out of one array, whose positions are their ids."""
    found = chapters.select(*keys, F.posexplode(segment_array(F.col(text))).alias("id", "s"))
    return found.select(*keys, "id", "s.para", "s.kind", "s.text")


def chapter_index(chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, title, chars, quotes): length and quotation marks of each chapter; a null text has none."""
    text = F.coalesce("text", F.lit(""))
    return chapters.select(*keys, "title", F.char_length(text).alias("chars"), quote_marks(text).cast("int").alias("quotes"))


def batches(script: DataFrame, keys: Sequence[str], most: int = 120) -> DataFrame:
    """`script` with its batch, counted from 0: even windows of at most `most` quotations, one for a chapter without; and
    batch_quotes, the quotations of its chapter."""
    chapter = Window.partitionBy(*keys)
    ordered = chapter.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quote = (F.col("kind") == "quote").cast("int")
    total, so_far = F.sum(quote).over(chapter), F.sum(quote).over(ordered)
    per = F.when(total == 0, 1).otherwise(F.ceil(total / F.ceil(total / F.lit(most))))
    return script.withColumns({"batch": F.floor(F.greatest(so_far - 1, F.lit(0)) / per).cast("int"), "batch_quotes": total})


def batch_bounds(batched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First id, id after the last, and quotations of each batch."""
    return batched.groupBy(*keys, "batch").agg(
        F.min("id").alias("first_id"), (F.max("id") + 1).alias("end_id"), F.sum((F.col("kind") == "quote").cast("int")).alias("quotes")
    )


def rendered(kind: Column, number: Column, text: Column) -> Column:
    """A segment as a line of a prompt."""
    return F.when(kind == "quote", F.concat(F.lit("[Q"), number.cast("string"), F.lit('] "'), text, F.lit('"'))).otherwise(text)


def batch_prompts(batched: DataFrame, keys: Sequence[str], context: int = 12) -> DataFrame:
    """(keys, batch, earlier, body): each batch's lines, and the text of the `context` segments before it.  Each batch
    keeps its last texts, and looks at those of the batches before it."""
    lines = batched.withColumn("line", rendered(F.col("kind"), F.col("id"), F.col("text")))
    held = lines.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("id", "line", "text"))).alias("s"))

    def last(texts: Column) -> Column:
        return F.slice(texts, F.greatest(F.size(texts) - context + 1, F.lit(1)), F.lit(context))

    tails = held.withColumn("tail", last(F.transform("s", lambda x: x["text"])))
    before = Window.partitionBy(*keys).orderBy("batch").rowsBetween(-context, -1)
    seen = tails.withColumn("earlier", F.array_join(last(F.flatten(F.collect_list("tail").over(before))), " "))
    return seen.select(*keys, "batch", "earlier", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("body"))
