"""What models are asked of the cast: notes on each chapter, which people may be one, and casting briefs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioloom.operators import casting
from folioloom.operators.casting import Register, Sighting
from folioloom.operators.roster import _texts
from folioloom.providers import Provider, StubProvider, answered, any_object, ask
from folioloom.session import materialize

# Evidence in a casting brief's prompt; chapters and characters of evidence in a line on a person.
BRIEF_EVIDENCE, LINE_CHAPTERS, LINE_EVIDENCE = 40, 3, 80

NOTES_PROMPT = """Note who speaks or is described in one chapter of a book, so that voices can be found for them.

KNOWN SO FAR (name | other names):
{cast}

Write the name of somebody known exactly as it stands there, whatever the chapter calls them; for somebody new take the fullest proper name that the chapter gives, or a short description.
Answer with JSON alone: {{"characters": [{{"name": "", "new_aliases": [], "speaks": true, "lines": "how many", "gender": "", "age": "", "origin": "", "class": "", "evidence": ["short phrases of the text on voice, manner or looks"]}}], "disguises": [{{"name": "who", "as": "under which name"}}]}}

CHAPTER {n}:
{text}"""

_DONE = T.StructType(
    [
        T.StructField("book_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("known", T.IntegerType()),
        T.StructField("delta", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType()),
    ]
)


def collect(
    chapters: DataFrame, make: Callable[[], Provider] = StubProvider, done: DataFrame | None = None, attempts: int = 3, max_tokens: int = 4096
) -> DataFrame:
    """(book_id, n, known, delta, attempts, error): a model's notes on each chapter (book_id, n, text), in order, each
    asked with the cast that the chapters before it gave; known is that cast's size.  Chapters in `done` (book_id, n,
    delta) are not asked again; a chapter without an answer that can be read has a null delta and adds nobody.

    The order is the algorithm: a book's chapters go through one task one by one and are not held."""
    texts = chapters.select("book_id", F.col("n").cast("int").alias("n"), "text")
    old = texts.withColumn("delta", F.lit(None).cast("string")) if done is None else texts.join(done.select("book_id", "n", "delta"), ["book_id", "n"], "left")
    arrow = to_arrow_schema(_DONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for book, rows in groupby(casting.stream(batches), key=lambda r: r["book_id"]):
            register = Register()
            for r in rows:
                known, delta, tried, error = len(register.people), r["delta"], 0, None
                if delta is None and r["text"] is not None:
                    prompt = NOTES_PROMPT.format(cast=register.summary(), n=r["n"], text=r["text"])
                    delta, tried, error = answered(provider, prompt, any_object, attempts, max_tokens)
                if delta is not None:
                    take_in(register, r["n"], json.loads(delta))
                yield casting.batch([{"book_id": book, "n": r["n"], "known": known, "delta": delta, "attempts": tried, "error": error}], arrow)
        provider.free()

    return casting.in_order(old, "n").mapInArrow(run, _DONE)


def take_in(register: Register, n: int, delta: dict) -> None:
    """A chapter's notes into a book's register; what is no list of objects counts as none."""
    rows = lambda k: [x for x in delta.get(k) or () if isinstance(x, dict)] if isinstance(delta.get(k), list) else []
    for said in rows("characters"):
        register.see(Sighting.read(n, said))
    for d in rows("disguises"):
        text = lambda k: d.get(k) if isinstance(d.get(k), str) else None  # noqa: E731, B023
        register.unmask(text("name"), text("as"), text("id"))


def cast_of(collected: DataFrame) -> DataFrame:
    """The cast of each book from the notes of `collect`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, rows in groupby(casting.stream(batches), key=lambda r: r["book_id"]):
            register = Register()
            for r in rows:
                take_in(register, r["n"], json.loads(r["delta"]))
            yield casting.batch(casting.cast_rows(book, register))

    held = collected.where(F.col("delta").isNotNull()).select("book_id", "n", "delta")
    return casting.in_order(held, "n").mapInArrow(run, casting._TYPE)


# ---- who may be one ----

MERGE_PROMPT = """The people of a book were noted chapter by chapter, and some stand there twice. Each line is: id | name | other names | chapters | evidence.

{cast}

Name the ids that mean one person; members of a family are different people.
Answer with JSON alone: {{"merges": [{{"keep": "id", "drop": ["ids"]}}]}}"""


def person_lines(cast: DataFrame) -> DataFrame:
    """(book_id, id, line): one line on each person, with the first chapters and the beginning of the first evidence."""
    chapters = F.concat(F.lit("["), F.array_join(F.slice(F.coalesce("chapters", F.array().cast("array<int>")), 1, LINE_CHAPTERS).cast("array<string>"), ", "), F.lit("]"))
    evidence = F.substring(F.coalesce(F.get("evidence", F.lit(0)), F.lit("")), 1, LINE_EVIDENCE)
    return cast.select("book_id", "id", "ord", F.concat_ws(" | ", "id", F.coalesce("name", F.lit("")), F.array_join(_texts("aliases"), ", "), chapters, evidence).alias("line"))


def merge_prompts(cast: DataFrame) -> DataFrame:
    """(book_id, prompt): what a model is asked about each book's cast."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "line"))), lambda r: r["line"]), "\n")
    head, tail = MERGE_PROMPT.format(cast="\0").split("\0")
    return person_lines(cast).groupBy("book_id").agg(F.concat(F.lit(head), rows, F.lit(tail)).alias("prompt"))


def suggested_merges(cast: DataFrame, make: Callable[[], Provider] = StubProvider) -> DataFrame:
    """(book_id, keep, drop): pairs that a model takes for one person, to be looked at by somebody; nothing applies
    them.  An answer that cannot be read suggests nothing."""
    answers = materialize(ask(merge_prompts(cast), make, "book_id", attempts=1, accept=any_object), "merges")
    merges = F.try_variant_get(F.try_parse_json("raw"), "$.merges", "array<variant>")
    each = answers.select("book_id", F.explode(merges).alias("m"))
    drop = F.try_variant_get("m", "$.drop", "array<string>")
    pairs = each.select("book_id", F.try_variant_get("m", "$.keep", "string").alias("keep"), F.explode(drop).alias("drop"))
    return pairs.where("keep IS NOT NULL AND drop IS NOT NULL").distinct()


# ---- casting briefs ----

BRIEF_PROMPT = """Write the casting brief for one character of the book "{title}", to be read by an actor of the same voice throughout.

{name} ({id}), also called {aliases}; speaks in {chapters} chapters, some {lines} lines, first in chapter {first}.
Noted: gender {gender}; age {age}; origin {origin}; standing {class}. Disguises: {disguises}.
{evidence}

Answer with JSON alone: {{"gender": "", "age_range": "", "origin_accent": "", "temperament": "", "voice": "", "delivery_notes": "", "tier": "lead, supporting or minor"}}"""


def _filled(template: str, **columns: Column) -> Column:
    """A template of braces as a concatenation of columns; doubled braces are braces."""
    out, rest = [], template.replace("{{", "\1").replace("}}", "\2")
    plain = lambda t: F.lit(t.replace("\1", "{").replace("\2", "}"))
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [plain(before), columns[name]]
    return F.concat(*out, plain(rest))


def brief_prompts(cast: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, id, place, prompt) of speaking characters without a persona, those of most chapters first.  books:
    book_id, title."""
    said = lambda c, none, sep=", ": F.when(F.size(_texts(c)) > 0, F.array_join(_texts(c), sep)).otherwise(none)
    noted = {k: F.array_join(F.filter(F.coalesce(F.try_element_at("notes", F.lit(k)), F.array().cast("array<string>")), lambda x: x.isNotNull()), "/") for k in casting.NOTES}
    evidence = F.array_join(F.slice(_texts("evidence"), 1, BRIEF_EVIDENCE), "\n")
    chapters = F.coalesce("chapters", F.array().cast("array<int>"))
    todo = cast.where((F.size(chapters) > 0) & F.col("persona").isNull()).join(books.select("book_id", "title"), "book_id", "left")
    prompt = _filled(
        BRIEF_PROMPT, title=F.coalesce("title", "book_id"), name=F.coalesce("name", F.lit("")), id=F.col("id"), aliases=said("aliases", "nothing else"),
        chapters=F.size(chapters).cast("string"), lines=F.coalesce(F.col("lines").cast("string"), F.lit("0")), first=F.get(chapters, F.lit(0)).cast("string"),
        disguises=said("disguises", "none"), evidence=F.when(evidence != "", evidence).otherwise("(no evidence)"),
        **{k: F.when(v != "", v).otherwise("?") for k, v in noted.items()},
    )
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.size(chapters).desc(), "ord", "entry_id"))
    return todo.select("book_id", "id", place.alias("place"), prompt.alias("prompt"))


def personas(cast: DataFrame, books: DataFrame, make: Callable[[], Provider] = StubProvider) -> DataFrame:
    """(book_id, id, persona, error): a model's casting brief as JSON; null where its answer cannot be read."""
    got = ask(brief_prompts(cast, books), make, ["book_id", "id"], attempts=1, accept=any_object)
    return got.select("book_id", "id", F.col("raw").alias("persona"), "error")
