"""Who speaks: labels of a model, checked against the cast, and the dialogue tags that overrule them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.text import tag_name
from folioloom.operators.segmentation import batch_prompts, batches
from folioloom.providers import Provider, StubProvider, any_object, ask
from folioloom.session import materialize


def current_script(saved: DataFrame) -> DataFrame:
    """The row of each (book_id, n, id) that was loaded last; ties go to the larger seg_key.  Rows are parted by chapter,
    so that what goes by chapter next needs no shuffle; few rows are delivered twice."""
    fields = [c for c in saved.columns if c not in ("book_id", "n", "id")]
    last = F.max_by(F.struct(*fields), F.struct("loaded_at", "seg_key")).alias("r")
    return saved.repartition("book_id", "n").groupBy("book_id", "n", "id").agg(last).select("book_id", "n", "id", "r.*")


def _tag() -> Column:
    name = F.lower(F.when(F.col("kind") == "narration", tag_name(F.col("text"))))
    return F.when(name != "", name)


def with_tag(script: DataFrame) -> DataFrame:
    """`script` with the name in the dialogue tag that a text begins with, in small letters, in place of the text: all
    that the tags need of it, and far less to shuffle."""
    return script.withColumn("tag", _tag()).drop("text")


def tag_lookup(index: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, tag, id): whom a tag's name means, by the name or, failing that, by the name without "the "."""
    whole = index.select(book, F.col("key").alias("tag"), "id", F.lit(0).alias("_way"))
    bare = index.select(book, F.concat(F.lit("the "), "key").alias("tag"), "id", F.lit(1).alias("_way"))
    return whole.unionByName(bare).groupBy(book, "tag").agg(F.min_by("id", "_way").alias("_who"))


def tag_override(script: DataFrame, index: DataFrame, keys: Sequence[str] = ("book_id", "n"), book: str = "book_id") -> DataFrame:
    """`script` with speaker and tag_override as the tags have it: a quotation followed in its paragraph by narration
    that begins with a tag ("said Zoé") belongs to whom the tag names, if the index knows the name.

    A quotation looks at its own successor alone, so one window does it; `script` may come with a column tag (see
    `with_tag`) and without text.  Rows without a tag meet nothing in the index; their keys are spread.
    """
    chapter = Window.partitionBy(*keys).orderBy("id")
    tagged = script if "tag" in script.columns else script.withColumn("tag", _tag())
    ahead = F.lead(F.struct("kind", "para", "tag")).over(chapter)
    met = (F.col("kind") == "quote") & (F.col("_next.kind") == "narration") & (F.col("_next.para") == F.col("para"))
    nobody = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*keys, "id"), F.lit(4096)).cast("string"))
    named = tagged.withColumn("_next", ahead).withColumn("tag", F.coalesce(F.when(met, F.col("_next.tag")), nobody))
    found = named.join(tag_lookup(index, book), [book, "tag"], "left")
    who = F.col("_who")
    changed = who.isNotNull() & ~F.col("speaker").eqNullSafe(who)
    flag = F.when(changed, True).otherwise(F.col("tag_override") if "tag_override" in script.columns else F.lit(None).cast("boolean"))
    return found.select(
        *[c for c in script.columns if c not in ("speaker", "tag_override", "tag")], F.when(changed, who).otherwise(F.col("speaker")).alias("speaker"),
        flag.alias("tag_override"), changed.alias("overridden_now"),
    )


def chapter_stats(script: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quotations, those set by tags, and those of unknown speakers, by chapter."""
    quote = F.col("kind") == "quote"
    return script.groupBy(*keys).agg(
        F.count_if(quote).alias("quotes"), F.count_if(quote & F.coalesce("tag_override", F.lit(False))).alias("overrides"),
        F.count_if(quote & (F.col("speaker") == "unknown")).alias("unknown"),
    )


def read_labels(labels: DataFrame, members: DataFrame, label: str = "label", keys: Sequence[str] = ("key",), book: str = "book_id") -> DataFrame:
    """(book, keys, speaker, emotion) of a model's labels, which come in many shapes: a string; an object whose speaker
    is a string, or an object with id, speaker or name.  The first of them that is in the book's cast is the speaker,
    else "unknown"; an emotion that is no non-empty string is "neutral".  labels: with a column book; members: book, id."""
    v = F.try_parse_json(label)
    inner = F.try_variant_get(v, "$.speaker", "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))

    def text(x: Column, path: str) -> Column:
        got = F.try_variant_get(x, path, "variant")
        return F.when(kind(got) == "STRING", F.try_variant_get(x, path, "string"))

    candidates = (
        F.when(kind(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
        .when(kind(inner) == "STRING", F.array(F.try_variant_get(inner, "$", "string")))
        .when(kind(inner).startswith("OBJECT"), F.array(text(inner, "$.id"), text(inner, "$.speaker"), text(inner, "$.name")))
        .otherwise(F.array().cast("array<string>"))
    )
    emotion = F.when(kind(v).startswith("OBJECT"), text(v, "$.emotion"))
    read = labels.select(book, *keys, candidates.alias("c"), F.when(emotion != "", emotion).otherwise("neutral").alias("emotion"))
    known = members.select(book, F.col("id").alias("_id")).distinct()
    each = read.select(book, *keys, "emotion", F.posexplode_outer("c").alias("_at", "_id"))
    found = each.join(known.withColumn("_in", F.lit(True)), [book, "_id"], "left")
    best = F.min_by("_id", F.when(F.col("_in"), F.col("_at")))
    return found.groupBy(book, *keys).agg(F.coalesce(best, F.lit("unknown")).alias("speaker"), F.min("emotion").alias("emotion"))


PROMPT = """A chapter of a book is to be read with a voice for each character. Quotations are marked [Q<number>].

CHARACTERS, one a line as id | name | other names:
{cast}

Say of each marked quotation which character speaks it, from what the narration tells and from the turns of the talk, and in which mood (one word). Where no character of the list fits, the speaker is "unknown".
Answer with JSON alone: {{"quotes": {{"<number>": {{"speaker": "<id>", "emotion": "<mood>"}}}}}}

{chapter}"""
_EARLIER = "(Before this part: ..."


def label_prompts(script: DataFrame, cast: DataFrame, keys: Sequence[str], most: int = 120, context: int = 12) -> DataFrame:
    """(keys, batch, prompt): what a model is asked of each batch of a chapter with quotations, with its book's cast and
    the text before the batch; nothing of chapters without.  keys begin with the book."""
    book = keys[0]
    member = F.concat_ws(" | ", "id", F.coalesce("name", F.lit("")), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", "))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry_id", member.alias("line")))), lambda m: m["line"]), "\n")
    casts = cast.groupBy(book).agg(listed.alias("cast"))
    made = batch_prompts(batches(script, keys, most).where("batch_quotes > 0").drop("batch_quotes"), keys, context)
    before = F.when(F.col("earlier") != "", F.concat(F.lit(_EARLIER), "earlier", F.lit(")\n\n"))).otherwise("")
    head, middle = PROMPT.replace("{{", "{").replace("}}", "}").split("{cast}")
    prompt = F.concat(F.lit(head), F.coalesce("cast", F.lit("(none)")), F.lit(middle.replace("{chapter}", "")), before, F.col("body"))
    return made.join(casts, book, "left").select(*keys, "batch", prompt.alias("prompt"))


def labels_of(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, label) of answers (keys, raw) to label prompts; of a number answered twice, the last batch's."""
    quotes = F.try_variant_get(F.try_parse_json("raw"), "$.quotes", "map<string,variant>")
    each = answers.select(*keys, "batch", F.explode(quotes).alias("q", "v")).where(F.col("q").rlike(r"^(0|[1-9]\d{0,8})$"))
    said = each.select(*keys, "batch", F.col("q").cast("int").alias("id"), F.to_json("v").alias("label"))
    return said.groupBy(*keys, "id").agg(F.max_by("label", "batch").alias("label"))


def attribute(
    script: DataFrame, cast: DataFrame, index: DataFrame, make: Callable[[], Provider] = StubProvider, keys: Sequence[str] = ("book_id", "n"), most: int = 120
) -> DataFrame:
    """Segments (keys, id, para, kind, text) with speaker, emotion and tag_override: a model labels the quotations, batch
    by batch, in three attempts; labels are joined back by number and checked against the book's cast, what has none is
    unknown and neutral; then the dialogue tags have their say.  Narration is the narrator's.  keys begin with the book.

    The model is asked once: its answers are written before they are used."""
    book = keys[0]
    answers = materialize(ask(label_prompts(script, cast, keys, most), make, [*keys, "batch"], accept=any_object), "answers")
    read = read_labels(labels_of(answers, keys), cast, keys=[*keys[1:], "id"], book=book)
    met = script.join(read, [*keys, "id"], "left")
    quote = F.col("kind") == "quote"
    spoken = met.withColumns({
        "speaker": F.when(quote, F.coalesce("speaker", F.lit("unknown"))).otherwise("narrator"),
        "emotion": F.when(quote, F.coalesce("emotion", F.lit("neutral"))).otherwise("neutral"),
    })
    return tag_override(spoken, index, keys, book)


def checked_speakers(script: DataFrame, cast: DataFrame) -> DataFrame:
    """`script` with speakers that are not in their book's cast set to "unknown"; "narrator" stays."""
    members = cast.select("book_id", F.col("id").alias("speaker")).distinct().withColumn("_in", F.lit(True))
    met = script.join(members, ["book_id", "speaker"], "left")
    known = F.col("_in") | (F.col("speaker") == "narrator")
    return met.withColumn("speaker", F.when(F.coalesce(known, F.lit(False)), F.col("speaker")).otherwise("unknown")).drop("_in").select(*script.columns)
