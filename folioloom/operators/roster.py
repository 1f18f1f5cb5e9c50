"""The cast: its current state, the index of names, and who may be the same person by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.arrow import ascii_fold
from folioloom.functions.text import first_name, gender, last_word, name_tokens, note_genders, proper_alias, strip, title_gender


def _texts(column: str) -> Column:
    return F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda a: a.isNotNull() & (strip(a) != ""))


def current_cast(saved: DataFrame) -> DataFrame:
    """The row of each (book_id, id) that was saved last; ties go to the larger entry."""
    fields = [c for c in saved.columns if c not in ("book_id", "id")]
    last = F.max_by(F.struct(*fields), F.struct("updated_at", "entry_id")).alias("r")
    return saved.groupBy("book_id", "id").agg(last).select("book_id", "id", "r.*")


def name_index(cast: DataFrame) -> DataFrame:
    """(book_id, key, id): whom a name in a dialogue tag means.

    Full names, aliases and epithets come first, with and without a leading "the ", and their last words; then a title
    with the surname, for a character of that gender; then first names that only one character has.  Where keys meet,
    the earlier way wins, then the character that comes first in the cast.
    """
    order = ["ord", "entry_id"]
    base = cast.where(F.col("name").isNotNull() & (strip(F.col("name")) != "")).select(
        "book_id", "id", *order, "name", "notes", _texts("aliases").alias("aliases"), _texts("epithets").alias("epithets")
    )
    said = F.explode(F.concat(F.array("name"), "aliases", "epithets"))
    names = base.select("book_id", "id", *order, said.alias("n"))
    small = F.lower("n")
    keys = F.array_distinct(F.array(small, F.regexp_replace(small, "^the ", ""), F.lower(last_word(F.col("n")))))
    first = names.select("book_id", F.explode(keys).alias("key"), "id", F.lit(1).alias("way"), *order)
    known = gender(F.col("name"), F.col("notes"))
    titles = F.when(known == "male", F.array(F.lit("m."))).when(known == "female", F.array(F.lit("madame"), F.lit("mademoiselle")))
    titled = base.select("book_id", "id", *order, F.lower(last_word(F.col("name"))).alias("surname"), F.explode(titles).alias("t"))
    second = titled.select("book_id", F.concat_ws(" ", "t", "surname").alias("key"), "id", F.lit(2).alias("way"), *order)
    given = base.select("book_id", "id", *order, first_name(F.col("name")).alias("key")).where("key IS NOT NULL")
    single = given.groupBy("book_id", "key").agg(
        F.count_distinct("id").alias("ids"), F.min(F.struct(*order, "id")).alias("f")
    ).where("ids = 1")
    third = single.select("book_id", "key", "f.id", F.lit(3).alias("way"), *[f"f.{c}" for c in order])
    return (
        first.unionByName(second).unionByName(third)
        .groupBy("book_id", "key")
        .agg(F.min_by("id", F.struct("way", *order)).alias("id"))
    )


def cast_summary(cast: DataFrame) -> DataFrame:
    """One line of text for each character: the name and, if there are any, the aliases."""
    others = F.array_join(_texts("aliases"), ", ")
    return cast.select("book_id", "id", F.concat("name", F.when(others != "", F.concat(F.lit(" | "), others)).otherwise("")).alias("line"))


def cast_listing(cast: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, listing): the lines of each book's cast in order, "(empty)" for a book without."""
    line = cast_summary(cast).join(cast.select("book_id", "id", "ord"), ["book_id", "id"])
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "line"))), lambda r: r["line"]), "\n")
    listed = line.groupBy("book_id").agg(rows.alias("listing"))
    return books.select("book_id").distinct().join(listed, "book_id", "left").select("book_id", F.coalesce("listing", F.lit("(empty)")).alias("listing"))


def shares_name(pairs: DataFrame, alias: str = "alias", name: str = "name", aliases: str = "aliases", notes: str = "notes") -> DataFrame:
    """`pairs` with shares_name: whether an alias fits a character.  It does if all its names are the character's; or
    if it leads with one of the names in the character's own and has all of them.  A title of the other gender never
    fits."""
    own = name_tokens(ascii_fold(F.col(name)))
    of_aliases = name_tokens(ascii_fold(F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), " . ")))
    words = name_tokens(ascii_fold(F.col(alias)))
    prepared = pairs.withColumns({"_own": own, "_all": F.array_union(own, of_aliases), "_words": words})
    said = title_gender(F.col(alias))
    known = F.coalesce(title_gender(F.col(name)), F.get(note_genders(F.col(notes)), F.lit(0)))
    inside = F.size(F.array_except("_words", "_all")) == 0
    leads = (F.size("_own") > 0) & (F.size(F.array_except("_own", "_words")) == 0) & F.array_contains("_own", F.get("_words", F.lit(0)))
    fits = (F.size("_words") > 0) & ~F.coalesce(said != known, F.lit(False)) & (inside | leads)
    return prepared.withColumn("shares_name", fits).drop("_own", "_all", "_words")


def dedupe_pairs(cast: DataFrame) -> DataFrame:
    """(book_id, a, b): characters, the earlier first, of whom one's name is among the other's names and aliases, and
    whose genders do not contradict.  Two equi-joins instead of all pairs; only characters with chapters."""
    speaking = cast.where(F.size("chapters") > 0).select(
        "book_id", "id", F.struct("ord", "entry_id").alias("at"), F.lower(proper_alias(F.col("name"))).alias("own"),
        note_genders(F.col("notes")).alias("genders"),
        F.filter(F.transform(F.concat(F.array("name"), _texts("aliases")), lambda a: F.lower(proper_alias(a))), lambda a: a.isNotNull()).alias("names"),
    )
    by_own = speaking.where("own IS NOT NULL").select("book_id", F.col("own").alias("key"), F.struct("at", "id", "genders").alias("x"))
    by_name = speaking.select("book_id", F.explode(F.array_distinct("names")).alias("key"), F.struct("at", "id", "genders").alias("y"))
    met = by_own.join(by_name, ["book_id", "key"]).where("x.id != y.id")
    clear = (F.size("x.genders") > 0) & (F.size("y.genders") > 0) & ~F.arrays_overlap("x.genders", "y.genders")
    earlier = F.col("x.at") < F.col("y.at")
    a, b = F.when(earlier, F.col("x.id")).otherwise(F.col("y.id")), F.when(earlier, F.col("y.id")).otherwise(F.col("x.id"))
    return met.where(~clear).select("book_id", a.alias("a"), b.alias("b")).distinct()


def first_names_once(cast: DataFrame) -> DataFrame:
    """(book_id, first_name): first names that one character alone has."""
    given = cast.where(F.col("name").isNotNull()).select("book_id", "id", first_name(F.col("name")).alias("first_name"))
    return given.where("first_name IS NOT NULL").groupBy("book_id", "first_name").agg(F.count_distinct("id").alias("n")).where("n = 1").drop("n")


def ranked_cast(cast: DataFrame) -> DataFrame:
    """(book_id, id, place): characters by chapters, a proper name before "the ...", lines, and order of appearance."""
    order = [F.size(F.coalesce("chapters", F.array().cast("array<int>"))).desc(), F.lower("name").startswith("the ").asc(), F.coalesce("lines", F.lit(0)).desc(), F.col("ord"), F.col("entry_id")]
    return cast.select("book_id", "id", F.row_number().over(Window.partitionBy("book_id").orderBy(*order)).alias("place"))
