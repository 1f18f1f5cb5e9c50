"""Problem 5: one consistent form for text that looks the same, in SQL.

Each value is mapped: look-alike letters of another script, compatibility forms, odd spaces and invisible characters
become what the reader sees.  Mapped values are grouped under an accent-sensitive Unicode collation, in which composed
and decomposed letters are equal, too.  Of each class one canonical member is chosen, the least one in byte order that
its own mapping leaves as it is; a class without such gets its least mapped value.  The choice is joined back to the
rows whose value is not it.  What cannot be changed by the mapping, nor be in a class with anything else, is told by
regular expressions and hashes and goes neither through the mapping nor through the collation.

Defined results: null stays null, and a null or unknown language is taken as one with Latin letters; empty and blank
values are ordinary unless their spaces are odd ones; repeated rows are rows like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.lookalikes import (
    CYRILLIC_AS_LATIN,
    GREEK_AS_LATIN,
    LATIN_AS_CYRILLIC,
    MARKS_AS_PLAIN,
    OTHER_AS_LATIN,
    invisible,
    odd_spaces,
)
from folioloom.session import materialize

COLLATION = "UNICODE"  # tertiary strength: accents and case tell values apart, composition and format characters do not
_CYRILLIC_REAL = "БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁУбвгджзийклмнптфцчшщъыьэюяё"
_GREEK_REAL = "ΓΔΘΛΞΠΣΦΨΩαβγδεζηθικλμξπρστυφχψωάέήίόύώϊϋ"
_JOINERS = "‌‍"
_TWINS = (("เเ", "แ"), ("ํา", "ำ"), ("अा", "आ"), ("एे", "ऐ"))  # fixed values: two signs that look like one
_PICTURES = f"{chr(0x1F000)}-{chr(0x1FAFF)}"  # as characters: Java looks behind for two units only if it sees them
_SELECTORS = "".join(map(chr, range(0xFE00, 0xFE10)))


def _folded(first: int, last: int) -> dict[str, str]:
    """Compatibility characters of a range that stand for one other character, by the Unicode database."""
    out = {}
    for c in map(chr, range(first, last + 1)):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and len(plain) == 1:
            out[c] = plain
    return out


@cache
def everywhere() -> dict[str, str]:
    """Character to character in every language."""
    table = {c: " " for c in odd_spaces() if c != "　"}
    table |= {a: b for a, b in (MARKS_AS_PLAIN | OTHER_AS_LATIN).items() if len(b) == 1}
    wide = _folded(0xFF01, 0xFF5E)
    table |= {a: b for a, b in wide.items() if b.isalnum()}
    # Radicals and compatibility ideographs, half-width kana and its marks.
    table |= _folded(0x2E80, 0x2FDF) | _folded(0xF900, 0xFAD9) | _folded(0xFF61, 0xFF9F)
    # Letters in the styles of mathematics.
    return table | _folded(0x1D400, 0x1D7FF) | _folded(0x210A, 0x2113)


@cache
def _outside_east_asia() -> dict[str, str]:
    """Full-width marks and the ideographic space, which Chinese and Japanese write rightly."""
    wide = {a: b for a, b in _folded(0xFF01, 0xFF5E).items() if not b.isalnum()}
    return wide | {"　": " "}


@cache
def _compositions() -> dict[str, str]:
    """Letter with one combining mark to the composed letter; letters of the languages' scripts and kana."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x3041, 0x30FF), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            out[parts] = c
    return out


def _translate(text: Column, table: dict[str, str]) -> Column:
    # The JVM's translate goes by code point; one string each is a constant of the plan.
    return F.translate(text, "".join(table), "".join(table.values()))


def _pieces(text: Column) -> Column:
    """A text cut beside spaces, dashes and brackets; joined again it is the text."""
    return F.split(text, r"(?<=[\s_/\-—–(«“‘])|(?=[\s_/\-—–)»”’])")


def _beside(pieces: Column, step: int) -> Column:
    """Each piece's neighbour `step` to the right (left if negative); empty beyond the ends."""
    n, edge = F.size(pieces), F.array_repeat(F.lit(""), abs(step))
    if step > 0:
        return F.concat(F.slice(pieces, F.lit(step + 1), F.greatest(n - step, F.lit(0))), edge)
    return F.slice(F.concat(edge, pieces), F.lit(1), n)


def _letters(text: Column, pieces: Column, russian: Column) -> Column:
    """Words in which letters only look like those of the word's script, with the script's own."""
    latin = CYRILLIC_AS_LATIN | GREEK_AS_LATIN
    real = f"[{_CYRILLIC_REAL}{_GREEK_REAL}]"
    cyrillic_real, any_cyrillic = f"[{_CYRILLIC_REAL}]", r"\p{IsCyrillic}"
    only_alike = "".join(LATIN_AS_CYRILLIC)
    latin_real = rf"[\p{{IsLatin}}&&[^{only_alike}]]"

    def fix(x: Column) -> Column:
        w = x["w"]
        around = F.concat(x["l1"], x["l2"], x["r1"], x["r2"])
        alone = w.rlike(rf"^\P{{L}}*[{only_alike}]+\P{{L}}*$") & around.rlike(any_cyrillic) & ~around.rlike(latin_real)
        to_cyrillic, to_latin = _translate(w, LATIN_AS_CYRILLIC), _translate(w, latin)
        return (
            F.when(w.rlike(cyrillic_real) & w.rlike(f"[{only_alike}]") & ~w.rlike(latin_real), to_cyrillic)
            .when(russian & w.rlike(any_cyrillic) & ~w.rlike(latin_real), to_cyrillic)
            .when(russian & alone, to_cyrillic)
            .when(~w.rlike(real) & (~russian | w.rlike(latin_real)), to_latin)
            .otherwise(w)
        )

    sides = {"l1": -1, "l2": -2, "r1": 1, "r2": 2}  # the next words, and what parts them
    zipped = F.arrays_zip(pieces.alias("w"), *[_beside(pieces, k).alias(name) for name, k in sides.items()])
    suspect = text.rlike(f"[{''.join(latin)}]") | (text.rlike(any_cyrillic) & text.rlike(f"[{only_alike}]"))
    return F.when(suspect, F.array_join(F.transform(zipped, fix), "")).otherwise(text)


def _ordinary(text: Column) -> Column:
    """A text without what shows nothing, its compatibility characters as those they stand for."""
    gone = "".join(c for c in invisible() if c not in _JOINERS + _SELECTORS)
    out = F.translate(text, gone, "")
    # Joiners and selectors shape Indic letters and pictures; elsewhere they show nothing.
    out = F.regexp_replace(out, rf"(?<![\u094D\u0CCD\u0D4D{_PICTURES}\u2600-\u27BF\uFE0F])[{_JOINERS}]", "")
    out = F.regexp_replace(out, rf"(?<![{_PICTURES}\u2190-\u2BFF\u00A9\u00AE#*0-9])[{_SELECTORS}]", "")
    out = _translate(out, everywhere())
    for a, b in (MARKS_AS_PLAIN | OTHER_AS_LATIN).items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in _TWINS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _composed(text: Column) -> Column:
    """Letters with one combining mark as the composed letters."""
    pairs = F.create_map(*[F.lit(x) for kv in _compositions().items() for x in kv])
    marks = "\u0300-\u036F\u3099\u309A"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)[^{marks}][{marks}]?|[{marks}]"), F.lit(0))
    whole = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(pairs, x), x)), "")
    return F.when(text.rlike(f"[{marks}]"), whole).otherwise(text)


def with_seen(values: DataFrame) -> DataFrame:
    """`values` (lang, value) with seen: the value as its reader sees it, in the ordinary characters of its language
    (two letters, lower case).  In steps, each of which uses the one before several times."""
    first = values.withColumn("_first", _ordinary(F.col("value")))
    east = F.col("lang").isin("zh", "ja")
    plain = first.withColumn("_plain", F.when(east, F.col("_first")).otherwise(_translate(F.col("_first"), _outside_east_asia())))
    cut = plain.withColumn("_pieces", _pieces(F.col("_plain")))
    own = cut.withColumn("_own", _letters(F.col("_plain"), F.col("_pieces"), F.col("lang") == "ru"))
    return own.withColumn("seen", _composed(F.col("_own"))).drop("_first", "_plain", "_pieces", "_own")


# ---- which values need the mapping, and which can share a class ----


def character_class(chars: set[str] | frozenset[str] | str) -> str:
    """Inside of a character class of a regular expression."""
    points, out, k = sorted(map(ord, chars)), [], 0
    while k < len(points):
        first = k
        while k + 1 < len(points) and points[k + 1] == points[k] + 1:
            k += 1
        out.append(f"\\x{{{points[first]:X}}}" + (f"-\\x{{{points[k]:X}}}" if k > first else ""))
        k += 1
    return "".join(out)


# What most texts are made of.
_COMMON = (
    (0x20, 0x7E), (0x0A, 0x0A), (0xA1, 0xFF), (0x152, 0x153), (0x400, 0x45F), (0x900, 0x950), (0x958, 0x96F), (0xE01, 0xE5B), (0x2013, 0x2014), (0x2018, 0x201E),
    (0x2026, 0x2026), (0x2039, 0x203A), (0x2116, 0x2116), (0x3000, 0x3002), (0x3005, 0x3011), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF), (0xFF01, 0xFF65),
)


def _rare(chars: set[str]) -> str:
    """A class of characters as a regular expression that is quick at common ones outside it."""
    return f"(?![{character_class(common_characters() - chars)}])[{character_class(chars)}]"


@cache
def common_characters() -> frozenset[str]:
    return frozenset(chr(c) for first, last in _COMMON for c in range(first, last + 1))


@cache
def _odd_chars(east: bool) -> frozenset[str]:
    """What the mapping may change, letters of other scripts aside; in texts of East Asia or elsewhere."""
    chars = set(everywhere()) | set(MARKS_AS_PLAIN) | set(OTHER_AS_LATIN) | set(invisible()) | set(_SELECTORS) | set(_JOINERS)
    chars |= {chr(c) for c in range(0x300, 0x370)} | {"\u3099", "\u309a"}
    return frozenset(chars if east else chars | set(_outside_east_asia()))


@cache
def _loose_chars() -> frozenset[str]:
    """Characters that the collation ignores, and such as are not in composed normal form wherever they stand."""
    ignored = {chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) in ("Cc", "Cf")} - set("\t\n\x0b\x0c\r")
    unstable = {chr(c) for c in range(0x30000) if unicodedata.normalize("NFC", chr(c)) != chr(c)}
    # Marks that compose with what stands before them or may stand in another order; those of Thai see below.
    marks = {chr(c) for c in range(0x300, 0x30000) if unicodedata.combining(chr(c)) and not 0xE00 <= c < 0xE80 and c != 0x94D}
    jamo = {chr(c) for c in range(0x1100, 0x1200)}
    parts = {unicodedata.normalize("NFD", chr(c))[-1] for c in range(0x900, 0x1200) if len(unicodedata.normalize("NFD", chr(c))) > 1}
    return frozenset(ignored | unstable | marks | jamo | parts | set(invisible()))


_LOOSE_PAIRS = "[\\u0E48-\\u0E4B][\\u0E38-\\u0E3A]"  # marks of Thai in the other order


@cache
def _loose() -> str:
    """Pattern of values that another one may equal under the collation; without a match a value equals only itself
    among those without."""
    return f"{_rare(_loose_chars())}|{_LOOSE_PAIRS}"


@cache
def _plain_texts() -> dict[str, str]:
    """Patterns of whole texts that are neither odd nor loose, as most are, by group of languages.  Each allows the
    letters of its own scripts only, so that letters of two scripts never pass."""
    base = {c for c in common_characters() if c < "\u0100" or "\u2000" < c < "\u2200" or c in "\u0152\u0153"} - _loose_chars()
    latin = {c for c in base if "LATIN" in unicodedata.name(c, "")}
    block = lambda first, last: {c for c in common_characters() if first <= c <= last}
    cjk, indic, cyrillic = block("\u3000", "\uffff"), block("\u0900", "\u0e5b"), block("\u0400", "\u045f")
    whole = lambda chars, east=False: f"\\A[{character_class(chars - _loose_chars() - _odd_chars(east))}]*+\\z"
    return {"east": whole(base | cjk, True), "russian": whole(base - latin | cyrillic), "indic": whole(base | indic), "other": whole(base)}


def plain_text(text: Column, lang: Column) -> Column:
    """Whether a text, at a quick look, is neither changed by the mapping nor equal to another under the collation."""
    p = _plain_texts()
    indic = text.rlike(p["indic"]) & ~text.rlike(f"{_LOOSE_PAIRS}|{'|'.join(a for a, _ in _TWINS)}")
    return F.when(lang.isin("zh", "ja"), text.rlike(p["east"])).when(lang == "ru", text.rlike(p["russian"])).when(lang.isin("hi", "th"), indic).otherwise(text.rlike(p["other"]))


@cache
def _unsettled() -> str:
    """Pattern of all that values which the collation takes for equal may differ in: characters that it ignores, marks,
    what can be decomposed, and letters before a mark that composes with them.  From the Unicode database."""
    ignored = {chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) in ("Cc", "Cf", "Mn", "Mc", "Me")} - set("\t\n\x0b\x0c\r")
    parted = {chr(c) for c in range(0x30000) if not 0xAC00 <= c < 0xD7A4 and unicodedata.normalize("NFD", chr(c)) != chr(c)}
    more = {chr(c) for c in range(0x1100, 0x1200)} | {chr(c) for c in range(0xAC00, 0xD7A4)} | set(invisible())
    return f"{_rare(ignored | parted | more)}|.(?=[\\u0300-\\u036F\\u3099\\u309A\\u093C])"


def _looked_at(values: DataFrame) -> DataFrame:
    """The rows with a value, a language for all, and plain, whether a quick look finds nothing."""
    sure = values.where(F.col("value").isNotNull()).withColumn("lang", F.coalesce("lang", F.lit("xx")))
    return sure.withColumn("plain", plain_text(F.col("value"), F.col("lang")))


def _seen(looked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plain rows, which are what they look like, and the others, which go through the mapping; both with seen."""
    plain = looked.where("plain").drop("plain")
    return plain.withColumn("seen", F.col("value")), with_seen(looked.where("NOT plain").drop("plain"))


def _bounded(small: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, int]:
    """A written table, to be broadcast if it has no more than `most` rows, and the number of rows up to there."""
    held = materialize(small, "small")
    n = held.limit(most + 1).count()
    return (F.broadcast(held) if n <= most else held), n


def exceptions(values: DataFrame, most_langs: int = 1000) -> DataFrame:
    """(lang, seen, canonical) of the mapped values that are not their class's canonical member.

    Classes are equal values under the collation.  Its comparisons are slow, so it is asked only where a class can have
    several members: in languages with a loose value, and there for different mapped values that are the same without
    all that the collation may overlook."""
    plain, mapped = _seen(_looked_at(values.select("lang", "value")))
    # As an aggregate: a filter would go below the mapping's steps and write each of them out many times.
    loose = mapped.groupBy("lang").agg(F.max(F.col("seen").rlike(_loose())).alias("loose")).where("loose")
    langs = [r["lang"] for r in loose.limit(most_langs + 1).collect()]
    seen = plain.unionByName(mapped)
    if len(langs) <= most_langs:
        seen = seen.where(F.col("lang").isin(langs))
    settled = F.xxhash64(F.regexp_replace("seen", _unsettled(), ""))
    marked = seen.select("lang", "value", "seen", settled.alias("settled"), F.xxhash64("seen").alias("print"))
    several = marked.groupBy("lang", "settled").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low != high").select("lang", "settled")
    met = marked.join(_bounded(several)[0], ["lang", "settled"], "left_semi")
    # An ordinary member is one that its own mapping leaves as it is; a class without one gets its mapped value.
    members = met.groupBy("lang", "seen").agg(F.max(F.col("value") == F.col("seen")).alias("ordinary"))
    key = F.collate(F.col("seen"), COLLATION)
    canonical = F.coalesce(F.min(F.when(F.col("ordinary"), F.col("seen"))), F.min("seen"))
    classes = members.groupBy("lang", key.alias("class")).agg(canonical.alias("canonical"), F.collect_set("seen").alias("all"))
    return classes.select("lang", F.explode("all").alias("seen"), "canonical").where("seen != canonical")


def with_canonical(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lang, value, canonical) of the rows whose value is not its class's canonical member.

    A row's canonical member is its mapped value, but for the exceptions; those are joined, by broadcast where they are
    few, so that rows are not shuffled, however often a value occurs."""
    other, n = _bounded(exceptions(rows.select("lang", "value")))
    plain, mapped = _seen(_looked_at(rows.select(*keys, "lang", "value")))
    seen = mapped.unionByName(plain) if n else mapped  # a plain value can only be changed by an exception
    canonical = F.coalesce("canonical", "seen")
    met = seen.join(other, ["lang", "seen"], "left").where(canonical != F.col("value"))
    return met.select(*keys, "lang", "value", canonical.alias("canonical"))


def short_language(language: Column) -> Column:
    """Two letters of a language however it is written; null for none."""
    code = F.lower(F.regexp_extract(language, r"^\s*([A-Za-z]{2})(?:$|[^A-Za-z])", 1))
    return F.when(code != "", code)


def book_values(tables: Sequence[tuple[str, DataFrame, str, str]], books: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """(tbl, row_key, field, lang, value) of the named columns of tables with a book_id; lang is the language of the
    book as loaded last.  The books are broadcast only if they are no more than `most_broadcast`."""
    by_book = books.where(F.col("book_id").isNotNull()).groupBy("book_id").agg(
        F.max_by(short_language(F.col("language")), F.struct("loaded_at", "language")).alias("lang")
    )
    if by_book.limit(most_broadcast + 1).count() <= most_broadcast:
        by_book = F.broadcast(by_book)
    out = None
    for name, df, key, field in tables:
        part = df.select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), F.lit(field).alias("field"), "book_id", F.col(field).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.join(by_book, "book_id", "left").select("tbl", "row_key", "field", "lang", "value")
