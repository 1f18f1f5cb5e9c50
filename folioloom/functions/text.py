"""Column expressions on names, quotations and answers of models.

Regular expressions carry (?U), as letters and white space here are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles by gender, words that are no names, verbs of dialogue tags.
FEMALE_TITLES = (
    "madame", "mme", "mademoiselle", "mlle", "countess", "comtesse", "baroness", "baronne", "marquise", "duchess", "duchesse",
    "viscountess", "vicomtesse", "lady", "mrs", "miss", "signora", "mother", "sister", "queen", "princess",
)
MALE_TITLES = (
    "m", "monsieur", "count", "comte", "baron", "marquis", "duke", "duc", "viscount", "vicomte", "sir", "lord", "mr", "signor",
    "father", "brother", "king", "prince", "abbé", "abbe",
)
OTHER_TITLES = ("captain", "doctor", "dr", "general", "major", "citizen", "the", "a", "an", "old", "young", "de", "of", "d")
TITLES = FEMALE_TITLES + MALE_TITLES + OTHER_TITLES
VERBS = (
    "said|replied|cried|asked|muttered|remarked|exclaimed|continued|answered|returned|added|resumed|interrupted|observed|rejoined|"
    "called|whispered|shouted|murmured|stammered|persisted|repeated"
)
# Letters, digits and underscores: combining marks and joiners, which (?U)\w has in Java, are no part of a word here.
WORD = r"\p{L}\p{N}_"
BOUND = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
TAG = rf"^(?:[{WORD}’']+\s+){{0,3}}?(?:{VERBS})\s+((?:the\s+|M\.\s+|Madame\s+|Mademoiselle\s+)?[A-Z][{WORD}’é\-]+)"

JSON_STRING = r'"(?:\\.|[^"\\])*+"'

_EMPTY = "array<string>"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def last_word(text: Column) -> Column:
    return F.regexp_extract(strip(text), r"(?U)(\S+)$", 1)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _bare(word: Column) -> Column:
    return F.rtrim(F.lower(word), F.lit("."))


def is_title(word: Column) -> Column:
    return _bare(word).isin(*TITLES)


def proper_alias(text: Column) -> Column:
    """A name without quotes around it, if some word of it is a proper name and it has at most 60 characters; else
    null."""
    bare = strip(F.regexp_replace(strip(text), r"^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", ""))
    words = all_matches(bare, rf"[{WORD}'’\-]+")
    named = F.exists(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}") & ~is_title(w))
    return F.when((F.char_length(bare) > 0) & (F.char_length(bare) <= 60) & named, bare)


def name_tokens(ascii_text: Column) -> Column:
    """Proper words of a text already folded to ASCII, in order of appearance, once each, in small letters."""
    words = F.filter(all_matches(ascii_text, r"[A-Za-z'\-]+"), lambda w: F.substring(w, 1, 1).rlike("[A-Z]") & ~is_title(w))
    return F.array_distinct(F.transform(words, _bare))


def title_gender(text: Column) -> Column:
    """female or male by a title in the text; null without one."""
    words = F.transform(all_matches(text, r"[A-Za-zÀ-ÿ.]+"), _bare)
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, FEMALE_TITLES))), "female").when(
        F.arrays_overlap(words, F.array(*map(F.lit, MALE_TITLES))), "male"
    )


def note_genders(notes: Column) -> Column:
    """Distinct first words of the gender notes."""
    said = F.filter(F.coalesce(F.try_element_at(notes, F.lit("gender")), F.array().cast(_EMPTY)), lambda g: g.isNotNull() & (strip(g) != ""))
    return F.array_distinct(F.transform(said, lambda g: F.lower(F.regexp_extract(strip(g), r"(?U)^(\S+)", 1))))


def gender(name: Column, notes: Column) -> Column:
    """Gender by title, else by the notes if they agree; else null."""
    noted = note_genders(notes)
    return F.coalesce(title_gender(name), F.when(F.size(noted) == 1, F.get(noted, F.lit(0))))


def first_name(name: Column) -> Column:
    """First word that is no title, of a name with more than one such word."""
    words = F.filter(F.split(strip(name), r"(?U)\s+"), lambda w: ~is_title(w))
    return F.when(F.size(words) > 1, F.lower(F.get(words, F.lit(0))))


def slug(ascii_text: Column) -> Column:
    """Id made of a name already folded to ASCII."""
    made = F.regexp_replace(F.regexp_replace(F.lower(ascii_text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "someone").otherwise(made)


def fold(ascii_text: Column) -> Column:
    """Letters and spaces of a text already folded to ASCII, for comparing with what was heard."""
    return F.regexp_replace(F.lower(ascii_text), "[^a-z ]", "")


def tag_name(text: Column) -> Column:
    """Name in a dialogue tag at the start of a text; empty if there is none."""
    return F.regexp_extract(text, f"(?U){TAG}", 1)


def json_of_answer(raw: Column) -> Column:
    """The JSON object in a model's answer, from the first to the last brace, thoughts left out; null if there is none."""
    bare = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def salvaged_instruct(raw: Column) -> Column:
    """The string "instruct" of an answer whose JSON may be broken elsewhere."""
    text = F.try_variant_get(F.try_parse_json(F.regexp_extract(raw, rf'(?s)"instruct"\s*:\s*({JSON_STRING})', 1)), "$", "string")
    return F.when(strip(text) != "", strip(text))


def line_count(said: Column) -> Column:
    """Number at the start of what a model calls a count of lines; 0 if it is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(strip(said), r"(?U)^(\d{1,9})(?:\s|$)", 1), F.lit("999999999")).cast("int"), F.lit(0))


def chunks(text: Column, most: int = 400) -> Column:
    """Pieces of about `most` characters, cut after sentences; a sentence longer than that stays whole."""
    parts = F.split(text, r"(?U)(?<=[.!?;])\s+")

    def pack(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.char_length(acc["cur"]) + F.char_length(s) > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, s).otherwise(strip(F.concat(acc["cur"], F.lit(" "), s))).alias("cur"),
        )

    start = F.struct(F.array().cast(_EMPTY).alias("done"), F.lit("").alias("cur"))
    packed = F.aggregate(parts, start, pack, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(packed)


def quote_marks(text: Column) -> Column:
    """Opening curly quotes and straight ones of a text."""
    return sum((F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in "“\""), F.lit(0))


def short_title(title: Column) -> Column:
    """A chapter's title without its number, fit for a file's name."""
    return F.replace(F.regexp_replace(title, r"(?U)^Chapter\s+\d+\.\s*", ""), F.lit("/"), F.lit("-"))
