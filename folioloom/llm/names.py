"""Problem 4: variant spellings of the names of persons.

Every name and alias of an entry is read as a form: its words without titles, in plain letters, with what is left to
know of it (a generation, a married form, initials).  Forms of one book meet by MinHash banding over padded q-grams; the
number of bands follows from the collision curve 1 - (1 - J^r)^b, so that forms of a given similarity meet with a given
probability.  Forms that met are compared by Monge-Elkan similarity over their words, in which an inner similarity
knows typing errors, transpositions, initials and short forms of given names; the short forms are learnt from the
table itself, where one entry has both.  Entries linked so are grouped by star clustering, the entry with most links
first, and entries known only by an initial, a given name or a title join the one cluster that they fit, if it is one.

A book with few forms is judged in one task as a whole, a larger one over many tasks; the rules and the result are the
same, and the larger are never collected.

Genders that contradict each other and different generations (the Elder, the Younger) keep entries apart.

Defined results: entries without a usable name or alias are linked to none; null and empty values say nothing; repeated
rows change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioloom.llm.lookalikes import plain
from folioloom.llm.survivor import EMPTY_WORDS, usable
from folioloom.session import materialize, release

# Titles by the gender they tell; fixed values.
FEMALE_TITLES = set("mrs ms miss lady madame mme mlle mademoiselle baroness countess sister aunt frau fräulein fraulein sra señora senora doña dona donna госпожа г-жа श्रीमती".split())
MALE_TITLES = set("mr sir lord baron count father brother uncle monsieur herr hr sr señor senor don г-н господин".split())
OTHER_TITLES = set("dr doctor prof professor captain capt colonel col major general lieutenant judge rev reverend saint mx доктор д-р профессор श्री डॉ जी".split())
MARRIED_TITLES = set("mrs madame mme frau sra señora senora".split())
TITLES = FEMALE_TITLES | MALE_TITLES | OTHER_TITLES
GENERATIONS = {"younger": "2", "junior": "2", "jr": "2", "ii": "2", "elder": "1", "senior": "1", "младший": "2", "старший": "1", "iii": "3"}
HAN_SUFFIXES = ("先生", "女士", "小姐", "太太", "夫人", "さん", "さま", "様", "ちゃん", "くん", "君", "氏", "殿")
HAN_PREFIXES = ("小", "老", "阿")
THAI_PREFIXES = ("คุณ", "นางสาว", "นาย", "นาง", "ดร.", "ด.ช.", "ด.ญ.")

_CJK = re.compile("^[々〆ヶー぀-ヿ㐀-鿿豈-﫿]+$")
_GLUED = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])")
_BREAK = re.compile(r"[\s_,;·・/()（）\[\]]+|(?<=[^\W\d_])[-–—](?=[^\W\d_])")
_DIGITS = str.maketrans("015", "ols")


def _bare(word: str) -> str:
    """A word folded, without accents; marks of other scripts than Latin, Greek and Cyrillic stay."""
    out = unicodedata.normalize("NFKD", word.casefold())
    return unicodedata.normalize("NFC", "".join(c for c in out if not "̀" <= c <= "ͯ"))


def read_form(text: str) -> dict | None:
    """A name as a form: kind, words (sorted), generation, gender by title ('f', 'm', ''), and its key."""
    text = plain(text).strip()
    gender, generation, married, titled = "", "", False, ""
    words: list[str] = []
    initials: list[str] = []
    given_only = False
    for raw in _BREAK.split(_GLUED.sub(" ", text)):
        for prefix in THAI_PREFIXES:
            if raw.startswith(prefix) and len(raw) > len(prefix) + 1:
                raw, titled = raw[len(prefix) :], "khun"
                break
        dotted = raw.endswith(".")
        word = _bare(raw.strip(".'’\"“”‘!?:"))
        if not word:
            continue
        if _CJK.match(word):
            for suffix in HAN_SUFFIXES:
                if word.endswith(suffix) and len(word) > len(suffix):
                    word, titled = word[: -len(suffix)], suffix
                    break
            if word[0] in HAN_PREFIXES and len(word) == 3:
                word, given_only = word[1:], True
            words.append(word)
        elif word.replace(".", "") in TITLES and not (len(word) == 1):
            word = word.replace(".", "")
            if word.isascii():  # with the others a given name goes as well as a family name
                titled = titled or word
            gender = "f" if word in FEMALE_TITLES else "m" if word in MALE_TITLES else gender
            married |= word in MARRIED_TITLES
        elif word in GENERATIONS and words:
            generation = GENERATIONS[word]
        elif word in ("the", "le", "la", "der", "die", "el", "de", "von", "van", "du", "des", "of"):
            continue
        elif len(word) == 1 and not "฀" <= word <= "๿" or dotted and re.fullmatch(r"(?:\w\.)+\w?", raw):
            initials += [c for c in word if c.isalpha()]
        elif any(c.isalpha() for c in word):
            word = word.translate(_DIGITS) if re.search(r"[a-z]", word) and re.search(r"\d", word) else word
            words.append(word + "." if dotted and len(word) <= 5 else word)
    if not words:
        return None
    if all(_CJK.match(w) for w in words):
        joined = "".join(words)
        kind = "full" if len(words) > 1 or not given_only and (len(joined) > 2 and not re.fullmatch("[ぁ-ゖァ-ヺー]+", joined)) else "single"
        # The same person may be written family name first or last: the least rotation stands for all.
        words = [min(joined[i:] + joined[:i] for i in range(len(joined)))] if kind == "full" else [joined]
        script = "cjk"
    else:
        script = "letters"
        if len(words) > 1:
            kind = "married" if married else "full"
        elif initials:
            kind = "initial"
        else:
            kind = "titled" if titled and titled != "khun" else "single"
    words = sorted(words)
    if kind == "initial":
        words = [*words, *(i + "." for i in initials[:1])]
    if kind == "titled":
        words = [*words, titled]
    return {
        "kind": kind, "script": script, "words": words, "generation": generation, "gender": gender,
        "key": "|".join([kind, generation if kind == "full" else "", *words]),
    }


def grams(words: list[str], script: str, q: int = 2) -> list[str]:
    """Padded q-grams of each word; of names without spaces single characters and pairs, the pair around the ends too, as
    such a name is kept in one of its rotations."""
    if script == "cjk":
        joined = "".join(words)
        around = joined + joined[0] if len(joined) > 2 else joined
        return sorted({*joined, *(around[i : i + 2] for i in range(len(around) - 1))})
    out = set()
    for w in words:
        padded = "^" + w.rstrip(".") + ("$" if not w.endswith(".") else "")
        out.update(padded[i : i + q] for i in range(len(padded) - q + 1))
    return sorted(out)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of `rows` hashes with which sets of this Jaccard similarity share a band with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


@lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and transpositions of neighbours between two words."""
    before: list[int] = []
    last, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
    return row[-1]


# Spellings of one sound, in this order; fixed values.
_SOUNDS = (("ough", "ow"), ("eaux", "o"), ("eau", "o"), ("ault", "olt"), ("aux", "o"), ("au", "o"), ("ph", "f"), ("ck", "k"), ("y", "i"), ("w", "v"))


@lru_cache(100_000)
def sound(word: str) -> str:
    """A word with spellings of one sound made one, and no letter twice in a row."""
    for spelling, one in _SOUNDS:
        word = word.replace(spelling, one)
    return re.sub(r"(.)\1+", r"\1", word)


@lru_cache(200_000)
def word_similarity(a: str, b: str) -> float:
    """1 for equal words, less for typing errors, 0.9 for a short form with a point."""
    if a == b:
        return 1.0
    if a.endswith(".") or b.endswith("."):
        short, long = sorted((a.rstrip("."), b.rstrip(".")), key=len)
        rest = iter(long)
        return 0.9 if len(short) > 1 and short[0] == long[0] and all(c in rest for c in short) else 0.0
    n = max(len(a), len(b))
    if min(len(a), len(b)) < 4:
        return 0.0
    if sound(a) == sound(b):
        return 0.94
    d = edits(a, b)
    # One error in four letters, two from six on.
    return 1 - d / n if d == 1 or d == 2 and n >= 6 or d == 3 and n >= 12 else 0.0


def monge_elkan(a: list[str], b: list[str], full: dict[str, set[str]]) -> tuple[float, float, int]:
    """Symmetric Monge-Elkan similarity of two word lists, the least similar word's similarity, equal words.
    full: longer forms of short given names."""

    def inner(x: str, y: str) -> float:
        s = word_similarity(x, y)
        if s < 0.95 and (y in full.get(x, ()) or x in full.get(y, ()) or full.get(x, set()) & full.get(y, set())):
            s = 0.95
        return s

    table = [[inner(x, y) for y in b] for x in a]
    ahead = [max(row) for row in table]
    back = [max(table[i][j] for i in range(len(a))) for j in range(len(b))]
    shorter = ahead if len(a) < len(b) else back if len(b) < len(a) else ahead + back
    return sum(shorter) / len(shorter), min(shorter), sum(s >= 0.95 for s in (ahead if len(a) <= len(b) else back))


def compare(a: dict, b: dict) -> str:
    """'strong', 'weak' or '' for two forms of a book; each a dict of kind, script, words, generation and full (longer
    forms of its words)."""
    ka, kb = a["kind"], b["kind"]
    if ka == kb == "full" and a["generation"] != b["generation"] and a["generation"] and b["generation"]:
        return ""
    if a["key"] == b["key"]:
        return "strong" if ka in ("full", "initial", "married") else "weak"
    if a["script"] != b["script"]:
        return ""
    wa, wb = a["words"], b["words"]
    if a["script"] == "cjk":
        if ka == kb == "full":
            return ""
        if ka == "single" and kb == "full" or kb == "single" and ka == "full":
            part, whole = (wa[0], wb[0]) if ka == "single" else (wb[0], wa[0])
            # The name is kept as its least rotation, so the part may lie across its ends.
            return "weak" if len(part) > 1 and part in whole + whole else ""
        return ""
    if "married" in (ka, kb):
        if ka != kb:
            return ""
    kinds = {ka, kb}
    full = a["full"] | b["full"]
    if kinds <= {"full", "married"}:
        if min(len(wa), len(wb)) < 2:
            return ""
        mean, least, equal = monge_elkan(wa, wb, full)
        if least >= 0.65 and (equal >= 1 and mean >= 0.82 or mean >= 0.85):
            return "strong" if a["generation"] == b["generation"] else "weak"
        return ""
    if kinds == {"full", "initial"} or kinds == {"initial"}:
        if ka == kb:
            mean, least, _ = monge_elkan(wa[:1], wb[:1], full)
            return "strong" if least >= 0.8 and wa[1] == wb[1] else ""
        short, long = (wa, wb) if ka == "initial" else (wb, wa)
        for k, w in enumerate(long):
            if word_similarity(short[0], w) >= 0.7:
                if any(x[0] == short[1][0] or any(y[0] == short[1][0] for y in full.get(x, ())) for i, x in enumerate(long) if i != k):
                    return "weak"
        return ""
    if kinds == {"full", "single"}:
        short, long = (wa, wb) if ka == "single" else (wb, wa)
        return "weak" if monge_elkan(short, long, full)[2] else ""
    if kinds == {"titled"}:
        return "weak" if wa[1] == wb[1] and word_similarity(wa[0], wb[0]) >= 0.8 else ""
    return ""


# ---- MinHash over q-grams: the same signature whether a book is judged in one task or in many ----

SIMILARITY, RECALL, ROWS = 0.35, 0.985, 2
_BASE = np.random.default_rng(4)
_TIMES = _BASE.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _BASE.integers(0, 1 << 63, 4096, dtype=np.uint64)


@lru_cache(500_000)
def _gram_hash(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram)


def band_keys(all_grams: list[list[str]], similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> np.ndarray:
    """A row of band keys for each set of q-grams; sets of the similarity share a key with the probability `recall`."""
    bands = bands_for(similarity, recall, rows)
    starts = np.cumsum([0, *map(len, all_grams[:-1])])
    h = np.array([_gram_hash(g) for grams in all_grams for g in grams], np.uint64)
    with np.errstate(over="ignore"):
        out = np.empty((len(all_grams), bands), np.uint64)
        for k in range(bands):
            key = np.full(len(all_grams), k, np.uint64)
            for r in range(k * rows, (k + 1) * rows):
                mixed = h * _TIMES[r] + _PLUS[r]
                least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)
                key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            out[:, k] = key
    return out


# ---- forms of entries ----

_FORM_ROW = T.StructType(
    [
        T.StructField("book_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("gender", T.StringType()),
        T.StructField("generation", T.StringType()), T.StructField("key", T.StringType()), T.StructField("own", T.BooleanType()),
        T.StructField("texts", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("script", T.StringType()),
        T.StructField("words", T.ArrayType(T.StringType())), T.StructField("form_generation", T.StringType()),
    ]
)
_SEP = "\x1f"
_read = lru_cache(200_000)(read_form)


def _id_forms(key: tuple, texts: dict[str, bool], told: set[str]) -> list[tuple]:
    """Rows of forms of one id.  texts: whether each is the name (True) or an alias; told: genders in the notes."""
    forms: dict[str, list] = {}
    titles, generations = set(), set()
    for text, own in sorted(texts.items()):
        form = _read(text)
        if form is not None:
            held = forms.setdefault(form["key"], [form, False, 0])
            held[1] |= own
            held[2] += 1
            titles.add(form["gender"])
            if own and form["generation"]:
                generations.add(form["generation"])
    said = told & {"m", "f"} or titles & {"m", "f"}
    if told >= {"m", "f"}:
        said = titles & {"m", "f"}
    gender = next(iter(said)) if len(said) == 1 else None
    return [(*key, gender, max(generations, default=""), k, own, n, f["kind"], f["script"], f["words"], f["generation"] if f["kind"] == "full" else "") for k, (f, own, n) in forms.items()]


def entry_forms(cast: DataFrame) -> DataFrame:
    """Forms (book_id, id, gender, generation, key, own, texts, kind, script, words, form_generation) that an id is
    known by; gender and generation are the id's, from its notes and titles.  own: the form comes from the name, not
    from an alias.  Descriptions (epithets) are shared by persons and say nothing."""
    noted = F.transform(F.element_at("notes", "gender"), lambda x: F.lower(F.trim(x)))
    has = lambda g: F.coalesce(F.array_contains(noted, g), F.lit(False))
    names = F.when(usable(F.col("name")), F.col("name"))
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.contains(_SEP))
    rows = cast.where(F.col("book_id").isNotNull() & F.col("id").isNotNull())
    # Rows delivered again are one before they are shuffled by id.
    rows = rows.select("book_id", "id", names.alias("name"), F.array_join(aliases, _SEP).alias("aliases"), has("male").alias("m"), has("female").alias("f")).distinct()
    schema = to_arrow_schema(_FORM_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, texts, told = None, {}, set()
        for batch in batches:
            for book, id_, name, more, m, f in zip(*[c.to_pylist() for c in batch.columns]):
                if (book, id_) != held:
                    if held is not None:
                        out += _id_forms(held, texts, told)
                    held, texts, told = (book, id_), {}, set()
                if name is not None:
                    texts[name] = True
                for alias in more.split(_SEP) if more else ():
                    if alias.strip().lower() not in EMPTY_WORDS:
                        texts.setdefault(alias, False)
                told |= {g for g, yes in (("m", m), ("f", f)) if yes}
            if len(out) > 5000:
                yield _rows(out, schema)
                out = []
        if held is not None:
            out += _id_forms(held, texts, told)
        if out:
            yield _rows(out, schema)

    return rows.repartition("book_id", "id").sortWithinPartitions("book_id", "id").mapInArrow(run, _FORM_ROW)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def short_forms(forms: DataFrame, least_books: int = 2) -> DataFrame:
    """(word, full ARRAY<STRING>): given names that stand for others, learnt where an id has two forms that agree in all
    words but one, or an alias of one word beside a full name; a pair counts from `least_books` books on, and in the
    second case if it makes up half of the books with that alias.  Each form is held against the id's commonest full
    one, so that no id, however many forms it has, gives more pairs than forms."""
    letters = forms.where(F.col("script") == "letters")
    full = letters.where((F.col("kind") == "full") & (F.size("words") == 2))
    hub = full.groupBy("book_id", "id").agg(F.max_by("words", F.struct("texts", "key")).alias("hub"))
    words = F.col("words")
    first = lambda x: F.get(x, F.lit(0))
    pairs = (
        full.join(hub, ["book_id", "id"])
        .where(F.size(F.array_intersect(words, "hub")) == 1)
        .select("book_id", first(F.array_except(words, "hub")).alias("a"), first(F.array_except("hub", words)).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL")
    )
    alone = (
        letters.where((F.col("kind") == "single") & ~F.col("own"))
        .join(hub, ["book_id", "id"])
        .select("book_id", first(words).alias("a"), "hub")
        .where(~F.array_contains(F.col("hub"), F.col("a")))
    )
    of_word = alone.groupBy("a").agg(F.count_distinct("book_id").alias("all_books"))
    beside = (
        alone.select("book_id", "a", F.explode("hub").alias("b"))
        .groupBy("a", "b")
        .agg(F.count_distinct("book_id").alias("books"))
        .join(of_word, "a")
        .where((F.col("books") >= least_books) & (F.col("books") * 2 >= F.col("all_books")))
        .select("a", "b", "books")
    )
    both = pairs.unionByName(pairs.select("book_id", F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.groupBy("a", "b").agg(F.count_distinct("book_id").alias("books")).where(F.col("books") >= least_books)
    counted = counted.unionByName(beside).unionByName(beside.select(F.col("b").alias("a"), F.col("a").alias("b"), "books"))
    counted = counted.groupBy("a", "b").agg(F.max("books").alias("books"))
    # All of them, the commonest first.
    return counted.groupBy(F.col("a").alias("word")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("books", "b"))))["b"].alias("full"))


def candidate_forms(forms: DataFrame) -> DataFrame:
    """Pairs (book_id, a, b) of a book's forms (book_id, key, words, script) that share a band, a < b."""

    @F.pandas_udf("array<bigint>")
    def bands(words: pd.Series, scripts: pd.Series) -> pd.Series:
        if not len(words):
            return pd.Series([], dtype=object)
        return pd.Series(list(band_keys([grams(list(w), s) for w, s in zip(words, scripts)]).view(np.int64)))

    banded = forms.select("book_id", "key", F.explode(bands("words", "script")).alias("band"))
    left = banded.select("book_id", "band", F.col("key").alias("a"))
    right = banded.select("book_id", "band", F.col("key").alias("b"))
    return left.join(right, ["book_id", "band"]).where("a < b").select("book_id", "a", "b").distinct()


def _judge(pairs: DataFrame) -> DataFrame:
    """(book_id, a, b, link) of the pairs whose forms are alike.  pairs: with fa and fb, the forms, and na and nb, the
    longer forms of their words as a map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for a, b, fa, fb, na, nb in zip(batch["a"], batch["b"], batch["fa"], batch["fb"], batch["na"], batch["nb"]):
                x = {"key": a, "kind": fa["kind"], "script": fa["script"], "words": list(fa["words"]), "generation": fa["generation"], "full": {w: set(v) for w, v in dict(na or {}).items()}}
                y = {"key": b, "kind": fb["kind"], "script": fb["script"], "words": list(fb["words"]), "generation": fb["generation"], "full": {w: set(v) for w, v in dict(nb or {}).items()}}
                links.append(compare(x, y))
            out = batch[["book_id", "a", "b"]].assign(link=links)
            yield out[out["link"] != ""]

    return pairs.mapInPandas(run, "book_id string, a string, b string, link string")


def entry_links(forms: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids (book_id, id), and links (book_id, a, b, strong) between ids of a book, a < b.  forms: see `entry_forms`;
    names: see `short_forms`.  Books of any size, over many tasks."""
    ids = forms.select("book_id", "id", "gender", "generation").distinct()
    # The longer forms of each form's words.
    form = F.struct("kind", "script", "words", F.col("form_generation").alias("generation"), "key").alias("form")
    words = forms.groupBy("book_id", "key").agg(F.first("words").alias("words"), F.first("script").alias("script"), F.first("kind").alias("kind"), F.first("form_generation").alias("form_generation"))
    word = words.select("book_id", "key", F.explode("words").alias("word"))
    longer = word.join(names, "word").groupBy("book_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("word", "full"))).alias("more"))
    known = materialize(words.join(longer, ["book_id", "key"], "left").select("book_id", "key", "words", "script", form, "more"), "known")
    met = candidate_forms(known)
    a = known.select("book_id", F.col("key").alias("a"), F.col("form").alias("fa"), F.col("more").alias("na"))
    b = known.select("book_id", F.col("key").alias("b"), F.col("form").alias("fb"), F.col("more").alias("nb"))
    judged = _judge(met.join(a, ["book_id", "a"]).join(b, ["book_id", "b"]))
    same = known.select(
        "book_id", F.col("key").alias("a"), F.col("key").alias("b"), F.when(F.col("form.kind").isin(*_STRONG_KINDS), "strong").otherwise("weak").alias("link")
    )
    of_a = forms.select("book_id", F.col("key").alias("a"), F.col("id").alias("ida"), (F.col("own") & (F.col("kind") != "full")).alias("own_a"))
    of_b = forms.select("book_id", F.col("key").alias("b"), F.col("id").alias("idb"), (F.col("own") & (F.col("kind") != "full")).alias("own_b"))
    alike = judged.unionByName(same)
    # A weak form speaks for a person where somebody goes by it; as an alias it may be a whole family's, and all pairs
    # of those who have it as an alias are never made.
    strong = alike.where("link = 'strong'").join(of_a, ["book_id", "a"]).join(of_b, ["book_id", "b"])
    weak = alike.where("link = 'weak'")
    weak = weak.join(of_a.where("own_a"), ["book_id", "a"]).join(of_b, ["book_id", "b"]).unionByName(weak.join(of_b.where("own_b"), ["book_id", "b"]).join(of_a, ["book_id", "a"]), True)
    pairs = strong.unionByName(weak, True).where("ida != idb")
    linked = pairs.groupBy(
        "book_id", F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")
    ).agg(F.max((F.col("link") == "strong")).alias("strong"))
    ga = ids.select("book_id", F.col("id").alias("a"), F.col("gender").alias("gender_a"), F.coalesce("generation", F.lit("")).alias("gen_a"))
    gb = ids.select("book_id", F.col("id").alias("b"), F.col("gender").alias("gender_b"), F.coalesce("generation", F.lit("")).alias("gen_b"))
    apart = (F.col("gender_a") != F.col("gender_b")) | ((F.col("gen_a") != "") & (F.col("gen_b") != "") & (F.col("gen_a") != F.col("gen_b")))
    links = (
        linked.join(ga, ["book_id", "a"]).join(gb, ["book_id", "b"])
        .where(~F.coalesce(apart, F.lit(False)))
        .select("book_id", "a", "b", (F.col("strong") & (F.col("gen_a") == F.col("gen_b"))).alias("strong"))
    )
    first = materialize(links, "links")
    last = materialize(_one_gender(first, ids), "links")
    release(known, first)
    return ids.select("book_id", "id"), last


def _one_gender(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links without those of an id of unknown gender to the gender that fewer of its strong links have; to both where
    they are as many.  Else it would bring a man and a woman of one name together."""
    known = ids.select("book_id", F.col("id").alias("other"), F.col("gender").alias("g")).where("g IS NOT NULL")
    unknown = ids.where("gender IS NULL").select("book_id", "id")
    both = links.select("book_id", F.col("a").alias("id"), F.col("b").alias("other"), "strong").unionByName(
        links.select("book_id", F.col("b").alias("id"), F.col("a").alias("other"), "strong")
    )
    met = both.join(unknown, ["book_id", "id"]).join(known, ["book_id", "other"])
    count = met.groupBy("book_id", "id").agg(
        F.count_if((F.col("g") == "m") & F.col("strong")).alias("men"), F.count_if((F.col("g") == "f") & F.col("strong")).alias("women")
    ).where("men > 0 AND women > 0")
    fewer = F.when(F.col("g") == "m", F.col("men") <= F.col("women")).otherwise(F.col("women") <= F.col("men"))
    gone = met.join(count, ["book_id", "id"]).where(fewer).select(
        "book_id", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
    )
    return links.join(gone.distinct(), ["book_id", "a", "b"], "left_anti")


def star_clusters(links: DataFrame) -> DataFrame:
    """(book_id, id, star) of ids with a link.  Of the ids not yet in a cluster, one that has more links to such
    than all its neighbours (as many: by a hash, so that rounds are few) is a star; its free neighbours join it, each the
    star with most links.  So on until none is left; who has no free neighbour left stays alone, and has no row.
    links: book_id, a, b, once each."""
    both = links.select("book_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        links.select("book_id", F.col("b").alias("id"), F.col("a").alias("other"))
    )
    free = materialize(both, "free")
    parts = []
    while True:  # every round takes at least one star, that of most links, and its neighbours out of each component
        degree = free.groupBy("book_id", "id").agg(F.struct(F.count("*").alias("n"), F.xxhash64("id").alias("by"), F.col("id").alias("key")).alias("weight"))
        other = degree.select("book_id", F.col("id").alias("other"), F.col("weight").alias("other_weight"))
        seen = free.join(other, ["book_id", "other"])
        best = seen.groupBy("book_id", "id").agg(F.max("other_weight").alias("best")).join(degree, ["book_id", "id"])
        stars = best.where(F.col("weight") > F.col("best")).select("book_id", F.col("id").alias("other"), F.col("weight").alias("star_weight"))
        joined = (
            free.join(stars, ["book_id", "other"]).groupBy("book_id", "id").agg(F.max_by("other", "star_weight").alias("star"))
        )
        part = joined.unionByName(stars.select("book_id", F.col("other").alias("id"), F.col("other").alias("star")))
        part = materialize(part, "stars")
        parts.append(part)
        gone = part.select("book_id", "id")
        rest = free.join(gone, ["book_id", "id"], "left_anti").join(gone.withColumnRenamed("id", "other"), ["book_id", "other"], "left_anti")
        rest = materialize(rest, "free")
        release(free)
        free = rest
        if free.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _persons_of_links(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(book_id, id, person) from links over many tasks."""
    stars = star_clusters(links.where("strong"))
    placed = materialize(
        ids.join(stars, ["book_id", "id"], "left").select("book_id", "id", F.coalesce("star", "id").alias("star")), "placed"
    )
    # Weak links: an id joins the cluster that it fits, if it fits one only and is in none yet.
    size = placed.groupBy("book_id", "star").agg(F.count("*").alias("members"))
    at = placed.join(size, ["book_id", "star"])
    weak = links.where(~F.col("strong"))
    both = weak.select("book_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        weak.select("book_id", F.col("b").alias("id"), F.col("a").alias("other"))
    )
    goal = at.select("book_id", F.col("id").alias("other"), F.col("star").alias("goal"), F.col("members").alias("goal_members"))
    fits = (
        both.join(at.where("members = 1"), ["book_id", "id"])
        .join(goal, ["book_id", "other"])
        .groupBy("book_id", "id")
        .agg(F.count_distinct("goal").alias("goals"), F.max("goal").alias("goal"), F.max("goal_members").alias("goal_members"))
        .where("goals = 1")
        # Of two single ids that fit each other, one moves.
        .where((F.col("goal_members") > 1) | (F.col("goal") < F.col("id")))
        .select("book_id", "id", "goal")
    )
    moved = placed.join(fits, ["book_id", "id"], "left").select("book_id", "id", F.coalesce("goal", "star").alias("star"))
    # One step more, for an id that moved to one that moved itself.
    up = fits.select("book_id", F.col("id").alias("star"), F.col("goal").alias("up"))
    return moved.join(up, ["book_id", "star"], "left").select("book_id", "id", F.coalesce("up", "star").alias("person"))


# ---- a whole book in one task ----

MOST_FORMS, MOST_SHORT = 4000, 100_000
_STRONG_KINDS = ("full", "initial", "married")


def _candidates(forms: list[dict]) -> list[tuple[int, int]]:
    """Places of forms that share a band."""
    keys = band_keys([grams(f["words"], f["script"]) for f in forms])
    n = len(forms)
    met = np.zeros((n, n), bool)
    for k in range(keys.shape[1]):
        column = keys[:, k]
        met |= column[:, None] == column[None, :]
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(met, 1)))))


def book_links(rows: list[tuple], names: dict[str, set[str]]) -> tuple[dict[str, tuple], dict[tuple[str, str], bool]]:
    """Gender and generation of a book's ids, and its links (a, b) -> strong, a < b: what `entry_links` gives."""
    about, forms, holders = {}, {}, defaultdict(list)
    for _, id_, gender, generation, key, own, _, kind, script, words, form_generation in rows:
        about[id_] = gender, generation or ""
        if key not in forms:
            more = {w: names[w] for w in words if w in names}
            forms[key] = {"key": key, "kind": kind, "script": script, "words": words, "generation": form_generation, "full": more}
        holders[key].append((id_, own and kind != "full"))
    order = [forms[k] for k in sorted(forms, key=lambda k: k.encode())]
    alike = [(f, f, "strong" if f["kind"] in _STRONG_KINDS else "weak") for f in order]
    alike += [(order[i], order[j], link) for i, j in _candidates(order) if (link := compare(order[i], order[j]))]
    links: dict[tuple[str, str], bool] = {}
    for x, y, link in alike:
        here, there = holders[x["key"]], holders[y["key"]]
        if link == "weak":
            met = [(a, b) for a, own in here if own for b, _ in there] + [(a, b) for b, own in there if own for a, _ in here]
        else:
            met = [(a, b) for a, _ in here for b, _ in there]
        for a, b in met:
            if a != b:
                pair = (a, b) if a.encode() < b.encode() else (b, a)
                links[pair] = links.get(pair, False) or link == "strong"
    kept = {}
    for (a, b), strong in links.items():
        (ga, na), (gb, nb) = about[a], about[b]
        if not (ga and gb and ga != gb or na and nb and na != nb):
            kept[a, b] = strong and na == nb
    return about, _fit_genders(about, kept)


def _fit_genders(about: dict[str, tuple], links: dict[tuple[str, str], bool]) -> dict[tuple[str, str], bool]:
    """As `_one_gender`."""
    count: dict[str, dict[str, int]] = defaultdict(lambda: {"m": 0, "f": 0})
    for (a, b), strong in links.items():
        for x, y in ((a, b), (b, a)):
            if about[x][0] is None and about[y][0] and strong:
                count[x][about[y][0]] += 1
    gone = set()
    for a, b in links:
        for x, y in ((a, b), (b, a)):
            g = about[y][0]
            if about[x][0] is None and g and x in count and count[x]["m"] and count[x]["f"] and count[x][g] <= count[x]["m" if g == "f" else "f"]:
                gone.add((a, b))
    return {k: v for k, v in links.items() if k not in gone}


def book_stars(links: Iterable[tuple[str, str]]) -> dict[str, str]:
    """As `star_clusters`."""
    free: dict[str, set[str]] = defaultdict(set)
    for a, b in links:
        free[a].add(b)
        free[b].add(a)
    out: dict[str, str] = {}
    by = {x: xxhash.xxh64_intdigest(x.encode(), 42) for x in free}
    by = {x: (h - (1 << 64) if h >> 63 else h, x.encode()) for x, h in by.items()}
    while free:
        weight = {x: (len(n), *by[x]) for x, n in free.items()}
        stars = {x for x, n in free.items() if all(weight[x] > weight[y] for y in n)}
        taken = {x: max((y for y in n if y in stars), key=weight.__getitem__) for x, n in free.items() if x not in stars and n & stars}
        taken |= {x: x for x in stars}
        out |= taken
        free = {x: rest for x, n in free.items() if x not in taken and (rest := n - taken.keys())}
    return out


def book_persons(rows: list[tuple], names: dict[str, set[str]]) -> dict[str, str]:
    """Id -> person of one book, from its rows of forms: the same as over many tasks."""
    about, links = book_links(rows, names)
    placed = {x: x for x in about} | book_stars(k for k, strong in links.items() if strong)
    members = Counter(placed.values())
    goals: dict[str, set[str]] = defaultdict(set)
    for (a, b), strong in links.items():
        if not strong:
            for x, y in ((a, b), (b, a)):
                if members[placed[x]] == 1:
                    goals[x].add(placed[y])
    fits = {}
    for x, g in goals.items():
        goal = next(iter(g))
        # Of two single ids that fit each other, one moves.
        if len(g) == 1 and (members[goal] > 1 or goal.encode() < x.encode()):
            fits[x] = goal
    moved = {x: fits.get(x, star) for x, star in placed.items()}
    return {x: fits.get(star, star) for x, star in moved.items()}


_PERSON = T.StructType(
    [T.StructField("book_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("person", T.StringType()), T.StructField("others", T.ArrayType(T.StringType()))]
)


def _by_book(forms: DataFrame, names: dict[str, set[str]], most: int) -> DataFrame:
    """(book_id, id, person, others) of books of at most `most` forms; others: ids of the person after this one."""
    schema = to_arrow_schema(_PERSON)
    sent = forms.sparkSession.sparkContext.broadcast(names)

    def judged(rows: list[tuple]) -> list[tuple]:
        if len(rows) > most:
            return []
        persons = book_persons(rows, sent.value)
        groups: dict[str, list[str]] = defaultdict(list)
        for x in sorted(persons, key=str.encode):
            groups[persons[x]].append(x)
        return [(rows[0][0], x, p, g[k + 1 :]) for p, g in groups.items() for k, x in enumerate(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    out += judged(held)
                    held = []
                if len(held) <= most:  # a larger book is told apart by one row more, and dropped here
                    held.append(row)
            if len(out) > 5000:
                yield _rows(out, schema)
                out = []
        if held:
            out += judged(held)
        if out:
            yield _rows(out, schema)

    return forms.repartition("book_id").sortWithinPartitions("book_id").mapInArrow(run, _PERSON)


def persons_with_others(cast: DataFrame, most_forms: int = MOST_FORMS, most_short: int = MOST_SHORT) -> tuple[DataFrame | None, DataFrame | None]:
    """Persons of the books of at most `most_forms` forms, judged a book a task (with others, see `_by_book`), and
    (book_id, id, person) of all larger ones, judged over many tasks by the same rules; None for none.  Short forms of
    given names are learnt from all books, and sent to the tasks if they are at most `most_short`."""
    forms = materialize(entry_forms(cast), "forms")
    names = materialize(short_forms(forms), "short")
    sizes = forms.groupBy("book_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most_forms).select("book_id")
    known = names.limit(most_short + 1).collect()
    if len(known) > most_short:
        return None, _persons_of_links(*entry_links(forms, names))
    small = _by_book(forms, {r["word"]: set(r["full"]) for r in known}, most_forms)
    if large.isEmpty():
        return small, None
    return small, _persons_of_links(*entry_links(materialize(forms.join(large, "book_id", "left_semi"), "large"), names))


def same_persons(cast: DataFrame, **most: int) -> DataFrame:
    """(book_id, id, person) of every id of the table that has a name; person: one id of the cluster."""
    small, large = persons_with_others(cast, **most)
    parts = [p.select("book_id", "id", "person") for p in (small, large) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def same_person_pairs(cast: DataFrame, **most: int) -> DataFrame:
    """(book_id, id_a, id_b): all pairs of different ids of one person, id_a < id_b in byte order."""
    small, large = persons_with_others(cast, **most)
    parts = []
    if small is not None:
        parts.append(small.select("book_id", F.col("id").alias("id_a"), F.explode("others").alias("id_b")))
    if large is not None:
        persons = materialize(large, "persons")
        a = persons.select("book_id", "person", F.col("id").alias("id_a"))
        b = persons.select("book_id", "person", F.col("id").alias("id_b"))
        parts.append(a.join(b, ["book_id", "person"]).where("id_a < id_b").select("book_id", "id_a", "id_b"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
