"""Problem 3: sentence boundaries in many languages and scripts, in SQL expressions alone.

A text is cut into paragraphs at blank lines, and each paragraph goes through three steps.  Mask: full stops that end
nothing (decimals, addresses, initials, abbreviations, ordinals, pauses) become private-use characters of the same
length, and straight double quotes become opening and closing ones.  Split: the terminators of each kind of script mark
the ends, closing marks included, unless what follows goes on with the sentence: a small letter, a clause telling who
speaks, a particle that binds a citation.  Restore: as every placeholder has the length of what it stands for, a
sentence is the part of the stored text between two ends.

Defined results: null and blank texts have no sentences; a text of one line without terminators is one sentence; texts
of any length are read whole.  Private-use characters in a text count as ordinary characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.equal_looking import character_class, common_characters, everywhere
from folioloom.llm.lookalikes import CYRILLIC_AS_LATIN, GREEK_AS_LATIN
from folioloom.llm.survivor import SPACES
from folioloom.session import spread

# Placeholders.
_DOT, _BANG, _ASK, _GAP, _OPEN, _SHUT, _PARA, _END = ("", "", "", "", "", "", "", "")
_OWN = _DOT + _BANG + _ASK + _GAP + _OPEN + _SHUT + _PARA + _END
_BLANK = SPACES + _GAP

# Abbreviations, fixed values: before names; before numbers and citations; before numbers only.
BEFORE_NAMES = (
    "Mr|Mrs|Ms|Messrs|Dr|Drs|Prof|Capt|Col|Gen|Lt|Sgt|Maj|Rev|Hon|Gov|Pres|Sen|Rep|Mme|Mlle|MM|Mgr|Me|Pr|Hr|Hrn|Fr|Frl|Hl|Sr|Sra|Srta|Srs|Dra|"
    "Da|Ud|Uds|Lic|Ing|Sta|Sto|ул|пл|пер|просп|им|проф|акад|тов|гр|डॉ|श्री|प्रो"
)
BEFORE_WORDS = "cf|ch|chap|fig|figs|vol|vols|pp|ed|eds|vs|viz|ibid|approx|esp|cap|caps|pág|págs|núm|núms|art|ej|Abb|Bd|Kap|Nr|bzw|ca|evtl|ggf|vgl|Vgl|usw|рис|гл|стр|см|напр"
BEFORE_NUMBERS = "No|Nos|no|nos|lb|lbs|ft|yd|p|n|t|St|Abs|Art|п|с|т"
# Verbs of clauses that tell who speaks where the speaker comes first; fixed values.
_SAID = "said|asked|replied|answered|cried|added|muttered|whispered|remarked|observed|resumed|murmured|exclaimed|continued|returned|shouted"
_SAID_ZH = "低声说|轻声说|大声说|说|问道|答道|喊道|叫道|说道|回答|问|答|喊|嚷道|笑道|道"
_SAID_TH = "ตอบ|ถาม|กล่าว|กระซิบ|พูด|บอก|ตะโกน|ร้อง|เอ่ย"
_SAID_HI = "कहा|पूछा|उत्तर दिया|जवाब दिया|बोला|बोली|चिल्लाया|फुसफुसाया"

# Characters that show nothing may stand anywhere in a damaged text.
_INV = "\\u00AD\\u034F\\u200B-\\u200F\\u2060-\\u2064\\uFEFF"
_TH = "\\u0E01-\\u0E4E" + _INV
_CJK = "\\u3005\\u3040-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF"
_WORD_START = r"(?<![\p{L}\p{M}\p{N}])"


def _short_forms() -> Iterator[str]:
    """What stands around the full stop of a short form: behind it and ahead."""
    yield rf"(?<={_WORD_START}\p{{Lu}}\.)(?=\s)"
    yield rf"(?<={_WORD_START}[zduhpv]\.)(?=\s\p{{L}})"
    yield rf"(?<={_WORD_START}т\.)(?=\s[едкпн]\b)"
    yield rf"(?<={_WORD_START}(?:{BEFORE_NAMES}|{BEFORE_WORDS})\.)"
    yield rf"(?<={_WORD_START}(?:{BEFORE_NUMBERS})\.)(?=\s?\d)"
    yield rf"(?<!\p{{Lu}}[\p{{L}}’]{{1,15}}\sSt\.)(?<={_WORD_START}St\.)(?=\s\p{{Lu}})"
    # German ordinals.
    yield r"(?<=\b(?:Am|am|Im|im|Vom|vom|Zum|zum|Der|der|Den|den|Dem|dem|Des|des|Das|das|Die|die|bis|Bis)\s\d{1,3}\.)(?=\s)"
    yield r"(?<=\b\d{1,2}\.)(?=\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b)"


def _masks(p: Column) -> Column:
    """The paragraph with every full stop masked that looks like an end and is none."""

    # Each pattern begins with what it replaces and looks behind from there, as most characters are no full stop.
    def put(pattern: str, new: str) -> None:
        nonlocal p
        p = F.regexp_replace(p, F.lit(pattern), F.lit(new))

    put(r"^(\s*(?:Chapter|Chapitre|Kapitel|Capítulo|Глава|अध्याय|Book|Part|Volume) [\divxlcIVXLC]+)\.", f"$1{_DOT}")
    # Pauses: dots after a space, and the dot before such.
    put(r"\.(?<=\s\.{0,6}\.)(?=[\s.])", _DOT)
    put(rf"\.(?=\s{_DOT})", _DOT)
    # Between letters and digits: decimals, times, addresses, dotted short forms.
    put(r"\.(?<=[\p{L}\p{N}]\.)(?=[\p{L}\p{N}])", _DOT)
    put(rf"\.(?<={_WORD_START}(?![ap]{_DOT}m)\p{{L}}{_DOT}\p{{L}}\.)", _DOT)
    put(rf"е\.(?<=т{_DOT}\sе\.)", f"е{_DOT}")
    put(rf"\.(?:{'|'.join(_short_forms())})", _DOT)
    return p


def _ends(rows: DataFrame, masked: str) -> DataFrame:
    """`rows` with a mark after the end of each sentence of the masked paragraph.  In steps, as each step asks first
    whether the text has letters of its script, and would else be written out for both answers."""

    def put(c: Column, pattern: str, new: str) -> Column:
        return F.regexp_replace(c, F.lit(pattern), F.lit(new))

    p = F.col(masked)
    # Scripts with spaces.  What goes on: a small letter, a mark that cannot begin a sentence.
    onward = rf"(?![\p{{Ll}},;:)\]”’»{_SHUT}—–…。，、]|-\s)(?=\S)"
    shut = rf"(?:\s?[»›]|[”’“‘'{_SHUT}\)\]])"
    person = r"\p{Lu}[\p{L}\p{M}’.\-]*(?:\s\p{Lu}[\p{L}\p{M}’.\-]*){0,3}"
    clause = (
        rf"(?!{person}\s(?:{_SAID})[.,:;])"
        rf"(?!(?:\p{{IsDevanagari}}+[.\s{_DOT}]\s?){{1,4}}?(?:ने\s)?(?:\S+\sसे\s)?(?:{_SAID_HI})[।,:.\s])"
    )
    spaced = rf"[^\S{_GAP}]+"
    p = put(
        p,
        rf"([.!?…।॥]+(?:[’'\)\]{_INV}])*(?![”“‘»›{_SHUT}])(?!\s[»›]))({spaced}){onward}|([.!?…।॥]+{shut}+)({spaced}){onward}{clause}",
        f"$1$3{_END}$2$4",
    )
    rows = rows.withColumn(masked, p)
    p = F.col(masked)
    # Scripts without spaces.
    quoted = rf"[”」』{_SHUT}）\)]"
    bound = r"(?!\s*(?:と|って|との|という|などと|、|，|,))"
    zh_clause = rf"(?!\s?[{_CJK}·{_INV}]{{1,12}}?(?:{_SAID_ZH})(?:着)?[。，：！？,:“「{_OPEN}])"
    done = put(
        p,
        rf"([。！？｡]+|[!?]+(?=[”」』’{_SHUT}）]*[{_CJK}]))(?![。！？｡!?”」』’{_SHUT}）\)])(?=\s*\S)"
        rf"|((?:[。！？｡]+|[!?]+(?=[’）\)]?[”」』{_SHUT}）\)]+\s*[{_CJK}]))[’）\)]?{quoted}+)(?!{quoted}|[。！？])(?=\s*\S){bound}{zh_clause}",
        f"$1$2{_END}",
    )
    rows = rows.withColumn(masked, F.when(p.rlike(f"[{_CJK}。！？｡]"), done).otherwise(p))
    # Thai: a space ends a sentence, but beside figures, before a clause that tells who speaks, and after one that
    # introduces a quotation.
    done = put(p, rf"(?<=[{_TH}])(?<!(?:{_SAID_TH}))([ \t\u00A0]+)(?=[“‘{_OPEN}][{_TH}])", f"{_END}$1")
    done = put(done, rf"(?<=[{_TH}])([ \t\u00A0]+)(?=[{_TH}])", f"{_END}$1")
    done = put(done, rf"(?<=[{_TH}][”’{_SHUT}]{{1,2}})([ \t\u00A0]+)(?=[“‘{_OPEN}]?[{_TH}])(?![{_TH}]+(?:{_SAID_TH})(?:[\s{_END}]|$))", f"{_END}$1")
    return rows.withColumn(masked, F.when(p.rlike("[\u0E01-\u0E4E]"), done).otherwise(p))


@cache
def _as_is() -> tuple[str, str]:
    """Patterns of whole texts that hold no odd character: with Cyrillic letters only, without any."""
    gone = set(everywhere()) | set(_OWN)
    common = {c for c in common_characters() if c not in gone}
    cyrillic = {c for c in common if "CYRILLIC" in unicodedata.name(c, "")}
    latin = {c for c in common if c.isascii() and c.isalpha()}
    return f"\\A[{character_class(common - latin)}]*+\\z", f"\\A[{character_class(common - cyrillic)}]*+\\z"


def _plain(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` with a text of the same length in which odd spaces, full stops and letters are the ordinary ones they look
    like, and the placeholders stand for themselves."""
    table = everywhere()
    cyrillic, other = _as_is()
    usual = F.col(text).rlike(other) | F.col(text).rlike(cyrillic)
    made = F.translate(F.translate(F.col(text), _OWN, "�" * len(_OWN)), "".join(table), "".join(table.values()))
    rows = rows.withColumn("_usual", usual).withColumn(out, F.when(F.col("_usual"), F.col(text)).otherwise(made))
    alike = CYRILLIC_AS_LATIN | GREEK_AS_LATIN
    c = F.col(out)
    in_latin = c.rlike(f"[{''.join(alike)}]") & c.rlike("[A-Za-z]") & ~c.rlike("[БГДЖЗИЙЛФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюяΔΛΣβγδλμπσωάέήίόύώ]")
    return rows.withColumn(out, F.when(~F.col("_usual") & in_latin, F.translate(c, "".join(alike), "".join(alike.values()))).otherwise(c)).drop("_usual")


def _stored(text: Column, paras: Column) -> Column:
    """The stored text cut where its plain form is cut."""
    same = F.array_join(paras, "") == text
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("all"))
    step = lambda a, p: F.struct((a["at"] + F.char_length(p)).alias("at"), F.concat(a["all"], F.array(F.substring(text, a["at"] + 1, F.char_length(p)))).alias("all"))
    return F.when(same, paras).otherwise(F.aggregate(paras, begin, step, lambda a: a["all"]))


_BLOCK = 256


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each.  Long arrays go block by block, as each step copies what there is so far."""
    begin = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("all"))

    def of(part: Column, at: Column) -> Column:
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        return F.aggregate(part, begin(at), step, lambda a: a["all"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda k: F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK)))
    sums = of(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)), F.lit(0))
    long = F.flatten(F.zip_with(blocks, sums, of))
    return F.when(F.size(lengths) <= _BLOCK, of(lengths, F.lit(0))).otherwise(long)


def sentences(texts: DataFrame, keys: list[str], text: str = "text", heading: Column | None = None) -> DataFrame:
    """(keys, start_pos, sentence) of every sentence of every text; start_pos counts code points from 0.

    heading: whether a row's first paragraph is a heading, which is one sentence whatever stands in it.
    Columns beyond keys and text are not read.
    """
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    headed = F.lit(False) if heading is None else heading
    rows = spread(texts.select(*named, F.col(text).alias("text"), headed.alias("headed")).where(F.col("text").rlike(r"(?U)\S")))
    parted = lambda c: F.split(F.regexp_replace(c, r"(\n[^\S\n]*\n\s*)", f"$1{_PARA}"), _PARA)
    ends = lambda c: F.when(c.contains("\n"), parted(c)).otherwise(F.array(c))
    cut = _plain(rows, "text", "safe").select(*ks, "text", "headed", ends(F.col("safe")).alias("paras"))
    at = _starts(F.transform("paras", lambda x: F.char_length(x)))
    placed = cut.select(*ks, "headed", "paras", at.alias("at"), _stored(F.col("text"), F.col("paras")).alias("own"))
    paras = placed.select(*ks, "headed", F.posexplode(F.arrays_zip(F.col("paras").alias("p"), F.col("at").alias("at"), F.col("own").alias("own"))).alias("nr", "para"))
    title = F.col("headed") & (F.col("nr") == 0)
    plain = F.translate(F.col("para.p"), ".!?…। ", _DOT + _BANG + _ASK + _DOT + _DOT + _GAP)
    plain = F.translate(plain, "。！？", _DOT + _BANG + _ASK)
    quoted = F.regexp_replace("para.p", r'"([^"\n]*)"', f"{_OPEN}$1{_SHUT}")
    first = paras.select(*ks, F.col("para.own").alias("own"), F.col("para.at").alias("base"), F.when(title, plain).otherwise(quoted).alias("m"))
    masked = first.withColumn("m", F.when(F.col("m").contains("."), _masks(F.col("m"))).otherwise(F.col("m")))
    found = _ends(masked, "m").select(*ks, "own", "base", F.split("m", _END).alias("parts"))
    starts = _starts(F.transform("parts", lambda x: F.char_length(x)))
    each = found.select(*ks, "own", "base", F.explode(F.arrays_zip(F.col("parts").alias("s"), starts.alias("at"))).alias("e"))
    chars = F.char_length(F.btrim("e.s", F.lit(_BLANK)))
    lead = F.char_length("e.s") - F.char_length(F.ltrim("e.s", F.lit(_BLANK)))
    inside = each.select(*ks, "own", "base", (F.col("e.at") + lead).alias("at"), chars.alias("chars")).where("chars > 0")
    restored = F.substring(F.col("own"), F.col("at") + 1, F.col("chars"))
    return inside.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], (F.col("base") + F.col("at")).alias("start_pos"), restored.alias("sentence"))
