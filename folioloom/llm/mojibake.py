"""Problem 8: text decoded with the wrong character encoding.

For every pair (the encoding a text was written in, the encoding it was read in) the sequences are precomputed that
ordinary letters and marks turn into.  All of them go into one multi-pattern automaton, which reads each text once.
Its matches name the pairs to try.  UTF-8 read in another encoding proves itself, as its bytes must fit together: such
sequences are replaced one by one, whatever stands between them.  For the other pairs the garbled words of a line are
decoded again, and the pair is kept that leaves the fewest oddities (``oddity``).  Only matched spans change.

Defined results: a null, empty or blank text is not damaged and stays as it is.  A sequence that stands alone between
quotation marks is cited, and no damage.  U+FFFD marks damage that cannot be undone; it stays.
"""

from __future__ import annotations

import codecs
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioloom.session import spread

# Encodings of one byte a character, as readers; an unassigned byte is read as the C1 control of its number.
SINGLE = (
    "cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp1253",
    "iso8859_7", "cp1254", "cp1257", "cp874",
)
WIDE = ("gbk", "big5", "cp932", "euc_jp")
# Languages' letters and marks beyond ASCII, and the encodings that texts in them were written in.
LATIN = "àâäáãåæçéèêëíìîïñóòôöõøúùûüýÿœßÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝŒ"
POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
GREEK = "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ"
MARKS = "‘’“”«»„‚—–…¡¿£€½°№"
THAI = "".join(chr(c) for c in range(0xE01, 0xE4D) if not 0xE3A < c < 0xE40)
KANA = "".join(chr(c) for c in [*range(0x3042, 0x3094), *range(0x30A2, 0x30F4)]) + "、。「」！？…ー"
HAN = "的一是不了在有人这中大来上个国到说时要就出会也你对生能子那得于着下自之年过家作里用道行所然种事成方多经么去如都看好小没们我他她，。！？；：“”‘’"
WRITTEN = (
    (LATIN + MARKS, ("cp1252", "latin_1", "mac_roman", "cp437", "cp850")),
    (POLISH + MARKS, ("cp1250", "iso8859_2")),
    (CYRILLIC + MARKS, ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")),
    (GREEK + MARKS, ("cp1253", "iso8859_7", "cp737")),
    (THAI, ("cp874",)),
)
_NATURAL = ("çã", "çõ", "ÇÃ", "ÇÕ", "ée", "éé")
_UPPER_LATIN = "À-ÖØ-ÞĀĂĄĆČĎĐĘĚĹĽŁŃŇŐŒŔŘŚŞŠŤŢŮŰŸŹŻŽƒ"
_ORDINARY = set(LATIN + POLISH + CYRILLIC + GREEK + MARKS)


@cache
def _reads(encoding: str) -> tuple[str, ...]:
    """Character that each byte is read as."""
    out = []
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.append(c if len(c) == 1 else chr(b))
    return tuple(out)


@cache
def _writes(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_reads(encoding)))) if b >= 0x80}


@cache
def _code(reader: str) -> dict[int, int]:
    """Byte of each character that a reader knows, ASCII as it is."""
    return {ord(c): b for c, b in _writes(reader).items()} | {b: b for b in range(0x80)}


def _as_bytes(text: str, reader: str) -> bytes | None:
    """The bytes that `reader` read as this text; None if there are none."""
    if reader in WIDE:
        try:
            return text.encode(reader)
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text, "strict", _code(reader))[0]
    except UnicodeEncodeError:
        return None


@cache
def _common_cjk() -> frozenset[str]:
    """Kana, CJK marks and the first levels of the Chinese and Japanese national sets, by the sets' own order."""
    out = {chr(c) for c in [*range(0x3000, 0x3100), *range(0xFF01, 0xFF5F)]} | set("‘’“”…—")
    for codec, rows in (("gb2312", range(16, 56)), ("euc_jp", range(16, 48))):
        for row in rows:
            for cell in range(1, 95):
                try:
                    out.add(bytes([row + 0xA0, cell + 0xA0]).decode(codec))
                except UnicodeDecodeError:
                    pass
    return frozenset(out)


_ODD = re.compile(
    "|".join(
        [
            r"[\x80-\x84\x86-\x9f\ue000-\uf8ff]",
            rf"(?<=[a-zß-öø-ÿ])[{_UPPER_LATIN}]",  # a capital inside a small word
            r"(?<=[?!,.])[ß-öø-ÿ](?=\w)|(?<=[.,!?])[ß-öø-ÿ](?!\w)|(?<!\w)[ß-öø-ÿż](?=[A-Z])|[ÂÃ][ŁŽŠŚŤŹĄŞŻ]|ÔÇ[^\W\d_]",  # a small letter where a mark stands
            r"[ß-öø-ÿ](?=\d)|(?<!\w)[À-ÖØ-ÞŁŒœЈ](?=\d)|(?<=\d)[Ͱ-ϿЀ-Џ╜∂Ω](?!\w)",
            r"(?<=(?:is|as|ad|id|do|ld|re|ve|es|ca|wo)n)[^\x00-\x7f’](?=t\b)|(?<=(?:IS|AS|AD|ID|DO|LD|RE|VE|ES|CA|WO)N)[^\x00-\x7f’](?=T\b)",
            r"(?<=[^\W\d_])[‡†ˆ˜™¸´ªº¨¯°±²³¹µ¶§¬©®¢¤¥÷×¿¡„‚…‰‹›«»•–˛˙¼¾√∂∫≈≠≥≤∆◊∑∏⌐ƒ](?=[^\W\d_])",  # a sign inside a word
            r"(?<![^\W_])[‡†ˆ˜™¸¨¯±²³¹¶¬©®¢¤¥÷×‰‹›˛˙¼¾√∂∫≈≠≥≤∆◊∑∏⌐ƒ](?=[^\W\d_])|(?<=[^\W\d_])[‡†ˆ˜¸´ªº¨¯±²³¹µ¶¬¢¤¥÷×‰‹›˛˙¼¾√∂∫≈≠≥≤∆◊∑∏⌐ƒ¿¡](?![^\W_])",
            r"[─-▟⌠⌡ⁿ]",
            r"[ăőŕčďđěňřťůűľĺşţĂŐŔČĎĐĚŇŘŤŮŰĽĹŞŢšžŠŽŸýÝþÞðÐˇ˘˝]",  # letters of none of the languages
            r"[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕїѐ]",
            r"[΅ΆΈΉΊΌΎΏ](?=[Ά-Ώ΅])|[ΰΐ](?![α-ώ])",
            r"(?<=[а-яё])[А-ЯЁ]|(?<=[α-ώ])[Ά-Ϋ]",
            r"(?<=[A-Za-zÀ-ÿ])[Ͱ-ӿ]|(?<=[Ͱ-ӿ])[A-Za-zÀ-ÿ]",  # two scripts in a word
            r"(?<=[Ѐ-ӿ])[Ͱ-Ͽ]|(?<=[Ͱ-Ͽ])[Ѐ-ӿ]",
            r"(?=[À-ÞŒŠŽŸ]*[ß-ÿœšž])[À-ÿŒœŠšŽžŸ]{3,}",  # accented letters in a row, not all of them capitals
            r"[｡-ﾟ]",
            r"(?<![\u0e01-\u0e2e\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]",  # a Thai sign on no consonant
            r"(?<=[ก-๛])[A-Za-zÀ-ӿ\x80-\x9f]|(?<=[A-Za-zÀ-ӿ])[ก-๛]",
            r"[ฃฅฆฌฎฏฑฒฬฦ]{2,}",
            r"[\u0e3f\u0e4f\u0e5a\u0e5b\u0e3a\u0e4e]|(?<=[\u0e40-\u0e44])(?![\u0e01-\u0e2e])|(?<=[0-9])[\u0e00-\u0e7f]",
            r"(?<!\S)[ÇÈÒÓÔÕÐÞ´ªº](?!\S)|(?<!\S)[ÒÔÕÇ](?=[A-ZÀ-Ý])|(?<=[.,!?])[ÓÕÈÆ](?!\w)|[æÔ](?=[A-Z])|(?<=[.,!?])[”ö](?=[a-z])",
            r"[ƀ-˅ˈ-˗԰-ࣿ]",
            r"[ⅰ-ⅿ㈠-㏿ㄅ-ㄯ︰-﹏]",
        ]
    )
)
_HAN_RUN = re.compile("[々〇㐀-鿿豈-﫿]+")


# Letters of none of the languages: what damage turns into, and what names from elsewhere hold rightly.
_RARE = set("ăőŕčďđěňřťůűľĺşţĂŐŔČĎĐĚŇŘŤŮŰĽĹŞŢšžŠŽŸýÝþÞðÐЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕїѐ")
_BEYOND = re.compile(r"[^\x00-\x7f][^\x00-\x7f]*")  # one character first: the search leaps to it
# What the patterns of _ODD look at before and after a run beyond ASCII; all of their matches start in it or just behind.
_BEFORE, _AFTER = 3, 2
_SHORT = 40  # characters of what is kept; runs and words repeat, long ones seldom


def _weigh_run(text: str, start: int) -> tuple[float, float]:
    """Oddity of a run beyond ASCII that begins at `start` and ends before the last _AFTER characters, or fewer at the text's
    end, and its part that comes of rare letters."""
    run = _BEYOND.match(text, start)
    end = run.end()
    total = rare = 0.0
    for m in _ODD.finditer(text, start):
        if m.start() > end:  # another run's
            break
        total += len(m.group()) or 1
        rare += m.group() in _RARE
    common = _common_cjk()
    for m in _HAN_RUN.finditer(text, start, end):
        total += 0.5 * sum(c not in common for c in m.group())
    return total + run.group().count("�"), rare


_weigh_known = lru_cache(1 << 16)(_weigh_run)


def _weigh(text: str) -> tuple[float, float]:
    """Oddity of a text, and its part that comes of rare letters; each run beyond ASCII by itself."""
    total = rare = 0.0
    if not text.isascii():
        for m in _BEYOND.finditer(text):
            start, end = m.span()
            weigh = _weigh_known if end - start <= _SHORT else _weigh_run
            left = min(start, _BEFORE)
            a, b = weigh(text[start - left : end + _AFTER], left)
            total += a
            rare += b
    return total, rare


def oddity(text: str) -> float:
    """How much in a text hardly stands in ordinary writing of any of the languages."""
    return _weigh(text)[0]


@cache
def _odd(text: str) -> float:
    return oddity(text)


def _utf8_patterns() -> Iterator[tuple[str, tuple]]:
    """What the first two bytes of UTF-8 characters are read as.  A reader's two-byte sequences are whole characters."""
    for reader in SINGLE:
        table = _reads(reader)
        # Leads of Latin-1 and Latin Extended-A, Greek, Cyrillic; of three and four bytes.
        for lead in (0xC2, 0xC3, 0xC4, 0xC5, 0xCA, 0xCB, 0xCC, 0xCE, 0xCF, 0xD0, 0xD1, *range(0xE0, 0xF0), 0xF0):
            for follow in range(0x80, 0xC0):
                if lead == 0xE0 and follow < 0xA0 or lead == 0xF0 and follow < 0x90:
                    continue
                two = table[lead] + table[follow]
                if reader != "cp874" or _odd(two):  # Thai begins words with what UTF-8's leads are read as
                    yield two, ("utf_8", reader)
    # Read in a two-byte encoding: the character that a lead and its follower make, if it is a rare one.
    common = _common_cjk()
    for reader in WIDE:
        for lead in (0xC2, 0xC3, 0xCE, 0xCF, 0xD0, 0xD1, *range(0xE0, 0xF0)):
            for follow in range(0x80, 0xC0):
                try:
                    c = bytes([lead, follow]).decode(reader)
                except UnicodeDecodeError:
                    continue
                if len(c) == 1 and c not in common and c not in _ORDINARY:
                    yield c, ("utf_8", reader)


def _legacy_patterns() -> Iterator[tuple[str, tuple]]:
    """What letters of languages, with a neighbour, turn into under pairs of older encodings."""
    small = "abcdefghijklmnopqrstuvwxyz"
    for letters, writers in WRITTEN:
        for writer in writers:
            raw = {}
            for c in letters:
                try:
                    raw[c] = c.encode(writer)
                except UnicodeEncodeError:
                    pass
            for reader in SINGLE:
                if reader in (writer, "cp874"):
                    continue
                table = _reads(reader)
                turned = {c: table[b[0]] for c, b in raw.items() if len(b) == 1 and table[b[0]] != c and b[0] >= 0x80}
                if letters[0] in "àą":
                    for c, g in turned.items():
                        if g < "\x80":
                            continue
                        if g not in _ORDINARY and _odd(g) and _odd(f"a{g}a"):
                            yield g, (writer, reader)
                        if c == "’":
                            yield f"n{g}t", (writer, reader)
                            yield f"N{g}T", (writer, reader)
                        for x in small + " .,!?" + "0123456789":
                            if _odd(x + g + " ") or (x in small or x != " " and g.isalpha() and g < "Ͱ") and _odd(x + g + "a"):
                                yield x + g, (writer, reader)
                        for x in small + small.upper() + "0123456789":
                            if _odd(" " + g + x):
                                yield g + x, (writer, reader)
                else:
                    few = [c for c in turned if c not in MARKS]
                    for a in few:
                        for b in few:
                            two = turned[a] + turned[b]
                            # Two accented Latin letters are odd in a row of more.
                            if not b.isupper() and (_odd(two) or two < "Ͱ" and two not in _NATURAL and _odd(two + turned[a])):
                                yield turned[a] + turned[b], (writer, reader)
    for letters, writers in ((KANA, ("cp932", "euc_jp")), (HAN, ("gbk", "big5"))):
        for writer in writers:
            for reader in (*SINGLE, *WIDE):
                if reader == writer:
                    continue
                for c in letters:
                    try:
                        data = c.encode(writer)
                    except UnicodeEncodeError:
                        continue
                    if reader in SINGLE:
                        g = "".join(_reads(reader)[b] for b in data)
                    else:
                        g = data.decode(reader, "replace")
                    if "�" not in g and g != c and _odd(g) >= (1 if len(g) > 1 else 0.5):
                        yield g, (writer, reader)


_SMALL = re.compile(r"[а-яё]+|[α-ώ]+|(?=.*[a-z])[a-zß-öø-ÿąćęłńśźż]+")


_MACHINE: list[tuple[ahocorasick.Automaton, str, str]] = []


def automaton(packed: bytes | None = None) -> tuple[ahocorasick.Automaton, str, str]:
    """The automaton and its characters, built once or taken from `packed`, once in each process."""
    if not _MACHINE:
        _MACHINE.append(pickle.loads(packed) if packed else build())
    return _MACHINE[0]


def build() -> tuple[ahocorasick.Automaton, str, str]:
    """All garbled sequences, each with its length, the readers that make it of UTF-8 and the other pairs; the characters
    that are the first beyond ASCII of any, and those of them that another need not follow.

    The automaton runs over UTF-8 bytes: its nodes keep their followers in a list, which must be short."""
    # U+FFFD and C1 controls (U+0085 is a line's end in some systems): matches of no pair, which tell of lost characters.
    found: dict[str, set] = {c: {("lost", "")} for c in ("�", *map(chr, [*range(0x80, 0x85), *range(0x86, 0xA0)]))}
    for source in (_utf8_patterns(), _legacy_patterns()):
        for g, pair in source:
            # Small letters of one script alone are ordinary in it.
            if not g.isascii() and not _SMALL.fullmatch(g):
                found.setdefault(g, set()).add(pair)
    out = ahocorasick.Automaton()
    for g in sorted(found):
        pairs = sorted(found[g])
        readers = tuple(r for w, r in pairs if w == "utf_8" and r in SINGLE)
        others = tuple(p for p in pairs if p[0] != "lost" and not (p[0] == "utf_8" and p[1] in SINGLE))
        out.add_word(g.encode("utf-8").decode("latin-1"), (len(g), readers, others))
    out.make_automaton()
    first, single = set(), set()
    for g in found:
        k = next(k for k, c in enumerate(g) if c > "\x7f")
        first.add(g[k])
        if g[k + 1 : k + 2].isascii():
            single.add(g[k])
    return out, "".join(sorted(first)), "".join(sorted(single))


@cache
def _places() -> re.Pattern:
    """Stretches that can hold garbled sequences, from their first character beyond ASCII on.  No sequence has two
    characters of ASCII in a row, nor more than one at its ends."""
    first, single = (re.escape(x) for x in automaton()[1:])
    return re.compile(rf"[{first}](?:(?=[^\x00-\x7f])|(?<=[{single}]))[^\x00-\x7f]*(?:[\x00-\x7f][^\x00-\x7f]+)*")


def _matches_here(text: str) -> tuple[tuple[int, int, tuple, tuple], ...]:
    data = text.encode("utf-8")
    out, at, chars = [], 0, 0
    for end, (n, readers, others) in automaton()[0].iter(data.decode("latin-1")):
        chars += len(data[at : end + 1].decode("utf-8"))
        at = end + 1
        out.append((chars - n, chars, readers, others))
    return tuple(sorted(out, key=lambda m: m[0]))


_matches_known = lru_cache(1 << 16)(_matches_here)


def matches(text: str) -> list[tuple[int, int, tuple, tuple]]:
    """Start, end, UTF-8 readers and other pairs of all garbled sequences in a text, by start.  Each of them holds a
    character beyond ASCII, so plain stretches need no look; short stretches repeat, and are looked at once."""
    out = []
    for m in _places().finditer(text):
        start = max(0, m.start() - 1)
        part = text[start : m.end() + 1]
        for first, last, readers, others in (_matches_known if len(part) <= _SHORT else _matches_here)(part):
            out.append((start + first, start + last, readers, others))
    return out


MOST_CITED = 6  # characters: two of three bytes each
_OPEN, _CLOSE = "‘“«'\"„‚「", "’”»'\"“‘」"


def _cited(text: str, start: int, end: int) -> bool:
    """Whether these characters stand alone between quotation marks; what is cited so is a few signs, not a word that was
    damaged inside its marks."""
    return 0 < start and end < len(text) and text[start - 1] in _OPEN and text[end] in _CLOSE and end - start <= MOST_CITED


_NATURAL_NEXT = set("»”’“‘…–—„« ·ё№")


@cache
def _written() -> frozenset[str]:
    """What UTF-8 damage can come from: any character that some reader knows, the scripts of the languages, pictures."""
    out = {c for reader in SINGLE for c in _reads(reader)} | set(_ORDINARY) | {"�"}
    for first, last in ((0x900, 0x97F), (0xE00, 0xE7F), (0x2000, 0x206F), (0x2600, 0x27BF), (0x1F300, 0x1FAFF), (0xFE00, 0xFE0F)):
        out.update(map(chr, range(first, last + 1)))
    for codec in ("gb2312", "euc_jp", "big5"):
        for a in range(0xA1, 0xFF):
            for b in range(0x40, 0xFF):
                try:
                    c = bytes([a, b]).decode(codec)
                except UnicodeDecodeError:
                    continue
                out.update(c)
    return frozenset(out)


def _utf8_unit(text: str, i: int, reader: str) -> tuple[str, int] | None:
    """The UTF-8 character whose bytes were read as text[i:end], and the end."""
    table = _writes(reader)
    lead = table.get(text[i]) if i < len(text) else None
    if lead is None or lead < 0xC2 or lead > 0xF4:
        return None
    n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if i + n > len(text):
        return None
    data = bytearray([lead])
    for c in text[i + 1 : i + n]:
        b = table.get(c)
        if b is None or not 0x80 <= b < 0xC0:
            return None
        data.append(b)
    try:
        c = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return (c, i + n) if c in _written() else None


_FEW = re.compile(rf"[^\x00-\x7f]{{1,{_SHORT + 1}}}")


def _utf8_run(text: str, i: int, reader: str) -> tuple[str, int, int, int]:
    """The UTF-8 characters from here on without a gap, the characters they were read as, how many they are, and how many of
    them ordinary writing has too."""
    chars, j, plain = [], i, 0
    while (unit := _utf8_unit(text, j, reader)) is not None:
        c, end = unit
        chars.append(c)
        plain += end == j + 2 and text[j].isalpha() and text[j + 1] in _NATURAL_NEXT
        j = end
    return "".join(chars), j - i, len(chars), plain


_utf8_known = lru_cache(1 << 16)(_utf8_run)


@lru_cache(1 << 12)
def _in_order(readers: tuple[str, ...]) -> list[str]:
    return sorted(set(readers), key=SINGLE.index)


def _undo_utf8(text: str, hits: dict[int, tuple]) -> str:
    """Replace what single-byte readers made of UTF-8.  hits: readers by position.  A sequence that ordinary writing
    has too is replaced only beside others of the same reader."""
    new, sure = _undo_units(text, hits, frozenset())
    return _undo_units(text, hits, sure)[0] if sure else new


def _undo_units(text: str, hits: dict[int, tuple], sure: frozenset[str]) -> tuple[str, frozenset[str]]:
    used = set()
    out, at = [], 0
    for i in sorted(hits):
        if i < at:
            continue
        found: dict[tuple[int, str], str] = {}  # what the readers make of it; several may agree
        run = m.group() if (m := _FEW.match(text, i)) else ""
        for reader in _in_order(hits[i]):
            new, n, count, plain = _utf8_known(run, 0, reader) if len(run) <= _SHORT else _utf8_run(text, i, reader)
            if not count or reader == "cp874" and count < 3:
                continue
            # One sequence that ordinary writing has too, as a capital before a closing mark, is no proof.
            if reader not in sure and plain == count == 1 and (i and text[i - 1].isalpha() or not text[i].isupper()):
                continue
            found.setdefault((i + n, new), reader)
        best: tuple | None = None
        left = text[i - 1 : i]
        for (j, new), reader in found.items():
            letters = text[i:j].isalpha()
            gain = 0.0
            if letters or len(found) > 1:
                gain = oddity(text[max(0, i - 1) : j + 1]) - oddity(left + new + text[j : j + 1])
            if (gain > 0 or gain == 0 and not letters or reader in sure) and (best is None or (gain, j) > best[:2]):
                best = (gain, j, new, reader)
        if best and not _cited(text, i, best[1]):
            out += [text[at:i], best[2]]
            at = best[1]
            used.add(best[3])
    out.append(text[at:])
    return "".join(out), frozenset(used)


@cache
def _runs(reader: str) -> re.Pattern:
    """Stretches of characters beyond ASCII that a reader knows, plain ones between them included."""
    if reader in WIDE:
        return re.compile(r"[^\x00-\x7f]+")
    known = "".join(map(re.escape, sorted(_writes(reader))))
    return re.compile(f"[{known}](?:[{known}\x20-\x7e]*[{known}])?")


def _redecode(text: str, writer: str, reader: str) -> str | None:
    data = _as_bytes(text, reader)
    if data is None:
        return None
    try:
        return data.decode(writer)
    except UnicodeDecodeError:
        if writer in SINGLE:
            return "".join(_reads(writer)[b] for b in data)
        return None


def _loose(text: str, writer: str, reader: str) -> str | None:
    """As _redecode for two-byte readers, where some bytes were lost: what does fit together, U+FFFD for the rest."""
    try:
        new = text.encode(reader, "ignore").decode(writer, "replace")
    except (UnicodeError, LookupError):
        return None
    return re.sub("�+", "�", new)


def _impossible(text: str) -> float:
    """Oddity without the letters that are rare only."""
    total, rare = _weigh(text)
    return total - rare


_SURE = 40  # pairs with most votes


def _undo_line(line: str, votes: Counter, known: list, partly: set | None = None, wait: list | None = None) -> str:
    """A line decoded again under the pair that leaves the fewest oddities; if none leaves far fewer, with only those
    words decoded again that hold what cannot be right and get far less odd, and the line itself if there are none.
    All pairs with votes are tried, readers that agree on the line's characters once.

    known: pairs that the text's other lines were garbled by, tried first where they have votes, else last.  partly: the
    lines decoded in part, as what is left in them stays; None for no such lines.  wait: takes the lines whose best
    reading leaves oddities and is by a pair of few votes; they stay until the other lines have told their pairs; None
    to wait no more."""
    before = oddity(line)
    best, best_rank, pair = line, (before, 0), None
    some, some_rank = line, (_impossible(line), 0)
    seen = {line}  # readers often agree on the characters of a line
    words = re.split(r"(\s+)", line)
    odd = [k for k, w in enumerate(words) if oddity(w)]
    voted = [p for p, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])) if p not in known]
    order = [p for p in known if p in votes] + voted + [p for p in known if p not in votes]
    own = [c for c in sorted(set(line)) if c > "\x7f"]
    tried = set()
    for writer, reader in order:
        if best_rank[0] == 0:
            break
        # Readers that agree on all characters of the line make the same of it: the one with most votes stands for all.
        if reader not in WIDE:
            same = writer, tuple(map(_writes(reader).get, own))
            if same in tried:
                continue
            tried.add(same)
        n = votes[writer, reader]
        tries = []
        whole = _redecode(line, writer, reader)
        if whole is not None:
            tries.append(whole)
        if writer not in WIDE and writer != "utf_8" and odd:
            first, last = odd[0], odd[-1] + 1
            span = _redecode("".join(words[first:last]), writer, reader)
            if span is not None:
                tries.append("".join(words[:first]) + span + "".join(words[last:]))
            # Only the odd words, the odd characters' neighbours included.
            parts = list(words)
            for k in odd:
                parts[k] = _redecode(words[k], writer, reader) or words[k]
            tries.append("".join(parts))
            for k in odd if partly is not None else ():  # the rest may hold rare letters rightly
                if parts[k] == words[k] or _impossible(parts[k]) >= _impossible(words[k]) or oddity(parts[k]) > 0.6 * oddity(words[k]):
                    parts[k] = words[k]
            if (rank := (_impossible(line_now := "".join(parts)), -n)) < some_rank:
                some, some_rank = line_now, rank
        elif writer in WIDE or writer == "utf_8":

            def swap(m: re.Match) -> str:
                run = m.group()
                new = _redecode(run, writer, reader)
                if new is None and len(run) > 3 and reader in WIDE:
                    new = _loose(run, writer, reader)
                if new is None or oddity(new) >= oddity(run):
                    return run
                return new

            tries.append(_runs(reader).sub(swap, line))
        for new in tries:
            if new in seen:
                continue
            seen.add(new)
            rank = (oddity(new), -n)
            if rank < best_rank:
                best, best_rank, pair = new, rank, (writer, reader)
    if wait is not None and 0 < best_rank[0] <= 0.6 * before and pair in order[_SURE:]:
        wait.append(line)
        return line
    if best_rank[0] > 0.6 * before:
        if partly is not None and some != line:
            partly.add(some)
            return some
        return line
    if pair and pair not in known:
        known.append(pair)
    return best


_BESIDE = 4  # characters beside a sequence that its oddity may depend on


def _garbled(text: str, found: list[tuple[int, int, tuple, tuple]]) -> bool:
    """Whether a text, of which these are the matches, holds marks of lost characters, or garbled sequences, uncited, that some pair reads as less odd than
    they stand, be it with characters lost.  Each place is judged by itself, whether the rest of its line can be restored
    or not."""
    spans: dict[tuple, list[list[int]]] = {}
    for start, end, readers, pairs in found:
        if end - start == 1 and (text[start] == "�" or text[start] < "\xa0"):
            return True
        if _cited(text, start, end):
            continue
        for pair in (*(("utf_8", r) for r in readers), *pairs):
            own = spans.setdefault(pair, [])
            if own and start <= own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([start, end])
    judged: dict[tuple[int, int], float] = {}  # most spans have many pairs
    for (writer, reader), own in spans.items():
        for start, end in own:
            left, right = text[max(0, start - _BESIDE) : start], text[end : end + _BESIDE]
            beside = left, right
            if (start, end) not in judged:
                judged[start, end] = oddity(left + text[start:end] + right)
            if not judged[start, end] or (data := _as_bytes(text[start:end], reader)) is None:
                continue
            if writer not in WIDE and writer != "utf_8":
                new = _redecode(text[start:end], writer, reader) or ""
                # What stands beside it was read by the same reader.
                beside = tuple("".join(_redecode(c, writer, reader) or c for c in x) for x in beside)
            else:
                new = re.sub("�+", "�", data.decode(writer, "replace"))
            if new and oddity(beside[0] + new + beside[1]) < judged[start, end]:
                return True
    return False


def _split_hits(text: str, found: list[tuple[int, int, tuple, tuple]]) -> tuple[dict[int, tuple], list[tuple[int, tuple]]]:
    """Of a text and its matches: UTF-8 readers by position, and positions and pairs of the other sequences."""
    utf8: dict[int, tuple] = {}
    other: list[tuple[int, tuple]] = []
    for start, end, readers, pairs in found:
        if _cited(text, start, end):
            continue
        if readers:
            utf8[start] = readers + utf8.get(start, ())
        if pairs:
            other.append((start, pairs))
    return utf8, other


def _undo(line: str, utf8: dict[int, tuple], pairs: list[tuple], known: list, partly: set, wait: list | None) -> str:
    """A line without what garbled sequences can be undone in it; damage on damage included."""
    new = line
    # Each time sequences become single characters, so a line that changes gets shorter, and the loop ends.
    while utf8 and len(again := _undo_utf8(new, utf8)) < len(new):
        new = again
        utf8 = _split_hits(new, matches(new))[0]
    if pairs and line not in partly and (left := oddity(new)):
        votes: Counter = Counter()
        for p in pairs:
            votes.update(p)
        other = _undo_line(line, votes, known, partly if wait is not None and new == line else None, wait)
        if other != line and oddity(other) < left:
            return other
    return new


_TORN = re.compile(r"(?<!\w)â(?=[A-Z])|(?<=[a-z.,!?])â(?=\s|$|[st]\b)")


def restore(text: str | None) -> tuple[bool, str | None]:
    """Whether a text is damaged, and the text as far as it can be had back."""
    if not text or text.isascii():
        return False, text
    damaged, known, partly = False, [], set()
    wait: list | None = []
    seen = {text}
    found = matches(text)
    while True:  # until nothing changes, or a text comes again
        utf8, other = _split_hits(text, found)
        out, at, starts, k, j = [], 0, sorted({*utf8, *(i for i, _ in other)}), 0, 0
        while k < len(starts):  # line by line, as damage seldom goes beyond
            begin = text.rfind("\n", 0, starts[k]) + 1
            stop = text.find("\n", starts[k])
            stop = len(text) if stop < 0 else stop
            own, pairs = {}, []
            while k < len(starts) and starts[k] <= stop:
                if starts[k] in utf8:
                    own[starts[k] - begin] = utf8[starts[k]]
                k += 1
            while j < len(other) and other[j][0] <= stop:
                pairs.append(other[j][1])
                j += 1
            out += [text[at:begin], _undo(text[begin:stop], own, pairs, known, partly, wait)]
            at = stop
        out.append(text[at:])
        new = "".join(out)
        if new == text and not wait:
            break
        if new != text:
            found = matches(new)
        damaged, text, wait, again = damaged or new != text, new, None, new in seen and new != text
        if again:
            break
        seen.add(new)
    # Nor is a mark's first byte left alone text.
    damaged = damaged or "â" in text and _TORN.search(text) is not None
    # Damage that no reading of its line undoes is damage all the same.
    return damaged or _garbled(text, found), text


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored STRING): the damaged rows only, with their text as far as it can be had back.

    Other columns are not read.  Repeated rows are rows like any other."""
    kind = docs.schema[key].dataType
    # The patterns are a fixed set of some 90,000, about 8 MB; building them costs more than sending them.
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(automaton()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton(packed.value)
        for batch in batches:
            done = [restore(t) for t in batch.column(1).to_pylist()]
            rows = pa.array([k for k, (damaged, _) in enumerate(done) if damaged], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([t for damaged, t in done if damaged], pa.string())], names=[key, "restored"]
            )

    schema = T.StructType([T.StructField(key, kind), T.StructField("restored", T.StringType())])
    return spread(docs.select(key, text)).mapInArrow(run, schema)
