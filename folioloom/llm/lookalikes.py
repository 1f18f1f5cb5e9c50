"""Characters that look like others: shared by the operators on equal-looking text and on names.

The letter tables are fixed values, in the order of the Latin letters they look like.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

CYRILLIC_AS_LATIN = dict(zip("АВСЕНІЈКМОРЅТУХЗаеорсухіјѕԁһԛԝь", "ABCEHIJKMOPSTYX3aeopcyxijsdhqwb"))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυιαρκ", "ABEZHIKMNOPTYXovuiapk"))
for _less in ("З", "ь", "υ", "ι", "α", "ρ", "κ"):  # not alike enough
    CYRILLIC_AS_LATIN.pop(_less, None)
    GREEK_AS_LATIN.pop(_less, None)
LATIN_AS_CYRILLIC = dict(zip("ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"))
OTHER_AS_LATIN = {
    "\u212a": "K", "\u212b": "Å", "\u0131": "i", "\u0261": "g", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi",
    "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
}
MARKS_AS_PLAIN = {
    "\u2024": ".", "\u2025": "..", "\u2010": "-", "\u2011": "-", "\u02bc": "’", "\u037e": ";", "\u0589": ":", "\u2236": ":",
    "\ua789": ":", "\u2044": "/", "\u2215": "/", "\u01c3": "!",
}


@cache
def invisible() -> str:
    """Format characters and others that show nothing, from the Unicode database; joiners are among them."""
    out = [chr(c) for c in range(0x20, 0x30000) if unicodedata.category(chr(c)) == "Cf"]
    return "".join(out) + "͏᠋᠌᠍ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10))) + "".join(map(chr, range(0xE0000, 0xE0080)))


@cache
def odd_spaces() -> str:
    """White space other than the ordinary characters for it, from the Unicode database."""
    return "".join(chr(c) for c in range(0x80, 0x3000) if unicodedata.category(chr(c)) == "Zs")


_CYRILLIC_ONLY = re.compile("[бвгджзийклмнптфцчшщъыьэюяёБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁУ]")


@cache
def _tables() -> tuple[dict, dict, dict]:
    shared = dict.fromkeys(map(ord, invisible())) | {ord(c): " " for c in odd_spaces()}
    shared |= {ord(k): v for k, v in (MARKS_AS_PLAIN | OTHER_AS_LATIN).items()}
    latin = {ord(k): v for k, v in (CYRILLIC_AS_LATIN | GREEK_AS_LATIN).items()}
    cyrillic = {ord(k): v for k, v in LATIN_AS_CYRILLIC.items()}
    return shared, latin, cyrillic


def plain(text: str) -> str:
    """A name as its reader sees it: compatibility forms and look-alikes of another script undone, nothing invisible."""
    shared, latin, cyrillic = _tables()
    text = unicodedata.normalize("NFKC", text.translate(shared))
    words = text.split(" ")
    whole = bool(_CYRILLIC_ONLY.search(text))
    for k, w in enumerate(words):
        if not w.isascii():
            if _CYRILLIC_ONLY.search(w) or whole and not re.search("[b-df-hj-np-su-wzA-Z]", w):
                words[k] = w.translate(cyrillic)
            elif re.search("[A-Za-z]", w) or all(ord(c) in latin or not c.isalpha() for c in w):
                words[k] = w.translate(latin)
    return unicodedata.normalize("NFC", " ".join(words))
