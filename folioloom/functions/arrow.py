"""What no built-in function does: Unicode decomposition and HTML, as Arrow functions over batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Elements that end a paragraph, that hold no text, that hold a heading.
BLOCKS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "br", "li", "blockquote"))
SILENT = frozenset(("script", "style", "head"))
HEADINGS = frozenset(("h1", "h2", "h3"))


def fold_to_ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@cache
def _ascii_fold():
    @F.pandas_udf("string")
    def ascii_fold(texts: pd.Series) -> pd.Series:
        return texts.map(fold_to_ascii, na_action="ignore")

    return ascii_fold


def ascii_fold(text):
    """Letters decomposed and all that is not ASCII dropped."""
    return _ascii_fold()(text)


class _Events(HTMLParser):
    """What a parser meets, as a list: elements that open (+tag) and close (-tag), and text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.all: list[tuple[str, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.all.append(("+", tag))

    def handle_endtag(self, tag):
        self.all.append(("-", tag))

    def handle_data(self, data):
        self.all.append(("text", data))


def _heard(events: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The events without text inside elements that hold none."""
    out, silent = [], 0
    for kind, value in events:
        if value in SILENT and kind != "text":
            silent += 1 if kind == "+" else -1
        elif kind != "text" or not silent:
            out.append((kind, value))
    return out


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _paragraphs(heard: list[tuple[str, str]]) -> list[str]:
    flow = "".join(value if kind == "text" else "\n\n" for kind, value in heard if kind == "text" or value in BLOCKS)
    return list(filter(None, map(_one_line, re.split(r"\n\s*\n", flow))))


def _first_heading(heard: list[tuple[str, str]], fits: re.Pattern) -> str | None:
    """Text from where a heading opens to where one closes, the first that fits."""
    begin = None
    for k, (kind, value) in enumerate(heard):
        if value in HEADINGS and kind == "+":
            begin = k
        elif value in HEADINGS and kind == "-" and begin is not None:
            title = _one_line("".join(v for what, v in heard[begin:k] if what == "text"))
            if title and fits.match(title):
                return title
            begin = None
    return None


def read_page(html: str, heading: str = r"chapter\s") -> tuple[str, str | None]:
    """Text of a page, paragraphs parted by blank lines, and its heading."""
    heard = _heard(_Events(html).all)
    return "\n\n".join(_paragraphs(heard)), _first_heading(heard, re.compile(heading, re.IGNORECASE))


@cache
def _html_text(heading: str):
    @F.pandas_udf("struct<text:string,heading:string>")
    def html_text(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(p, heading) if p is not None else (None, None) for p in pages], columns=["text", "heading"])

    return html_text


def html_text(html, heading: str = r"chapter\s"):
    """(text, heading) of HTML pages; heading is a pattern, for the start of a heading, case ignored."""
    return _html_text(heading)(html)


def _named(one: Callable[[str], str]):
    @F.pandas_udf("string")
    def over_texts(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return over_texts


def register(spark: SparkSession) -> None:
    """The functions under their names for SQL."""
    spark.udf.register("ascii_fold", _ascii_fold())
    spark.udf.register("html_text", _html_text(r"chapter\s"))
    spark.udf.register("slug", _named(lambda t: "_".join(re.findall("[a-z0-9]+", fold_to_ascii(t).lower())) or "someone"))
    spark.udf.register("fold", _named(lambda t: re.sub("[^a-z ]", "", fold_to_ascii(t).lower())))
