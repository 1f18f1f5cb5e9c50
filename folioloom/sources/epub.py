"""EPUB files: pages in reading order and what the package says about the book."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions.arrow import html_text

_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_PACKAGE = "{http://www.idpf.org/2007/opf}"


def pages_of(data: bytes) -> tuple[str, list[tuple[int, str, str]]]:
    """The package document, and (position, path, HTML) of the pages in the spine's order.  A spine entry without its
    file is an error, not a shorter book."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(f".//{_CONTAINER}rootfile")
        if root is None:
            raise ValueError("no package in the container")
        at = root.attrib["full-path"]
        package = z.read(at).decode("utf-8")
        tree = ElementTree.fromstring(package)
        items = {i.attrib["id"]: i.attrib["href"] for i in tree.iter(f"{_PACKAGE}item")}
        out = []
        for k, ref in enumerate(tree.iter(f"{_PACKAGE}itemref")):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(at), unquote(items[ref.attrib["idref"]])))
            out.append((k, path, z.read(path).decode("utf-8")))
        return package, out


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, package, pos, page, html) of all EPUB files under a path; one task a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                package, pages = pages_of(data)
                yield pd.DataFrame([(p, package, *page) for page in pages], columns=["path", "package", "pos", "page", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, package string, pos int, page string, html string")


def spine(manifest: DataFrame, refs: DataFrame) -> DataFrame:
    """(book_id, pos, href): pages in reading order; manifest: book_id, item, href; refs: book_id, pos, item."""
    return refs.join(manifest, ["book_id", "item"]).select("book_id", "pos", "href")


def metadata(package: Column) -> list[Column]:
    """title, author and language of a package document; the author is the first creator up to " and "."""

    def first(tag: str) -> Column:
        return F.coalesce(F.xpath_string(package, F.lit(f'(//*[local-name()="{tag}"])[1]')), F.lit(""))

    author = F.get(F.split(first("creator"), " and "), F.lit(0))
    return [first("title").alias("title"), author.alias("author"), first("language").alias("language")]


def chapters(pages: DataFrame, book: str = "path", heading: str = r"chapter\s", keep: Sequence[str] = ()) -> DataFrame:
    """(book, n, title, text, keep): the pages with a heading that fits, numbered in order of pos from 1.  heading: a
    pattern for the start of a heading, such as those of several languages, case ignored."""
    read = pages.withColumn("page_text", html_text(F.col("html"), heading)).where(F.col("page_text.heading").isNotNull())
    n = F.row_number().over(Window.partitionBy(book).orderBy("pos"))
    return read.select(book, n.alias("n"), F.col("page_text.heading").alias("title"), F.col("page_text.text").alias("text"), *keep)
