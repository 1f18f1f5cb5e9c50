"""Text, JSON and settings in, scripts, playlists and markers out."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(n, text) of whole files NNN.txt."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"), F.input_file_name().alias("f"))
    return files.select(F.regexp_extract("f", r"(\d+)\.txt$", 1).cast("int").alias("n"), "text")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Segments of files NNN.script.json: n, id, para, kind, text, speaker, emotion, tag_override."""
    segment = "struct<id:int,para:int,kind:string,text:string,speaker:string,emotion:string,tag_override:boolean>"
    files = spark.read.schema(f"segments array<{segment}>").json(path, multiLine=True, pathGlobFilter="*.script.json")
    numbered = files.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.script\.json$", 1).cast("int").alias("n"), F.explode("segments").alias("s"))
    return numbered.select("n", "s.*")


def write_json(df: DataFrame, path: str, by: str = "book_id") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_texts(df: DataFrame, path: str, text: str, by: str = "book_id") -> None:
    """One text a book, such as a playlist or chapter markers."""
    df.select(by, F.regexp_replace(text, "\n$", "").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def _leaves(settings: Mapping, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Paths of all values that are no sections; an empty section counts as a value."""
    for k, v in settings.items():
        if isinstance(v, Mapping) and v:
            yield from _leaves(v, (*at, k))
        else:
            yield (*at, k), v


def overlaid(*layers: Mapping) -> dict:
    """Settings laid over each other, value by value; a value hides a section of its name, and a section a value."""
    flat: dict[tuple[str, ...], object] = {}
    for layer in layers:
        for path, value in _leaves(layer):
            if value == {} and any(p[: len(path)] == path for p in flat):
                continue
            hidden = [p for p in flat if p != path and (p[: len(path)] == path or path[: len(p)] == p)]
            for p in hidden:
                del flat[p]
            flat[path] = value
    out: dict = {}
    for (*sections, last), value in flat.items():
        place = out
        for k in sections:
            place = place.setdefault(k, {})
        place[last] = value
    return out


def load_settings(path: str, local: str | None = None, profile: str | None = None, variable: str = "FOLIOLOOM_PROFILE") -> dict:
    """Settings of a TOML file, a local one laid over it; the profile is the one asked for, or the variable's, or the
    default one, and what it says goes over the section llm.  An unknown profile is an error.  A key that a file holds
    (api_key_file) is read."""
    sources = [path, *([local] if local and Path(local).exists() else [])]
    settings = overlaid(*(tomllib.loads(Path(p).read_text("utf-8")) for p in sources))
    name = profile or os.environ.get(variable) or settings.get("profile")
    chosen = settings.get("profiles", {})[name] if name else {}
    out = {**settings, **settings.get("llm", {}), **chosen, "profile": name}
    if out.get("api_key_file"):
        out["api_key"] = Path(out["api_key_file"]).expanduser().read_text("utf-8").strip()
    return out
