"""Finished books out: sound files, their tags, listings, and copies to where they are listened to.  Encoders, hosts and
model stores are programs outside Spark; what they are given is made here."""

from __future__ import annotations

import shlex
import shutil
import subprocess
import tempfile
import wave
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encoders by format.
CODECS = {"m4a": ("-c:a", "aac"), "m4b": ("-c:a", "aac"), "mp3": ("-c:a", "libmp3lame")}
GENRE = "Audiobook"


def write_wav(path: str | Path, samples: Sequence[float], rate: int) -> None:
    """One channel of 16 bits."""
    whole = np.clip(np.asarray(samples, np.float64), -1, 1)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(whole * 32767).astype("<i2").tobytes())


def read_wav(path: str | Path) -> tuple[np.ndarray, int]:
    with wave.open(str(path)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32767, w.getframerate()


def codec_arguments(kind: str, bitrate: str = "96k") -> list[str]:
    """What an encoder is told of the format; one channel.  An unknown format is an error."""
    if kind not in CODECS:
        raise ValueError(f"unknown format {kind!r}: one of {', '.join(CODECS)}")
    return ["-b:a", bitrate, "-ac", "1", *CODECS[kind]]


def tag_rows(entries: DataFrame, books: DataFrame, label: str = "Full Cast") -> DataFrame:
    """(book_id, n, tag, value): the tags of each file; entries: book_id, n, title; a null n is the file of a whole book,
    which has no track."""
    about = books.select("book_id", F.coalesce("author", F.lit("")).alias("author"), F.concat(F.coalesce("title", F.lit("")), F.lit(f" ({label})")).alias("album"))
    met = entries.select("book_id", "n", "title").join(about, "book_id")
    tags = {"title": F.col("title"), "album": F.col("album"), "artist": F.col("author"), "album_artist": F.col("author"), "genre": F.lit(GENRE), "track": F.col("n").cast("string")}
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), v.alias("value")) for k, v in tags.items()]))
    return met.select("book_id", "n", pair.alias("t")).select("book_id", "n", "t.tag", "t.value").where("value IS NOT NULL")


def tag_arguments(tags: Mapping[str, str]) -> list[str]:
    return [x for k, v in tags.items() for x in ("-metadata", f"{k}={v}")]


def concat_listing(parts: DataFrame) -> DataFrame:
    """(book_id, listing): the files of each book in order, for an encoder that joins them; parts: book_id, n, path."""
    quoted = F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", quoted.alias("line")))), lambda r: r["line"])
    return parts.groupBy("book_id").agg(F.concat(F.array_join(rows, "\n"), F.lit("\n")).alias("listing"))


Runner = Callable[[Sequence[str]], None]


def run_program(arguments: Sequence[str]) -> None:
    subprocess.run(list(arguments), check=True)


def encode_chapter(sound: str, out: str, kind: str, tags: Mapping[str, str], bitrate: str = "96k", run: Runner = run_program, program: str = "ffmpeg") -> bool:
    """One file of sound; False, and nothing done, if it is there and younger than what it is made of."""
    source, target = Path(sound), Path(out)
    if target.exists() and target.stat().st_mtime > source.stat().st_mtime:
        return False
    run([program, "-y", "-loglevel", "error", "-i", sound, *codec_arguments(kind, bitrate), *tag_arguments(tags), out])
    return True


def encode_book(listing: str, markers: str, out: str, tags: Mapping[str, str], bitrate: str = "96k", run: Runner = run_program, program: str = "ffmpeg") -> None:
    """One file of a whole book with its chapters marked."""
    with tempfile.TemporaryDirectory() as folder:
        parts, marks = Path(folder, "parts.txt"), Path(folder, "marks.txt")
        parts.write_text(listing, "utf-8")
        marks.write_text(markers, "utf-8")
        join = ["-f", "concat", "-safe", "0", "-i", str(parts), "-i", str(marks), "-map_metadata", "1", "-map", "0:a"]
        run([program, "-y", "-loglevel", "error", *join, *codec_arguments("m4b", bitrate), *tag_arguments(tags), out])


def remote_command(path: str) -> str:
    """What a host's shell is told: make the folder, unpack into it."""
    return f"mkdir -p {shlex.quote(path)} && tar -C {shlex.quote(path)} -xf -"


def publish(folder: str, target: str, author: str, album: str, pipe: Callable[[Sequence[str], Sequence[str]], None] | None = None) -> str | None:
    """Copy a finished book under target/author/album: a local folder, or host:path through tar and ssh.  No target: None,
    and nothing is done."""
    if not target:
        return None
    place = f"{target}/{author}/{album}"
    if ":" not in target:
        shutil.copytree(folder, place, dirs_exist_ok=True)
        return place
    host, path = place.split(":", 1)
    (pipe or _pipe)(["tar", "-C", folder, "-cf", "-", "."], ["ssh", host, remote_command(path)])
    return place


def _pipe(first: Sequence[str], second: Sequence[str]) -> None:
    """Two programs, the output of one going into the other; an error if either fails."""
    with subprocess.Popen(list(first), stdout=subprocess.PIPE) as source:
        subprocess.run(list(second), stdin=source.stdout, check=True)
        if source.wait():
            raise subprocess.CalledProcessError(source.returncode, list(first))


def models_of(settings: Mapping) -> list[str]:
    """Models that a profile needs on this machine, in the order they are used."""
    own = ["llm_model"] if settings.get("llm_backend") == "local" else []
    return [settings[k] for k in (*own, "design_model", "tts_model") if settings.get(k)]


def fetch(settings: Mapping, download: Callable[[str], str]) -> dict[str, str]:
    """Where each model of a profile lies after `download`."""
    return {m: download(m) for m in models_of(settings)}


def write_book(folder: str, files: Iterable[tuple[str, str]]) -> None:
    """Small texts of a book, such as its playlist, by name."""
    for name, text in files:
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, "utf-8")
