"""From scripts to sound: which chapters are to be read, by whom, with which silences.  Speech comes from a provider; the
default hums, which is enough to test everything around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial
from itertools import groupby
from types import MappingProxyType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioloom.functions.arrow import fold_to_ascii
from folioloom.functions.text import chunks
from folioloom.operators import audio, timeline
from folioloom.operators.casting import batch, stream

SHORTEST_REFERENCE = 6.0  # fixed value: seconds to which short references are repeated


class Speech:
    """Says a text in the voice of a reference; made once in each Python worker.  kind: how the model takes references:
    "coded" (encoded once, with what they say), "looped" (at least six seconds long), or "plain"."""

    kind = "plain"
    rate = 24000

    def design(self, line: str, instruct: str) -> np.ndarray:
        """A clip that says the line in a voice made from a description."""
        raise NotImplementedError

    def encode(self, clip: np.ndarray) -> object:
        return clip

    def parts(self, text: str, reference: object, said: str) -> Iterator[np.ndarray]:
        """The sound of a text, in one part or several."""
        raise NotImplementedError

    def free(self) -> None:
        """Give back what the model holds."""


class Hum(Speech):
    """A tone for each voice, as long as the text, in parts of ten words."""

    rate = 1000

    def design(self, line, instruct):
        return self._tone(line, sum(instruct.encode()) % 40)

    def parts(self, text, reference, said):
        words = text.split()
        for k in range(0, len(words), 10):
            yield self._tone(" ".join(words[k : k + 10]), len(said) % 40)

    def _tone(self, text: str, pitch: int) -> np.ndarray:
        return (0.5 * np.sin(np.arange(10 * len(text) + 50) * (0.05 + pitch / 100))).astype(np.float32)


def whole(parts: Iterator[np.ndarray]) -> np.ndarray:
    """All parts of an utterance; an error if there are none."""
    held = [np.asarray(p, np.float32).reshape(-1) for p in parts]
    if not held:
        raise RuntimeError("the model gave no sound")
    return np.concatenate(held)


def reference(speech: Speech, clip: np.ndarray) -> object:
    """A clip as the model takes it."""
    if speech.kind == "coded":
        return speech.encode(clip)
    least = int(SHORTEST_REFERENCE * speech.rate)
    if speech.kind == "looped" and 0 < len(clip) < least:
        return np.resize(clip, least)
    return clip


def design_clips(voices: DataFrame, make: Callable[[], Speech] = Hum, held: DataFrame | None = None) -> DataFrame:
    """(book_id, id, clip, rate): a reference clip for each voice (book_id, id, instruct, line) that is not in `held`."""
    todo = voices if held is None else voices.join(held.select("book_id", "id"), ["book_id", "id"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speech = make()
        for b in batches:
            clips = [speech.design(line or "", how or "").tolist() for line, how in zip(b["line"], b["instruct"])]
            yield b[["book_id", "id"]].assign(clip=clips, rate=speech.rate)
        speech.free()

    return todo.select("book_id", "id", "instruct", "line").mapInPandas(run, "book_id string, id string, clip array<float>, rate int")


def chapters_to_render(script: DataFrame, rendered: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """(book_id, n): chapters of the script without sound, or all of those chosen, rendered or not."""
    all_ = script.select("book_id", "n").distinct()
    if chosen:
        return all_.where(F.col("n").isin(chosen))
    return all_.join(rendered.select("book_id", "n").distinct(), ["book_id", "n"], "left_anti")


def reading_plan(script: DataFrame, voice_map: DataFrame, voices: DataFrame, keys: tuple[str, ...] = ("book_id", "n")) -> DataFrame:
    """(keys, id, chunk, piece, voice, pause): every piece that is read, in whose voice, and the seconds before it.  A
    quotation whose speaker's voice does not exist is read by the narrator."""
    exist = voices.select("book_id", F.col("id").alias("voice")).distinct()
    usable = voice_map.join(exist, ["book_id", "voice"], "left_semi")
    met = script.where(F.col("text").isNotNull()).join(usable.select("book_id", "speaker", "voice"), ["book_id", "speaker"], "left")
    voice = F.when(F.col("kind") == "quote", F.coalesce("voice", F.lit("narrator"))).otherwise("narrator")
    pieces = met.select(*keys, "id", "para", voice.alias("voice"), F.posexplode(chunks(F.col("text"))).alias("chunk", "piece"))
    return timeline.pauses(pieces, list(keys))


def silent_samples(pause: Column, rate: int) -> Column:
    """Samples of silence for seconds, cut to whole ones."""
    return F.floor(pause * rate).cast("int")


_CHAPTER = T.StructType(
    [
        T.StructField("book_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType())),
        T.StructField("rate", T.IntegerType()),
    ]
)


def render(plan: DataFrame, clips: DataFrame, voices: DataFrame, make: Callable[[], Speech] = Hum) -> DataFrame:
    """(book_id, n, samples, rate): the sound of each chapter of a reading plan, tidied, with its silences, below the
    ceiling.  A chapter's pieces stream through one task in order; it holds that chapter's sound and its book's
    references."""
    said = voices.select("book_id", F.col("id").alias("voice"), F.col("line").alias("said"))
    refs = clips.select("book_id", F.col("id").alias("voice"), "clip").join(said, ["book_id", "voice"], "left")
    order = Window.partitionBy("book_id", "n", "voice").orderBy("id", "chunk")
    # A voice's clip goes with its first piece in the chapter only.
    first = plan.where(F.trim("piece") != "").withColumn("_k", F.row_number().over(order))
    met = first.join(refs.withColumn("_k", F.lit(1)), ["book_id", "voice", "_k"], "left").select("book_id", "n", "id", "chunk", "piece", "voice", "pause", "clip", "said")
    arrow = to_arrow_schema(_CHAPTER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech = make()
        for (book, n), rows in groupby(stream(batches), key=lambda r: (r["book_id"], r["n"])):
            held: dict[str, tuple] = {}
            sound: list[np.ndarray] = []
            for r in rows:
                if r["voice"] not in held:
                    held[r["voice"]] = reference(speech, np.asarray(r["clip"] or (), np.float32)), r["said"] or ""
                sound.append(np.zeros(int(r["pause"] * speech.rate), np.float32))
                sound.append(audio.tidied(whole(speech.parts(r["piece"], *held[r["voice"]])), speech.rate))
            yield batch([{"book_id": book, "n": n, "samples": audio.below_ceiling(np.concatenate(sound)).tolist(), "rate": speech.rate}], arrow)
        speech.free()

    ordered = met.repartition("book_id", "n").sortWithinPartitions("book_id", "n", "id", "chunk")
    return ordered.mapInArrow(run, _CHAPTER)


# ---- how names sound ----


class Listener:
    """Writes down what is heard; the default hears what was said."""

    def heard(self, samples: np.ndarray, rate: int, said: str) -> str:
        return said


def score_names(options: DataFrame, make: Callable[[], Speech] = Hum, listen: Callable[[], Listener] = Listener) -> DataFrame:
    """(book_id, name, option, spoken_as, heard, recognised): each way to say a name (book_id, name, variants) said in a
    sentence and listened to; it is recognised if the name is in what was heard, both folded."""
    each = options.select("book_id", "name", F.posexplode("variants").alias("option", "spoken_as"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speech, listener = make(), listen()
        for b in batches:
            said = [f"{v}. I said, {v}." for v in b["spoken_as"]]
            heard = [listener.heard(audio.tidied(whole(speech.parts(t, None, "")), speech.rate), speech.rate, t) for t in said]
            fits = [_letters(n) in _letters(h) for n, h in zip(b["name"], heard)]
            yield b.assign(option=b["option"] + 1, heard=heard, recognised=fits)
        speech.free()

    kinds = "book_id string, name string, option int, spoken_as string, heard string, recognised boolean"
    return each.mapInPandas(run, kinds)


def _letters(text: str) -> str:
    return "".join(c for c in fold_to_ascii(text).lower() if c == " " or "a" <= c <= "z")


def from_settings(settings: Mapping, kinds: Mapping[str, Callable[..., Speech]] = MappingProxyType({})) -> Callable[[], Speech]:
    """A maker of the speech that the settings name in tts; "hum" without one."""
    name = settings.get("tts", "hum")
    if name == "hum":
        return Hum
    if name not in kinds:
        raise ValueError(f"unknown tts {name!r}")
    return partial(kinds[name], settings.get("tts_model"))
