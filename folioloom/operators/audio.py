"""Sound as arrays of samples."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Loudness, ceiling, edges and fades in seconds.
TARGET_RMS, PEAK, LOUD, PAD, FADE_IN, FADE_OUT = 0.08, 0.89, 0.02, 0.03, 0.015, 0.04


def rms(samples: Column) -> Column:
    """Root of the mean square; null for no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(F.try_divide(total, F.size(samples)))


def limited(samples: Column) -> Column:
    """Samples beyond the ceiling bent below 1 by a tanh knee."""
    room = 1 - PEAK
    bend = lambda x: F.sign(x) * (PEAK + room * F.tanh((F.abs(x) - PEAK) / room))
    return F.transform(samples, lambda x: F.when(F.abs(x.cast("double")) > PEAK, bend(x.cast("double"))).otherwise(x.cast("double")))


def looped(samples: Column, least: Column) -> Column:
    """Samples repeated to at least `least`, cut there; longer ones as they are, none stay none."""
    times = F.ceil(least / F.greatest(F.size(samples), F.lit(1))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(samples, times)), F.lit(1), least)
    return F.when(F.size(samples) >= least, samples).otherwise(again)


def resampled(samples: Column, count: Column) -> Column:
    """`count` samples at even distances between the first and the last, by linear interpolation."""
    last = F.size(samples) - 1

    def at(i: Column) -> Column:
        x = F.when(count > 1, i * last / (count - 1)).otherwise(F.lit(0.0))
        low = F.least(F.floor(x).cast("int"), last)
        a, b = F.get(samples, low).cast("double"), F.get(samples, F.least(low + 1, last)).cast("double")
        return a + (b - a) * (x - low)

    return F.when((count > 0) & (last >= 0), F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def joined(parts: Column) -> Column:
    """Clips one after another; null for no clips."""
    return F.when(F.size(parts) > 0, F.flatten(parts))


def seconds(frames: Column, rate: Column) -> Column:
    return F.try_divide(frames.cast("double"), rate.cast("double"))


def tidied(samples: np.ndarray, rate: int) -> np.ndarray:
    """One clip without silent edges, levelled, its ends faded."""
    a = np.asarray(samples, np.float32).reshape(-1)
    loud = np.flatnonzero(np.abs(a) > LOUD)
    if len(loud):
        pad = int(PAD * rate)
        a = a[max(0, loud[0] - pad) : loud[-1] + pad]
    a = a.copy()
    level = float(np.sqrt(np.mean(np.square(a)))) if len(a) else 0.0
    if level > 1e-4:
        a *= TARGET_RMS / level
    for at, length, ramp in ((slice(None), FADE_IN, (0, 1)), (None, FADE_OUT, (1, 0))):
        n = min(int(length * rate), len(a) // 2)
        if n:
            a[slice(0, n) if at else slice(len(a) - n, len(a))] *= np.linspace(*ramp, n, dtype=np.float32)
    return a


def below_ceiling(samples: np.ndarray) -> np.ndarray:
    """One clip with samples beyond the ceiling bent below 1; the array form of `limited`."""
    size = np.abs(samples)
    return np.where(size > PEAK, np.sign(samples) * (PEAK + (1 - PEAK) * np.tanh((size - PEAK) / (1 - PEAK))), samples).astype(np.float32)


@cache
def _tidy(rate: int):
    @F.pandas_udf("array<float>")
    def tidy(clips: pd.Series) -> pd.Series:
        return clips.map(lambda a: tidied(a, rate), na_action="ignore")

    return tidy


def tidy(samples: Column, rate: int) -> Column:
    return _tidy(rate)(samples)
