"""How good an attribution or a pronunciation is."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.arrow import ascii_fold
from folioloom.functions.text import fold
from folioloom.operators.attribution import attribute
from folioloom.operators.roster import name_index
from folioloom.providers import Provider


def accuracy(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, quotes, model_only, with_tag_override, share, wrong): right speakers, with those that tags set and without,
    and the mistakes.  predicted: keys, speaker, tag_override; gold: keys, gold."""
    met = predicted.join(gold, list(keys))
    right = F.col("gold").eqNullSafe(F.col("speaker"))
    own = right & ~F.coalesce("tag_override", F.lit(False))
    rest = [k for k in keys if k not in by]
    mistake = F.when(~right, F.struct(*rest, F.col("speaker").alias("got"), "gold"))
    return met.groupBy(*by).agg(
        F.count("*").alias("quotes"), F.count_if(own).alias("model_only"), F.count_if(right).alias("with_tag_override"),
        F.try_divide(F.count_if(right), F.count("*")).alias("share"), F.array_sort(F.collect_list(mistake)).alias("wrong"),
    )


def recognised(name: Column, heard: Column) -> Column:
    """Whether a name was heard in a transcript, letters folded."""
    return F.contains(fold(ascii_fold(heard)), fold(ascii_fold(name)))


def score_profiles(
    script: DataFrame, gold: DataFrame, cast: DataFrame, profiles: Mapping[str, Callable[[], Provider]], keys: Sequence[str] = ("book_id", "n")
) -> DataFrame:
    """(profile, by, quotes, model_only, with_tag_override, share, wrong): chapters attributed anew with each profile's
    model and the same cast, held against the speakers in `gold` (keys, id, gold)."""
    index = name_index(cast)
    parts = []
    for name, make in profiles.items():
        done = attribute(script, cast, index, make, keys).where("kind = 'quote'")
        scored = accuracy(done.select(*keys, "id", "speaker", "tag_override"), gold, [*keys, "id"], list(keys))
        parts.append(scored.select(F.lit(name).alias("profile"), *scored.columns))
    return reduce(DataFrame.unionByName, parts)
