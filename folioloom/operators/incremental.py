"""What is still to be done, and writing it so that a run can be repeated."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("extract", "cast", "attribute", "voices", "design", "render", "encode", "publish")


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `work` whose keys are not in `done`."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stage_state(manifest: DataFrame) -> DataFrame:
    """(book_id, stage, done, done_at, seconds) as last recorded: by done_at, a null before all, then by loaded_at; where
    these are equal, what is done, then what took longer."""
    last = F.max_by(F.struct("done", "done_at", "seconds"), F.struct("done_at", "loaded_at", "done", "seconds")).alias("r")
    return manifest.groupBy("book_id", "stage").agg(last).select("book_id", "stage", "r.*")


def next_stages(manifest: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """(book_id, stage): the first stage of each book that is not done."""
    state = stage_state(manifest).groupBy("book_id").agg(F.collect_set(F.when(F.col("done"), F.col("stage"))).alias("done"))
    todo = F.filter(F.array(*map(F.lit, stages)), lambda s: ~F.array_contains("done", s))
    return state.select("book_id", F.get(todo, F.lit(0)).alias("stage")).where("stage IS NOT NULL")


def chosen_stages(stages: Sequence[str], only: Sequence[str] | None = None, start: str | None = None, until: str | None = None) -> list[str]:
    """Stages to run: those of `only`, whatever the others say; else from `start` to `until`."""
    if only:
        return [s for s in stages if s in only]
    first = stages.index(start) if start else 0
    last = stages.index(until) + 1 if until else len(stages)
    return list(stages[first:last])


def stale(outputs: DataFrame, inputs: DataFrame, keys: Sequence[str], at: str = "modified_at") -> DataFrame:
    """Keys of inputs without an output that is younger."""
    fresh = outputs.select(*keys, F.col(at).alias("_made"))
    met = inputs.join(fresh, list(keys), "left")
    return met.where(F.col("_made").isNull() | (F.col("_made") <= F.col(at))).select(*keys)


def write_parts(df: DataFrame, path: str, by: Sequence[str] = ("book_id",)) -> None:
    """Replace only the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run_stages(
    stages: Sequence[tuple[str, str | None]], act: Callable[[str], None], state: dict[str, dict], *, only: Sequence[str] | None = None, start: str | None = None,
    until: str | None = None, chapters: Sequence[int] = (), force: bool = False, server: tuple[Callable[[], None], Callable[[], None]] | None = None,
    profile: str | None = None, clock: Callable[[], float] = time.time,
) -> dict[str, dict]:
    """Run stages (name, kind) in order and record each in `state`; done ones are skipped, unless they are asked for by
    `only`, `chapters` or `force`.  A run over some chapters never marks a stage done.  server: stops the model server
    before a stage of kind "sound" and starts it again before one of kind "text", and at the end."""
    names = [s for s, _ in stages]
    stopped = False
    try:
        for name in chosen_stages(names, only, start, until):
            if state.get(name, {}).get("done") and not (force or only or chapters):
                continue
            kind = dict(stages)[name]
            if server and kind == "sound" and not stopped:
                server[0]()
                stopped = True
            elif server and kind == "text" and stopped:
                server[1]()
                stopped = False
            began = clock()
            act(name)
            state[name] = {"done": not chapters, "done_at": clock(), "seconds": round(clock() - began), "profile": profile, "chapters": list(chapters) or None}
    finally:
        if server and stopped:
            server[1]()
    return state
