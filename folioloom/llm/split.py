"""Problem 1: cutting texts over a limit into overlapping pieces at natural boundaries.

A piece after the first starts exactly ``overlap`` code points before the end of the piece before it.  Where the
pieces end is found by dynamic programming over all boundary positions (``boundary_positions``), so that no plan over
these costs less: the cost of a plan is the sum of the penalties of
its cuts (small after a paragraph, larger after a sentence, a clause, a word, between characters), of a piece that
starts inside a word, of every further piece, and of pieces that differ from the even size.  Where a stretch longer
than a quarter of a piece holds no boundary of words, any position may be cut that does not part a letter from its
combining marks.

Defined results: a text of at most ``max_chars`` code points, an empty and a null one is not split and has no row;
pieces are never longer than the limit; dropping the overlaps gives the text back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.session import spread

PARAGRAPH, SENTENCE, CLAUSE, WORD, IDEOGRAPH, ANY = 0.0, 0.4, 1.2, 2.0, 2.4, 8.0
NEVER = 1e6
_PIECE, _START, _EVEN = 3.0, 0.5, 6.0
_CLOSERS = "’”»\"')\\]」』）】›"
# Patterns of boundaries, the weakest first; a cut stands at the end of the match.
_BOUNDARIES = (
    (IDEOGRAPH, re.compile("[぀-ヿ㐀-鿿豈-﫿](?=[぀-ヿ㐀-鿿豈-﫿])")),
    (WORD, re.compile(r"\s+|[-—–](?=\w)")),
    (CLAUSE, re.compile(rf"[,;:—–…،][{_CLOSERS}]*\s+|[，、；：…][{_CLOSERS}]*")),
    (SENTENCE, re.compile(rf"(?<!\b[A-Z])(?<!\b(?:Mr|Dr|St|cf|pp|No|no|Nr|Fr|Hr))(?<!\b(?:Mrs|Mme|fig|vol|Rev|Sra))[.!?…][{_CLOSERS}]*\s+(?![a-zß-ÿа-яё])|[。！？｡।॥][{_CLOSERS}]*\s*|(?<=[฀-๿”])\s+(?=[฀-๿“])")),
    (PARAGRAPH, re.compile(r"\n\s*\n\s*|\n+")),
)


def cut_penalties(text: str) -> np.ndarray:
    """Penalty of a cut before each position 0 .. len(text)."""
    n = len(text)
    out = np.full(n + 1, ANY)
    for penalty, pattern in _BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        if len(ends):
            out[ends] = penalty
    # A combining mark, a joiner and what follows one belong to the character before them.
    for i in [m.start() for m in re.finditer("[^\x00-˿ぁ-ゖァ-ヺ一-鿿]", text)]:
        if unicodedata.combining(text[i]) or unicodedata.category(text[i]) in ("Mn", "Mc", "Me") or text[i] == "‍":
            out[i] = NEVER
            if text[i] == "‍":
                out[i + 1] = NEVER
    return out


def boundary_positions(penalty: np.ndarray, overlap: int, step: int) -> np.ndarray:
    """Where pieces may end: 0, all natural boundaries behind the overlap, the end; and in stretches longer than a
    quarter of a step that have none, every position that does not part a letter from its marks."""
    n = len(penalty) - 1
    natural = penalty < ANY
    natural[[0, n]] = True
    natural[1 : overlap + 1] = False
    at = np.flatnonzero(natural)
    at = np.unique(np.concatenate([at, [overlap]])) if 0 < overlap < n else at
    gaps = np.flatnonzero(np.diff(at) > step // 4)
    more = [np.flatnonzero(penalty[at[g] + 1 : at[g + 1]] < NEVER) + at[g] + 1 for g in gaps if at[g] >= overlap]
    out = np.unique(np.concatenate([at, *more])) if more else at
    return out[(out == 0) | (out > overlap)]


def plan_cuts(text: str, max_chars: int, overlap: int) -> list[int]:
    """Ends of the pieces of a text longer than max_chars."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be less than the limit")
    n, step = len(text), max_chars - overlap
    penalty = cut_penalties(text)
    begins = np.where(penalty <= WORD + 0.5, 0.0, _START)  # of a piece that starts here
    begins[penalty >= NEVER] = 4.0
    at = boundary_positions(penalty, overlap, step)
    # What is the same text in every plan: the fewest pieces, and their even size.
    fewest = -(-(n - overlap) // step)
    even = (n + (fewest - 1) * overlap) / fewest
    cut = penalty[at].copy()
    cut[-1] = 0.0
    # Cost up to each cut, with that of beginning the piece that starts `overlap` before it.
    lead = np.zeros(len(at))
    lead[1:] = begins[np.maximum(at[1:] - overlap, 0)]
    uneven = _EVEN * ((np.arange(step + 1) + overlap - even) / max_chars) ** 2  # by how far a cut is from the one before
    ready = np.full(len(at), np.inf)
    came = np.zeros(len(at), np.int64)
    first_in_reach = np.searchsorted(at, at - step).tolist()
    place, price = at.tolist(), (cut + _PIECE).tolist()
    whole = (_EVEN * ((at - even) / max_chars) ** 2).tolist()
    last = np.inf
    for i in range(1, len(place)):
        lo, best, j = max(first_in_reach[i], 1), np.inf, -1
        if lo < i:
            total = ready[lo:i] + uneven[place[i] - at[lo:i]]
            k = int(total.argmin())
            best, j = total[k], lo + k
        if place[i] <= max_chars and whole[i] <= best:
            best, j = whole[i], 0
        last = best + price[i]
        if last < np.inf:
            ready[i], came[i] = last + lead[i], j
    if not np.isfinite(last):  # only marks that must not be parted, for more than a piece's length: cut evenly
        return [*range(max_chars, n, step), n]
    ends, i = [], len(at) - 1
    while i:
        ends.append(int(at[i]))
        i = int(came[i])
    return ends[::-1]


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the pieces, in order."""
    ends = plan_cuts(text, max_chars, overlap)
    return [(0 if k == 0 else ends[k - 1] - overlap, end) for k, end in enumerate(ends)]


def split_long(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pieces of the rows whose text is longer than their column max_chars: keys, piece_no, start_pos, end_pos, piece.

    `rows` needs the columns max_chars and overlap_chars; an overlap as large as the limit is taken as the limit less
    one.  Columns beyond those named are not read.  Equal rows give equal pieces once each.
    """
    n = len(keys)
    fields = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, number, starts, ends, pieces = [], [], [], [], []
            texts, most, over = (batch.column(n + i).to_pylist() for i in range(3))
            for r, (t, m, o) in enumerate(zip(texts, most, over)):
                for k, (s, e) in enumerate(split_text(t, m, min(max(o or 0, 0), m - 1))):
                    take.append(r)
                    number.append(k)
                    starts.append(s)
                    ends.append(e)
                    pieces.append(t[s:e])
            index = pa.array(take, pa.int64())
            columns = [batch.column(i).take(index) for i in range(n)]
            columns += [pa.array(x, pa.int32()) for x in (number, starts, ends)] + [pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "piece_no", "start_pos", "end_pos", "piece"])

    numbers = [T.StructField(c, T.IntegerType()) for c in ("piece_no", "start_pos", "end_pos")]
    schema = T.StructType([*fields, *numbers, T.StructField("piece", T.StringType())])
    long = rows.where((F.col("max_chars") > 0) & (F.char_length(text) > F.col("max_chars")))
    return spread(long.select(*keys, text, "max_chars", "overlap_chars")).mapInArrow(run, schema)


def limited(tables: dict[str, tuple[DataFrame, str]], limits: DataFrame, most_limits: int = 1000) -> DataFrame:
    """(tbl, row_key, text, max_chars, overlap_chars) of several tables, each given with its key; `limits` has one row
    a table, and its size is checked before it is used as literals."""
    found = limits.select("tbl", "max_chars", "overlap_chars").where("tbl IS NOT NULL").distinct().limit(most_limits + 1).collect()
    if len(found) > most_limits:
        raise ValueError(f"more than {most_limits} limits")
    if len({r["tbl"] for r in found}) < len(found):
        raise ValueError("two limits for one table")
    parts = []
    for name, (df, key) in tables.items():  # an empty table of limits splits nothing
        none = df.where(F.lit(False)).select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), "text")
        parts.append(none.withColumns({"max_chars": F.lit(0), "overlap_chars": F.lit(0)}))
    for r in found:
        if r["tbl"] in tables:
            df, key = tables[r["tbl"]]
            # The limit stands as a literal beside the scan, so that short texts go no further.
            parts.append(
                df.select(
                    F.lit(r["tbl"]).alias("tbl"), F.col(key).alias("row_key"), "text",
                    F.lit(r["max_chars"]).alias("max_chars"), F.lit(r["overlap_chars"]).alias("overlap_chars"),
                )
            )
    return reduce(DataFrame.unionAll, parts)
