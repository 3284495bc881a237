"""Cutting long texts into overlapping pieces at natural boundaries (problem 6).

Content-defined: a rolling hash over the text marks landmarks; a piece ends at
the natural boundary (the end of a sentence unit) nearest to its first landmark
between the least and the greatest size. Because landmarks depend on the text
around them only, an edit moves the cuts of the neighbouring pieces alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.segment import unit_spans

LIMIT = 2000
OVERLAP = 200
LEAST = 600
_WINDOW = 32
_EVERY = 512


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> tuple[str, list[tuple[int, int, bool]]]:
    """('natural' or 'forced', pieces as (start, end, ends at a boundary)).

    Forced means that a piece had to end inside a unit that no piece could hold;
    one that ends inside a unit for the sake of the overlap says so itself. A
    text within the limit is one piece. Consecutive pieces overlap by exactly
    ``overlap`` characters, so that the text is the first piece followed by each
    later piece without its first ``overlap`` characters.
    """
    n = len(text)
    spans = unit_spans(text)
    kind = "natural"
    if n <= limit:
        return kind, [(0, n, True)]
    natural = [e for _, e in spans]
    marks = hashing.windows(hashing.prefix(hashing.codepoints(text)), _WINDOW)
    landmarks = (np.flatnonzero(marks % np.uint64(_EVERY) == 0) + _WINDOW).tolist()
    out: list[tuple[int, int, bool]] = []
    start = fresh = 0
    while n - start > limit:
        low, high = max(fresh + 1, start + least), start + limit
        first, last = bisect_left(natural, low), bisect_right(natural, high)
        if first < last:
            m = bisect_left(landmarks, low)
            if m < len(landmarks) and landmarks[m] <= high:
                k = bisect_left(natural, landmarks[m], first, last)
                near = [natural[j] for j in (k - 1, k) if first <= j < last]
                end = min(near, key=lambda e: (abs(e - landmarks[m]), e))
            else:
                end = natural[last - 1]
            out.append((start, end, True))
        else:
            early = bisect_right(natural, high)
            if early and natural[early - 1] > max(fresh, start + overlap):
                end = natural[early - 1]  # a boundary below the least size is better than none
                out.append((start, end, True))
            else:
                end = high
                while end > low and not text[end - 1].isspace():
                    end -= 1
                end = end if end > low else high
                out.append((start, end, False))
                unit = bisect_left(natural, end)
                if unit < len(spans) and spans[unit][0] < end and spans[unit][1] - spans[unit][0] > limit:
                    kind = "forced"
        fresh, start = end, end - overlap
    out.append((start, n, True))
    return kind, out


def text_pieces(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text above the limit: (key, piece_no, start_pos, end_pos, at_boundary, cut_kind).

    Null texts and texts within the limit give no rows; repeated rows are cut
    each for themselves; a null key stays null; other columns are not read.
    """
    given = rows.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where(F.length("t") > limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, made = pieces(t, limit, overlap)
                for no, (s, e, at) in enumerate(made):
                    for col, v in zip(cols, (k, no, s, e, at, kind)):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "piece_no", "start_pos", "end_pos", "at_boundary", "cut_kind"])

    return given.mapInArrow(cut, "key bigint, piece_no int, start_pos bigint, end_pos bigint, at_boundary boolean, cut_kind string")
