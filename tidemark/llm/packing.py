"""Packing texts into containers of fixed capacity, measured in tokens (problem 7).

The plan is made on the histogram of lengths, which has no more rows than a
container has tokens, however many texts there are. Best fit: the longest
length left opens a container of the permitted size that costs least for each
token held, the longest lengths that still fit fill it, and the same filling
is repeated as often as its lengths last. In the end each container shrinks to
the smallest permitted size that holds its contents. The permitted sizes are
chosen jointly: every set of them that holds the longest length is planned, and
the plan that allots least capacity in all is taken.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern of byte-level BPE vocabularies (a fixed value of the public format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of one length that one task numbers; a more frequent length is salted.
NUMBERED = 250_000


def _encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every text that is not null; special tokens are ordinary text."""
    given = rows.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return given.mapInArrow(count, "key bigint, n_tokens bigint")


def joint_plan(counts: dict[int, int], sizes: tuple[int, ...]) -> list[tuple[dict[int, int], int, int]]:
    """The fillings of the set of sizes that allots least capacity; containers shrink to any of the permitted sizes in the end."""
    top = max(sizes)
    smaller = sorted(set(sizes) - {top})
    best = None
    for k in range(1 << len(smaller)):
        opened = (*(s for j, s in enumerate(smaller) if k >> j & 1), top)
        plan = [(used, times, next(s for s in (*smaller, top) if s >= sum(n * c for n, c in used.items()))) for used, times, _ in plan_fillings(counts, opened)]
        total = sum(times * size for _, times, size in plan)
        if best is None or total < best[0]:
            best = (total, plan)
    return best[1]


def plan_fillings(counts: dict[int, int], sizes: tuple[int, ...]) -> list[tuple[dict[int, int], int, int]]:
    """Fillings as ({length: how often in one container}, containers filled so, final size)."""
    sizes = tuple(sorted(sizes))
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    lengths = sorted(left)
    out = []

    def fill(capacity: int, longest: int) -> tuple[dict[int, int], int]:
        used, room = {longest: 1}, capacity - longest
        k = bisect.bisect_right(lengths, room) - 1
        while k >= 0 and room > 0:
            n = lengths[k]
            take = min((left[n] - used.get(n, 0)), room // n)
            if take > 0:
                used[n] = used.get(n, 0) + take
                room -= take * n
            k = min(k - 1, bisect.bisect_right(lengths, room) - 1)
        return used, room

    while lengths:
        longest = lengths[-1]
        best = None
        for size in sizes:
            if size < longest:
                continue
            used, room = fill(size, longest)
            cost = (room / (size - room), -size)
            if best is None or cost < best[0]:
                best = (cost, used, size - room)
        _, used, held = best
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
        out.append((used, times, next(s for s in sizes if s >= held)))
    return out


def packed(rows: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (CAPACITY,), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, part_no, token_start, token_end, container_id, container_size) of every text.

    Only a text longer than the largest size is split, into parts of that size
    and a rest. Null texts have no row; a text without tokens takes no space
    and stands in container 0. Rows that stand twice are packed twice; an empty
    table gives no rows. Ordinals within a length are counted by salt, so a
    length that a third of all texts share is not numbered by one task.
    """
    top = max(sizes)
    lengths = stored(token_counts(rows, key, text, vocabulary))
    parts = (
        lengths.withColumn("part_no", F.explode(F.expr(f"sequence(0, cast(greatest(n_tokens - 1, 0) div {top} as int))")))
        .withColumn("token_start", F.col("part_no").cast("bigint") * top)
        .withColumn("token_end", F.least("n_tokens", F.col("token_start") + top))
        .withColumn("n", (F.col("token_end") - F.col("token_start")).cast("int"))
    )
    # at most as many rows as a container has tokens
    frequent = {r.n: r["count"] for r in parts.groupBy("n").count().collect()}
    salts = {n: -(-c // NUMBERED) for n, c in frequent.items() if c > NUMBERED}
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in salts.items() for x in p]), F.col("n")), F.lit(1)) if salts else F.lit(1)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("key", "part_no"), many).cast("int"))
    base_of = np.zeros(top + 2, np.int64)
    base_of[1:] = np.cumsum([salts.get(n, 1) for n in range(top + 1)])
    starts = np.zeros(int(base_of[-1]), np.int64)
    counts: dict[int, int] = dict(frequent)
    if salts:
        sized = parts.where(F.col("n").isin(*salts)).groupBy("n", "salt").count().collect()  # one row for each NUMBERED texts
        at: dict[int, int] = {}
        for r in sorted(sized, key=lambda r: (r.n, r.salt)):
            starts[base_of[r.n] + r.salt] = at.get(r.n, 0)
            at[r.n] = at.get(r.n, 0) + r["count"]
    slots: list[tuple[int, int, int, int, int]] = []
    taken: dict[int, int] = {}
    base = 0
    for used, times, size in joint_plan(counts, sizes):
        for n, c in used.items():
            slots.append((n, taken.get(n, 0), base, c, size))
            taken[n] = taken.get(n, 0) + c * times
        base += times
    slots.sort()
    table = np.array(slots or [(0, 0, 0, 1, min(sizes))], np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast((table, starts, base_of))

    @F.pandas_udf("container_id bigint, container_size int")
    def place(n: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, starts, base_of = shared.value
        n_, o = n.to_numpy(np.int64), starts[base_of[n.to_numpy()] + salt.to_numpy()] + rank.to_numpy(np.int64) - 1
        first, last = np.searchsorted(table[:, 0], n_, "left"), np.searchsorted(table[:, 0], n_, "right")
        at = first.copy()
        for length in np.unique(n_):
            mine = n_ == length
            lo, hi = first[mine][0], last[mine][0]
            at[mine] = lo + np.searchsorted(table[lo:hi, 1], o[mine], "right") - 1
        at = np.clip(at, 0, len(table) - 1)
        row = table[at]
        container = np.where(n_ > 0, row[:, 2] + (o - row[:, 1]) // row[:, 3], 0)
        return pd.DataFrame({"container_id": container, "container_size": np.where(n_ > 0, row[:, 4], table[0, 4] if len(table) else 0).astype(np.int32)})

    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy("key", "part_no"))
    placed = parts.withColumn("rank", rank).withColumn("at", place("n", "salt", "rank"))
    return placed.select("key", "part_no", "token_start", "token_end", "at.container_id", "at.container_size")
