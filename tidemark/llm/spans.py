"""Long spans that stand word for word in more than one record (problem 4).

Windows double level by level. At the first level, windows of a quarter of the
wanted length are taken where winnowing selects them: of all windows inside any
span of the wanted length at least one is selected, and the same one in each
record that holds the span. Windows found in one record only are dropped, the
others are doubled (to the left or to the right, one of which lies inside the
span) and counted again. At the last level the surroundings of the survivors
are compared character by character at the full length.

Copies are folded twice: records of one text are shared from end to end and
only the smallest id goes on, and surroundings that are equal are compared once
and their places looked up afterwards. So a text, or most of one, may stand in
a third of all records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.session import stored

LENGTH = 300
#: Ids of copies are broadcast up to this number; beyond it they are joined.
BROADCAST_ROWS = 500_000


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost minimum of each ``width`` consecutive hashes (winnowing), each place once."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= width:
        return np.array([int(h.argmin())])
    # minima of sliding windows by running minima over blocks, place breaking ties
    pad = -n % width
    order = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    left = np.minimum.accumulate(order, axis=1).ravel()
    right = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - width + 1], left[width - 1 : n])
    # a place is selected if it holds the minimum of a window and no equal value stands left of it in that window
    change = np.concatenate(([True], low[1:] != low[:-1]))
    first = np.flatnonzero(change)
    out = []
    ends = np.append(first[1:], len(low))
    for a, b in zip(first.tolist(), ends.tolist()):
        places = np.flatnonzero(h[a : b + width - 1] == low[a]) + a
        if len(places) == 1:
            out.append(places)
            continue
        # the leftmost in each window a..b-1
        k = np.searchsorted(places, np.arange(a, b))
        out.append(places[np.unique(k[k < len(places)])])
    return np.unique(np.concatenate(out))


def _first_level(length: int):
    base, double = length // 4, length // 2
    width = length - base + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, hb, hl, hr = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = hashing.prefix(hashing.codepoints(text))
                n = len(h) - 1
                if n < length:
                    continue
                w = hashing.windows(h, base)
                at = _anchors(w, width)
                ids.append(np.full(len(at), key))
                pos.append(at)
                hb.append(w[at])
                # doubled windows: 0 stands for one that would leave the text
                back, fore = at - (double - base), at + double
                left = np.zeros(len(at), np.uint64)
                ok = back >= 0
                left[ok] = hashing.spans(h, back[ok], back[ok] + double)
                right = np.zeros(len(at), np.uint64)
                ok = fore <= n
                right[ok] = hashing.spans(h, at[ok], fore[ok])
                hl.append(left)
                hr.append(right)
            if ids:
                cols = [pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(pos).astype(np.int32))]
                cols += [pa.array(np.concatenate(c).view(np.int64)) for c in (hb, hl, hr)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "pos", "h", "hl", "hr"])

    return run


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs in more than one record; counts are combined before the shuffle."""
    several = rows.groupBy(key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select(key)
    return rows.join(several, key, "left_semi")


def _surroundings(length: int):
    """Explodes (id, text, positions) into the surroundings of each position."""
    base = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, froms, ats, texts = [], [], [], [], []
            for key, text, marks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for m in marks:
                    p = m["pos"]
                    lo = max(0, p - (length - base))
                    ids.append(key)
                    hs.append(m["h"])
                    froms.append(lo)
                    ats.append(p - lo)
                    texts.append(text[lo : p + length])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(froms, pa.int32()), pa.array(ats, pa.int32()), pa.array(texts, pa.string())], names=["h", "id", "lo", "at", "context"])

    return run


def _window_rows(length: int):
    """Explodes surroundings into their windows of the full length, for groups too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                hs, cs, ats, contexts, los, his = (batch.column(k).slice(a, 200).to_pylist() for k in range(6))
                out = [_windows_of(c, at, length) for c, at in zip(contexts, ats)]
                n = [len(x) for x in out]
                start = np.concatenate([np.arange(k) for k in n])
                w = hashing.mix(np.concatenate(out) ^ hashing.mix(np.repeat(np.array(hs, np.int64), n).view(np.uint64)))
                cols = [w.view(np.int64), *(np.repeat(np.array(x, np.int64), n) for x in (hs, cs)), start.astype(np.int32), *(np.repeat(np.array(x, np.int64), n) for x in (los, his))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["w", "h", "c", "s", "lo_id", "hi_id"])

    return run


def _windows_of(context: str, at: int, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` that begin at or before ``at``."""
    return hashing.windows(hashing.prefix(hashing.codepoints(context)), length)[: at + 1]


def _last_level(length: int):
    """Compares the surroundings of each group (sorted by ``h``) and yields shared stretches."""

    def solve(h: np.ndarray, cs: list, ats: list, contexts: list, los: list, his: list) -> pa.RecordBatch | None:
        ws = [_windows_of(c, at, length) for c, at in zip(contexts, ats)]
        sizes = np.array([len(w) for w in ws])
        if not sizes.sum():
            return None
        member = np.repeat(np.arange(len(ws)), sizes)
        # the window hash within its group: equal windows of other groups are found there
        w = hashing.mix(np.concatenate(ws) ^ hashing.mix(h[member].view(np.uint64)))
        order = np.argsort(w, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], w[order][1:] != w[order][:-1])))
        lo = np.minimum.reduceat(np.asarray(los, np.int64)[member][order], new)
        hi = np.maximum.reduceat(np.asarray(his, np.int64)[member][order], new)
        shared = np.zeros(len(w), bool)
        shared[order] = np.repeat(lo != hi, np.diff(np.append(new, len(w))))
        offset = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(shared)
        if not len(at):
            return None
        # runs of offsets within a member
        cut = np.flatnonzero((np.diff(offset[at]) != 1) | (np.diff(member[at]) != 0))
        first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
        m = member[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(h[m]), pa.array(np.asarray(cs, np.int64)[m]), pa.array(offset[first].astype(np.int32)), pa.array((offset[last] + length).astype(np.int32))], names=["h", "c", "s", "e"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            got = solve(t["h"].to_numpy(), *(t[c].to_pylist() for c in ("c", "at", "context", "lo_id", "hi_id")))
            if got is not None:
                yield got

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != h[0] and sum(b.num_rows for b in held) > 500:
                yield from flush(held)
                held = []
            begin = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if begin > 0:
                yield from flush([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from flush(held)

    return run


def shared_stretches(records: DataFrame, key: str, text: str, length: int = LENGTH, hot: int = 2000) -> DataFrame:
    """(id, start_pos, end_pos): merged stretches of ``length`` or more that stand verbatim in a record of another id.

    Texts below the length and null texts or ids have none. Rows of one id are
    one record: a repetition inside it counts for nothing. Other columns are
    not read. Groups of more than ``hot`` different surroundings are compared
    by counting their windows over the cluster instead of in one task.
    """
    base = length // 4
    given = records.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where(f"t is not null and id is not null and length(t) >= {length}")
    digests = stored(given.select("id", F.md5("t").alias("d"), F.length("t").alias("n")))
    classes = digests.groupBy("d").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("d", "lo")
    copies = stored(digests.join(classes, "d"))
    whole = copies.select("id", F.lit(0).cast("bigint").alias("start_pos"), F.col("n").cast("bigint").alias("end_pos"))
    others = copies.where("id <> lo").select("id").distinct()
    given = given.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, "id", "left_anti")
    anchors = stored(given.mapInArrow(_first_level(length), "id bigint, pos int, h bigint, hl bigint, hr bigint"))
    level = _repeated(anchors, "h")
    sides = level.select("id", "pos", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("hl").alias("d")), F.struct(F.lit(1).alias("side"), F.col("hr").alias("d")))).alias("x")).select("id", "pos", "h", F.when(F.col("x.d") != 0, F.xxhash64("x.side", "x.d")).alias("d"))
    level = _repeated(sides.where("d is not null"), "d").groupBy("id").agg(F.collect_set(F.struct("pos", "h")).alias("marks"))
    around = stored(given.join(level, "id").select("id", "t", "marks").mapInArrow(_surroundings(length), "h bigint, id bigint, lo int, at int, context string").withColumn("c", F.xxhash64("context", "at")))
    # each surrounding once, with the smallest and greatest id that has it
    once = stored(around.groupBy("h", "c", "at", "context").agg(F.min("id").alias("lo_id"), F.max("id").alias("hi_id")))
    sizes = once.groupBy("h").count().where(F.col("count") > hot).select("h")
    small = once.join(sizes, "h", "left_anti").repartition("h").sortWithinPartitions("h").select("h", "c", "at", "context", "lo_id", "hi_id")
    found = small.mapInArrow(_last_level(length), "h bigint, c bigint, s int, e int")
    windows = once.join(sizes, "h", "left_semi").select("h", "c", "at", "context", "lo_id", "hi_id").mapInArrow(_window_rows(length), "w bigint, h bigint, c bigint, s int, lo_id bigint, hi_id bigint")
    several = windows.groupBy("w").agg(F.min("lo_id").alias("lo"), F.max("hi_id").alias("hi")).where("lo <> hi").select("w")
    wide = windows.join(several, "w", "left_semi").select("h", "c", "s", (F.col("s") + length).alias("e"))
    places = around.select("h", "c", "id", "lo")
    placed = places.join(found.unionAll(wide), ["h", "c"]).select("id", (F.col("lo") + F.col("s")).cast("bigint").alias("start_pos"), (F.col("lo") + F.col("e")).cast("bigint").alias("end_pos"))
    return merged(placed.unionAll(whole).distinct())


def merged(stretches: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of one record as one; a record has no more of them than characters."""
    w = Window.partitionBy("id").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = stretches.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start_pos")).cast("int"))
    return new.withColumn("no", F.sum("new").over(w)).groupBy("id", "no").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("no")
