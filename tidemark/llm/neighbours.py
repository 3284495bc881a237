"""The most similar vectors of every vector (problem 5).

Vectors are assigned to cells around centroids. What is left of a vector after
its centroid is quantised to four bits for each pair of dimensions, by codes
that penalise the error parallel to the vector more than the error across it
(score-aware, anisotropic), because only the parallel error moves large inner
products. The codes, a sixteenth of a vector, are what is copied: to the cells
nearest to the vector. Each query scans the codes in its own cell through a
table of its inner products with every code, and its shortlist is reranked with
whole vectors in the cells where the listed vectors live.

The number of cells grows with the root of the number of vectors, so that
cells and copies grow together: a code is copied to twice as many cells as the
logarithm of their number says, and what a query scans grows with the root.

Equal vectors are searched for once, by the smallest id among them, and spelled
out in the end, so a group of copies may hold a third of all rows.

Centroids and code books are fitted on a bounded sample (``SAMPLE`` vectors or
``PER_CELL`` a cell, whichever is more, taken by the hash of their id); every
vector is indexed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

DIMS = 384
SAMPLE = 10_000
PER_CELL = 12
#: A cell expecting more queries than this is served in blocks of it.
BLOCK = 8192
#: The bound of the fitted model; up to some 46 million vectors cells grow with their root.
MOST_CELLS = 4096
#: Fewest cells that a vector's code is copied to, and fewest listed vectors.
PROBES = 16
SHORTLIST = 96
#: Queries that share a table, codes scanned at once, and codes held before they are scanned.
_TILE, _CHUNK, _HELD = 128, 2048, 65_536
#: Ids of copies are broadcast up to this number; beyond it they are joined.
BROADCAST_ROWS = 500_000
#: Inner products below this share of the norm do not matter (the T of score-aware quantisation).
THRESHOLD = 0.2


def _usable(blobs: list[bytes | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as they are, and which blobs hold them."""
    good = np.array([b is not None and len(b) == 4 * dims for b in blobs], bool)
    at = np.flatnonzero(good)
    x = np.frombuffer(b"".join(blobs[k] for k in at), "<f4").reshape(-1, dims).astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
    return x[ok].astype(np.float32), at[ok]


def _unit(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(kind)


def _lloyd(x: np.ndarray, k: int, rounds: int, spherical: bool, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))).argmax(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(np.float32)
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Quantiser:
    """Centroids of cells, and sixteen codes for each pair of dimensions of the residual."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = _lloyd(sample, cells, 8, True, rng)
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(1)]
        few = rest[rng.choice(len(rest), min(len(rest), 4096), replace=False)]
        self.pairs = sample.shape[1] // 2
        book = [_lloyd(few[:, 2 * m : 2 * m + 2], 16, 6, False, rng) for m in range(self.pairs)]
        self.book = np.stack([np.pad(b, ((0, 16 - len(b)), (0, 0)), mode="edge") for b in book])
        self.eta = (sample.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)
        self.load = np.bincount((sample @ self.centroids.T).argmax(1), minlength=len(self.centroids))

    def encode(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Codes that minimise eta * (parallel error)**2 + (error across)**2 by coordinate descent; two codes a byte."""
        rest = (x - self.centroids[home]).reshape(len(x), self.pairs, 2)
        unit = x.reshape(len(x), self.pairs, 2)
        codes = np.empty((len(x), self.pairs), np.uint8)
        parallel = np.zeros(len(x), np.float32)
        for m in range(self.pairs):
            e = rest[:, m, None] - self.book[m][None]
            codes[:, m] = (e * e).sum(2).argmin(1)
            parallel += ((rest[:, m] - self.book[m][codes[:, m]]) * unit[:, m]).sum(1)
        for m in range(self.pairs):
            e = rest[:, m, None] - self.book[m][None]
            along = np.einsum("nkd,nd->nk", e, unit[:, m])
            others = parallel - along[np.arange(len(x)), codes[:, m]]
            cost = (self.eta - 1) * (others[:, None] + along) ** 2 + (e * e).sum(2)
            codes[:, m] = cost.argmin(1)
            parallel = others + along[np.arange(len(x)), codes[:, m]]
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def scores(self, x: np.ndarray, packed: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Inner products of the queries ``x`` with the quantised vectors, by look-ups in the queries' tables.

        A table holds a query's inner product with each of the sixteen codes of
        each pair of dimensions, in 16-bit steps, put together for the two codes
        of a byte; a scan adds up one entry for each byte of the codes.
        """
        one = np.einsum("qmd,mkd->mkq", x.reshape(len(x), self.pairs, 2), self.book, optimize=True)
        step = 32_000 / max(float(np.abs(one).max(1).sum(0).max()), 1e-9)
        one = np.rint(one * step).astype(np.int16)
        table = (one[1::2, :, None] + one[0::2, None]).reshape(self.pairs // 2, 256, len(x))
        whole = (x @ self.centroids.T).T
        codes = np.ascontiguousarray(packed.T)
        out = np.empty((len(x), len(packed)), np.float32)
        for lo in range(0, len(packed), _CHUNK):
            some = codes[:, lo : lo + _CHUNK]
            total, entry = np.zeros((some.shape[1], len(x)), np.int16), np.empty((some.shape[1], len(x)), np.int16)
            for j in range(len(some)):
                np.take(table[j], some[j], axis=0, out=entry, mode="clip")
                total += entry
            out[:, lo : lo + _CHUNK] = (total.astype(np.float32) / step + whole[home[lo : lo + _CHUNK]]).T
        return out


def cells_for(total: int) -> int:
    return int(np.clip(round(0.6 * math.sqrt(total)), 1, MOST_CELLS))


def probes_for(cells: int) -> int:
    """Cells a code is copied to; what routing loses hardly grows with the cells (README gives the figures)."""
    return min(cells, max(PROBES, math.ceil(2 * math.log2(cells + 1))))


def shortlist_for(total: int) -> int:
    """Vectors to rerank: more of them come between the true neighbours by the codes' error as the vectors get denser."""
    return max(SHORTLIST, math.ceil(4.2 * total**0.25))


def fit(vectors: DataFrame, dims: int, total: int) -> Quantiser:
    """Fitted on the vectors whose hash falls into a share of the ids, which bounds their number whatever the total."""
    cells = cells_for(total)
    share = min(1.0, max(SAMPLE, PER_CELL * cells) / total)
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("vec").collect()
    if not rows:
        rows = vectors.select("vec").limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join(r.vec for r in rows), "<f4").reshape(-1, dims)
    return Quantiser(_unit(sample), min(cells, len(sample)))


def _fixed(col: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def nearest(records: DataFrame, key: str, blob: str, k: int = 10, dims: int = DIMS, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
    """(id, other, similarity, rank) of the ``k`` most similar vectors of every usable vector, by cosine.

    Unusable blobs (null, of another size, not finite, of length 0) and null
    ids are left out; rows that stand twice count once. Equal similarities go
    to the smaller id. With fewer than ``k`` others all of them are listed; an
    empty table gives no rows. Other columns are not read. ``probes`` and
    ``shortlist`` follow the number of vectors unless given.
    """
    spark = records.sparkSession

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _usable(batch.column(1).to_pylist(), dims)
            blobs = [v.tobytes() for v in x]
            digests = [hashlib.blake2b(v, digest_size=16).digest() for v in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(blobs, pa.binary()), pa.array(digests, pa.binary())], names=["id", "vec", "d"])

    given = records.select(F.col(key).cast("bigint").alias("id"), F.col(blob).alias("b")).where("id is not null and b is not null")
    vectors = given.mapInArrow(decode, "id bigint, vec binary, d binary")
    keys = stored(vectors.groupBy("id").agg(F.min("d").alias("d"), F.count("*").alias("times")))
    classes = stored(keys.groupBy("d").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "id bigint, other bigint, similarity double, rank int")
    if keys.where("times > 1").limit(1).count():
        vectors = vectors.groupBy("id").agg(F.min_by("vec", "d").alias("vec"), F.min("d").alias("d"))
    copies = keys.join(classes.where("n > 1"), "d").where("id <> rep").select("id")
    vectors = vectors.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti").select("id", "vec")
    shared = spark.sparkContext.broadcast(fit(vectors, dims, total))
    cells = len(shared.value.centroids)
    probes, shortlist = min(probes or probes_for(cells), cells), shortlist or shortlist_for(total)
    scale = total / len_sample(shared.value)
    blocks = spark.sparkContext.broadcast(np.maximum(1, np.ceil(shared.value.load * scale / BLOCK)).astype(np.int64))

    def copied(cell: np.ndarray, block: np.ndarray, kind: int, who: np.ndarray, home: np.ndarray, data: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(who), kind, np.int8)), pa.array(who), pa.array(home.astype(np.int32)), data],
            names=["cell", "block", "kind", "id", "home", "data"],
        )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, nb = shared.value, blocks.value
        p = probes
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            x = _unit(_fixed(batch.column(1), dims, "<f4"))
            score = x @ q.centroids.T
            near = np.argpartition(-score, p - 1, axis=1)[:, :p] if p < score.shape[1] else np.tile(np.arange(p), (len(x), 1))
            home = score.argmax(1)
            codes = [c.tobytes() for c in q.encode(x, home)]
            n = len(x)
            # queries: to one block of their cell, with the vector
            yield copied(home, own % nb[home], 0, own, home, batch.column(1))
            # codes: to every block of each near cell, a batch for each so that memory does not grow with the cells
            for j in range(p):
                c = near[:, j]
                times = nb[c]
                at = np.repeat(np.arange(n), times)
                yield copied(c[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), 1, own[at], home[at], pa.array([codes[a] for a in at], pa.binary()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a cell block come first, then its codes, which are scanned some at a time."""
        q, nb = shared.value, blocks.value
        state: dict = {"at": None}

        def sweep() -> None:
            """Scan the codes at hand for all queries and keep the shortlists."""
            if not state["codes"] or not len(state["ids"]):
                state["codes"], state["held"] = [], 0
                return
            who, home = (np.concatenate([c[k] for c in state["codes"]]) for k in (0, 1))
            packed = np.concatenate([c[2] for c in state["codes"]])
            state["codes"], state["held"] = [], 0
            n = len(state["ids"])
            if state["score"] is None:
                state["score"] = np.full((n, shortlist), -np.inf, np.float32)
                state["cand"], state["home"] = np.zeros((n, shortlist), np.int64), np.zeros((n, shortlist), np.int32)
            for lo in range(0, n, _TILE):
                at = slice(lo, lo + _TILE)
                score = q.scores(_unit(state["vec"][at]), packed, home)
                score[state["ids"][at, None] == who[None]] = -np.inf
                if score.shape[1] > shortlist:
                    top = np.argpartition(-score, shortlist - 1, axis=1)[:, :shortlist]
                else:
                    top = np.tile(np.arange(score.shape[1]), (len(score), 1))
                score = np.concatenate([state["score"][at], np.take_along_axis(score, top, 1)], axis=1)
                cand, homes = np.concatenate([state["cand"][at], who[top]], axis=1), np.concatenate([state["home"][at], home[top]], axis=1)
                top = np.argpartition(-score, shortlist - 1, axis=1)[:, :shortlist]
                state["score"][at], state["cand"][at], state["home"][at] = (np.take_along_axis(x, top, 1) for x in (score, cand, homes))

        def close() -> Iterator[pa.RecordBatch]:
            if state["at"] is None:
                return
            sweep()
            if not len(state["ids"]) or state["score"] is None:
                return
            qid, vec = state["ids"], state["vec"]
            kept = np.isfinite(state["score"])
            who = np.repeat(np.arange(len(qid)), kept.sum(1))
            cand, home = state["cand"][kept], state["home"][kept]
            part = cand % nb[home]
            order = np.lexsort((part, home, who))
            who, cand, home, part = who[order], cand[order], home[order], part[order]
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (home[1:] != home[:-1]) | (part[1:] != part[:-1])))) if len(who) else np.zeros(0, int)
            if not len(new):
                return
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(who)).astype(np.int32)), pa.array(cand))
            yield pa.RecordBatch.from_arrays(
                [pa.array(home[new].astype(np.int32)), pa.array(part[new].astype(np.int32)), pa.array(np.ones(len(new), np.int8)), pa.array(qid[who[new]]), pa.array([vec[w].tobytes() for w in who[new]], pa.binary()), lists],
                names=["cell", "block", "kind", "id", "data", "cands"],
            )

        for batch in batches:
            cell, block, kind = (batch.column(j).to_numpy() for j in range(3))
            group = cell.astype(np.int64) << 33 | block.astype(np.int64) << 1 | kind
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
                if b == a:
                    continue
                at = (int(cell[a]), int(block[a]))
                if at != state["at"]:
                    yield from close()
                    state = {"at": at, "ids": np.zeros(0, np.int64), "vec": np.zeros((0, dims), np.float32), "score": None, "codes": [], "held": 0}
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    state["ids"] = np.append(state["ids"], part.column(3).to_numpy())
                    state["vec"] = np.concatenate([state["vec"], _fixed(part.column(5), dims, "<f4")])
                    continue
                state["codes"].append((part.column(3).to_numpy(), part.column(4).to_numpy(), _fixed(part.column(5), dims // 4, np.uint8)))
                state["held"] += b - a
                if state["held"] >= _HELD:
                    sweep()
        yield from close()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a cell block come first, then the queries whose shortlists name them."""
        at, ids, vec, sorter = None, np.zeros(0, np.int64), np.zeros((0, dims), np.float32), None
        for batch in batches:
            cell, block, kind = (batch.column(j).to_numpy() for j in range(3))
            group = cell.astype(np.int64) << 33 | block.astype(np.int64) << 1 | kind
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
                if b == a:
                    continue
                if at != (int(cell[a]), int(block[a])):
                    at, ids, vec, sorter = (int(cell[a]), int(block[a])), np.zeros(0, np.int64), np.zeros((0, dims), np.float32), None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    ids = np.append(ids, part.column(3).to_numpy())
                    vec = np.concatenate([vec, _fixed(part.column(4), dims, "<f4")])
                    continue
                if sorter is None:
                    sorter = np.argsort(ids, kind="stable")
                lists = part.column(5)
                cand = lists.flatten().to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                who = np.repeat(np.arange(b - a), sizes)
                q = _unit(_fixed(part.column(4), dims, "<f4"), np.float64)
                found = sorter[np.searchsorted(ids, cand, sorter=sorter)]
                sim = np.concatenate([np.einsum("nd,nd->n", q[who[s : s + 8192]], _unit(vec[found[s : s + 8192]], np.float64)) for s in range(0, len(who), 8192)])
                yield pa.RecordBatch.from_arrays([pa.array(part.column(3).to_numpy()[who]), pa.array(cand), pa.array(sim)], names=["id", "other", "similarity"])

    routed = vectors.mapInArrow(assign, "cell int, block int, kind tinyint, id bigint, home int, data binary")
    short = routed.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(scan, "cell int, block int, kind tinyint, id bigint, data binary, cands array<bigint>")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, nb = shared.value, blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            home = (_unit(_fixed(batch.column(1), dims, "<f4")) @ q.centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array((own % nb[home]).astype(np.int32)), pa.array(np.zeros(len(own), np.int8)), batch.column(0), batch.column(1)], names=["cell", "block", "kind", "id", "data"])

    living = vectors.mapInArrow(homes, "cell int, block int, kind tinyint, id bigint, data binary").withColumn("cands", F.lit(None).cast("array<bigint>"))
    scored = living.unionAll(short).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(rerank, "id bigint, other bigint, similarity double")
    best = lambda who, other: Window.partitionBy(who).orderBy(F.desc(F.round("similarity", 7)), other)
    near = scored.withColumn("rank", F.row_number().over(best("id", "other"))).where(F.col("rank") <= k).select(F.col("id").alias("rep"), "other", "similarity")
    # copies: the k + 1 smallest ids of a class are all that a list can hold of it
    own = classes.where("n > 1").select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity"))
    heads = keys.withColumn("no", F.row_number().over(Window.partitionBy("d").orderBy("id"))).where(F.col("no") <= k + 1).join(classes, "d").select(F.col("rep").alias("other"), F.col("id").alias("member"))
    lists = near.unionAll(own).join(heads, "other").withColumn("rank", F.row_number().over(best("rep", "member"))).where(F.col("rank") <= k + 1).select("rep", "member", "similarity")
    members = keys.join(classes, "d").select("rep", "id")
    spelled = members.join(lists, "rep").where("id <> member").select("id", F.col("member").alias("other"), "similarity")
    return spelled.withColumn("rank", F.row_number().over(best("id", "other"))).where(F.col("rank") <= k)


def len_sample(q: Quantiser) -> int:
    return int(q.load.sum())
