"""Records that are the same text up to small edits (problem 2).

The token-group matrix is a table of groups of similar records with, for each
group, the union of its members' tokens: a query's overlap with the union
bounds its overlap with every member, so a group is opened only if the bound
reaches what the threshold needs and sizes allow it.

Here the matrix is spread over the cluster. A record's five-character tokens
are hashed by one-permutation minhash; bands of hashes partition records that
may be similar into buckets, and each bucket holds its part of the matrix:
groups of up to ``GROUP`` records that lie next to each other in token order,
and for each group the union of the sampled tokens at each of 64 places and the
range of its members' numbers of tokens. Every bucket, of whatever size, is
searched through its groups. Members of opened groups are compared sketch by
sketch, and what is left is verified exactly on the whole sets of
five-character substrings.

A bucket that gets hot is banded again by the sampled tokens, so its records
meet only where they agree once more; what stays hot even then is compared in
pairs of blocks. Exact copies are folded into one representative before any of
this.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.operators.graph import both_ways, components
from tidemark.session import stored

SIMILARITY = 0.7
GRAM = 5
LEAST_CHARS = 40
_SALTS, _BINS = 4, 64
#: Sampled tokens of a record: one of each bin, kept as four bits of its hash.
_PLACES = 64
#: Chance that no band brings two records of just the threshold together.
MISS = 1.5e-3
#: Rows of a bucket that one task compares; larger buckets are banded again, then compared in blocks.
HOT = 4096
#: Bands of three sampled tokens that a hot bucket is split by: two records of just the threshold miss all of them with a chance of ``MISS``.
AGAIN = 15
#: Pairs of one record that are verified together, so that its text travels once for all of them.
TOGETHER = 64
GROUP = 16
#: Hot buckets and ids of copies are broadcast up to this number; beyond it they are joined.
BROADCAST_ROWS = 500_000
#: Copy groups up to this size come out as all their pairs, larger ones as a star around the representative.
EXPAND = 20

_OTHER = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")


def normal_form(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def similarity(a: str, b: str) -> float:
    """Share of the distinct five-character substrings of two normal forms that both contain."""
    x, y = ({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def bands_for(records: int, similar: float) -> tuple[int, int]:
    """(rows of a band, bands): a longer band for each tenfold of a million records, as many bands as ``MISS`` needs."""
    r = 4 + max(0, math.ceil(math.log10(max(records, 1) / 1e6)))
    return r, math.ceil(math.log(MISS) / math.log(1 - similar**r))


def minhashes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation minhash with ``_SALTS`` salts and ``_BINS`` bins, empty bins filled from others of the record, and the number of distinct tokens."""
    cps = [hashing.codepoints(f) for f in forms]
    sizes = np.array([len(c) for c in cps])
    tokens = hashing.windows(hashing.prefix(np.concatenate(cps)), GRAM)
    doc = np.repeat(np.arange(len(forms)), sizes)[: len(tokens)]
    last = np.cumsum(sizes) - GRAM
    ok = np.arange(len(tokens)) <= last[doc]
    tokens, doc = tokens[ok], doc[ok]
    # distinct tokens of each text: one sort of hashes whose 16 lowest bits give way to the number of the text
    mask = np.uint64(0xFFFF)
    both = np.sort(tokens & ~mask | doc.astype(np.uint64))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    tokens, doc = both & ~mask, (both & mask).astype(np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((_SALTS, len(forms), _BINS), none)
    for s in range(_SALTS):
        t = hashing.mix(tokens, s + 1)
        flat = out[s].reshape(-1)
        np.minimum.at(flat, doc * _BINS + (t >> np.uint64(58)).astype(np.int64), t & np.uint64((1 << 58) - 1))
        m = out[s]
        empty = m == none
        held = m.copy()
        attempt = 0
        while empty.any() and attempt < 400:
            attempt += 1
            source = (hashing.mix(np.arange(_BINS, dtype=np.uint64), 1000 + attempt) >> np.uint64(58)).astype(np.int64)
            take = empty & (held[:, source] != none)
            m[take] = hashing.mix(held[:, source], attempt)[take]
            empty &= ~take
    return out.transpose(1, 0, 2).reshape(len(forms), _SALTS * _BINS), np.bincount(doc, minlength=len(forms))


def band_keys(m: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.empty((len(m), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(m), np.uint64(b * 7919 + 1))
        for i in range(rows):
            # the first 64 bands take one bin of each salt; further rows and bands pair other bins
            acc = hashing.mix(acc ^ m[:, (i % _SALTS) * _BINS + (b + (23 + i * (b // _BINS)) * (i // _SALTS) + 7 * i * (b // _BINS)) % _BINS], i + 1)
        keys[:, b] = acc
    return keys


def sketches(m: np.ndarray) -> np.ndarray:
    """The sampled token of each bin of the first salt, four bits each, as four words of 64."""
    bits = (hashing.mix(m[:, :_PLACES], 77) & np.uint64(15)).astype(np.uint8)
    return (bits[:, 0::2] | bits[:, 1::2] << 4).view(np.uint64)


def least_agreement(similar: float) -> int:
    """Sampled tokens that two records of just the threshold share, less four standard deviations."""
    p = similar + (1 - similar) / 16
    return int(_PLACES * p - 4 * math.sqrt(_PLACES * p * (1 - p)))


_ONES = np.uint64(0x1111111111111111)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return _PLACES - np.bitwise_count(x & _ONES).sum(-1, dtype=np.int64)


def _tokens(s: np.ndarray) -> np.ndarray:
    flat = s.view(np.uint8).reshape(len(s), -1)
    out = np.empty((len(s), _PLACES), np.uint8)
    out[:, 0::2], out[:, 1::2] = flat & 15, flat >> 4
    return out


class Matrix:
    """The token-group matrix of the buckets at hand: rows must come sorted by bucket."""

    def __init__(self, bucket: np.ndarray, sk: np.ndarray, size: np.ndarray, least: int, similar: float):
        self.least, self.room = least, 1 / similar * 1.02  # sizes are kept to a hundredth
        order = np.lexsort((*sk.T[::-1], bucket))
        self.order, self.bucket, self.sk, self.size = order, bucket[order], sk[order], size[order]
        n = len(order)
        edge = np.flatnonzero(np.concatenate(([True], self.bucket[1:] != self.bucket[:-1])))
        length = np.diff(np.append(edge, n))
        # a group ends with its bucket, where the next record is not like the last one, and at GROUP members
        fresh = np.concatenate(([True], (self.bucket[1:] != self.bucket[:-1]) | (_agree(self.sk[1:], self.sk[:-1]) < least)))
        run = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        self.start = np.flatnonzero(place % GROUP == 0)
        self.stop = np.append(self.start[1:], n)
        self.group = np.repeat(np.arange(len(self.start)), self.stop - self.start)
        self.last = np.repeat(np.searchsorted(self.start, edge + length) - 1, length)  # last group of each row's bucket
        self.tokens = _tokens(self.sk)
        one = np.left_shift(np.uint16(1), self.tokens.astype(np.uint16))
        self.union = np.zeros((len(self.start), _PLACES), np.uint16)
        self.twice = np.zeros_like(self.union)  # tokens of two members at least: what a member finds in the others of its own group
        for k in range(GROUP):
            at = np.flatnonzero(self.start + k < self.stop)
            x = one[self.start[at] + k]
            self.twice[at] |= self.union[at] & x
            self.union[at] |= x
        self.low, self.high = np.minimum.reduceat(self.size, self.start), np.maximum.reduceat(self.size, self.start)
        self.tests = self.opened = 0

    def _bound(self, q: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Whether any member of group ``g`` may be similar enough to query ``q``: overlap with the union, and sizes."""
        held = self.union[g]
        own = np.flatnonzero(self.group[q] == g)
        held[own] = self.twice[g[own]]
        overlap = (held >> self.tokens[q] & np.uint16(1)).sum(1, dtype=np.int64)
        self.tests += len(q)
        fit = (overlap >= self.least) & (self.low[g] <= self.size[q] * self.room) & (self.high[g] * self.room >= self.size[q])
        self.opened += int(fit.sum())
        return fit

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows (as given) of each pair that shares a bucket and enough sampled tokens."""
        first, second = [], []
        # groups of the bucket from the row's own on, or from the next where the row has its group to itself
        skip = (self.stop[self.group] - self.start[self.group] == 1).astype(np.int64)
        many = self.last - self.group + 1 - skip
        lo = 0
        reach = np.cumsum(many)
        while lo < len(many):
            hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + 200_000, "right")))
            q = np.repeat(np.arange(lo, hi), many[lo:hi])
            g = self.group[q] + skip[q] + np.arange(len(q)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
            ok = self._bound(q, g)
            q, g = q[ok], g[ok]
            size = self.stop[g] - self.start[g]
            i = np.repeat(q, size)
            j = np.repeat(self.start[g], size) + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            i, j = i[j > i], j[j > i]
            ok = _agree(self.sk[i], self.sk[j]) >= self.least
            first.append(self.order[i[ok]])
            second.append(self.order[j[ok]])
            lo = hi
        none = [np.zeros(0, np.int64)]
        return np.concatenate(first or none), np.concatenate(second or none)


def _open_groups(least: int, similar: float):
    """Candidates of each bucket; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            route, side, ids, code, size = (t[c].to_numpy() for c in ("route", "side", "id", "code", "size"))
            edge = np.concatenate(([True], route[1:] != route[:-1]))
            alone = edge & np.append(edge[1:], True)
            if alone.all():
                return
            keep = np.flatnonzero(~alone)
            sk = np.stack([t[f"s{w}"].to_numpy()[keep] for w in range(4)], 1).view(np.uint64)
            i, j = Matrix(route[keep], sk, size[keep].astype(np.float64), least, similar).pairs()
            i, j = keep[i], keep[j]
            ok = (side[i] != side[j]) | (side[i] == 0)
            i, j = i[ok], j[ok]
            x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            pairs = np.unique(np.stack([code[i].astype(np.int64), x, y], 1)[x != y], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c].copy()) for c in range(3)], names=["code", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            route = batch.column(0).to_numpy()
            begin = int(np.flatnonzero(route != route[-1])[-1] + 1) if (route != route[-1]).any() else 0
            if begin or held and held[-1].column(0)[-1].as_py() != route[0]:
                yield from flush([*held, batch.slice(0, begin)] if begin else held)
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from flush(held)

    return run


def signed(records: DataFrame, kind: str, key: str, text: str, rows: int, bands: int) -> DataFrame:
    """(kind, id, digest, size, keys, s0..s3) of every record whose normal form is long enough; ``size`` is its number of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ids, texts = (batch.column(j).to_pylist() for j in range(3))
            at, total, start = [], 0, 0
            chunks = []
            forms = [normal_form(t) for t in texts]
            for j, f in enumerate(forms):
                if len(f) < LEAST_CHARS:
                    continue
                at.append(j)
                total += len(f)
                if total > 1_000_000 or len(at) == 0xFFFF:
                    chunks.append(at)
                    at, total = [], 0
            if at:
                chunks.append(at)
            for at in chunks:
                m, sizes = minhashes([forms[j] for j in at])
                salts = {k: zlib.crc32(str(k).encode()) for k in set(kinds)}
                salt = np.array([salts[kinds[j]] for j in at], np.uint64)
                keys = hashing.mix(band_keys(m, rows, bands) ^ salt[:, None]).view(np.int64)
                sk = sketches(m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kinds[j] for j in at]), pa.array([ids[j] for j in at], pa.int64()), pa.array([hashlib.blake2b(forms[j].encode("utf-8", "surrogatepass"), digest_size=16).digest() for j in at], pa.binary()), pa.array(sizes.astype(np.int32)), lists, *(pa.array(sk[:, w].copy().view(np.int64)) for w in range(4))],
                    names=["kind", "id", "digest", "size", "keys", "s0", "s1", "s2", "s3"],
                )

    given = records.select(F.col(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where(f"t is not null and id is not null and kind is not null and length(t) >= {LEAST_CHARS}")
    return given.mapInArrow(run, "kind string, id bigint, digest binary, size int, keys array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _verify(least: float):
    """Exact similarity of a record's text (side 0) to those of its partners, which follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for batch in batches:
            out: dict[tuple, float] = {}
            for k, hub, part, side, other, text in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if (k, hub, part) != at:
                    at, mine = (k, hub, part), []
                grams = _grams(normal_form(text))
                if not side:
                    mine.append(grams)
                    continue
                for x in mine:
                    both = len(x & grams)
                    s = both / (len(x) + len(grams) - both)
                    if s >= least:
                        key = (k, min(hub, other), max(hub, other))
                        out[key] = max(s, out.get(key, 0.0))
            yield _pairs([(*k, s) for k, s in out.items()])

    return run


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["kind", "a", "b", "similarity"])


def near_copies(records: DataFrame, kind: str, key: str, text: str, similar: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links between representatives (kind, a, b, similarity) and membership (kind, rep, id, copies).

    Texts are compared within a kind. Null texts, null ids and texts whose
    normal form is shorter than ``LEAST_CHARS`` take no part; equal normal forms
    are copies of the representative, the smallest id among them; rows that
    stand twice count once. An empty table gives no rows; other columns are not
    read.
    """
    rows, bands = bands_for(records.count(), similar)
    sign = stored(signed(records, kind, key, text, rows, bands))
    kinds = sorted(r.kind for r in sign.select("kind").distinct().collect() if r.kind is not None)  # a few names of tables
    code = F.create_map(*[F.lit(x) for c, k in enumerate(kinds) for x in (k, c)]) if kinds else F.create_map()
    numbered = lambda c: F.try_element_at(code, F.col(c)).cast("tinyint") if kinds else F.lit(0).cast("tinyint")
    groups = sign.groupBy("kind", "digest").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")).where("copies > 1")
    members = stored(sign.select("kind", "digest", "id").distinct().join(groups, ["kind", "digest"]).select("kind", "rep", "id", "copies"))
    others = members.where("id <> rep").select("kind", "id")
    reps = sign.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, ["kind", "id"], "left_anti")
    words = ("id", "code", "size", "s0", "s1", "s2", "s3")
    # ids of different kinds may be equal: the routed row carries the number of its kind, which its bucket depends on as well
    routed = reps.select(F.explode("keys").alias("bucket"), "id", numbered("kind").alias("code"), "size", "s0", "s1", "s2", "s3")
    hot = _hot(routed)
    if hot is not None:
        again = F.array(*[F.struct(F.lit(i).alias("i"), (F.shiftrightunsigned(f"s{i // 5}", 12 * (i % 5)).bitwiseAND(4095)).alias("t")) for i in range(AGAIN)])
        warm = routed.join(hot.select("bucket"), "bucket", "left_semi").select("bucket", *words, F.explode(again).alias("x")).select(F.xxhash64("bucket", "x.i", "x.t").alias("bucket"), *words)
        routed = routed.join(hot.select("bucket"), "bucket", "left_anti").unionByName(warm)
        hot = _hot(warm)
    if hot is not None:
        routed = routed.join(hot, "bucket", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        routed = routed.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        # a pair of different blocks compares across only: its upper block is marked 1, its lower block 2
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2).cast("tinyint")
        routed = routed.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("route"), side.alias("side"), *words)
    else:
        routed = routed.select(F.col("bucket").alias("route"), F.lit(0).cast("tinyint").alias("side"), *words)
    links = stored(routed.repartition("route").sortWithinPartitions("route").mapInArrow(_open_groups(least_agreement(similar), similar), "code bigint, a bigint, b bigint").distinct())
    # the end with more links is the hub of a pair: its text travels once for each TOGETHER of them, the other end's once
    degree = links.select("code", F.explode(F.array("a", "b")).alias("id")).groupBy("code", "id").agg(F.count("*").alias("n"))
    sized = links.join(degree.select("code", F.col("id").alias("a"), F.col("n").alias("na")), ["code", "a"]).join(degree.select("code", F.col("id").alias("b"), F.col("n").alias("nb")), ["code", "b"])
    hub = F.when(F.col("na") >= F.col("nb"), F.struct(F.col("a").alias("hub"), F.col("b").alias("other"), F.col("na").alias("n"))).otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("other"), F.col("nb").alias("n")))
    turned = stored(sized.select("code", hub.alias("h")).select("code", "h.hub", "h.other", F.pmod(F.xxhash64("h.other"), F.ceil(F.col("h.n") / TOGETHER)).cast("int").alias("part")))
    heads = turned.select("code", "hub", "part").distinct().select("code", "hub", "part", F.lit(0).cast("tinyint").alias("side"), F.col("hub").alias("id"))
    ends = heads.unionByName(turned.select("code", "hub", "part", F.lit(1).cast("tinyint").alias("side"), F.col("other").alias("id")))
    given = records.select(F.col(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("t is not null and kind is not null").withColumn("code", numbered("kind").cast("bigint"))
    # texts without a candidate stay where they are, if the list of the others is of a bounded size
    wanted = ends.select("code", "id").distinct()
    if links.count() <= BROADCAST_ROWS:
        given = given.join(F.broadcast(wanted), ["code", "id"], "left_semi")
    sides = ends.join(given, ["code", "id"]).select("kind", "hub", "part", "side", "id", "t")
    sure = sides.repartition("kind", "hub", "part").sortWithinPartitions("kind", "hub", "part", "side").mapInArrow(_verify(similar), "kind string, a bigint, b bigint, similarity double")
    return sure.groupBy("kind", "a", "b").agg(F.max("similarity").alias("similarity")), members


def _hot(routed: DataFrame) -> DataFrame | None:
    """(bucket, nb) of the buckets that look hot in a sixteenth of the rows, if there are any; this decides on where rows meet, never on whether."""
    hot = stored(routed.where("pmod(xxhash64(id), 16) = 0").groupBy("bucket").count().where(F.col("count") > HOT // 16).select("bucket", F.ceil(F.col("count") * 16 / HOT).cast("int").alias("nb")))
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= BROADCAST_ROWS else hot


def all_pairs(links: DataFrame, members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """(kind, a, b), smaller id first, with copies spelled out.

    Groups of up to ``expand`` copies come out as all their pairs and link to
    others member by member; a larger group is a star around its representative,
    and its representative alone carries the links, from which all others follow.
    """
    small = members.where(F.col("copies") <= expand)
    star = members.where((F.col("copies") > expand) & (F.col("id") != F.col("rep"))).select("kind", F.col("rep").alias("x"), F.col("id").alias("y"))
    within = small.alias("m").join(small.alias("n"), F.expr("m.kind = n.kind and m.rep = n.rep and m.id < n.id")).select("m.kind", F.col("m.id").alias("x"), F.col("n.id").alias("y"))
    copies = small.select(F.col("kind").alias("k"), "rep", "id")
    for side in ("a", "b"):
        links = links.join(copies, F.expr(f"kind = k and {side} = rep"), "left").select(*[c for c in links.columns if c != side], F.coalesce("id", side).alias(side))
    pairs = links.select("kind", F.col("a").alias("x"), F.col("b").alias("y")).unionAll(within).unionAll(star)
    return pairs.select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(records: DataFrame, kind: str, key: str, links: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, id, class_id, copies, links), one row for each record with an id and a kind, whatever the size of its group.

    ``class_id`` is the smallest id that the record is connected with by links
    and copies, ``copies`` the number of records of the same normal form (itself
    among them), ``links`` the number of other texts that are similar to its own.
    """
    node = lambda i: F.struct(F.col("kind").alias("kind"), F.col(i).alias("id"))
    edges = links.select(node("a").alias("a"), node("b").alias("b"), F.col("similarity").alias("sim"))
    ends = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("links"))
    label = components(ends.select("node"), edges).join(ends, "node").select("node.kind", F.col("node.id").alias("rep"), F.col("component.id").alias("low"), "links")
    ids = records.select(F.col(kind).alias("kind"), F.col(key).cast("bigint").alias("id")).where("kind is not null and id is not null").distinct()
    known = ids.join(members, ["kind", "id"], "left").withColumn("rep", F.coalesce("rep", "id"))
    return known.join(label, ["kind", "rep"], "left").select("kind", "id", F.coalesce("low", "rep").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
