"""Test items whose passages stand in corpus documents (problem 8).

Every window of sixteen words (forty characters in Japanese and Chinese) of an
item and of a document gets a 64-bit SimHash; an item shorter than that gets
one of its own size, and documents are read in windows of that size too. Fingerprints are cut into four
blocks of sixteen bits: two fingerprints within a distance of three agree in
one block at least, so a look-up of each block finds all of them. Candidates
are then verified exactly, by the words of the window and by the weighted
share of the item's shingles that the document holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing

WORDS = 16
CHARS = 40
RADIUS = 3
SHINGLE = 5
#: Items are held by every task; more text than this is matched in several passes.
BLOCK_CHARS = 16_000_000

_DROP = ("\u00ad", "\u200b")
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LETTER = regex.compile(r"\p{L}")


def matching_form(text: str) -> str:
    """NFKC, without soft hyphens and zero-width spaces, lower case, one blank between words."""
    text = unicodedata.normalize("NFKC", text)
    for sign in _DROP:
        if sign in text:
            text = text.replace(sign, "")
    text = text.lower()
    return _OTHER.sub(" ", text).strip()


def _word_bounds(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.flatnonzero(cp == 32)
    return np.concatenate(([0], blank + 1)), np.concatenate((blank, [len(cp)]))


def _features(form: str, by_chars: bool) -> np.ndarray:
    """The hashes whose windows are fingerprinted: words, or pairs of characters."""
    if by_chars:
        cp = hashing.codepoints(form.replace(" ", ""))
        return hashing.windows(hashing.prefix(cp), 2)
    if not form:
        return np.zeros(0, np.uint64)
    cp = hashing.codepoints(form)
    starts, ends = _word_bounds(cp)
    return hashing.spans(hashing.prefix(cp), starts, ends)


def _simhash(feats: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` features; bit sums of a window are put together from sums of 1, 2, 4 ... features."""
    n = len(feats) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.unpackbits(feats.view(np.uint8).reshape(-1, 8), axis=1)  # a window has fewer than 256 features
    total, at, width, rest = np.zeros((n, 64), np.uint8), 0, 1, size
    while rest:
        if rest & 1:
            total += sums[at : at + n]
            at += width
        rest >>= 1
        if rest:
            sums = sums[:-width] + sums[width:]
            width *= 2
    return np.packbits(total > size // 2, axis=1).view(np.uint64).ravel()


class _Index:
    """Fingerprints of all item windows of one kind, by block."""

    def __init__(self, forms: list[tuple[int, str]], by_chars: bool, size: int):
        self.by_chars = by_chars
        self.size = size
        prints, exact, owner = [], [], []
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for item, form in forms:
            feats = _features(form, by_chars)
            h = hashing.prefix(feats)
            fp = _simhash(feats, self.size)
            prints.append(fp)
            exact.append(hashing.windows(h, self.size))
            owner.append(np.full(len(fp), item))
            sh = np.unique(hashing.windows(h, SHINGLE)) if len(feats) >= SHINGLE else np.zeros(0, np.uint64)
            weight = np.ones(len(sh))
            if not by_chars and len(sh):
                lengths = np.array([len(w) for w in form.split(" ")], float)
                sums = np.convolve(lengths, np.ones(SHINGLE), "valid")
                order = hashing.windows(h, SHINGLE)
                _, first = np.unique(order, return_index=True)
                weight = sums[first]
            self.shingles[item] = (sh, weight)
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.exact = np.concatenate(exact) if exact else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.blocks = []
        for b in range(RADIUS + 1):
            part = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            start = np.zeros(65537, np.int64)
            np.cumsum(np.bincount(part.astype(np.int64), minlength=65536), out=start[1:])
            self.blocks.append((order, start))

    def look_up(self, feats: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, exactly shared windows, weighted share of the item's shingles) of every item in reach of a document's features."""
        if not len(self.prints):
            return []
        fp = _simhash(feats, self.size)
        if not len(fp):
            return []
        h = hashing.prefix(feats)
        near_w, near_i = [], []
        for b, (order, start) in enumerate(self.blocks):
            part = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            count = start[part + 1] - start[part]
            at = np.flatnonzero(count)
            if not len(at):
                continue
            c = count[at]
            w = np.repeat(at, c)
            offset = np.arange(len(w)) - np.repeat(np.cumsum(c) - c, c)
            i = order[start[part[w]] + offset]
            ok = np.bitwise_count(fp[w] ^ self.prints[i]) <= RADIUS
            near_w.append(w[ok])
            near_i.append(i[ok])
        if not near_w:
            return []
        w, i = np.concatenate(near_w), np.concatenate(near_i)
        if not len(w):
            return []
        same = hashing.spans(h, w, w + self.size) == self.exact[i]
        own = None
        out = []
        for item in np.unique(self.owner[i]):
            mine = self.owner[i] == item
            shared = len(np.unique(w[mine & same]))
            sh, weight = self.shingles[int(item)]
            if own is None:
                own = np.unique(hashing.windows(h, SHINGLE))
            held = weight[np.isin(sh, own, assume_unique=True)].sum() / weight.sum() if len(sh) else 0.0
            out.append((int(item), shared, float(held)))
        return out


def _split(items: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    words, chars = [], []
    for item, text in items:
        form = matching_form(text)
        cjk = len(_CJK.findall(form))
        (chars if cjk * 2 > len(_LETTER.findall(form)) else words).append((item, form))
    return words, chars


#: The fewest words, or pairs of characters, of an item that is looked for.
LEAST = SHINGLE


class Indexes:
    """The fingerprints of all items: one index for whole passages, one for each size of shorter items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.all: list[tuple[bool, _Index]] = []
        for by_chars, forms in zip((False, True), _split(items)):
            by: dict[int, list[tuple[int, str]]] = {}
            full = CHARS - 1 if by_chars else WORDS
            for item, form in forms:
                size = min(full, len(_features(form, by_chars)))
                if size >= LEAST:
                    by.setdefault(size, []).append((item, form))
            self.all += [(size == full, _Index(some, by_chars, size)) for size, some in sorted(by.items())]
        self.chars = any(x.by_chars for _, x in self.all)

    def look_up(self, text: str) -> list[tuple[int, int, float, bool]]:
        """(item, exactly shared windows, weighted share of the item, whether a window is a whole passage)."""
        form = matching_form(text)
        feats = {False: _features(form, False), True: _features(form, True) if self.chars and _CJK.search(form) else np.zeros(0, np.uint64)}
        return [(*hit, whole) for whole, index in self.all for hit in index.look_up(feats[index.by_chars])]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, shared_windows, item_share, passage) of every document an item leaked into.

    A row stands for an exactly shared window (``shared_windows`` > 0) or for
    fingerprints in reach whose weighted shingle share is ``least`` or more.
    ``passage`` tells that windows are whole passages of sixteen words (forty
    characters); items shorter than that are found as a whole, from ``LEAST`` words on.
    Null and empty texts on either side match nothing; rows that stand twice
    are reported once; other columns are not read. The items are a fixed test
    set: their size is measured first, and beyond ``BLOCK_CHARS`` they are
    matched block by block.
    """
    given = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    chars = given.agg(F.sum(F.length("t"))).first()[0] or 0
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    passes = max(1, -(-chars // BLOCK_CHARS))
    out = None
    for k in range(passes):
        block = given if passes == 1 else given.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        held = [(r.i, r.t) for r in block.dropDuplicates().collect()]
        out = _one_pass(rows, held, least) if out is None else out.unionAll(_one_pass(rows, held, least))
    return out.dropDuplicates(["doc_id", "item_id"])


def _one_pass(rows: DataFrame, held: list[tuple[int, str]], least: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Indexes(held))  # built once

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        for batch in batches:
            out = [(key, item, count, share, whole) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item, count, share, whole in indexes.look_up(text) if count or share >= least]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "shared_windows", "item_share", "passage"])

    return rows.mapInArrow(match, "doc_id bigint, item_id bigint, shared_windows bigint, item_share double, passage boolean")
