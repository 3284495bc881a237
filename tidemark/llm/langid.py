"""Languages of documents and of the stretches inside them (problem 9).

Rank-order profiles: each language has its most frequent character n-grams in
order; a sentence unit is compared with each profile by the out-of-place
distance, the sum over its n-grams of how far their ranks lie apart. Units of
one document are read together: the cheapest sequence of languages pays its
distances and a price for each change, so a foreign name or a short heading
starts no stretch of its own.

Profiles are fitted on a bounded sample of labelled rows (``SAMPLE`` rows of
each language on average, taken by the hash of their id; all of a language that
has fewer); rows that the first profiles put into another language than their
label are left out of the second fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.segment import unit_spans

#: Labelled rows of each language that the profiles are fitted on, on average.
SAMPLE = 500
PROFILE = 1200
GRAMS = (1, 2, 3)
#: Price of a change of language, in n-grams that are wholly out of place.
CHANGE = 6.0
LEAST_LETTERS = 10
_SLOT_BITS = 18
_ABSENT = 30_000

# The languages and the usual ways of writing them, in lower case.
LANGUAGES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands flemish",
    "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
    "ja": "ja jpn jp japanese 日本語",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 zh-hans zh-hant",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "th": "th tha thai ไทย ภาษาไทย",
}
CODES = tuple(LANGUAGES)
_NAMES = {name: code for code, names in LANGUAGES.items() for name in names.split()}
_MISSING = frozenset(("", "und", "unknown"))
# Python's own classes: quicker than full Unicode ones; vowel signs of Indic and Thai words fall out everywhere alike.
_OTHER = re.compile(r"[\W\d_]+")
_OTHER_OR_CAPITALISED = re.compile(r"(?:[\W\d_]+|(?<![^\W\d_])[a-zß-ÿ]?[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*)+")
_LETTER = regex.compile(r"\p{L}")
_INVISIBLE = ("\u00ad", "\u200b")
_FEW = 12
# cp1252 as it is met in texts decoded twice: bytes without a character stand for themselves
_BYTES = {ord(bytes([b]).decode("cp1252")): b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {b: b for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {b: b for b in range(128)} | {b: b for b in range(0x80, 0x100)}


def code_of(label: str | None) -> str | None:
    """The code a label stands for; '' if it is missing, None if it names no known language."""
    name = (label or "").strip().lower()
    if name in _MISSING:
        return ""
    return _NAMES.get(name) or _NAMES.get(regex.split(r"[-_ ]", name)[0])


def repaired(text: str) -> str:
    """A text whose UTF-8 bytes were read as cp1252, read again; any other text as it is."""
    if "Ã" not in text and "Â" not in text and "Ð" not in text and "à¤" not in text and "à¸" not in text:
        return text
    try:
        return bytes(_BYTES[ord(c)] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return text


def letters(text: str) -> str:
    """Letters in lower case, one blank for all else.

    Capitalised words are left out, being names more often than not, unless
    too little would be left.
    """
    text = repaired(text)
    for sign in _INVISIBLE:
        if sign in text:
            text = text.replace(sign, "")
    form = _OTHER_OR_CAPITALISED.sub(" ", text).strip()
    return form if len(form) >= _FEW else _OTHER.sub(" ", text.lower()).strip()


def _grams(forms: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams at each character of all forms, and the form each character is of."""
    cps = [hashing.codepoints(f" {f} ") for f in forms]
    owner = np.repeat(np.arange(len(forms)), [len(c) for c in cps])
    h = hashing.prefix(np.concatenate(cps))
    return [hashing.mix(hashing.windows(h, n), n) for n in GRAMS], owner


class Profiles:
    def __init__(self, ranked: dict[str, np.ndarray]):
        """``ranked``: n-gram hashes of each language, the most frequent first."""
        self.codes = tuple(ranked)
        vocabulary = np.unique(np.concatenate(list(ranked.values())))
        slot = (vocabulary >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        vocabulary = vocabulary[np.unique(slot, return_index=True)[1]]
        slot = (vocabulary >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.size = len(vocabulary)
        self.slot_hash = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.slot_hash[slot] = vocabulary
        self.slot_id = np.zeros(1 << _SLOT_BITS, np.int32)
        self.slot_id[slot] = np.arange(len(vocabulary))
        self.ranks = np.full((len(vocabulary), len(self.codes)), _ABSENT, np.int16)
        for j, grams in enumerate(ranked.values()):
            at = np.searchsorted(vocabulary, grams)
            at[at == len(vocabulary)] = 0
            ok = vocabulary[at] == grams
            self.ranks[at[ok], j] = np.flatnonzero(ok)

    def distances(self, forms: list[str]) -> np.ndarray:
        """Out-of-place distance of each form to each language, in wholly misplaced n-grams."""
        out = np.zeros((len(forms), len(self.codes)), np.float64)
        lo = 0
        while lo < len(forms):
            hi, chars = lo, 0
            while hi < len(forms) and hi - lo < 2000 and chars < 400_000:
                chars += len(forms[hi]) + 2
                hi += 1
            out[lo:hi] = self._some(forms[lo:hi])
            lo = hi
        return out

    def _some(self, forms: list[str]) -> np.ndarray:
        grams, owner = _grams(forms)
        cells = []
        for g in grams:
            slot = (g >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            hit = np.flatnonzero(self.slot_hash[slot] == g)
            cells.append(owner[hit] * self.size + self.slot_id[slot[hit]])
        cell = np.concatenate(cells)
        if not len(cell):
            return np.zeros((len(forms), len(self.codes)))
        cell.sort()
        at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        count = np.diff(np.append(at, len(cell)))
        form, gram = np.divmod(cell[at], self.size)
        key = form << 40 | (0xFFFFF - np.minimum(count, 0xFFFFF)) << 20 | gram
        key.sort()
        form, gram = key >> 40, key & 0xFFFFF
        edges = np.flatnonzero(np.concatenate(([True], form[1:] != form[:-1])))
        rank = np.arange(len(form)) - np.repeat(edges, np.diff(np.append(edges, len(form))))
        apart = self.ranks[gram]
        apart -= np.minimum(rank, PROFILE).astype(np.int16)[:, None]
        np.abs(apart, out=apart)
        np.minimum(apart, PROFILE, out=apart)
        out = np.zeros((len(forms), len(self.codes)))
        if len(edges):
            out[form[edges]] = np.add.reduceat(apart, edges, axis=0, dtype=np.int64) / PROFILE
        return out


def _ranked(forms: list[str]) -> np.ndarray:
    grams, counts = np.unique(np.concatenate(_grams(forms)[0]), return_counts=True)
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def fit(labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles from (code, text) rows, fitted twice."""
    by: dict[str, list[str]] = {}
    for code, text in labelled:
        form = letters(text)
        if len(form) >= 40:
            by.setdefault(code, []).append(form)
    by = {c: by[c] for c in CODES if c in by}
    first = Profiles({c: _ranked(f) for c, f in by.items()})
    again = {}
    for j, (c, forms) in enumerate(by.items()):
        kept = [f for f, best in zip(forms, first.distances(forms).argmin(1)) if best == j]
        again[c] = _ranked(kept or forms)
    return Profiles(again)


def _cheapest(cost: np.ndarray) -> np.ndarray:
    """The language of each unit in the cheapest sequence; a change comes as late as it may."""
    n, k = cost.shape
    stay = np.zeros((n, k), bool)
    origin = np.zeros(n, int)
    total = cost[0].copy()
    for u in range(1, n):
        low = int(total.argmin())
        stay[u] = total < total[low] + CHANGE
        stay[u, low] = True
        origin[u] = low
        total = np.where(stay[u], total, total[low] + CHANGE) + cost[u]
    out = np.zeros(n, int)
    lang = int(total.argmin())
    for u in range(n - 1, -1, -1):
        out[u] = lang
        if u and not stay[u, lang]:
            lang = int(origin[u])
    return out


def stretches(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(id, start_pos, end_pos, lang_code, confidence, label_code, n_langs), one row per stretch of one language.

    ``label_code`` is the code the label stands for: '' where it is missing,
    null where it names none of the languages. Null texts and texts of fewer
    than ``LEAST_LETTERS`` letters have no row; repeated rows each have theirs;
    without a single labelled row there is nothing to fit and no row comes out.
    Other columns are not read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"), F.col(label).alias("label")).where("t is not null")
    named = F.lower(F.trim("label"))
    name = F.when(named.isin(*_NAMES), named).otherwise(F.split(named, "[-_ ]")[0])
    known = given.withColumn("name", name).where(F.col("name").isin(*_NAMES))
    rows: dict[str, int] = {}
    for r in known.groupBy("name").count().collect():  # one row for each usual name of a language
        rows[_NAMES[r.name]] = rows.get(_NAMES[r.name], 0) + r["count"]
    share = {n: min(1.0, SAMPLE / rows[c]) for n, c in _NAMES.items() if c in rows}
    sample = []
    if share:
        part = F.try_element_at(F.create_map(*[F.lit(x) for p in share.items() for x in p]), F.col("name"))
        sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part * 1_000_000).select("label", "t").collect()
    labelled = [(c, r.t) for r in sample if (c := code_of(r.label))]
    schema = "id bigint, start_pos bigint, end_pos bigint, lang_code string, confidence double, label_code string, n_langs int"
    if not labelled:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fit(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                yield _label(profiles, *(batch.column(j).slice(lo, 1000).to_pylist() for j in range(3)))

    return given.mapInArrow(run, schema)


def _label(profiles: Profiles, ids: list, texts: list, labels: list) -> pa.RecordBatch:
    spans, forms, edge, rows = [], [], [0], []
    for k, text in enumerate(texts):
        units = unit_spans(text)
        if len(text) < 200 and len(_LETTER.findall(text)) < LEAST_LETTERS or not units:
            continue
        made = [letters(text[s:e]) for s, e in units]
        if len(text) >= 200 and sum(map(len, made)) < 4 * LEAST_LETTERS and len(_LETTER.findall(text)) < LEAST_LETTERS:
            continue
        rows.append(k)
        spans.append(units)
        forms += made
        edge.append(len(forms))
    cols: list[list] = [[], [], [], [], [], [], []]
    cost = profiles.distances(forms) if forms else np.zeros((0, len(profiles.codes)))
    best = cost.argmin(1) if len(cost) else np.zeros(0, int)
    for k, units, a, b in zip(rows, spans, edge, edge[1:]):
        mine = best[a:b]
        langs = mine if (mine == mine[0]).all() else _cheapest(cost[a:b])
        cuts = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), len(langs)]
        for s, e in zip(cuts, cuts[1:]):
            total = np.sort(cost[a + s : a + e].sum(0))
            sure = 1.0 if len(total) < 2 or total[1] <= 0 else 1.0 - total[0] / total[1]
            for col, v in zip(cols, (ids[k], units[s][0], units[e - 1][1], profiles.codes[langs[s]], float(np.clip(sure, 0.0, 1.0)), code_of(labels[k]), len(set(langs.tolist())))):
                col.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "start_pos", "end_pos", "lang_code", "confidence", "label_code", "n_langs"])


def misfits(found: DataFrame) -> DataFrame:
    """Stretches of documents whose label is missing or wrong or that hold more than one language."""
    return found.where("n_langs > 1 or label_code is null or label_code <> lang_code")
