"""Sentence units of a text in any script (problem 1).

A text falls into blocks at blank lines. Inside a block every end mark is a
candidate boundary, and a semi-Markov dynamic programme picks the spans between
candidates whose joint score is largest. A span's score adds what its closing
words say about an end there, in the light of the words that open the next
span, whether quotation marks and brackets are left open in it, and how
plausible its length is. Boundaries that are in no or in every best cut,
whatever the lengths, are settled beforehand, and spans beyond the longest
plausible length score alike, so the work is linear in the text.

Scripts without end marks (Thai, Lao) have a candidate at each blank between
two of their letters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = r"(?:\r\n|\r(?!\n)|\n)"
_BLANK_LINES = re.compile(rf"{_BREAK}(?:[^\S\r\n]*{_BREAK})+")
_MARKS = re.compile(r"[.!?…。！？｡؟۔।॥]+")
_DIGIT_POINT = re.compile(r"\d\.\d")
_QUOTES = re.compile(r"[\"“”„«»‘’「」『』()（）\[\]【】〈〉《》]")
_SPACELESS = re.compile(r"(?<=[฀-໿])[^\S\r\n]+(?=[฀-໿])")
_HAS_SPACELESS = re.compile(r"[ก-໿]")
_WORD_BEFORE = re.compile(r"[^\s(\[\"“„«‘「（]*$")
_WORD_AFTER = re.compile(r"[^\W\d_]+")

_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》", "«": "»"}
_CLOSES = {v: k for k, v in _PAIRS.items()}
_OPENERS = frozenset("\"“„«‘「『(（[【〈《¿¡'")
_CJK_MARKS = frozenset("。！？｡")

# Abbreviations after which a sentence goes on, in lower case.
_NEVER_FINAL = frozenset(
    "mr mrs ms dr prof st gov gen sen rep rev hon capt col lt sgt messrs mt ft "
    "vs cf cfr vgl e.g i.e eg ie viz approx aprox env ca no nos nr núm num pág pag pp p sec art arts abs fig figs vol ch "
    "ex dept jan feb apr aug sept oct nov dec mon tue wed thu fri sat sun "
    "hr fr frl dipl ing bzw z.b d.h u.a bspw inkl exkl evtl ggf str tel "
    "sr sra srta dra dña d.ª ud uds ee rr ss sig sigg dott dott.ssa ing avv prof.ssa "
    "mme mlle dhr mevr dhr mw bijv blz d.w.z o.a nl t.a.v m.b.t incl excl "
    "ст г-н г-жа им ул т.е т.к напр см стр тел д-р ред "
    "al".split()
)
# Abbreviations that may also end a sentence, in lower case.
_MAY_END = frozenset(
    "inc corp ltd co llc plc bros jr sr. mio mrd mln mld mio mill bn etc ecc usw ff u.s u.k u.s.a u.n e.u uu ee.uu p.m a.m "
    "s.a s.p.a s.r.l b.v n.v s.l s.a.s s.l.u ltda cia cía gmbh a.g k.k p.l.c r.l г гг руб коп млн млрд трлн тыс др пр н.э р.х jr m.b.h o.o.o".split()
)
_LIST_END = frozenset("etc ecc usw др пр ff".split())
# Words that follow "U.S." inside a name.
_AFTER_US = frozenset(
    "treasury government department securities bankruptcy federal dollar dollars congress court supreme patent internal environmental "
    "bank steel virgin army navy senate tax gaap attorney district person persons postal census customs bancorp food".split()
)
# Month names before which a number with a point is an ordinal.
_ORDINAL_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

# Words before the number of a heading, and German words before an ordinal.
_HEADING_WORDS = frozenset("item items note notes part section table exhibit schedule article chapter appendix".split())
_BEFORE_ORDINAL = frozenset("am zum vom dem den der des bis im ab seit".split())

_SURE = 3.5  # beyond this no length score can turn a decision
_OPEN = -7.0  # a quotation or bracket left open at the end of a span
_LONG = 600
_HEADING = 80
_FINAL = re.compile(r"[.!?…。！？｡؟۔।॥][\s\"“”»’」』）)\]】〉》]*$")


def _inside(block: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Matched pairs of quotation marks and brackets, and the places of their closing marks."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    low_quote = "„" in block
    n = len(block)

    waiting: dict[str, int] = {}

    def push(what: str, at: int) -> None:
        stack.append((what, at))
        waiting[what] = waiting.get(what, 0) + 1

    def close(what: str, at: int) -> bool:
        if not waiting.get(what):
            return False
        while True:  # what was opened inside and never closed is dropped
            ch, start = stack.pop()
            waiting[ch] -= 1
            if ch == what:
                pairs.append((start, at))
                return True

    for m in _QUOTES.finditer(block):
        ch, at = m.group(), m.start()
        if ch in _PAIRS or ch == "„":
            push(ch, at)
        elif ch in _CLOSES:
            close(_CLOSES[ch], at)
        elif ch == "“":
            if not (low_quote and close("„", at)):
                push("“", at)
        elif ch == "”":
            close("“", at) or close("„", at)
        elif ch == "‘":
            if not (at and block[at - 1].isalnum()):
                push("‘", at)
        elif ch == "’":
            if not (at + 1 < n and block[at + 1].isalpha() and at and block[at - 1].isalpha()):
                close("‘", at)
        else:
            blank_before = at == 0 or block[at - 1].isspace() or block[at - 1] in "([（「"
            blank_after = at + 1 == n or block[at + 1].isspace() or block[at + 1] in ".,;:!?)]）"
            if blank_before and not blank_after or not blank_after and not waiting.get('"'):
                push('"', at)
            else:
                close('"', at)
    return pairs, {e for _, e in pairs}


def _shouting(block: str) -> bool:
    return sum(map(str.isupper, block)) > 0.6 * sum(map(str.isalpha, block))


def _weight(block: str, mark_at: int, mark_end: int, end: int, nxt: int, shouting: bool) -> float:
    """How much closing and opening words speak for a boundary at ``end``."""
    n = len(block)
    mark = block[mark_end - 1]
    # closing words
    before = _WORD_BEFORE.search(block, max(0, mark_at - 40), mark_at).group()
    lower = before.lower()
    first = block[nxt]
    at = nxt
    while at < n and (block[at] in _OPENERS or block[at].isspace()):
        at += 1
    opens = at > nxt
    head = block[at] if at < n else ""
    gap = nxt - end
    if mark in _CJK_MARKS:
        if end > mark_end:
            return -4.0  # 。」 and then a quotative: the sentence goes on
        return 5.0
    if mark in "।॥۔؟":
        return 5.0
    if mark in "!?":
        if not gap and end == mark_end and head and not (head.isupper() or opens):
            return -6.0 if head.isascii() and head.islower() else 2.0
        if head.islower():
            return 4.0 if at + 1 < n and block[at + 1].isupper() else -6.0
        if first in "—–-,;:":
            return -5.0
        return 5.0 if gap or head.isupper() else -3.0
    if mark == "…" or mark_end - mark_at > 1:
        if head.isupper() and (shouting or not (at + 1 < n and block[at + 1].isupper())):
            return -1.0 if shouting else 4.0
        return -5.0
    # a point
    after = _WORD_AFTER.match(block, at)
    word = after.group() if after else ""
    if not gap and end == mark_end:
        good = word and head.isupper() and len(word) > 1 and word[1:].islower() and before and (before[-1].islower() and before.isalpha() and len(before) > 2 or before[-1] in "%)")
        return 4.0 if good and lower not in _NEVER_FINAL and "@" not in before else -6.0
    last = before[-1:] if before else ""
    if "฀" <= last <= "໿" or "ऀ" <= last <= "ൿ" and len(before) <= 4:
        return -5.0
    if head.islower():
        camel = at + 1 < n and block[at + 1].isupper()
        return (2.0 if lower not in _MAY_END else 1.0) if camel and lower not in _NEVER_FINAL else -6.0
    if first in "—–,;:|/" or not head:
        return -5.0
    if head.isdigit() or head.isnumeric():
        if lower in _NEVER_FINAL or len(before) == 1 and before.isalpha():
            return -6.0
        if lower in _MAY_END:
            return 1.5
        return 4.0 if before and not before.isdigit() else 1.0
    if not head.isalpha():
        return -1.0
    if not head.isupper():  # a script without capitals
        if not last.isalpha():
            return 3.0 if last in "%)" else -5.0
        if "぀" <= head <= "鿿" and lower in _MAY_END:
            return 2.0  # these scripts take no Latin abbreviation into a sentence's middle
        if lower in _NEVER_FINAL or lower in _MAY_END or "." in before:
            return -5.0
        return 4.0 if len(before) > 4 else -5.0
    if before[:1].isdigit() and len(before) <= 4 and not "." in before:
        ahead = block[: mark_at - len(before)].rstrip()
        led = ahead[-24:].rsplit(None, 1)[-1].lower() if ahead else ""
        if len(before) <= 2 and (word.lower() in _ORDINAL_MONTHS or led in _BEFORE_ORDINAL):
            return -6.0
        if not ahead or led in _HEADING_WORDS and len(ahead) == len(led):
            return -5.0  # a number at the head of a block
        return 4.0
    if lower == "no":
        return 4.0  # an answer, not a number
    if lower in _NEVER_FINAL:
        return -6.0
    if len(before) == 1 and before.isalpha():
        return -5.0
    shout = len(word) > 1 and word.isupper()
    if lower in _MAY_END:
        if lower in _LIST_END:
            return 2.0 if not shout else -1.0
        if shout:
            return -2.5
        if lower in ("u.s", "u.k", "e.u", "u.n", "u.s.a"):
            return -3.0 if word.lower() in _AFTER_US else 1.5
        if lower in ("mio", "mrd", "mln", "млн", "млрд", "тыс"):
            return -2.0 if word in ("EUR", "USD", "CHF", "Euro") or shout else 1.0
        return 1.5
    if "." in before and not _DIGIT_POINT.search(before):
        parts = before.split(".")
        if all(0 < len(x) <= 2 for x in parts):  # initials and the like
            return -4.0
    if end > mark_end and first not in _OPENERS:
        return 3.6
    return 5.0


def _length_score(size: int) -> float:
    """Spans of a word or two are unlikely units, and so are endless ones."""
    if size < 4:
        return -2.0
    if size < 12:
        return -0.5
    return 0.0 if size <= _LONG else -0.5


def _span_score(size: int, closing: float, left_open: bool) -> float:
    """Score of a span of ``size`` characters: its length, its closing words, and quotations or brackets left open at its end."""
    return _length_score(size) + closing + (_OPEN if left_open else 0.0)


class _Nesting:
    """How many quotations and brackets are open at a place."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.starts, self.ends = sorted(s for s, _ in pairs), sorted(e for _, e in pairs)

    def __call__(self, at: int) -> int:
        return bisect_left(self.starts, at) - bisect_right(self.ends, at)


def _cut_block(text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    """Append the units of the block ``text[lo:hi]``, which has no blanks at its ends."""
    block = text[lo:hi]
    n = hi - lo
    if block.count("|") >= 2 or n <= _HEADING and "\n" not in block and _FINAL.search(block) is None and not _HAS_SPACELESS.search(block):
        out.append((lo, hi))  # a table or a heading
        return
    cands: list[tuple[int, int, float, bool]] = []
    inner: _Nesting | None = None
    closing: set[int] = set()
    shouting: bool | None = None
    for m in _MARKS.finditer(block):
        a, b = m.span()
        if b >= n:
            break
        if b - a == 1 and block[a] == "." and block[b].isdigit():
            continue
        if inner is None:
            pairs, closing = _inside(block) if _QUOTES.search(block) else ([], set())
            inner = _Nesting(pairs)
        end = b
        while end < n:
            if end in closing:
                end += 1
            elif block[end].isspace() and end + 1 < n and block[end + 1] == "»" and end + 1 in closing:
                end += 2
            else:
                break
        nxt = end
        while nxt < n and (block[nxt].isspace() or block[nxt] == "\u200b"):
            nxt += 1
        if nxt >= n:
            break
        if block[nxt] in ".!?…。！？" and nxt == end:
            continue  # the outer mark decides
        if shouting is None and (b - a > 1 or block[b - 1] == "…"):
            shouting = _shouting(block)
        w = _weight(block, a, b, end, nxt, bool(shouting))
        left_open = inner(end - 1) > 0
        if w + (_OPEN if left_open else 0.0) > -_SURE:
            cands.append((end, nxt, w, left_open))
    if _HAS_SPACELESS.search(block):
        inner = inner or _Nesting(_inside(block)[0])
        for m in _SPACELESS.finditer(block):
            if not inner(m.start()):
                cands.append((m.start(), m.end(), 5.0, False))
        cands.sort()
    if not cands:
        out.append((lo, hi))
        return
    ends = [*(c[0] for c in cands), n]
    starts = [0, *(c[1] for c in cands)]
    closes = [*((w, o) for _, _, w, o in cands), (0.0, False)]
    # semi-Markov: best[j] is the best score of the text before boundary j; a sure boundary is passed by every best cut
    best, back, floor = [0.0], [0], 0
    far, far_best, far_arg = 0, -1e18, 0  # boundaries from which a span to here is beyond the longest plausible length
    for j in range(len(ends)):
        while far <= j and ends[j] - starts[far] > _LONG:
            if far >= floor and best[far] > far_best:
                far_best, far_arg = best[far], far
            far += 1
        top, arg = -1e18, floor
        if far_best > -1e18:
            top, arg = far_best + _span_score(_LONG + 1, *closes[j]), far_arg
        for i in range(max(floor, far), j + 1):
            score = best[i] + _span_score(ends[j] - starts[i], *closes[j])
            if score > top:
                top, arg = score, i
        best.append(top)
        back.append(arg)
        if closes[j][0] + (_OPEN if closes[j][1] else 0.0) > _SURE:
            floor, far, far_best = j + 1, j + 1, -1e18
    spans = []
    j = len(ends)
    while j > 0:
        i = back[j]
        spans.append((lo + starts[i], lo + ends[j - 1]))
        j = i
    out.extend(reversed(spans))


def unit_spans(text: str | None) -> list[tuple[int, int]]:
    """The sentence units of ``text`` as (start, end) code point offsets.

    Null, empty and blank texts have none; a text without an end mark is one unit.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    n = len(text)
    for m in _BLANK_LINES.finditer(text):
        _trimmed(text, at, m.start(), out)
        at = m.end()
    _trimmed(text, at, n, out)
    return out


def _trimmed(text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    if lo < hi:
        _cut_block(text, lo, hi, out)


def _units_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, ids, texts = (batch.column(k).to_pylist() for k in range(3))
        k_out, i_out, s_out, e_out = [], [], [], []
        for kind, key, text in zip(kinds, ids, texts):
            for s, e in unit_spans(text):
                k_out.append(kind)
                i_out.append(key)
                s_out.append(s)
                e_out.append(e)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k_out, pa.string()), pa.array(i_out, pa.int64()), pa.array(s_out, pa.int64()), pa.array(e_out, pa.int64())],
            names=["record_kind", "record_id", "start_pos", "end_pos"],
        )


def sentence_units(records: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """Units of every record of ``records``: (kind, key, text) columns by name.

    Rows of a null key keep a null ``record_id``; null and blank texts give no
    row; repeated rows each give their units; other columns are not read.
    """
    rows = records.select(F.col(kind).alias("k"), F.col(key).cast("bigint").alias("i"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(_units_arrow, "record_kind string, record_id bigint, start_pos bigint, end_pos bigint")
