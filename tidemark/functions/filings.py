"""Sections of one filing: from inline tags, or from headings in cleaned text.

Works on one document at a time and knows nothing of Spark; ``documents`` wraps
it as Arrow-batched functions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Headings of the sections of each kind of report, in lower-case text.
HEADINGS = {
    "10-K": [
        ("business", r"item\s+1[\.\s:\-—]+(?!a|b)"),
        ("risk_factors", r"item\s+1a[\.\s:\-—]+"),
        ("unresolved_staff_comments", r"item\s+1b[\.\s:\-—]+"),
        ("properties", r"item\s+2[\.\s:\-—]+"),
        ("legal_proceedings", r"item\s+3[\.\s:\-—]+"),
        ("mdna", r"item\s+7[\.\s:\-—]+(?!a)"),
        ("quantitative_disclosures", r"item\s+7a[\.\s:\-—]+"),
        ("financial_statements", r"item\s+8[\.\s:\-—]+"),
    ],
    "10-Q": [
        ("financial_statements", r"item\s+1[\.\s:\-—]+(?!a|b)"),
        ("risk_factors", r"item\s+1a[\.\s:\-—]+"),
        ("mdna", r"item\s+2[\.\s:\-—]+"),
        ("quantitative_disclosures", r"item\s+3[\.\s:\-—]+"),
        ("legal_proceedings", r"part\s+ii[\s\S]{0,30}?item\s+1[\.\s:\-—]+"),
    ],
    "8-K": [
        ("material_agreement", r"item\s+1\.01[\s:\-—]+"),
        ("material_agreement_termination", r"item\s+1\.02[\s:\-—]+"),
        ("acquisition_disposition", r"item\s+2\.01[\s:\-—]+"),
        ("results_of_operations", r"item\s+2\.02[\s:\-—]+"),
        ("exit_disposal_costs", r"item\s+2\.05[\s:\-—]+"),
        ("material_impairments", r"item\s+2\.06[\s:\-—]+"),
        ("delisting_notice", r"item\s+3\.01[\s:\-—]+"),
        ("accountant_change", r"item\s+4\.01[\s:\-—]+"),
        ("financial_restatement", r"item\s+4\.02[\s:\-—]+"),
        ("director_officer_change", r"item\s+5\.02[\s:\-—]+"),
        ("regulation_fd", r"item\s+7\.01[\s:\-—]+"),
        ("other_events", r"item\s+8\.01[\s:\-—]+"),
        ("financial_exhibits", r"item\s+9\.01[\s:\-—]+"),
    ],
}
# Looser headings of annual reports at the head of a line, in any case.
LOOSE = [
    ("business", r"(?:^|\n)\s*(?:ITEM\s+1|item\s+1)[\.\s:\-—]*(?:business)?(?:\s|$)(?!a|b)"),
    ("risk_factors", r"(?:^|\n)\s*(?:ITEM\s+1A|item\s+1a)[\.\s:\-—]*(?:risk\s+factors)?"),
    ("unresolved_staff_comments", r"(?:^|\n)\s*(?:ITEM\s+1B|item\s+1b)[\.\s:\-—]*(?:unresolved)?"),
    ("properties", r"(?:^|\n)\s*(?:ITEM\s+2|item\s+2)[\.\s:\-—]*(?:properties)?(?:\s|$)"),
    ("legal_proceedings", r"(?:^|\n)\s*(?:ITEM\s+3|item\s+3)[\.\s:\-—]*(?:legal)?(?:\s|$)"),
    ("mdna", r"(?:^|\n)\s*(?:ITEM\s+7|item\s+7)[\.\s:\-—]*(?:management)?(?:\s|$)(?!a)"),
    ("quantitative_disclosures", r"(?:^|\n)\s*(?:ITEM\s+7A|item\s+7a)[\.\s:\-—]*(?:quantitative)?"),
    ("financial_statements", r"(?:^|\n)\s*(?:ITEM\s+8|item\s+8)[\.\s:\-—]*(?:financial)?(?:\s|$)"),
]
# Titles of annual reports without an item number.
TITLES = [
    ("risk_factors", r"(?:^|\n)\s*RISK\s+FACTORS[\.\s:\-—]*(?:\n|$)"),
    ("legal_proceedings", r"(?:^|\n)\s*LEGAL\s+PROCEEDINGS[\.\s:\-—]*(?:\n|$)"),
    ("mdna", r"(?:^|\n)\s*MANAGEMENT.S?\s+DISCUSSION\s+AND\s+ANALYSIS"),
    ("business", r"(?:^|\n)\s*(?:DESCRIPTION\s+OF\s+)?BUSINESS[\.\s:\-—]*(?:\n|$)"),
    ("properties", r"(?:^|\n)\s*PROPERTIES[\.\s:\-—]*(?:\n|$)"),
    ("quantitative_disclosures", r"(?:^|\n)\s*QUANTITATIVE\s+AND\s+QUALITATIVE"),
    ("financial_statements", r"(?:^|\n)\s*FINANCIAL\s+STATEMENTS\s+AND\s+SUPPLEMENTARY"),
    ("unresolved_staff_comments", r"(?:^|\n)\s*UNRESOLVED\s+STAFF\s+COMMENTS"),
]
# Names of inline tags and the sections they hold.
INLINE = {
    "BusinessDescriptionAndBasisOfPresentationTextBlock": "business",
    "RiskFactorsTextBlock": "risk_factors",
    "UnresolvedStaffCommentsTextBlock": "unresolved_staff_comments",
    "PropertiesTextBlock": "properties",
    "LegalProceedingsTextBlock": "legal_proceedings",
    "ManagementDiscussionAndAnalysisTextBlock": "mdna",
    "QuantitativeAndQualitativeDisclosuresAboutMarketRiskTextBlock": "quantitative_disclosures",
    "FinancialStatementsTextBlock": "financial_statements",
    "DiscussionAndAnalysisOfFinancialConditionAndResultsOfOperations": "mdna",
    "RiskFactors": "risk_factors",
    "LegalProceedings": "legal_proceedings",
}
# What points elsewhere, and lines of a table of contents.
POINTER = (
    r"see\s+item|refer\s+to\s+item|incorporated\s+by\s+reference|filed\s+as\s+exhibit|included\s+in\s+part|"
    r"information\s+required\s+by\s+this\s+item\s+is\s+included\s+in|information\s+relating\s+to\s+this\s+item\s+is\s+set\s+forth\s+in|"
    r"reference\s+is\s+made\s+to\s+the\s+information|the\s+information\s+required\s+by\s+this\s+item\s+is\s+incorporated|"
    r"this\s+item\s+is\s+not\s+applicable|response\s+to\s+this\s+item\s+is\s+included\s+in|for\s+a\s+discussion.*?see\s+(?:part|note|item)"
)
LEADING_ITEM = r"^(?:item\s+\d+[a-z]?[\.\s:\-—]*\S*\s*)+"
NOTHING = ("none", "not applicable", "n/a", "na")
NOTE = r"(?:see|refer\s+to)\s+(?:note|footnote)\s+(\d+)"
CONTENTS = r"table\s+of\s+contents"
CONTENTS_LINE = r"table\s+of\s+contents|index\s+to|(?:page|pg\.?)\s*\d+|\.\s*\.\s*\.\s*\d+"
CONTENTS_ENTRY = r"^\s*item\s+\d+[a-z]?\b.*\d+\s*$"

_DROPPED = {"script", "style"}
_POINTER, _NOTE = re.compile(POINTER, re.I), re.compile(NOTE, re.I)
_JUNK = re.compile(r"http|\{|xmlns|[\d\-]+$|[a-z\-]+:[\w/\.\-]+$", re.I)
_SHORT, _STUB, _FEW = 100, 200, 20


class _Reader(HTMLParser):
    """Text of a document, a line for each piece between tags, and the text of each inline tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0
        self.open: list[tuple[str, str, int]] = []
        self.inline: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in _DROPPED
        self.parts.append("\n")
        name = dict(attrs).get("name") or ""
        if tag in ("ix:nonnumeric", "ix:nonfraction") or name.startswith(("us-gaap:", "dei:", "srt:", "country:")):
            self.open.append((tag, name, len(self.parts)))

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED and self.skip:
            self.skip -= 1
        self.parts.append("\n")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, name, start = self.open.pop(k)
                self.inline.append((name, "".join(self.parts[start:])))
                break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def _read(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader


def _tidy(text: str) -> str:
    lines = (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in text.splitlines())
    return "\n".join(line for line in lines if line)


def without_preamble(text: str, least: int = 50) -> str:
    """Without the addresses and name spaces before the first line of six words, if they fill more than ``least`` lines."""
    lines = text.split("\n")
    end = 0
    for no, line in enumerate(lines[:5001]):
        line = line.strip()
        if line and (len(line) < 3 or _JUNK.match(line)):
            end = no + 1
        elif len(line.split()) >= 6:
            break
    return "\n".join(lines[end:]) if end > least else text


def without_contents(text: str) -> str:
    """Without a table of contents near the head: its heading and the short lines after it, if there are three or more."""
    lines = text.split("\n")
    head = next((no for no, line in enumerate(lines[:31]) if re.search(CONTENTS, line, re.I)), None)
    if head is None:
        return text
    entries, end = 0, head + 1
    for no in range(head + 1, len(lines)):
        line = lines[no].strip()
        if line and not re.search(CONTENTS, line, re.I):
            if len(line) >= 80 and not re.match(CONTENTS_ENTRY, line, re.I):
                break
            entries += 1
        end = no + 1
    return "\n".join(lines[end:]) if entries >= 3 else text


def contents_zone(text: str) -> tuple[int, int]:
    """Where a table of contents lies: up to the fifth line of content after its heading, or 5,000 characters; (0, 0) without one."""
    start = re.search(CONTENTS, text, re.I)
    if start is None:
        return 0, 0
    at, content = start.start(), 0
    for line in text[start.start() :].split("\n"):
        bare = line.strip()
        if bare:
            entry = re.search(CONTENTS_LINE, bare, re.I) is not None or len(bare) < 100 and not content
            content = 0 if entry else content + 1
            if content == 5:
                return start.start(), at + 1
        at += len(line) + 1
    return start.start(), min(len(text), start.start() + 5000)


def plain_text(html: str | None) -> str | None:
    """Text without tags, scripts and styles, preamble and contents; runs of blanks as one, lines trimmed, empty lines left out. Null stays null."""
    if html is None:
        return None
    return without_contents(without_preamble(_tidy("".join(_read(html).parts)))).strip()


def inline_sections(html: str) -> dict[str, str]:
    """The longest text of each section that inline tags mark; empty without such tags."""
    found: dict[str, str] = {}
    for name, text in _read(html).inline:
        local = name.split(":")[-1].lower()
        section = next((s for key, s in INLINE.items() if key.lower() in local), None)
        text = _tidy(text)
        if section and len(text) > len(found.get(section, "")):
            found[section] = text
    return found


def is_stub(text: str) -> bool:
    """A text under 200 words that says nothing, points elsewhere, or has no sentence of ten words in fewer than twenty."""
    if len(text.split()) >= _STUB:
        return False
    body = re.sub(LEADING_ITEM, "", text.strip(), flags=re.I).strip()
    if body.lower().rstrip(".") in NOTHING or _POINTER.search(text):
        return True
    return len(body.split()) < _FEW and not any(len(s.split()) >= 10 for s in re.split(r"[.!?]", body))


def resolved(stub: str, sections: dict[str, str]) -> str | None:
    """The note that a stub points to, from its heading to the next note or 5,000 characters; at least fifty words."""
    number = _NOTE.search(stub)
    if number is None:
        return None
    n = number.group(1)
    for name in sorted(sections, key=lambda s: s != "financial_statements"):
        text = sections[name]
        head = re.search(rf"note\s+{n}\b[^\n]*\n", text, re.I)
        if head is None:
            continue
        after = re.compile(rf"note\s+(?!{n}\b)\d+\b", re.I).search(text, head.end())
        body = text[head.start() : after.start() if after else head.start() + 5000].strip()
        if len(body.split()) >= 50:
            return body
    return None


def _cut(text: str, marks: list[tuple[str, str]], flags: int, zone: tuple[int, int]) -> list[tuple[str, str]]:
    """(section, body) from each heading outside the contents to the next."""
    found = sorted(((m.start(), k) for k, (_, p) in enumerate(marks) for m in re.finditer(p, text, flags) if not zone[0] < m.start() < zone[1]))
    return [(marks[k][0], text[at:end].strip()) for (at, k), end in zip(found, [*(at for at, _ in found[1:]), len(text)])]


def sections_of(text: str | None, form: str | None) -> list[tuple[str, str]]:
    """(section, body) of a filing's text, by name: the longest body of each section that is no stub; looser headings and titles of annual reports where a section has under a hundred words; notes in place of stubs; else the full text."""
    if not text:
        return []
    kind = next((k for k in HEADINGS if (form or "").startswith(k)), None)
    zone = contents_zone(text)
    cut = _cut(text, HEADINGS[kind], re.I, zone) if kind else []
    if not cut:
        return [("full_text", text)]
    found: dict[str, str] = {}
    stubs: dict[str, str] = {}
    for name, body in cut:
        if is_stub(body):
            stubs[name] = body
        elif len(body) >= len(found.get(name, "")):
            found[name] = body
    for marks, flags in ((LOOSE, re.I), (TITLES, 0)):
        if kind == "10-K" and any(len(b.split()) < _SHORT for b in found.values()):
            for name, body in _cut(text, marks, flags, zone):
                if not is_stub(body) and len(body.split()) > len(found.get(name, "").split()):
                    found[name] = body
    if not found:
        return [("full_text", text)]
    for name, stub in stubs.items():
        if name not in found and (note := resolved(stub, found)):
            found[name] = note
    return sorted(found.items())


def parse_filing(html: str | None, form: str | None) -> list[tuple[str, str]]:
    """(section, body) of a document: from inline tags if it has any, else from its cleaned text."""
    if not html:
        return []
    return sorted(inline_sections(html).items()) or sections_of(plain_text(html), form)
