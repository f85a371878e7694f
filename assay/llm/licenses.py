"""License scans: an Aho-Corasick automaton and licence expressions.

One automaton over the word sequence of a text finds notice phrases and the
identifier tag, all places in one pass. Behind a tag the rest of the line is read as
a licence expression: a shunting-yard parser turns it into postfix order (WITH
binds tighter than AND, AND tighter than OR), and evaluation gives its licences
and whether it can be met with accepted ones only.

A null text is the empty text: no words, no labels, score 0. Overlapping and
repeated phrases count at every place. Rows are independent, so repeated rows and
hot sources need nothing special, no row is shuffled, and an empty table gives no rows.
A very long text takes time in proportion to its length: places are looked up in
one list of its blanks.
An expression that cannot be parsed gives the label ``unparsed``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm.common import texts

# The contract's phrases with their labels, then this scanner's own.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
ACCEPTED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc 0bsd unlicense cc0-1.0 cc-by-4.0".split())
BINDING = {"or": 1, "and": 2, "with": 3}
# How far a finding is trusted.
WEIGHTS = {"base": 0.9, "expression": 0.95, "notice": 0.6, "unparsed": 0.3}


@dataclass(frozen=True)
class Licence:
    names: frozenset[str]
    accepted: bool


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard; raises ValueError for anything but a whole expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand or "(" must come next
    for t in tokens:
        word = t.lower()
        if word in BINDING:
            if operand:
                raise ValueError(f"operator {t} without a left side")
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif t == "(":
            if not operand:
                raise ValueError("a bracket opens behind an operand")
            stack.append(t)
        elif t == ")":
            if operand:
                raise ValueError("a bracket closes without an operand")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("a bracket closes that was not opened")
            stack.pop()
        else:
            if not operand:
                raise ValueError(f"operand {t} without an operator")
            out.append(word)
            operand = False
    if operand:
        raise ValueError("the expression ends too early")
    while stack:
        if stack[-1] == "(":
            raise ValueError("a bracket stays open")
        out.append(stack.pop())
    return out


def evaluate(tokens: list[str], accepted: frozenset[str] = ACCEPTED) -> Licence:
    """All licences named, and whether accepted ones can meet the expression."""
    stack: list[Licence] = []
    for t in postfix(tokens):
        if t not in BINDING:
            stack.append(Licence(frozenset([t]), t.removesuffix("+") in accepted))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            if len(left.names) != 1 or len(right.names) != 1:
                raise ValueError("WITH joins one licence and one exception")
            stack.append(Licence(frozenset([f"{min(left.names)}-with-{min(right.names)}"]), left.accepted))
        else:
            met = left.accepted and right.accepted if t == "and" else left.accepted or right.accepted
            stack.append(Licence(left.names | right.names, met))
    return stack[0]


TAG_IN_TEXT = re.compile(r"spdx[-\s]license[-\s]identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*|[()]|\S")


def expression_of(line: str) -> list[str]:
    """The tokens of a licence expression at the start of ``line``; prose or signs behind it end it."""
    out: list[str] = []
    depth, operand = 0, True
    for t in TOKEN.findall(line):
        joins = t.lower() in BINDING
        if not (joins or t in "()" or t[0].isalnum()) or (not operand and not joins and t != ")"):
            break
        if t == ")" and depth == 0:
            break
        depth += (t == "(") - (t == ")")
        operand = joins or t == "("
        out.append(t.rstrip(".") if t[0].isalnum() else t)
    return out


# Bytes of a word stay (A-Z lower-cased, every byte of a non-ASCII character), all others part words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], accepted: frozenset[str]):
        import ahocorasick

        self.accepted = accepted
        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("notice", notices), ("base", base), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                spelled = f" {phrase} ".encode().decode("latin-1")
                self.automaton.add_word(spelled, (kind, label, len(spelled), phrase.count(" ") + 1))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        spots, base, own, spans, expressions = [], set(), set(), [], []
        doubt, tagged = 1.0, False
        gaps = None
        for end, (kind, label, size, length) in self.automaton.iter(line):
            if gaps is None:  # where the blanks stand, listed once per text
                gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            first = int(np.searchsorted(gaps, end - size + 1))
            if kind == "tag":
                tagged = True
                continue
            spans.append((label, first, first + length))
            doubt *= 1 - WEIGHTS[kind]
            if kind == "base":
                spots.append(first)
                base.add(label)
            else:
                own.add(label)
        if tagged:
            for tail in TAG_IN_TEXT.findall(text):
                try:
                    found = evaluate(expression_of(tail), self.accepted)
                    own |= found.names
                    expressions.append((tail.strip(), found.accepted))
                    doubt *= 1 - WEIGHTS["expression"]
                except ValueError:
                    own.add("unparsed")
                    doubt *= 1 - WEIGHTS["unparsed"]
        return (
            len(words),
            len(spots),
            min(spots, default=None),
            max(spots, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base | own)),
            1 - doubt,
            [{"label": a, "first": b, "last": c} for a, b, c in spans],
            [{"expression": a, "accepted": b} for a, b in expressions],
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first long, last long>>, "
    "expressions array<struct<expression string, accepted boolean>>"
)
SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
TYPES = [
    *[(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")],
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", pa.list_(SPAN)),
    ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("accepted", pa.bool_())]))),
]


def scanned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    accepted: frozenset[str] = ACCEPTED,
) -> DataFrame:
    """Per row: word count, places and labels of phrases, word spans, parsed expressions, score."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, accepted)
        for batch in batches:
            rows = [scanner.scan(str(t)) for t in batch.column(1)]
            columns = [batch.column(0), *(zip(*rows, strict=True) if rows else [()] * 9)]
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(list(c), t)
                    for c, (_, t) in zip(columns, TYPES, strict=True)
                ],
                names=[n for n, _ in TYPES],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
