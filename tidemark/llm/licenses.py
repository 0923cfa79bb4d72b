"""License scans: an Aho-Corasick automaton over normalised words, and SPDX-like expressions.

Method. A text's A-Z are lowered and everything in ASCII that is no letter or digit separates words;
the words joined by single blanks go once through an automaton that holds every notice phrase and
identifier tag (`SPDX-License-Identifier`, `License-Expression`), each between blanks, so that a hit is
a run of whole words. A tag's hit is followed up in the original text: if it is written as a tag, the
expression after its colon is parsed by the shunting-yard algorithm (WITH binds tightest, then AND, then
OR) and evaluated: its identifiers become labels, and it is acceptable if some choice among its ORs
needs only permissive licences.

A null text is empty and has no label; a text may be of any length, and places are found in one pass.
Rows are scanned each for itself, repeated or not, in one pass without a shuffle; an empty table gives an
empty one, other columns are ignored. The phrase list is fixed, so nothing that is held grows with the
data.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, rows_of

#: ASCII: 0-9, a-z stay, A-Z are lowered, the rest separates; bytes from 0x80 belong to words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: phrase -> label of the fixed base
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: phrase -> label that the method adds
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "all rights reserved": "proprietary",
}
#: Identifier of an expression, lower case -> label and whether the licence is permissive.
IDENTIFIERS = {
    "mit": ("mit", True), "apache-2.0": ("apache-2", True), "bsd-2-clause": ("bsd-2-clause", True),
    "bsd-3-clause": ("bsd-3-clause", True), "isc": ("isc", True), "unlicense": ("unlicense", True),
    "cc0-1.0": ("cc0", True), "cc-by-4.0": ("cc-by", True), "cc-by-sa-4.0": ("cc-by-sa", False),
    "cc-by-nc-4.0": ("cc-by-nc", False), "gpl-2.0": ("gpl-2", False), "gpl-2.0-only": ("gpl-2", False),
    "gpl-2.0-or-later": ("gpl-2", False), "gpl-3.0": ("gpl-3", False), "gpl-3.0-only": ("gpl-3", False),
    "gpl-3.0-or-later": ("gpl-3", False), "lgpl-2.1": ("lgpl", False), "lgpl-3.0": ("lgpl", False),
    "agpl-3.0": ("agpl", False), "mpl-2.0": ("mpl-2", False), "epl-2.0": ("epl", False), "zlib": ("zlib", True),
}
#: Exceptions that make a copyleft licence linkable.
EXCEPTIONS = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "autoconf-exception-3.0"}
#: words of a tag -> how it is written; the expression goes on to the line's end
TAGS = {
    "spdx license identifier": re.compile(rb"(?i)spdx-license-identifier\s*:\s*([^\r\n*#]+)"),
    "license expression": re.compile(rb"(?i)license-expression\s*:\s*([^\r\n*#]+)"),
}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: A word of the original text, in bytes.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BINDS = {"or": 1, "and": 2, "with": 3}


class Verdict(NamedTuple):
    labels: frozenset[str]
    permissive: bool
    name: str


def parse_expression(text: str) -> list[str]:
    """Reverse Polish form by shunting-yard. It ends where the grammar does; ValueError if nothing fits."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last symbol was one
    depth = at = 0
    for m in TOKEN.finditer(text):
        if text[at : m.start()].strip():
            break  # other punctuation ends the expression
        at = m.end()
        word = m[0].lower()
        if word in BINDS:
            if not operand:
                raise ValueError("an operator without a left side")
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        elif word == "(":
            if operand:
                break
            stack.append(word)
            depth += 1
        elif word == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if operand:
                break  # prose after the expression
            out.append(word)
            operand = True
    if not operand or depth:
        raise ValueError("not an expression")
    return out + stack[::-1]


def evaluate(polish: list[str]) -> Verdict:
    """AND needs both sides, OR either; WITH a linking exception lifts what it is attached to."""
    stack: list[Verdict] = []
    for word in polish:
        if word not in BINDS:
            label, free = IDENTIFIERS.get(word.rstrip("+"), (None, False))
            stack.append(Verdict(frozenset([label] if label else []), free, word))
            continue
        b, a = stack.pop(), stack.pop()
        if word == "with":
            stack.append(Verdict(a.labels, a.permissive or b.name in EXCEPTIONS, a.name))
        else:
            joined = a.labels | b.labels
            free = (a.permissive and b.permissive) if word == "and" else (a.permissive or b.permissive)
            stack.append(Verdict(joined, free, ""))
    return stack.pop()


_AUTOMATON: list = []


def automaton():
    """Of all phrases between blanks, over Latin-1 text: one code unit for each UTF-8 byte."""
    if not _AUTOMATON:
        import ahocorasick

        made = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, *TAGS}:
            made.add_word(f" {phrase} ", (phrase, len(phrase) + 1))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


class Found(NamedTuple):
    n_words: int
    #: (first word, label, whether of the base), in order
    hits: list[tuple[int, str, bool]]
    expressions: list[tuple[str, bool]]


def scan(raw: bytes | None) -> Found:
    words = raw.translate(FOLD).split() if raw else []
    if not words:
        return Found(0, [], [])
    joined = b" ".join((b"", *words, b""))
    text = joined.decode("latin-1")
    hits, tagged, last, count = [], [], 0, -1
    for end, (phrase, back) in automaton().iter(text):
        start = end - back  # of the blank before the phrase
        # words before: blanks up to and with this one, less one; hits come by end, so starts may step back
        if start >= last:
            count += text.count(" ", last, start + 1)
            last = start + 1
            first = count
        else:
            first = count - text.count(" ", start + 1, last)
        if phrase in BASE:
            hits.append((first, BASE[phrase], True))
        if phrase in NOTICES:
            hits.append((first, NOTICES[phrase], False))
        if phrase in TAGS:
            tagged.append((first, TAGS[phrase]))
    expressions = []
    if tagged:
        places = {w for w, _ in tagged}
        begins = {n: m.start() for n, m in enumerate(WORD.finditer(raw)) if n in places}
        for first, written in sorted(tagged, key=lambda t: t[0]):
            m = written.match(raw, begins[first])
            if m is None:  # the words, but no tag
                continue
            expression = m[1].decode("utf-8", "replace")
            try:
                verdict = evaluate(parse_expression(expression))
            except ValueError:
                continue
            hits += [(first, label, False) for label in sorted(verdict.labels)]
            expressions.append((expression.strip(), verdict.permissive))
    return Found(len(words), sorted(hits), expressions)


FOUND = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, hits array<struct<word:bigint,label:string,base:boolean>>, permissive boolean"
)
_HITS = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: words, places of base phrases, labels, every hit and the expressions' verdict.

    score is 0 without a label, 0.5 with notices alone, 0.9 with a base phrase, 1 with a valid tag.
    permissive is null without a tag, else whether all of its expressions can be met permissively.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(raw) for raw in rows_of(batch.column(1).cast(pa.binary()))]
        base = [[w for w, _, b in r.hits if b] for r in rows]
        join = lambda r, only: ",".join(sorted({x for _, x, b in r.hits if b or not only}))
        score = [1.0 if r.expressions else 0.9 if b else 0.5 if r.hits else 0.0 for r, b in zip(rows, base, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([r.n_words for r in rows], pa.int64()),
                pa.array(list(map(len, base)), pa.int64()),
                pa.array([min(b, default=None) for b in base], pa.int64()),
                pa.array([max(b, default=None) for b in base], pa.int64()),
                pa.array([join(r, True) for r in rows], pa.string()),
                pa.array([join(r, False) for r in rows], pa.string()),
                pa.array(score, pa.float64()),
                pa.array([[{"word": w, "label": x, "base": b} for w, x, b in r.hits] for r in rows], _HITS),
                pa.array([all(p for _, p in r.expressions) if r.expressions else None for r in rows], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits", "permissive"],
        )

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_batches(narrow, run, FOUND)
