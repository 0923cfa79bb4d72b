"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Method. Patterns find what looks like a secret wherever it stands. The lexer then reads the text as
source or configuration: it finds name-literal pairs (`name = "literal"`, `name: literal`,
`"name": 'literal'`, `export NAME=literal`, `name := "a" + "b"`), keeps an environment of constants so
that a name given another name's value gets its literals too, and scores each literal by how sensitive
its target's name is and how random the literal looks. Literals that score enough and that no pattern
covers become spans of kind `literal`.

Constants are kept by reference and measured once each, so time and memory grow with the text's length,
not with what its names stand for (`a = a + a` doubles).

Positions are code points, ends exclusive. A null text counts as empty; rows are scanned each for
itself, so repeated rows repeat; extra columns pass through or are ignored; an empty table gives an
empty one. Spans of equal start come in the order of kinds. One pass, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, rows_of

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_BYTES = re.compile(rb"[0-9a-f]{24}")
STEMS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Words of a name and how sensitive they make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 0.95, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 0.95, ("access", "key"): 0.95, ("private", "key"): 0.95, ("auth", "key"): 0.95,
    ("signing", "key"): 0.95, ("encryption", "key"): 0.95, ("secret", "key"): 1.0,
}
#: Lower-case words of which a text must hold one, or both of a pair; otherwise no name in it scores.
LEXED = tuple(w.encode() for w in SENSITIVE)
LEXED_PAIRS = tuple((a.encode(), b.encode()) for a, b in SENSITIVE_PAIRS)
#: Words that say the value is about a secret, not the secret.
HARMLESS = {
    "name", "file", "path", "url", "uri", "id", "type", "length", "len", "size", "count", "max", "min", "public",
    "example", "placeholder", "hint", "label", "field", "prompt", "expiry", "expires", "ttl", "limit", "policy", "env",
}
DUMMY = re.compile(
    r"(?i)^(?:x+|\*+|\.+|null|none|nil|true|false|undefined|todo|changeme|change_me|password|secret|token|"
    r"your[_-].*|my[_-].*|test.*|example.*|dummy.*|sample.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$"
)
#: Those that a value too long to be put together can be.
LONG_DUMMY = re.compile(r"(?i)^(?:your[_-].*|my[_-].*|test.*|example.*|dummy.*|sample.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$", re.DOTALL)
#: A dotted or hyphenated name, taken whole, and what makes it a target: an optional type and an operator.
NAME = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+", re.ASCII)
TARGET = re.compile(
    r"""["']?(?:\s*+:\s*+[A-Za-z_][\w.<>\[\]]*+(?=\s*+=[^=]))?[\x20\t]*+(:=|=>|=|:)(?![=:/])[\x20\t]*+""", re.ASCII
)
TERM = re.compile(
    r"""\"\"\"(?P<t>.*?)\"\"\"|"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`]*+)`|(?P<n>[A-Za-z_$][\w$.]*+)(?=[\x20\t]*(?:$|[;,)}\n+]))|(?P<w>[^\s"'`,;(){}\[\]<>])""",
    re.DOTALL | re.MULTILINE | re.ASCII,
)
#: What ends an unquoted word, of which TERM takes the first character alone.
STOP = re.compile(r"""[\s"'`,;(){}\[\]<>]|\Z""", re.ASCII)
#: Words that end together are measured by what the next one so many characters on measures.
BLOCK = 1024
QUOTES = ('"', "'", "`")
JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.?)[\x20\t]*\n?[\x20\t]*")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    #: what to blank when the text is redacted
    value_start: int
    value_end: int
    score: float


class Value:
    """What a name was given: literals (start, end, quoted) and values of other names, by reference."""

    __slots__ = ("measures", "parts", "pieces")

    def __init__(self, parts: list):
        self.parts: list[tuple[int, int, bool] | Value] = parts
        #: the same text in the pieces that are measured
        self.pieces = parts
        self.measures: Measures | None = None


class Measures:
    """Length, character counts and form of a value's whole text, which may be far longer than the source."""

    __slots__ = ("classes", "counts", "head", "lines", "quoted", "size", "tail", "text")

    def __init__(self, parts: list[Measures]):
        total = sum(p.size for p in parts)
        self.size = min(total, HUGE)
        self.quoted = any(p.quoted for p in parts)
        self.lines = any(p.lines for p in parts)
        self.classes = tuple(any(p.classes[k] for p in parts) for k in range(4)) if parts else (False,) * 4
        self.text = "".join(p.text for p in parts) if self.size <= WHOLE and all(p.text is not None for p in parts) else None
        self.head, self.tail = "", ""
        for p in parts:
            if len(self.head) < 16:
                self.head = (self.head + p.head)[:16]
            self.tail = (self.tail + p.tail)[-2:]
        #: by code point modulo 128, as shares of the whole
        self.counts = np.zeros(128)
        if self.size:
            for p in parts:
                self.counts += p.counts * (p.size / total)

    @classmethod
    def of(cls, text: str, quoted: bool) -> Measures:
        self = cls([])
        self.size, self.quoted, self.lines = len(text), quoted, "\n" in text
        self.head, self.tail, self.text = text[:16], text[-2:], text if len(text) <= WHOLE else None
        seen = Counter(text)
        for c, n in seen.items():
            self.counts[ord(c) % 128] += n / len(text)
        self.classes = tuple(any(map(f, seen)) for f in (str.islower, str.isupper, str.isdigit, _is_mark))
        return self


def _is_mark(c: str) -> bool:
    return not c.isalnum()


#: Characters up to which a value's text is put together; a size that stands for all above it.
WHOLE, HUGE = 4096, 1 << 50


def measure(value: Value, text: str) -> Measures:
    """Measures of a value, of each value it refers to once."""
    stack = [value]
    while stack:
        top = stack[-1]
        if top.measures is not None:
            stack.pop()
            continue
        waiting = [p for p in top.pieces if isinstance(p, Value) and p.measures is None]
        if waiting:
            stack += waiting
            continue
        top.measures = Measures([p.measures if isinstance(p, Value) else Measures.of(text[p[0] : p[1]], p[2]) for p in top.pieces])
        stack.pop()
    return value.measures


def name_score(name: str) -> float:
    words = [w.lower() for w in CAMEL.findall(name)]
    if not words or words[-1] in HARMLESS or words[0] == "public":
        return 0.0
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([best, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


def literal_score(m: Measures) -> float:
    """Near 1 for long, random-looking strings; 0 for dummies, words and what is too short."""
    n = m.size
    if n < 8 or (not m.quoted and n < 12):
        return 0.0
    if DUMMY.match(m.text) if m.text is not None else not m.lines and LONG_DUMMY.match(m.head + m.tail):
        return 0.0
    if n < 20 and any(map(str.isspace, m.text)):
        return 0.0
    if sum(m.classes) < 2 or not (m.classes[2] or m.classes[3]):
        return 0.0
    shares = m.counts[m.counts > 0]
    bits = float(-(shares * np.log2(shares)).sum())
    return min(1.0, bits / 3.2) * min(1.0, 0.7 + n / 80)


def lex(text: str) -> list[tuple[str, Value]]:
    """(name, its value) in the text's order, with constants followed through names.

    The environment is the text's own: a name stands for the value it was given last before. Values
    refer to one another, so a name made of others costs no copy. An unquoted word, however long, ends
    before a sensitive name that is itself given a value. Words may overlap (`a=b=c`): those of one end
    are measured by one another.
    """
    targets: list[tuple[int, str, int, str]] = []
    upto = 0
    for m in NAME.finditer(text):
        if m.start() >= upto and (target := TARGET.match(text, m.end())):
            upto = target.end()
            targets.append((m.start(), m[0], upto, target[1]))
    ends, end = [], len(text)  # where each target's unquoted words end at the latest
    for start, name, _, _ in reversed(targets):
        ends.append(end)
        if name_score(name):
            end = start
    constants: dict[str, Value] = {}
    found = []
    run = (0, 0)  # the unquoted characters last seen
    words: list[Value] = []  # unquoted words of one end, from the last one that others are measured by
    for (_, name, at, operator), end in zip(targets, reversed(ends), strict=True):
        parts: list = []
        while term := TERM.match(text, at) if text[at : at + 1] in QUOTES else TERM.match(text, at, end):
            kind = term.lastgroup
            if kind == "n":
                known = constants.get(term["n"])
                if known is not None:
                    parts.append(known)
                elif not parts and operator != "=>":
                    parts.append((term.start(), term.end(), False))
            elif kind == "w":
                if not run[0] <= at < run[1]:
                    run = at, STOP.search(text, at).start()
                stop = min(run[1], end)
                word = Value([(at, stop, False)])
                if words and not (words[-1].parts[0][0] <= at and words[-1].parts[0][1] == stop):
                    words = []
                if words and at >= words[0].parts[0][0] + BLOCK:
                    for w in words:
                        w.pieces = [(w.parts[0][0], at, False), word]
                    words = []
                words.append(word)
                parts.append(word)
                break
            else:
                parts.append((term.start(kind), term.end(kind), True))
            joined = JOIN.match(text, term.end())
            if joined is None:
                break
            at = joined.end()
        if parts:
            alone = len(parts) == 1 and isinstance(parts[0], Value)
            value = constants[name] = parts[0] if alone else Value(parts)
            found.append((name, value))
    return found


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: leftmost, without overlap inside a kind; failing matches use up text."""
    found = [
        Span("assign", m.start(), m.end(), m.start(1), m.end(1), 1.0)
        for m in ASSIGN.finditer(text)
        if m.end(1) - m.start(1) >= 6
    ]
    found += [Span("access", m.start(), m.end(), m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span("hex", m.start(), m.end(), m.start(), m.end(), 1.0) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def lexed_spans(text: str, base: list[Span], threshold: float) -> list[Span]:
    """Literals of sensitive names that no base span covers, each with its best name's score."""
    scored = []
    for name, value in lex(text):
        score = name_score(name)
        if score >= threshold:
            score *= literal_score(measure(value, text))
            if score >= threshold:
                scored.append((round(score, 6), value))
    best: dict[tuple[int, int], float] = {}
    seen: set[int] = set()
    for score, value in sorted(scored, key=lambda x: -x[0]):  # the best first: what it reaches is settled
        stack = [value]
        while stack:
            top = stack.pop()
            if id(top) in seen:
                continue
            seen.add(id(top))
            for p in top.parts:
                if isinstance(p, Value):
                    stack.append(p)
                elif p[1] > p[0]:
                    best.setdefault(p[:2], score)
    starts = [b.start for b in base]
    reach = list(accumulate((b.end for b in base), max))
    covered = lambda a, b: (k := bisect_right(starts, a)) and reach[k - 1] >= b
    return [Span("literal", a, b, a, b, score) for (a, b), score in best.items() if not covered(a, b)]


def scan(raw: bytes | None, threshold: float = 0.5) -> list[Span]:
    """All spans of a UTF-8 text, by start, then kind as listed."""
    if not raw:
        return []
    low = raw.lower()
    stems = any(s in low for s in STEMS)
    named = stems or any(s in low for s in LEXED) or any(b in low and a in low for a, b in LEXED_PAIRS)
    lexed = named and (b"=" in raw or b":" in raw)
    if not stems and not lexed and b"AKIA" not in raw and not HEX_BYTES.search(raw):
        return []
    text = raw.decode()
    base = base_spans(text)
    more = lexed_spans(text, base, threshold) if lexed else []
    return sorted([*base, *more], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


FOUND = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and its spans (kind, start, end, score) in order; an empty list where there is none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in scan(raw, threshold)]
            for raw in rows_of(batch.column(1).cast(pa.binary()))
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_batches(narrow, run, FOUND)


def redact_secrets(docs: DataFrame, mark: str = "[REDACTED]", threshold: float = 0.5) -> DataFrame:
    """docs with the secrets in text blanked out; the other columns as they were, n_chars adjusted.

    Of an assignment the value goes and the name stays. Overlapping values are blanked as one.
    """
    names = docs.columns
    at = names.index("text")

    def clean(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        spans = scan(raw, threshold)
        text = raw.decode()
        if not spans:
            return text
        out, end = [], 0
        for a, b in sorted((s.value_start, s.value_end) for s in spans):
            if a >= end:
                out += (text[end:a], mark)
            end = max(end, b)
        return "".join((*out, text[end:]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array(map(clean, rows_of(batch.column(at).cast(pa.binary()))), pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            sizes = [None if t is None else len(t) for t in rows_of(columns[at])]
            columns[k] = pa.array(sizes, pa.int64()).cast(batch.column(k).type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, docs.schema)
