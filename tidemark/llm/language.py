"""Language identification with spans of mixed-language text.

Method. The script of a word's letters narrows its candidate languages to those learned in that
script. Each candidate is scored by log P(word | language), a mixture of the word's own frequency and
a character trigram model. Viterbi then labels every word of the text under a penalty for switching;
runs of one label are the spans, and the text's language is the one with most words.

Learning. Word counts of a sample of labelled documents: `sample_docs` for each language, chosen by a
hash of doc_id that is small enough, so the model's size is bounded whatever the table holds; at most
`max_words` words a language are kept. Everything else covers every word of every text.

Nulls: a null text, or one without a letter, is `und` with score 0; a null lang is not learned from.
Without any labelled document everything is `und`. Ties go to the language first in alphabetical
order. A text whose letters are all of scripts that were not learned gets the most frequent language
with score 0. Repeated rows are labelled each for itself; extra columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, kept, rows_of

WORD = re.compile(r"[^\W\d_]+")
#: (first code point, script); a script goes on to the next row's start.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3130, "Hangul"),
    (0x31A0, "Han"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Yi"), (0xAC00, "Hangul"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPTS]
#: Weight of a word's own frequency against the trigram model; how far below the best a score may be.
MIX, FLOOR = 0.6, 8.0
#: Words whose scores are remembered; beyond it all are forgotten, after a group of texts.
MEMO = 200_000


def script_of(word: str) -> str:
    """The script of most of a word's letters, the first among equals."""
    if word.isascii():
        return "Latin"
    return Counter(SCRIPTS[bisect.bisect_right(_STARTS, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


class Model:
    """Score vectors of words, one entry a language, in alphabetical order."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.total = {x: sum(c.values()) for x, c in counts.items()}
        self.words = counts
        self.first = max(range(len(self.langs)), key=lambda k: (self.total[self.langs[k]], -k), default=0)
        self.grams: dict[str, Counter] = {}
        self.heads: dict[str, Counter] = {}
        letters: set[str] = set()
        scripts: dict[str, Counter] = {}
        for x, c in counts.items():
            grams, heads, seen = Counter(), Counter(), Counter()
            for w, n in c.items():
                seen[script_of(w)] += n
                padded = f"^{w}$"
                letters.update(padded)
                for i in range(len(padded) - 1):
                    a, b = padded[max(0, i - 1) : i + 1], padded[i + 1]
                    grams[a + b] += n
                    heads[a] += n
            self.grams[x], self.heads[x], scripts[x] = grams, heads, seen
        self.letters = max(1, len(letters))
        self.logs: dict[str, tuple[float, ...]] = {}
        #: script -> indices of languages of which it makes at least a hundredth
        self.candidates: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(self.langs):
            for s, n in scripts[x].items():
                if 100 * n >= self.total[x]:
                    self.candidates[s].append(k)

    def gram(self, gram: str) -> tuple[float, ...]:
        """Log probabilities, one a language, of a gram's last letter after the others."""
        return tuple(
            math.log((self.grams[x][gram] + 0.1) / (self.heads[x][gram[:-1]] + 0.1 * self.letters)) for x in self.langs
        )

    def scores(self, word: str) -> tuple[float, ...] | None:
        """0 for the best candidate, less for others, -FLOOR at least; None if the script is unknown."""
        word = word.lower()
        found = self.candidates.get(script_of(word))
        if not found:
            return None
        padded, logs = f"^{word}$", self.logs
        grams = [padded[:2], *(padded[i : i + 3] for i in range(len(padded) - 2))]
        rows = []
        for gram in grams:
            row = logs.get(gram)
            if row is None:
                if len(logs) > MEMO:
                    logs.clear()
                row = logs[gram] = self.gram(gram)
            rows.append(row)
        sums = list(map(sum, zip(*rows, strict=True)))
        out = []
        for k, x in enumerate(self.langs):
            own = self.words[x].get(word, 0) / self.total[x]
            out.append(math.log(MIX * own + (1 - MIX) * math.exp(max(sums[k], -200.0)) + 1e-300))
        best = max(out[k] for k in found)
        return tuple(max(v - best, -FLOOR) if k in found else -FLOOR for k, v in enumerate(out))


def learn(docs: DataFrame, sample_docs: int = 400, max_words: int = 20_000) -> Model:
    """Model of a sample: about sample_docs documents of each language (docs: doc_id, text, lang).

    Two aggregations: documents for each language, then words of the sample. What comes to the driver
    is max_words rows a language at most.
    """
    usable = docs.where("lang is not null and text is not null").select(
        "text", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    )
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample_docs / n))))
    words = (
        usable.where(F.col("u") < share[F.col("lang")])
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in words.withColumn("k", rank).where(F.col("k") <= max_words).collect():
        counts[r["lang"]][r["word"]] = r["n"]
    return Model(dict(counts))


class Labeller:
    """A model with a memo of words' scores; index 0 is a word of an unknown script, 1 no word."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.reset()

    def reset(self) -> None:
        wide = max(1, len(self.model.langs))
        self.table = np.zeros((1024, wide), np.float32)
        self.ids: dict[str, int] = {}
        self.used = 2

    def add(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            found = 1
        else:
            scores = self.model.scores(word)
            found = 0
            if scores is not None:
                if self.used == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                found, self.used = self.used, self.used + 1
                self.table[found] = scores
        self.ids[word] = found
        return found

    def words(self, text: str) -> np.ndarray:
        found = list(map(self.ids.get, split := WORD.findall(text)))
        if None in found:
            found = [self.add(w) if k is None else k for k, w in zip(found, split, strict=True)]
        return np.array(found, np.int32)

    def label(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over each text's words: all texts of the list step together, the longest first."""
        kind = np.min_scalar_type(self.table.shape[1] - 1)  # a byte up to 256 languages
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        n = int((sizes > 0).sum())
        if not n:
            return [np.zeros(0, kind) for _ in texts]
        flat = np.concatenate([texts[k] for k in order[:n]])
        starts = np.concatenate([[0], np.cumsum(sizes[: n - 1])]).astype(np.int64)
        longest = int(sizes[0])
        #: texts that have a word at step t
        alive = n - np.searchsorted(sizes[:n][::-1], np.arange(1, longest + 1), side="left")
        table, penalty = self.table, np.float32(self.penalty)
        value = table[flat[starts]]
        back: list[np.ndarray] = []
        ends = np.zeros(n, kind)
        for t in range(1, longest):
            m = int(alive[t])
            if m < len(value):
                ends[m : len(value)] = value[m:].argmax(1)
                value = value[:m]
            arg = value.argmax(1).astype(kind)
            switch = value[np.arange(m), arg] - penalty
            stay = value >= switch[:, None]
            back.append(np.where(stay, np.arange(value.shape[1], dtype=kind), arg[:, None]))
            value = np.where(stay, value, switch[:, None]) + table[flat[starts[:m] + t]]
        ends[: len(value)] = value.argmax(1)
        labels = np.zeros(len(flat), kind)
        now = ends[: int(alive[longest - 1])]
        for t in range(longest - 1, -1, -1):
            m = int(alive[t])
            if m > len(now):
                now = np.concatenate([now, ends[len(now) : m]])
            labels[starts[:m] + t] = now
            if t:
                now = back[t - 1][np.arange(m), now]
        out: list[np.ndarray] = [np.zeros(0, kind)] * len(texts)
        for k in range(n):
            out[order[k]] = labels[starts[k] : starts[k] + sizes[k]]
        return out


#: Texts that are labelled together: a step of Viterbi costs much the same for one text and for thousands.
GROUP_ROWS, GROUP_WORDS = 8192, 4_000_000


def _shipped(docs: DataFrame, model: Model, penalty: float) -> Callable[[], Labeller]:
    """A function for tasks that gives the labeller of a broadcast model; a worker keeps it."""
    raw = pickle.dumps(model)
    shipped, key = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).digest() + str(penalty).encode()
    return lambda: kept(("labeller", key), lambda: Labeller(pickle.loads(shipped.value), penalty))


def _labelled(batches: Iterator[pa.RecordBatch], labeller: Labeller, at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Batches with the words and labels of column `at`; bounded groups of batches are labelled at once."""
    none = np.zeros(0, np.int32)
    known = bool(labeller.model.langs)
    held: list[pa.RecordBatch] = []
    words: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
        labels, k = labeller.label(words), 0
        for b in held:
            yield b, words[k : k + b.num_rows], labels[k : k + b.num_rows]
            k += b.num_rows
        held.clear(), words.clear()
        if len(labeller.ids) > MEMO:
            labeller.reset()

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [labeller.words(t) if t and known else none for t in rows_of(batch.column(at))]
        held.append(batch)
        words += own
        size += sum(map(len, own))
        if len(words) >= GROUP_ROWS or size >= GROUP_WORDS:
            yield from flush()
            size = 0
    yield from flush()


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, penalty: float = 6.0) -> DataFrame:
    """docs' rows whose text has a language: some letter, and one language for least_score of its words."""
    bounded_batches(docs.sparkSession)
    labeller_of, at = _shipped(docs, model, penalty), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, labels in _labelled(batches, labeller_of(), at):
            found = []
            for ids, label in zip(words, labels, strict=True):
                scored = label[ids > 1]
                found.append(bool(len(scored)) and np.bincount(scored).max() >= least_score * len(scored))
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


PREDICTED = "doc_id bigint, lang_pred string, score double, spans string"


def predict(docs: DataFrame, model: Model, penalty: float = 6.0) -> DataFrame:
    """doc_id, lang_pred, score (share of words in that language) and spans.

    spans: `start:end:language` of the runs, comma-joined, code points; of a text in one language only
    the whole. One pass without a shuffle; the model is broadcast, its size is bounded by learn().
    """
    bounded_batches(docs.sparkSession)
    labeller_of = _shipped(docs, model, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of()
        langs = labeller.model.langs
        for batch, words, labelled in _labelled(batches, labeller, 1):
            column = batch.column(1)
            pred, score, spans = [], [], []
            for k, (ids, labels) in enumerate(zip(words, labelled, strict=True)):
                letters, scored = ids != 1, ids > 1
                n = int(scored.sum())
                if n:
                    counts = np.bincount(labels[scored], minlength=len(langs))
                    best = int(counts.argmax())
                    pred.append(langs[best])
                    score.append(float(counts[best]) / n)
                    spans.append(_spans(column[k].as_py(), ids, labels, langs))
                elif letters.any():
                    pred.append(langs[labeller.model.first])
                    score.append(0.0)
                    spans.append("")
                else:
                    pred.append("und")
                    score.append(0.0)
                    spans.append("")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return narrow.mapInArrow(run, PREDICTED)


def _spans(text: str, ids: np.ndarray, labels: np.ndarray, langs: list[str]) -> str:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    if not len(cuts):
        return f"0:{len(text)}:{langs[labels[0]]}"
    begins = {0, *cuts.tolist()}
    places = [m.start() for k, m in enumerate(WORD.finditer(text)) if k in begins]
    places[0] = 0
    return ",".join(
        f"{a}:{b}:{langs[labels[k]]}" for a, b, k in zip(places, [*places[1:], len(text)], sorted(begins), strict=True)
    )
