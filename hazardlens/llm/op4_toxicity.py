"""Toxicity scores from a weighted lexicon.

Texts are folded first: lower case, homoglyphs and digits or symbols that
stand for letters become those letters, everything else a blank. An
Aho-Corasick automaton then finds lexicon terms at word starts; a word
counts with its longest term's weight. Exception phrases (a term with the
word before or behind it) take the weight back. The weighted hits are
normalised by length and a logistic curve maps them to a score.

Terms (word beginnings and whole words), weights, exceptions and the curve
are learned from a bounded sample of labelled rows: at most
``MAX_TRAINING_ROWS`` rows whose crc32(doc_id as text) mod 5 is not 0, so
the lexicon is bounded too and is sent to all tasks. ``train`` keeps the
``max_terms`` strongest terms and as many exception phrases, the commonest
first. Everything is scored.

Null and empty texts have no hits and get the curve's value for none. Null
labels are left out of training; without labels of both classes every score
is 0. Rows with equal texts have equal scores. An empty table gives an empty
result. Very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stored, table

MAX_TRAINING_ROWS = 8000
MAX_TERMS = 4000
MIN_TOXIC_DOCS = 8
MIN_LOG_ODDS = 2.0
PREFIX_LENGTHS = (4, 12)

# Characters that stand for a Latin letter.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏνοαρτικβ０１３４５７", "aeopcyxijsdhlvoaptikboieast"))
DIGITS = dict(zip("0134578", "oieastb"))
SYMBOLS = dict(zip("@$!|", "asil"))
_SYMBOL_LETTER = re.compile(r"[@$!|](?=\w)")


class _Fold(dict):
    """Character table, filled as characters appear."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF21 <= code <= 0xFF5A:  # full-width letters lie at a fixed distance
            c = chr(code - 0xFEE0).lower()
        c = LOOKALIKES.get(c, DIGITS.get(c, c))
        out = self[code] = c if c.isalpha() else " "
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, each with one blank before it; a blank ends the text."""
    low = (text or "").lower()
    if "!" in low or "$" in low or "@" in low or "|" in low:
        low = _SYMBOL_LETTER.sub(lambda m: SYMBOLS[m.group()], low)
    return " " + " ".join(low.translate(_FOLD).split()) + " "


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]       # " begin" or " whole ": weight
    exceptions: frozenset[str]    # two folded words
    curve: tuple[float, ...]      # intercept and slopes
    scale: tuple[tuple[float, float], ...]


def _terms_of(word: str) -> list[str]:
    lo, hi = PREFIX_LENGTHS
    return [" " + word[:n] for n in range(lo, min(hi, len(word)) + 1)] + [" " + word + " "]


def _log_odds(toxic, clean, n_toxic, n_clean):
    return np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0))


class Matcher:
    def __init__(self, terms: dict[str, float], exceptions: frozenset[str]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        if terms:
            self.automaton.make_automaton()
        self.empty = not terms
        self.exceptions = exceptions

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start of word, length, weight) of the longest term at each word."""
        if self.empty:
            return []
        best: dict[int, tuple[int, float]] = {}
        for end, (n, w) in self.automaton.iter(folded):
            start = end - n + 1
            if n > best.get(start, (0, 0.0))[0]:
                best[start] = (n, w)
        return [(s, n, w) for s, (n, w) in best.items()]

    def phrases(self, folded: str, start: int) -> list[str]:
        """The word at ``start`` with the word before and with the one behind."""
        end = folded.index(" ", start + 1)
        word = folded[start + 1:end]
        before = folded[folded.rfind(" ", 0, max(start, 0)) + 1:start] if start > 0 else ""
        after = folded[end + 1:folded.index(" ", end + 1)] if end + 1 < len(folded) else ""
        return [f"{before} {word}", f"{word} {after}"]

    def features(self, text: str | None) -> list[float]:
        folded = fold(text)
        n = max(0, folded.count(" ") - 1)
        total = kept = 0.0
        for start, _, w in self.hits(folded):
            if self.exceptions and any(p in self.exceptions for p in self.phrases(folded, start)):
                continue
            total += w
            kept += 1
        return [total / (n + 12.0) ** 0.5, np.log1p(total), kept / (n + 12.0)]


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``limit`` labelled rows (text, toxic) outside the held-out fifth,
    chosen by a hash of the id."""
    lab = (labels.where("toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("text", "toxic")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


_COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()),
                        T.StructField("clean", T.LongType())])


def _counted(rows: DataFrame, words_of) -> DataFrame:
    """Documents of either class that hold a term, summed per batch and then over all."""
    def make():
        def run(cols):
            sums = (Counter(), Counter())
            for text, y in zip(cols["text"], cols["toxic"]):
                sums[0 if y else 1].update(words_of(text))
            terms = list(sums[0] | sums[1])
            return {"term": terms, "toxic": [sums[0][t] for t in terms], "clean": [sums[1][t] for t in terms]}
        return run

    return map_batches(rows, make, _COUNTS).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, max_terms: int = MAX_TERMS) -> Model:
    """The model of the bounded sample, with at most ``max_terms`` terms and exception phrases each."""
    rows = stored(training_rows(docs, labels), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, frozenset(), (-50.0, 0.0, 0.0, 0.0), ((0.0, 1.0),) * 3)
    counts = _counted(rows, lambda t: {x for w in set(fold(t).split()) for x in _terms_of(w)})
    ratio = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    found = (counts.where(F.col("toxic") >= F.lit(min(MIN_TOXIC_DOCS, max(2, n_toxic // 20)))).withColumn("w", ratio)
             .where(F.col("w") >= MIN_LOG_ODDS)
             .orderBy((F.col("w") * F.sqrt("toxic")).desc(), "term").limit(max_terms).collect())
    # A longer beginning stays only if it says clearly more than a shorter one.
    terms: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["term"]), r["term"])):
        t = r["term"]
        shorter = max((terms.get(t[:k], 0.0) for k in range(2, len(t))), default=0.0)
        if r["w"] > shorter + 0.7 or shorter == 0.0:
            terms[t] = float(r["w"])
    matcher = Matcher(terms, frozenset())
    phrases = _counted(rows, lambda t: {p for f in (fold(t),) for s, _, _ in matcher.hits(f) for p in matcher.phrases(f, s)})
    exceptions = frozenset(r["term"] for r in phrases.where("toxic = 0 and clean >= 3")
                           .orderBy(F.col("clean").desc(), "term").limit(max_terms).collect())
    points = _points(rows, terms, exceptions)
    return Model(terms, exceptions, *_fit(points[:, :-1], points[:, -1]))


def _points(rows: DataFrame, terms, exceptions) -> np.ndarray:
    """Features and label of the bounded sample."""
    schema = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(3)] + [T.StructField("y", T.DoubleType())])

    def make():
        m = Matcher(terms, exceptions)

        def run(cols):
            f = [m.features(t) for t in cols["text"]]
            return {**{f"f{i}": [x[i] for x in f] for i in range(3)}, "y": [float(y) for y in cols["toxic"]]}
        return run

    return np.array([tuple(r) for r in map_batches(rows, make, schema).collect()])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[tuple[float, float], ...]]:
    """Ridge logistic regression by Newton steps."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - centre) / spread])
    b = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - 0.5 * np.r_[0, b[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(np.r_[1e-6, np.full(len(b) - 1, 0.5)])
        b = b + np.linalg.solve(h, g)
    return tuple(map(float, b)), tuple(zip(map(float, centre), map(float, spread)))


_SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _scorer(model: Model):
    m = Matcher(model.terms, model.exceptions)
    if not model.terms and model.curve[0] == -50.0:
        return lambda texts: [0.0] * len(texts)

    def run(texts):
        x = np.array([m.features(t) for t in texts]).reshape(len(texts), 3)
        centre, spread = np.array(model.scale).T
        z = model.curve[0] + ((x - centre) / spread) @ np.array(model.curve[1:])
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()
    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    def make():
        score = _scorer(model)
        return lambda cols: {"doc_id": cols["doc_id"], "score": score(cols["text"])}

    return map_batches(docs.select("doc_id", "text"), make, _SCORE)


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` that score below ``limit``."""
    schema = docs.schema

    def make():
        score = _scorer(model)

        def run(cols):
            keep = [s < limit for s in score(cols["text"])]
            return {k: [v for v, x in zip(vs, keep) if x] for k, vs in cols.items()}
        return run

    return map_batches(docs, make, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
