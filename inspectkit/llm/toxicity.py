"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs of other alphabets to Latin
letters, digits and signs that stand for letters to those letters.  An Aho-Corasick automaton over the lexicon finds all entries in one
pass; a match counts if it is a whole word and no exception phrase covers it.
The matched weights are normalised by the text's length and mapped to 0..1 by
a logistic curve.

Learning.  From at most ``sample_rows`` labelled rows (chosen by a hash of the
id; a documented bound), never from labels held out: a word's weight is its
smoothed log-odds of being in toxic against other texts, kept if it is
``min_weight`` or more and ``min_z`` standard errors above zero, at most the
``max_terms`` with the highest weight less one standard error; word
beginnings (written with a final *) are learned alike for words too rare to be
seen, and a word counts with the best entry that matches it.
Exception phrases are pairs of a matched word and a neighbour, seen in
``min_phrase`` other texts and in no toxic one.  The curve is a ridge logistic
regression on the same rows.  Word counts run on Spark; what reaches the driver
is the lexicon, its phrases and two numbers for each sampled row, all bounded.

Scoring is a map over the whole texts, no shuffle.

Defined cases.  Null and empty texts have length 0 and get the score of a text
without matches.  Null ids are scored too, and held_out is null for them.
Labels with nulls are ignored; an id labelled twice alike counts once.  Without
usable labels the lexicon is empty and every score is the prior.  An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import corpus as C

SAMPLE_ROWS = 20_000
MAX_TERMS = 5_000
MIN_WEIGHT = 2.0  # log-odds: frequent words of slight tendency say little, however sure
MIN_Z = 2.6
STEM = range(4, 11)
MIN_STEM_Z = 4.0
MIN_PHRASE = 3
THRESHOLD = 0.7
UNIT = 6  # characters: about a word and a space

# Letters that look like a Latin letter, and what stands for a
# letter inside a word.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

DIGITS = {d: c for d, c in SUBSTITUTES.items() if d.isdigit()}

_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)})
_LOOKALIKE = re.compile("[\u0131\u0250-\uffff]")
_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[@$](?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower case, lookalikes and digits as letters (in numbers too), and signs
    before a letter as letters."""
    s = text.lower()
    if not s.isascii() and _LOOKALIKE.search(s):
        s = s.translate(_FOLD)
    for digit, letter in DIGITS.items():
        if digit in s:
            s = s.replace(digit, letter)
    if "$" in s or "@" in s:
        s = _SIGN.sub(lambda m: SUBSTITUTES[m[0]], s)
    return s


def _word_end(s: str, a: int) -> int:
    found = _WORD.match(s, a)
    return found.end() if found else a


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    intercept: float
    slopes: tuple[float, float]


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            stem = term.rstrip("*")
            old = self.automaton.get(stem, (0, 0.0, 0.0))
            whole, start = (old[1], weight) if term.endswith("*") else (weight, old[2])
            self.automaton.add_word(stem, (len(stem), whole, start))
        if lexicon.weights:
            self.automaton.make_automaton()

    def matches(self, text: str) -> tuple[int, int, float]:
        """(length in units of UNIT characters, matches, their weight)."""
        s = fold(text)
        n = -(-len(s) // UNIT)
        if not self.lexicon.weights or not n:
            return n, 0, 0.0
        best, end, exceptions = {}, len(s), self.lexicon.exceptions
        for last, (size, whole, start) in self.automaton.iter(s):
            a, b = last + 1 - size, last + 1
            if a and s[a - 1].isalnum():
                continue
            weight = max(whole, start) if b == end or not s[b].isalnum() else start
            if weight > best.get(a, 0.0) and not (exceptions and self._excepted(s, a)):
                best[a] = weight
        return n, len(best), sum(best.values())

    def _excepted(self, s: str, a: int) -> bool:
        """Do the word at a and the one before or after it make an exception?"""
        i = a
        while i and not s[i - 1].isalnum():
            i -= 1
        j = i
        while j and s[j - 1].isalnum():
            j -= 1
        here, k = _WORD.match(s, a), _WORD.search(s, _word_end(s, a))
        near = [s[j:i], here[0] if here else "", k[0] if k else ""]
        return any(x and y and f"{x} {y}" in self.lexicon.exceptions for x, y in zip(near, near[1:]))

    def score(self, n: int, total: float) -> float:
        x = self.lexicon.intercept + sum(w * v for w, v in zip(self.lexicon.slopes, features(n, total)))
        return 1.0 / (1.0 + math.exp(-min(max(x, -30.0), 30.0)))


def features(n: int, total: float) -> tuple[float, float]:
    """Matched weight a unit of length, and against the root of the length (long texts
    gather chance matches, which grow slower than that)."""
    return math.log1p(100.0 * total / max(n, 1)), math.log1p(total / math.sqrt(max(n, 1)))


def _counts(emit):
    """Rows (term, n, toxic) summed over an Arrow batch."""

    def run(batches):
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = emit(_WORD.findall(fold(text)))
                seen.update(here)
                if label:
                    toxic.update(here)
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": [*map(int, seen.values())], "toxic": [toxic[t] for t in seen]}, schema=pa.schema([("term", pa.string()), ("n", pa.int64()), ("toxic", pa.int64())]))

    return run


def terms(found: list[str]) -> set[str]:
    """Words and word beginnings."""
    whole = set(found)
    return whole | {f"{w[:k]}*" for w in whole for k in STEM if k < len(w)}


_COUNTS = "term string, n long, toxic long"


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, min_weight: float = MIN_WEIGHT, min_z: float = MIN_Z, min_phrase: int = MIN_PHRASE) -> Lexicon:
    """Learn from the rows of ``labels`` (doc_id, toxic) given."""
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null").select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"] > 0).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = C.labelled(docs, chosen, sample_rows)
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("long"))).first()
    toxic = toxic or 0
    if not toxic or toxic == n:
        prior = (toxic + 0.5) / (n + 1)
        return Lexicon({}, frozenset(), math.log(prior / (1 - prior)), (0.0, 0.0))
    rows = rows.repartition(C.partitions(spark, 0))
    words = rows.mapInArrow(_counts(terms), _COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    inside, outside = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    weight = F.log(inside / (toxic + 1.0)) - F.log(outside / (n - toxic + 1.0))
    words = words.select("term", weight.alias("w"), F.sqrt(1 / inside + 1 / outside).alias("e")).where(F.col("w") >= min_weight)
    words = words.where(F.col("w") / F.col("e") >= F.when(F.col("term").endswith("*"), max(MIN_STEM_Z, min_z)).otherwise(min_z))
    weights = {r.term: r.w for r in words.orderBy(F.desc(F.col("w") - F.col("e")), "term").limit(max_terms).collect()}

    def matched(word: str) -> bool:
        return word in weights or any(k < len(word) and f"{word[:k]}*" in weights for k in STEM)

    def pairs(found: list[str]) -> set[str]:
        hit = [matched(w) for w in found]
        return {f"{a} {b}" for a, b, x, y in zip(found, found[1:], hit, hit[1:]) if x or y}

    phrases = rows.mapInArrow(_counts(pairs), _COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    phrases = phrases.where((F.col("t") == 0) & (F.col("n") >= min_phrase)).orderBy(F.desc("n"), "term").limit(max_terms)
    lexicon = Lexicon(weights, frozenset(r.term for r in phrases.collect()), 0.0, (0.0, 0.0))

    def measured(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.matches(t) for t in batch.column(0).to_pylist()]
            x = np.array([features(n, total) for n, _, total in found]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1).cast(pa.int8()).cast(pa.float64())], names=["a", "b", "y"])

    table = rows.mapInArrow(measured, "a double, b double, y double").toPandas().to_numpy()
    intercept, slopes = logistic(table[:, :2], table[:, 2])
    return Lexicon(weights, lexicon.exceptions, intercept, slopes)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, tuple[float, ...]]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), tuple(map(float, beta[1:]))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row: doc_id, n_units, n_matches, weight, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            found = [matcher.matches(t.as_py()) for t in batch.column(1)]
            n = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([matcher.score(f[0], f[2]) for f in found], pa.float64())],
                names=["doc_id", "n_units", "n_matches", "weight", "score"])

    return C.texts(docs).mapInArrow(run, "doc_id long, n_units long, n_matches long, weight double, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels")
    lexicon = fit(docs, labels.where(~held_out()))
    found = score(docs, lexicon)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_units", "n_matches")
