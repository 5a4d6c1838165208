"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digit or sign
substitutions become the Latin letters that they stand for, and all else becomes word breaks. The
lexicon holds word beginnings and whole words whose document frequency differs between the labels;
its weights are log odds. Exception phrases, learned too, are word pairs that hold a lexicon entry but
occur in clean documents: matches inside them don't count. Matches are summed, raw and normalised by
length, and a logistic curve turns the sums into a score.

Results for odd input: null and empty texts get the score of a text without matches; a label that is
null teaches nothing; without both labels the lexicon is empty and each score is the share of label 1;
rows that share an id are scored each on its own; of entries that match at one place, the largest weight counts;
other columns are ignored, whatever their names; an empty table gives an empty table. Texts are
matched whole, however long, in time and memory in proportion to their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, written

# Letters of other scripts that look like Latin ones, and signs that replace letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ı": "i", "ɑ": "a",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
_FOLD = {ord(k): v for k, v in LOOK_ALIKES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_BREAK = re.compile(r"[\W_]+")

#: Labelled documents of each label that the lexicon and the curve are fitted on (a sample by hash).
TRAINING_DOCS = 6_000
#: Characters of a word beginning, documents that must hold an entry, and its least log odds.
PREFIX, LEAST_DOCS, LEAST_ODDS = (3, 10), 5, 2.5


def fold(text: str) -> str:
    """Folded words with a space before, between and after them."""
    return f" {_BREAK.sub(' ', text.lower().translate(_FOLD)).strip()} "


def features(text: str) -> set[str]:
    """Word beginnings (" ab") and whole words (" abc ") of a text."""
    least, most = PREFIX
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= least:
            out.update(" " + w[:n] for n in range(least, min(most, len(w)) + 1))
            out.add(f" {w} ")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weights by entry, exception phrases, and the curve's intercept and slopes."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            a.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a if len(a) else None


def measures(automaton, folded: str) -> tuple[int, float, float]:
    """Matches, their weight, and their weight per hundred words."""
    if automaton is None:
        return 0, 0.0, 0.0
    hits, excused = {}, []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    if excused:
        hits = _outside(hits, sorted(excused))
    total = sum(hits.values())
    return len(hits), total, 100.0 * total / max(1, folded.count(" ") - 1)


def _outside(hits: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that start in none of the sorted spans: one sweep over both."""
    out, at, reach = {}, 0, -1
    for start in sorted(hits):
        while at < len(spans) and spans[at][0] <= start:
            reach = max(reach, spans[at][1])
            at += 1
        if start >= reach:
            out[start] = hits[start]
    return out


def inputs(measured: tuple[int, float, float]) -> tuple[float, float, float]:
    return math.log1p(measured[0]), math.log1p(measured[1]), math.log1p(measured[2])


def _sample(docs: DataFrame, labels: DataFrame, training_docs: int) -> DataFrame:
    """text, toxic of the documents with the ``training_docs`` ids of each label that hash lowest."""
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") > 0).alias("toxic"), drawn.alias("_h")).distinct()
    counts = rows.groupBy("toxic").count()  # two rows
    near = rows.join(F.broadcast(counts), "toxic").where(F.col("_h") < (1 << 30) * 2.0 * training_docs / F.col("count"))
    at = F.row_number().over(Window.partitionBy("toxic").orderBy("_h", "doc_id"))
    chosen = near.withColumn("_at", at).where(F.col("_at") <= training_docs).select("doc_id", "toxic")
    # At most 2 * training_docs ids are broadcast; no other text leaves its place.
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> Lexicon:
    """Fits lexicon, exceptions and curve on the texts of ``docs`` that ``labels`` (doc_id, toxic 0 or 1) has."""
    spark = docs.sparkSession
    sample = written(_sample(docs, labels, training_docs).repartition(16), "toxic_sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1.0)
        return Lexicon({}, frozenset(), (math.log(share / (1 - share)), 0.0, 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(features(text))
        keys = list(toxic)  # entries without a toxic document can't enter the lexicon ...
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], ["entry", "toxic", "clean"])
        keys = list(clean)  # ... but another task may have met one
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([0] * len(keys), pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])

    counted = sample.transform(in_arrow, count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    rows = counted.where(F.col("t") >= LEAST_DOCS).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS).collect()
    weights = prune({r.entry: (r.t, r.w) for r in rows})
    exceptions = _exceptions(sample, weights) if weights else frozenset()

    held = spark.sparkContext.broadcast(Lexicon(weights, exceptions, ()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.automaton()
        for batch in batches:
            x = [inputs(measures(own, fold(t))) for t in batch.column(0).to_pylist()]
            a, b, c = zip(*x) if x else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.float64()) for v in (a, b, c)), batch.column(1)], ["a", "b", "c", "toxic"])

    fitted = sample.transform(in_arrow, measure, "a double, b double, c double, toxic boolean").orderBy("a", "b", "c", "toxic").toPandas()
    curve = fit_curve(fitted[["a", "b", "c"]].to_numpy(), fitted["toxic"].to_numpy(float))
    return Lexicon(weights, exceptions, curve)


def prune(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of nested entries, the longest that still covers nearly all documents of its beginnings."""
    entries = dict(found)
    for entry in sorted(found, key=len, reverse=True):
        for n in range(PREFIX[0] + 1, len(entry)):
            short = entry[:n]
            if entry in entries and short in entries and found[entry][0] >= 0.9 * found[short][0]:
                del entries[short]
    out = {}
    for entry in sorted(entries, key=lambda e: (len(e), e)):
        if not any(entry[:n] in out for n in range(PREFIX[0] + 1, len(entry))):
            out[entry] = entries[entry][1]
    return out


def _exceptions(sample: DataFrame, weights: dict[str, float]) -> frozenset[str]:
    """Word pairs around an entry that are found in clean documents at least, and mostly."""
    held = sample.sparkSession.sparkContext.broadcast(Lexicon(weights, frozenset(), ()))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.automaton()
        for batch in batches:
            phrases, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, seen = fold(text), set()
                for end, (length, _) in own.iter(folded):
                    start = end - length + 1
                    stop = folded.index(" ", start + 1)
                    if start:
                        seen.add(folded[folded.rindex(" ", 0, start) : stop + 1])
                    if stop < len(folded) - 1:
                        seen.add(folded[start : folded.index(" ", stop + 1) + 1])
                phrases += seen
                labels += [label] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labels, pa.bool_())], ["phrase", "toxic"])

    counted = sample.transform(in_arrow, pairs, "phrase string, toxic boolean").groupBy("phrase").agg(F.count_if(~F.col("toxic")).alias("c"), F.count_if("toxic").alias("t"))
    return frozenset(r.phrase for r in counted.where((F.col("c") >= 3) & (F.col("c") >= 9 * F.col("t"))).select("phrase").collect())


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, *carry: Column) -> DataFrame:
    """doc_id, the ``carry`` columns, matches, score for every whole text; no shuffle."""
    rows = docs.select("doc_id", *carry, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = rows.drop("text").schema
    names = [*own.names, "matches", "score"]
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # entries that the training sample bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = held.value.automaton(), held.value.curve
        for batch in batches:
            matches, scores = [], []
            for value in batch.column(batch.num_columns - 1):
                m = measures(automaton, fold(value.as_py()))
                z = curve[0] + sum(a * b for a, b in zip(curve[1:], inputs(m)))
                matches.append(m[0])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(matches, pa.int32()), pa.array(scores, pa.float64())], names)

    return rows.transform(in_arrow, run, own.add("matches", "integer").add("score", "double"))
