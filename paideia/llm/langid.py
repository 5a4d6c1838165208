"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent letter n-grams (one to three characters, words framed by a
space) in rank order. A document's language is the one whose profile has the least out-of-place
distance from the document's own profile; an n-gram that a language lacks counts as ``size`` places.

N-grams are counted in pieces of ``PIECE`` characters, so that memory is bounded by a text's distinct n-grams,
not by its length; the counts are those of the whole text.

Results for odd input: null, empty and letterless texts are ``und`` with score 0; rows without a
language teach nothing but are predicted; ties in frequency go to the smaller code points, ties in
distance to the smaller language name; without any training row all texts are ``und``; rows that share an id
are predicted each on its own; other columns are ignored by ``predict`` and kept by ``keep_identified``,
whatever their names; an empty table gives an empty table. Texts are profiled whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow

#: N-grams in a profile, and training documents that are read for each language (a sample by hash).
PROFILE_SIZE, TRAINING_DOCS = 400, 2_000
#: Characters that are counted at once.
PIECE = 1 << 18
#: A text is in none of the languages if its distance from every profile is this share of the largest possible one
#: (texts of the learned languages stay below 0.61 in the test tables) and it has so many different n-grams to tell by.
FOREIGN, EVIDENCE = 0.9, 30
UNKNOWN = "und"
_BITS = 21  # of a code point


@cache
def _letters() -> np.ndarray:
    """For each code point, 2 if it is a letter, 1 if it is a mark inside a word, else 0."""
    import sys
    import unicodedata

    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


Counts = tuple[np.ndarray, np.ndarray]
_NONE: Counts = (np.empty(0, np.int64), np.empty(0, np.int64))


def _summed(grams: np.ndarray, counts: np.ndarray | None) -> Counts:
    """Distinct n-grams, sorted, with the sums of their counts (ones where None)."""
    if not len(grams):
        return _NONE
    if counts is None:
        grams = np.sort(grams)
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[first], np.diff(np.append(first, len(grams)))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def added(a: Counts, b: Counts) -> Counts:
    return b if not len(a[0]) else a if not len(b[0]) else _summed(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def gram_counts(text: str) -> Counts:
    """Distinct n-grams of a text, packed into integers, and their counts; none for a text without a letter."""
    text = text.lower()
    total, lettered = _NONE, False
    tail = np.full(1, 32, np.int64)  # the last two places of what was counted, one space between words
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kind = _letters()[codes]
        lettered = lettered or bool((kind == 2).any())
        framed = np.concatenate([tail, np.where(kind > 0, codes, 32), [32] if start + PIECE >= len(text) else []]).astype(np.int64)
        keep = np.ones(len(framed), bool)
        keep[1:] = (framed[1:] != 32) | (framed[:-1] != 32)
        c, old = framed[keep], len(tail)
        # Only n-grams that end in this piece are new; none reaches into the next word.
        pairs = c[old - 1 : -1] << _BITS | c[old:]
        middle, last = c[max(1, old - 1) : -1], c[max(2, old) :]
        triples = ((c[max(0, old - 2) : -2] << _BITS | middle) << _BITS | last)[middle != 32] if len(c) > 2 else _NONE[0]
        new = c[old:]
        total = added(total, _summed(np.concatenate([new[new != 32], pairs, triples]), None))
        tail = c[-2:]
    return total if lettered else _NONE


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in rank order, ties by code point."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        enough = counts >= least
        grams, counts = grams[enough], counts[enough]
    return grams[np.argsort(-counts, kind="stable")][:size]


@dataclass(frozen=True)
class Profiles:
    """Learned profiles: languages in name order, each with sorted n-grams and their ranks."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    ranks: tuple[np.ndarray, ...]
    size: int

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        own = np.arange(len(ranked))
        out = np.empty(len(self.languages))
        for k, (grams, ranks) in enumerate(zip(self.grams, self.ranks)):
            at = np.minimum(np.searchsorted(grams, ranked), len(grams) - 1)
            known = grams[at] == ranked
            out[k] = np.where(known, np.abs(ranks[at] - own), self.size).sum()
        return out

    def foreign(self, text: str) -> bool:
        """Whether a text has no letter, or is as far from all profiles as texts of other languages are; without profiles, only the former."""
        ranked = top_grams(*gram_counts(text), self.size)
        if not self.languages or len(ranked) < EVIDENCE:
            return not len(ranked)
        return float(self.distances(ranked).min()) >= FOREIGN * self.size * len(ranked)

    def predict(self, text: str) -> tuple[str, float]:
        """The language, and how far it is ahead of the next one, from 0 to 1."""
        if not self.languages:
            return UNKNOWN, 0.0
        ranked = top_grams(*gram_counts(text), self.size)
        if not len(ranked):
            return UNKNOWN, 0.0
        d = self.distances(ranked)
        best = int(np.argmin(d))
        if len(d) == 1:
            return self.languages[0], 1.0 - float(d[0]) / (self.size * len(ranked))
        second = float(np.partition(d, 1)[1])
        return self.languages[best], min(1.0, 1.0 - float(d[best]) / second) if second else 0.0


def learn_profiles(labelled: DataFrame, size: int = PROFILE_SIZE, training_docs: int = TRAINING_DOCS) -> Profiles:
    """Profiles of the languages in ``lang``.

    They are fitted on at most ``training_docs`` documents of each language, those whose ids hash
    lowest; n-grams are counted where the documents are, and only profiles come to the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # One row a language (as the profiles are) says which hashes are surely above the sample; their texts never move.
    counts = rows.groupBy("lang").count().select("lang", (2.0 * training_docs / F.col("count") * (1 << 30)).alias("_bound"))
    near = rows.select("lang", "text", drawn.alias("_h")).join(F.broadcast(counts), "lang").where(F.col("_h") < F.col("_bound"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    sample = near.withColumn("_at", at).where(F.col("_at") <= training_docs).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counts] = {}
        waiting: dict[str, list[str]] = {}
        size_of: dict[str, int] = {}

        def put(lang: str) -> None:
            total[lang] = added(total.get(lang, _NONE), gram_counts("\n".join(waiting.pop(lang))))
            size_of[lang] = 0

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                waiting.setdefault(lang, []).append(text)
                size_of[lang] = size_of.get(lang, 0) + len(text) + 1
                if size_of[lang] >= PIECE:
                    put(lang)
        for lang in list(waiting):
            put(lang)
        for lang in sorted(total):
            grams, n = total[lang]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    totals = sample.transform(in_arrow, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    found: dict[str, list[tuple[int, int]]] = {}
    for r in totals.withColumn("rank", rank - 1).where(F.col("rank") < size).select("lang", "gram", "rank").collect():
        found.setdefault(r.lang, []).append((r.gram, r["rank"]))
    languages = tuple(sorted(found))
    tables = [np.array(sorted(found[k]), np.int64) for k in languages]
    return Profiles(languages, tuple(t[:, 0] for t in tables), tuple(t[:, 1] for t in tables), size)


def predict(docs: DataFrame, profiles: Profiles, *carry: Column) -> DataFrame:
    """doc_id, lang_pred, score and the ``carry`` columns for every whole text; no shuffle."""
    rows = docs.select(F.col("doc_id"), *carry, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = rows.drop("text").schema
    names = [*own.names, "lang_pred", "score"]
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE_SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            lang, score = zip(*found) if found else ((), ())
            arrays = [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.transform(in_arrow, run, own.add("lang_pred", "string").add("score", "double"))


def keep_identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows and columns of ``docs`` whose text is in one of the languages (with a letter, where there are no profiles); no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [t.is_valid and not held.value.foreign(t.as_py()) for t in batch.column(text_at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)
