"""Scoring texts with a hidden Markov language model.

Words fall into classes by their last two bytes. A hidden Markov model over the class sequences is
trained with Baum-Welch: every partition computes expected counts of all its training texts with the
scaled forward-backward recursion, and their sums make the next model. A word's probability within
its class comes from counts over the whole training corpus, with one unseen word a class. The score of
a text is the exact log likelihood of its words and its end: the scaled forward recursion over the
classes plus the words' log probabilities within them.

Texts become blocks of about ``BLOCK_BYTES``. A block keeps its texts as numbers of the block's own words,
so that counts travel once for each distinct word of a block, not for each token.

Results for odd input: null and empty texts consist of their end alone; without training texts all
counts are 0 and the first model stays; rows that share an id are scored each on its own; null ids
never train; other columns are ignored, whatever their names; an empty table gives an empty table; texts of any
length are scored whole, in bounded memory beside the text's own numbers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, join_spread, text_of, written

STATES, CLASSES, ITERATIONS = 6, 254, 5
#: Bytes of a block, of which each text has ROW_BYTES besides its characters.
BLOCK_BYTES, ROW_BYTES = 16 << 20, 64
#: Steps x sequences that the recursions run over at once, and steps whose forward probabilities are kept.
BATCH_CELLS, SEGMENT = 300_000, 4096
#: Blocks whose words are summed in one window.
WINDOW_BLOCKS = 4096
#: No word holds white space, so this stands for the end; its class is the last one.
END = b"\n"
_UNIT = float(1 << 24)  # expected counts are summed as whole numbers of 1 / _UNIT, in any order alike


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def word_class(word: bytes) -> int:
    return CLASSES if word == END else zlib.crc32(word[-2:]) % CLASSES


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, states: int = STATES, classes: int = CLASSES + 1, seed: int = 7) -> Model:
        """States that stay, with emissions a little apart."""
        rng = np.random.default_rng(seed)
        emit = 1.0 + rng.random((states, classes))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def estimated(cls, counts: np.ndarray, states: int, classes: int) -> Model:
        """From expected counts, flat as start, moves, emissions; each has a small prior."""
        start = counts[:states] + 1.0
        move = counts[states : states + states * states].reshape(states, states) + 0.1
        emit = counts[states + states * states :].reshape(states, classes) + 0.01
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _batches(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of the sequences, long ones first, in batches of at most BATCH_CELLS steps x sequences (or one sequence)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, BATCH_CELLS // int(lengths[order[at]]))
        yield order[at : at + rows]
        at += rows


def _padded(sequences: list[np.ndarray], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes by step and sequence, and how many sequences each step still has."""
    lengths = np.array([len(sequences[i]) for i in part])
    steps = np.zeros((int(lengths[0]), len(part)), np.uint8)
    for k, i in enumerate(part):
        steps[: lengths[k], k] = sequences[i]
    return steps, np.searchsorted(-lengths, -np.arange(len(steps)), "left")


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each class sequence's probability; none is empty."""
    out = np.zeros(len(sequences))
    emit = np.ascontiguousarray(model.emit.T)
    for part in _batches(sequences):
        steps, live = _padded(sequences, part)
        total = np.zeros(len(part))
        alpha = model.start * emit[steps[0]]
        for t in range(len(steps)):
            n = live[t]
            if t:
                alpha = (alpha[:n] @ model.move) * emit[steps[t, :n]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[part] = total
    return out


def _forward(model: Model, emit: np.ndarray, steps: np.ndarray, live: np.ndarray, span: range, alpha: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scaled forward probabilities and scales of the steps in ``span``, from those of the step before."""
    for t in span:
        n = live[t]
        alpha = model.start * emit[steps[0]] if alpha is None else (alpha[:n] @ model.move) * emit[steps[t, :n]]
        scale = alpha.sum(axis=1, keepdims=True)
        alpha = alpha / scale
        yield alpha, scale


def expected_counts(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts of the class sequences, flat as start, moves, emissions.

    Of long sequences, only the forward probabilities before each SEGMENT of steps are kept; the backward pass makes
    those inside a segment again, so that memory doesn't grow with the length.
    """
    k, c = model.emit.shape
    start, move, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    emit = np.ascontiguousarray(model.emit.T)
    for part in _batches(sequences):
        steps, live = _padded(sequences, part)
        spans = [range(a, min(a + SEGMENT, len(steps))) for a in range(0, len(steps), SEGMENT)]
        before: list[np.ndarray | None] = [None]
        for span in spans[:-1]:
            for alpha, _ in _forward(model, emit, steps, live, span, before[-1]):
                pass
            before.append(alpha)
        beta = np.ones((0, k))
        for span, first in zip(reversed(spans), reversed(before)):
            alphas, scales = zip(*_forward(model, emit, steps, live, span, first))
            gammas = [None] * len(span)
            for t in reversed(span):
                n, i = live[t], t - span.start
                if len(beta) < n:  # sequences that end here
                    beta = np.concatenate([beta, np.ones((n - len(beta), k))])
                gammas[i] = alphas[i] * beta
                if t:
                    onward = beta * emit[steps[t, :n]] / scales[i]
                    move += (alphas[i - 1] if i else first)[:n].T @ onward
                    beta = onward @ model.move.T
            if not span.start:
                start += gammas[0].sum(axis=0)
            seen = np.concatenate([steps[t, : live[t]] for t in span])
            weights = np.concatenate(gammas)
            for s in range(k):
                emitted[:, s] += np.bincount(seen, weights[:, s], minlength=c)
    return np.concatenate([start, (move * model.move).ravel(), emitted.T.ravel()])


BLOCKS = "block long, doc_id long, held_out boolean, words binary, classes binary, place int, word binary, class int, trained long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: a row for each text (words as numbers, classes), then a row for each distinct word."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.binary()), ("classes", pa.binary()), ("place", pa.int32()), ("word", pa.binary()), ("class", pa.int32()), ("trained", pa.int64())])
    number = TaskContext.get().partitionId() << 32
    ids, held, found, size = [], [], [], 0
    places: dict[bytes, int] = defaultdict()
    places.default_factory = places.__len__

    def block() -> Iterator[pa.RecordBatch]:
        n = len(places)
        classes = np.fromiter(map(word_class, places), np.uint8, n)
        training = [w for w, h in zip(found, held) if not h]
        trained = np.bincount(np.concatenate(training), minlength=n) if training else np.zeros(n, np.int64)
        for a in range(0, len(found), 2000):
            part = found[a : a + 2000]
            rows = len(part)
            none = [pa.nulls(rows, schema.field(i).type) for i in range(5, 9)]
            packed = pa.array([zlib.compress(w.astype("<u4").tobytes(), 1) for w in part], pa.binary())
            kinds = pa.array([classes[w].tobytes() for w in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number] * rows, pa.int64()), pa.array(ids[a : a + 2000], pa.int64()), pa.array(held[a : a + 2000], pa.bool_()), packed, kinds, *none], schema=schema)
        words = list(places)
        for a in range(0, n, 50_000):
            b = min(n, a + 50_000)
            none = [pa.nulls(b - a, schema.field(i).type) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), *none, pa.array(np.arange(a, b, dtype=np.int32)), pa.array(words[a:b], pa.binary()), pa.array(classes[a:b].astype(np.int32)), pa.array(trained[a:b])], schema=schema)

    for batch in batches:
        for doc_id, h, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = value.as_py()
            own = tokens(text)
            found.append(np.fromiter(map(places.__getitem__, own), np.int32, len(own)))
            ids.append(doc_id)
            held.append(h)
            size += len(text) + ROW_BYTES
            if size >= BLOCK_BYTES:
                yield from block()
                ids, held, found, size = [], [], [], 0
                places.clear()
                number += 1
    if found:
        yield from block()


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint8) for v in column]


def train(classes: DataFrame, iterations: int = ITERATIONS, states: int = STATES) -> Model:
    """Baum-Welch over all rows of ``classes`` (one binary column of class sequences)."""
    spark = classes.sparkSession
    model = Model.first(states)
    size = states + states * states + states * (CLASSES + 1)
    for _ in range(iterations):
        held = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += expected_counts(held.value, _sequences(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.rint(total * _UNIT).astype(np.int64))], ["i", "v"])

        sums = classes.transform(in_arrow, count, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        held.unpersist()
        counts = np.zeros(size)
        for r in sums:  # one row for each parameter of the model
            counts[r.i] = float(r.v) / _UNIT
        if not counts.any():
            break
        model = Model.estimated(counts, states, CLASSES + 1)
    return model


def _counted(words: DataFrame, texts: DataFrame) -> DataFrame:
    """block, place, class, trained, c (training occurrences in all blocks), first (one row of each word).

    A word has at most one row for each block, its occurrences there counted. Up to WINDOW_BLOCKS blocks, the rows of
    a word are summed in one window. More blocks are parted into stretches of about that many; each stretch of a word
    is summed by itself, and the sums of the stretches are added and joined back.
    """
    stretches = -(-texts.select("block").distinct().count() // WINDOW_BLOCKS)
    by_word = Window.partitionBy("word")
    if stretches <= 1:
        return words.select("block", "place", "class", "trained", F.sum("trained").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("block")) == 1).alias("first"))
    stretch = F.pmod(F.xxhash64("block"), F.lit(stretches))
    sums = words.groupBy("word", stretch.alias("stretch")).agg(F.sum("trained").alias("c"), F.count(F.lit(1)).alias("rows"), F.min("block").alias("least"))
    sums = written(sums.groupBy("word").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows"), F.min("least").alias("least")), "sums")
    joined = join_spread(words, sums, ["word"], "rows", "block")
    return joined.select("block", "place", "class", "trained", "c", (F.col("block") == F.col("least")).alias("first"))


def score(docs: DataFrame, held_out: Column, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    Texts that are not held out train the counts and the model.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_of().alias("text"))
    blocks = written(rows.transform(in_arrow, _index, BLOCKS), "blocks")
    texts = blocks.where("words IS NOT NULL").select("block", "doc_id", "held_out", "words", "classes")
    counted = written(_counted(blocks.where("word IS NOT NULL").select("block", "place", "class", "word", "trained"), texts), "counts")
    n_class, v_class = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in counted.groupBy("class").agg(F.sum("trained").alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).collect():
        n_class[r["class"]], v_class[r["class"]] = r.n, r.v
    n, v = int(n_class.sum()), int(v_class.sum())
    model = train(texts.where("NOT held_out").select("classes"), iterations)
    held = spark.sparkContext.broadcast((model, np.log10(n_class + v_class + 1)))

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        own, within = held.value
        place = right.column("place").to_numpy()
        c, kind = np.zeros(len(place), np.int64), np.zeros(len(place), np.uint8)
        c[place], kind[place] = right.column("c").to_numpy(), right.column("class").to_numpy()
        logs = np.log10(c + 1.0)
        base = logs - np.log10(float(n + v + 1))
        inside = logs - within[kind]
        words = [np.frombuffer(zlib.decompress(w.as_py()), "<u4") for w in left.column("words")]
        chain = log_likelihoods(own, [kind[w] for w in words])
        known = c > 0
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array([len(w) for w in words], pa.int64()),
                "n_known": pa.array([int(known[w].sum()) for w in words], pa.int64()),
                "train_tokens": pa.array([n] * len(words), pa.int64()),
                "base_score": pa.array([float(base[w].sum()) for w in words], pa.float64()),
                "score": pa.array([float(inside[w].sum()) for w in words] + chain, pa.float64()),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.drop("classes").groupBy("block").cogroup(counted.select("block", "place", "class", "c").groupBy("block")).applyInArrow(score_block, schema)
