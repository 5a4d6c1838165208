"""Removal of repeated byte strings with a two-stage suffix sort.

A string of ``LENGTH`` bytes that starts at two places or more is repeated; every byte that a repeated
string covers is removed. Equal strings choose the same anchor (the least hash of their ``GRAM``-byte
substrings, the leftmost of equal ones), so that strings need comparing only where anchors are equal.
The stretch of text whose strings share one anchor is a context. Anchors only deal the work: the contexts of one
anchor go to one task, one that occurs several times as two copies, and the task sorts their suffixes in two stages:
suffixes smaller than their successors are sorted directly, the others are induced from them by scanning
the buckets of first bytes in order. Neighbours with a common prefix of LENGTH bytes are repeated; nothing else is.

An anchor with more than ``MOST`` different contexts is not one task's work: its strings are divided by the
anchor's place in them, halving the range each time, and contexts are regrouped by the bytes that all strings
of such a range share. A range of one place groups equal strings, so the division always ends.

Results for odd input: null counts as empty; texts shorter than LENGTH stay whole; texts that are equal
(or rows that are repeated, or that share an id) are repeated throughout and go wholly; overlaps within one text
count; other columns are ignored, whatever their names; an empty table gives an empty table; texts of any length are
searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_spread, maybe_flagged, text_of, written

LENGTH, GRAM = 200, 32
#: Different contexts of one anchor that one task compares, and bytes of contexts that it sorts at once.
MOST, SORT_BYTES = 4000, 1 << 18
#: Anchors of long texts are found in stretches of this many positions.
_STRETCH = 1 << 23
_FILTER_BITS = 18  # log2 of the words of a Bloom filter
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """hash, place, and first and last start of the strings that chose it, for all anchors of a text."""
    found = [_stretch(raw, s, length, gram) for s in range(0, max(1, len(raw) - length + 1), _STRETCH) if len(raw) >= length]
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretch(raw: bytes, start: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    h = np.frombuffer(raw, np.uint8)[start : start + _STRETCH + length - 1].astype(np.uint64) + np.uint64(1)
    step, power = 1, np.array([_ODD])
    while step < gram:  # ``gram`` is a power of two
        h = h[:-step] * power + h[step:]
        power = power * power
        step *= 2
    h = _mixed(h)
    places = np.uint64((1 << 24) - 1)  # a stretch and its last string are shorter
    least = (h & ~places) | np.arange(len(h), dtype=np.uint64)
    window, step = length - gram + 1, 1
    n = len(h) - window + 1
    while step * 2 <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    at = (np.minimum(least[:n], least[window - step : window - step + n]) & places).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], at[first] + start, first + start, np.append(first[1:], n) - 1 + start


def _bloom(keys: DataFrame, column: str) -> np.ndarray:
    """2 ** _FILTER_BITS words with two bits for each key, of a fixed size for any number of keys."""
    c = F.col(column)
    bits = F.expr(f"shiftleft(1L, cast(shiftright({column}, {_FILTER_BITS}) & 63 as int)) | shiftleft(1L, cast(shiftright({column}, {_FILTER_BITS + 6}) & 63 as int))")
    rows = keys.select(c.bitwiseAND((1 << _FILTER_BITS) - 1).alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = rows.toArrow()
    words = np.zeros(1 << _FILTER_BITS, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


def _maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may be in the filter."""
    one, n = np.uint64(1), np.uint64(_FILTER_BITS)
    bits = (one << ((keys >> n) & np.uint64(63))) | (one << ((keys >> (n + np.uint64(6))) & np.uint64(63)))
    return words[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] & bits == bits


def suffix_order(text: bytes, wanted: np.ndarray, length: int) -> np.ndarray:
    """Those positions that ``wanted`` marks (and some that they rest on), in the order of their suffixes' first ``length`` bytes."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, n)
    run_end = np.repeat(ends, np.diff(ends, prepend=0))  # first place with another byte
    beyond = np.append(t, 0).astype(np.int16)[run_end]
    beyond[run_end == n] = -1
    smaller = beyond > t  # the suffix is smaller than its successor
    # An induced suffix rests on the first suffix after its run, and so on until one that is sorted directly.
    need = wanted.copy()
    fresh = np.flatnonzero(need & ~smaller)
    while len(fresh):
        fresh = run_end[fresh]
        fresh = fresh[fresh < n]
        fresh = fresh[~need[fresh]]
        need[fresh] = True
        fresh = fresh[~smaller[fresh]]
    direct = np.flatnonzero(need & smaller).tolist()
    direct.sort(key=lambda i: text[i : i + length])
    direct = np.array(direct, np.int64)
    induced = np.flatnonzero(need & ~smaller)
    rank = np.full(n + 1, -1, np.int64)  # the empty suffix comes first
    out, base = [], 0
    direct = direct[np.argsort(t[direct], kind="stable")]
    induced = induced[np.argsort(t[induced], kind="stable")]
    edges = np.arange(257)
    d_at, i_at = np.searchsorted(t[direct], edges), np.searchsorted(t[induced], edges)
    for c in range(256):
        # Larger than their successors: in the order of what follows their run, shorter runs first.
        own = induced[i_at[c] : i_at[c + 1]]
        if len(own):
            own = own[np.lexsort((rank[run_end[own]], run_end[own] - own))]
        for part in (own, direct[d_at[c] : d_at[c + 1]]):
            rank[part] = np.arange(base, base + len(part))
            base += len(part)
            out.append(part)
    return np.concatenate(out)


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its strings of ``length`` bytes start at another place of the contexts, too."""
    repeated, starts, ends = _repeated(contexts, length)
    return [repeated[s : e - length + 1] for s, e in zip(starts, ends)]


def _repeated(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places of the contexts, one behind the other, start a repeated string; and where each context starts and ends."""
    text = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # The last length - 1 places of a context start no string of it.
    wanted = np.repeat(ends - length, sizes) >= np.arange(len(text))
    order = suffix_order(text, wanted, length)
    order = order[wanted[order]]
    # Common prefixes of neighbours, eight bytes at a time, up to ``length``.
    padded = np.frombuffer(text + b"\0" * 8, np.uint8)
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(text)]
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for step in [*range(0, length - 8, 8), length - 8]:
        alive = alive[word[a[alive] + step] == word[b[alive] + step]]
    repeated = np.zeros(len(text), bool)
    repeated[a[alive]] = True
    repeated[b[alive]] = True
    return repeated, starts, ends


def _scan(rows: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(key, raw)`` on every text of LENGTH bytes or more; it returns columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        size = 0
        state = {}
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                got = emit(key.as_py(), value.as_buffer().to_pybytes(), state)
                if got is not None:
                    held.append(got)
                    size += sum(c.nbytes for c in got)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names)

    return rows.transform(in_arrow, run, schema)


def _sort_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        keys, off = table.column("key").to_numpy(), table.column("off").to_numpy()
        contexts = table.column("ctx").to_pylist()
        # What occurs more than twice is as repeated as what occurs twice.
        copies = np.minimum(table.column("n").to_numpy(), 2)
        edges = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
        upto = np.cumsum(copies * np.array([len(c) for c in contexts]))[edges - 1]
        owner, first, last, start = [], [], [], 0
        for at in np.append(np.flatnonzero(np.diff(upto // SORT_BYTES)), len(edges) - 1):  # whole keys, about SORT_BYTES together
            end = edges[at]
            places = np.repeat(np.arange(start, end), copies[start:end])
            mask, begin, stop = _repeated([contexts[i] for i in places], length)
            # Runs of starts end with their context; only a context's first copy says what is repeated in it.
            new = mask.copy()
            new[1:] &= ~mask[:-1]
            new[begin] = mask[begin]
            close = mask.copy()
            close[:-1] &= ~mask[1:]
            a, b = np.flatnonzero(new), np.flatnonzero(close)
            of = np.searchsorted(stop, a, "right")
            fresh = np.concatenate([[True], places[1:] != places[:-1]])[of]
            owner.append(places[of][fresh])
            first.append((a - begin[of])[fresh])
            last.append((b - begin[of])[fresh])
            start = end
        k = np.concatenate(owner)
        place = off[k]
        return pa.table({"sid": table.column("sid").take(pa.array(k)), "l_lo": pa.array((place - np.concatenate(last)).astype(np.int32)), "l_hi": pa.array((place - np.concatenate(first)).astype(np.int32))})

    return run


def _resolve(contexts: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """sid, l_lo, l_hi: ranges of repeated strings by the anchor's place in them, as the sorted suffixes say.

    ``contexts`` has sid, key, off (the anchor's place), ctx and n (how often it occurs); it is a written table.
    """
    sizes = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most")).where("m > 1 OR most > 1").drop("most")
    sizes = written(sizes, "sizes")
    total = contexts.agg(F.coalesce(F.sum(F.octet_length("ctx")), F.lit(0))).first()[0]
    shards = max(8, int(total >> 21))
    sorted_ = contexts.join(sizes.where(F.col("m") <= MOST), "key").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = sorted_.select("shard", "key", "sid", "off", "ctx", "n").groupBy("shard").applyInArrow(_sort_shard(length), "sid binary, l_lo int, l_hi int")
    found = written(found, "repeats")
    above = sizes.where(F.col("m") > MOST).select("key")
    if width <= 1 or above.isEmpty():
        return found
    large = contexts.join(above, "key", "left_semi")
    half = (width + 1) // 2
    # l counts from a string's start to its anchor; the string covers ctx from off - l on.
    parts = large.withColumn("hi", F.col("off")).withColumn("lo", F.expr(f"off - (octet_length(ctx) - {length})")).withColumn("cell", F.explode(F.expr(f"sequence(lo div {half}, hi div {half})")))
    parts = parts.withColumn("a", F.expr(f"cast(greatest(lo, cell * {half}) as int)")).withColumn("b", F.expr(f"cast(least(hi, cell * {half} + {half - 1}) as int)"))
    parts = parts.withColumn("shared", F.expr(f"substring(ctx, cast(off - cell * {half} + 1 as int), cast({length - half + 1} as int))"))
    parts = parts.withColumn("sub", F.expr(f"substring(ctx, off - b + 1, b - a + {length})"))
    parts = parts.select(F.col("sid").alias("whole"), F.xxhash64("key", "cell", "shared").alias("key"), F.col("b").alias("off"), F.col("sub").alias("ctx"), "n")
    parts = written(parts.withColumn("sid", F.unhex(F.md5(F.concat("ctx", F.encode(F.concat(F.lit(":"), F.col("off").cast("string"), F.lit(":"), F.col("key").cast("string")), "utf-8"))))), "parts")
    below = written(parts.groupBy("sid", "key").agg(F.first("off").alias("off"), F.first("ctx").alias("ctx"), F.sum("n").alias("n")), "contexts")
    deeper = _resolve(below, length, gram, half)
    inner = parts.select("whole", "sid").join(deeper, "sid").select(F.col("whole").alias("sid"), "l_lo", "l_hi")
    return written(found.unionByName(inner), "repeats")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """tkey (a digest of the text), spans (array of start, end): what repeated strings cover, not yet merged; rows that have the text."""
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select(F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("tkey"), text.alias("text")).where(F.octet_length("text") >= length)

    def hashes(key, raw, state):
        h = anchors(raw, length, gram)[0]
        return [pa.array(h.view(np.int64))]

    twice = written(_scan(rows, hashes, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "anchors")
    wanted = spark.sparkContext.broadcast(_bloom(twice, "hash"))

    def candidates(key, raw, state):
        h, p, lo, hi = anchors(raw, length, gram)
        keep = _maybe(wanted.value, h)
        if not keep.any():
            return None
        h, p, lo, hi = h[keep], p[keep], lo[keep], hi[keep]
        sids = [_sid(raw[a : b + length], q - a) for q, a, b in zip(p.tolist(), lo.tolist(), hi.tolist())]
        return [pa.array([key] * len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(p), pa.array(lo), pa.array(hi), pa.array(sids, pa.binary())]

    found = written(_scan(rows, candidates, "tkey binary, hash long, p long, lo long, hi long, sid binary"), "candidates")
    counts = written(found.groupBy("hash", "sid").agg(F.count(F.lit(1)).alias("n")), "counts")
    mixed = counts.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most")).where("m > 1 OR most > 1").select("hash", "m")
    needed = join_spread(counts, written(mixed, "mixed"), ["hash"], "m", "sid").drop("m")
    needed = written(needed.withColumn("s64", F.conv(F.hex(F.substring("sid", 1, 7)), 16, 10).cast("long")), "needed")
    chosen = spark.sparkContext.broadcast(_bloom(needed, "s64"))

    def contexts(key, raw, state):
        h, p, lo, hi = anchors(raw, length, gram)
        keep = _maybe(wanted.value, h)
        ctx = [(raw[a : b + length], q - a) for q, a, b in zip(p[keep].tolist(), lo[keep].tolist(), hi[keep].tolist())]
        if not ctx:
            return None
        sids = [_sid(*c) for c in ctx]
        also = _maybe(chosen.value, np.frombuffer(b"".join(sids), ">u8")[::2].astype(np.uint64) >> np.uint64(8))
        seen = state.setdefault("seen", set())
        out = [(h, s, off, c) for h, s, (c, off), k in zip(h[keep].view(np.int64).tolist(), sids, ctx, also) if k and s not in seen]
        if len(seen) > 500_000:
            seen.clear()
        seen.update(o[1] for o in out)
        return [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.binary()))]

    texts = _scan(rows, contexts, "key long, sid binary, off int, ctx binary").groupBy("sid").agg(F.first("key").alias("key"), F.first("off").alias("off"), F.first("ctx").alias("ctx"))
    distinct = written(texts.join(needed.select("sid", "n"), "sid"), "contexts")
    inside = _resolve(distinct, length, gram, length - gram + 1)
    # A context has as many ranges as it has places at most, a text as many spans as it has anchors; equal texts share theirs.
    ranges = inside.groupBy("sid").agg(F.collect_list(F.struct("l_lo", "l_hi")).alias("ranges")).join(counts.select("sid", "n"), "sid")
    each = join_spread(found.select("tkey", "sid", "p"), written(ranges, "ranges"), ["sid"], "n", "p").select("tkey", "p", F.inline("ranges"))
    spans = each.select("tkey", (F.col("p") - F.col("l_hi")).alias("start"), (F.col("p") - F.col("l_lo") + length).alias("end")).distinct()
    # The first anchor of a text that several rows have is a candidate in each of them.
    rows_of = found.where("lo = 0").groupBy("tkey").agg(F.count(F.lit(1)).alias("rows"))
    grouped = spans.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return grouped.join(rows_of, "tkey", "left").select("tkey", "spans", F.coalesce("rows", F.lit(1)).alias("rows"))


def _sid(ctx: bytes, off: int) -> bytes:
    """Names a context: 128 bits of a hash of its bytes and its anchor's place."""
    return xxhash.xxh3_128_digest(ctx, off)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spans = written(repeated_spans(docs, length, gram), "spans")
    text = text_of()
    rows = docs.select("doc_id", F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("tkey"), text.alias("text"))
    # A filter of a fixed size parts the texts that surely stay whole; only the others are shuffled.
    parted = maybe_flagged(rows, "tkey", spans, "tkey")
    own = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    whole = parted.where("NOT _may").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = value.as_buffer().to_pybytes()
                gone = merged([(s["start"], s["end"]) for s in spans or []])
                edges = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    touched = join_spread(parted.where("_may").select("doc_id", "tkey", "text"), spans, ["tkey"], "rows", how="left").select("doc_id", "text", "spans").transform(in_arrow, cut, schema)
    return whole.unionByName(touched)
