"""Near-duplicate detection by DartMinHash signatures and banded joins.

A document is a weighted set: its five-word shingles with their multiplicities. The weights from 0 on are cut into
dyadic levels ([0, 1), [1, 2), [2, 4) ...), the ranks into dyadic strips; an element has a region in each strip for each
level that its weight reaches, so that its cost grows with the logarithm of its weight. A hash of element, level and
strip says how many darts fell into a region (Poisson, in proportion to its area), and hashes of each dart give its
coordinate, weight and rank; darts above the element's weight miss. A signature keeps, for each coordinate, the dart of
lowest rank; two documents agree in a coordinate with a probability equal to their weighted Jaccard similarity. The
strips are thrown from the lowest rank until every coordinate has a dart.

Equal texts are one class before anything is compared. Coordinates are banded; texts that share a band are candidates,
and a pair is a link only if the similarity of the shingles themselves reaches the threshold. With 20 bands of 4, a pair
at 0.8 shares no band with a probability of 3 in 100,000. Shingles are compared by 32 bits of their hashes: of two texts
of n and m shingles, about n m / 2 ** 32 unlike ones count as alike, which is less than one for texts below 65,000 words.
Buckets of up to ``SMALL`` members compare all; in larger ones, each member is compared with one central text, and those
that this doesn't link meet again in buckets of two bands at most five apart (any four common bands hold such two).
What is left is exact: in each large bucket whose members are of several classes by then, those outside the
most common class are queries against all members. Both sides are dealt to blocks of bounded size by hash; a
task holds one block of each, counts common shingles through an inverted index, and returns only links that join
classes. Classes are the connected components of all links; which way a link was found changes no class.

Results for odd input: null counts as empty; texts without words are similar to equal texts only;
texts of one to four words have one shingle, all their words; rows that share a text are one class, and
a class's id is its lowest document id (null if no row of it has one); rows that share an id but not their text are
texts of their own and may be in different classes; other columns are ignored, whatever their names; an empty table
gives an empty table. Texts of any length are taken whole: words are hashed in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_spread, maybe_among, maybe_flagged, text_of, written

WORDS, THRESHOLD, BANDS, ROWS, SMALL = 5, 0.8, 20, 4, 16
#: Any four of 20 bands hold two that are at most five apart, counted around.
NEXT = 5
#: Bytes of shingles and members in a block of a large bucket, about.
BLOCK, BLOCK_ROWS = 8 << 20, 1000
#: log2 of the lowest strip's upper rank.
_FIRST_STRIP = -9
#: Bytes of text that are worked on at once.
_CHUNK = 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about _CHUNK bytes."""
    start = 0
    while len(text) - start > _CHUNK:
        end = min((at for at in (text.find(c, start + _CHUNK) for c in (b" ", b"\n", b"\t")) if at >= 0), default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the text that each is of."""
    if sum(map(len, texts)) <= 2 * _CHUNK:
        return _hashed(texts)
    found = [(k, _hashed([piece])[0]) for k, text in enumerate(texts) for piece in _pieces(text)]
    return np.concatenate([h for _, h in found]), np.repeat([k for k, _ in found], [len(h) for _, h in found])


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_SPACE[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))  # words, as places in ``at``
    lengths = np.diff(np.append(starts, len(at)))
    inside = np.arange(len(at)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x100000001B3, np.uint64))
    h = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * powers[inside], starts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(h ^ (lengths.astype(np.uint64) * _MIX[2])), np.searchsorted(ends, at[starts], "right")


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text its shingles, sorted, repeated as often as they occur."""
    h, doc = word_hashes(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        run = mixed(run * _MIX[2] + h[k : k + len(run)])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.sort(run[a : b - words + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mixed(one * _MIX[2] + h[k : k + 1])
            out.append(one + np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@cache
def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts."""
    from math import exp, lgamma, log

    n = int(mean + 12 * mean**0.5 + 20)
    return np.cumsum([exp(-mean + k * log(mean) - lgamma(k + 1)) for k in range(n)])


def _levels(weights: np.ndarray) -> np.ndarray:
    """How many levels each weight reaches: [0, 1) is level 0, [2 ** (k - 1), 2 ** k) is level k."""
    return 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """One row of ``size`` dart hashes for each weighted set (elements, weights above 0); all sets not empty."""
    n = len(sets)
    out = np.zeros((n, size), np.uint64)
    filled = np.zeros((n, size), bool)
    sizes = np.array([len(e) for e, _ in sets])
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([np.asarray(w, float) for _, w in sets])
    reach = _levels(weights)
    owner = np.repeat(np.repeat(np.arange(n), sizes), reach)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
    weight = np.repeat(weights, reach)
    region = mixed(np.repeat(elements, reach) ^ mixed(level.astype(np.uint64) + _MIX[2]))
    floor = np.where(level > 0, 2.0 ** (level - 1), 0.0)  # the level's least weight, and its width
    width = np.where(level > 0, floor, 1.0)
    strip = _FIRST_STRIP
    low, high = 0.0, 2.0**strip
    while len(owner):
        base = mixed(region ^ mixed(np.uint64(1000 + strip) * np.ones(1, np.uint64))[0])
        thrown = np.empty(len(owner), np.int64)
        for w in np.unique(width):
            at = width == w
            thrown[at] = np.searchsorted(_poisson_table(size * (high - low) * float(w)), _unit(base[at]), "right")
        of = np.repeat(np.arange(len(owner)), thrown)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = mixed(base[of] + (nth.astype(np.uint64) + np.uint64(1)) * _MIX[2])
        inside = floor[of] + width[of] * _unit(mixed(dart + _MIX[1])) < weight[of]
        of, dart = of[inside], dart[inside]
        rank = low + (high - low) * _unit(mixed(dart + _MIX[0]))
        place = owner[of] * size + (dart % np.uint64(size)).astype(np.int64)
        order = np.lexsort((rank, place))
        places, at = np.unique(place[order], return_index=True)
        new = ~filled.ravel()[places]
        out.ravel()[places[new]] = dart[order][at[new]]
        filled.ravel()[places] = True
        keep = ~filled.all(axis=1)[owner]
        owner, region, weight, floor, width = owner[keep], region[keep], weight[keep], floor[keep], width[keep]
        strip += 1
        low, high = high, 2.0**strip
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), grouped.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h * _MIX[2] + grouped[:, :, r])
    return h


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) > both else 0.0


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    start, size = 0, 0
    for i, text in enumerate(batch.column(column)):
        size += len(text.as_py())
        if size >= _CHUNK:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _chunks(batch, 2)):
            found = shingles([t.encode() for t in part.column(2).to_pylist()], words)
            sets = [np.unique(s, return_counts=True) for s in found if len(s)]
            hashes = np.empty((0, bands), np.int64)
            if sets:
                hashes = band_hashes(signatures(sets, bands * rows), bands, rows).view(np.int64)
            sizes = np.array([bands * bool(len(s)) for s in found])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel(), pa.int64()))], ["doc_id", "digest", "bands"])

    return run


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _chunks(batch, 1)):
            found = shingles([t.encode() for t in part.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in found], pa.binary())], ["digest", "grams"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")  # sorted: they are upper halves of sorted hashes
                # Sizes alone rule out what can't reach the threshold.
                keep.append(min(len(a), len(b)) >= threshold * max(len(a), len(b)) and similarity(a, b) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingles reach the threshold."""
    left = grams.select(F.col("rep").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("rep").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(in_arrow, _verify(threshold), "a long, b long")


def _buckets(rows: DataFrame) -> DataFrame:
    """key, rep, n, least of the rows (key, rep) whose bucket has several members.

    ``least`` is what a large bucket's members are compared with first: the one that is in most large buckets (of a family
    of near copies, the text that they were made from), the lowest of such.
    """
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1"), "buckets")
    members = written(maybe_among(rows, "key", sizes, "key").join(sizes, "key"), "members")
    large = members.where(F.col("n") > SMALL).select("key", "rep")
    if large.isEmpty():
        return members
    shared = large.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    centres = large.join(shared, "rep").groupBy("key").agg(F.max_by("rep", F.struct("shared", -F.col("rep"))).alias("centre"))
    chosen = members.join(centres, "key", "left").select("key", "rep", "n", F.coalesce("centre", "least").alias("least"))
    return written(chosen, "centred")


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs to compare: all of small buckets, each with the centre in large ones."""
    # The filter bounds the lists: at most SMALL ids each.
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m"))
    inside = few.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    stars = members.where((F.col("n") > SMALL) & (F.col("rep") != F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return inside.unionByName(stars).distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root (lowest node of its component) for all nodes of the links (a, b), by alternating stars."""
    edges = written(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = mark(edges)
    while was[0]:
        # Large star: every neighbour above u points to the least of u's neighbourhood.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its lower neighbours point to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _elements(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the elements (shingle, how many times before) of all texts, and the text that each is of."""
    sizes = [len(g) for g in grams]
    every, owner = np.concatenate(grams).astype(np.uint64), np.repeat(np.arange(len(grams)), sizes)
    new = np.concatenate([[True], (np.diff(every) != 0) | (np.diff(owner) != 0)])
    nth = np.arange(len(every)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    _, numbers = np.unique((every << np.uint64(32)) | nth.astype(np.uint64), return_inverse=True)
    return numbers, owner


def joining_links(grams: list[np.ndarray], roots: np.ndarray, asked: np.ndarray, main: int, threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes (``roots``) of the texts as all links of the texts ``asked`` to any text do.

    A text that has come to class ``main`` asks no more: what it could be linked to either is of that class or asks itself.
    """
    if not any(len(g) for g in grams):
        return []
    numbers, owner = _elements(grams)
    sizes = np.bincount(owner, minlength=len(grams))
    order = np.argsort(numbers, kind="stable")
    by_element, starts = owner[order], np.searchsorted(numbers[order], np.arange(numbers.max() + 2))
    shared = np.diff(starts) > 1
    first, label, out = np.concatenate([[0], np.cumsum(sizes)]), roots.copy(), []
    for x in asked:
        mine = numbers[first[x] : first[x + 1]]
        mine = mine[shared[mine]]
        # A link has at least this share of either text's elements in common.
        if label[x] == main or not len(mine) or len(mine) < threshold * sizes[x]:
            continue
        common = np.bincount(np.concatenate([by_element[starts[e] : starts[e + 1]] for e in mine]), minlength=len(grams))
        hits = np.flatnonzero((common / (sizes[x] + sizes - common) >= threshold) & (label != label[x]))
        for other, y in zip(*np.unique(label[hits], return_index=True)):
            out.append((int(x), int(hits[y])))
            low, high = (label[x], other) if label[x] == main else (other, label[x])
            label[label == high] = low
    return out


def _block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, roots = table.column("rep").to_numpy(), table.column("root").to_numpy()
        grams = [np.frombuffer(g.as_buffer(), "<u4") for g in table.column("grams")]
        links = joining_links(grams, roots, np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False)), table.column("main")[0].as_py(), threshold)
        a, b = (ids[np.array(side, int)] for side in (zip(*links) if links else ((), ())))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _rest(large: DataFrame, roots: DataFrame, reps: DataFrame, keyed: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links that join the classes found so far, among all pairs of members of a large bucket (key, rep)."""
    rows = large.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    counted = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    rows = written(rows.join(main, "key").withColumn("asks", F.col("root") != F.col("main")), "rest")
    grams = _grams_of(rows.select(F.col("rep").alias("id")).distinct(), reps, keyed, words)
    size = F.length("grams")
    sized = written(rows.join(grams, "rep"), "rest_grams")
    share = size / BLOCK + 1 / BLOCK_ROWS  # of a block
    blocks = sized.groupBy("key").agg(*[F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(s), F.lit(0.0)))).cast("int").alias(n) for n, s in (("_all", share), ("_asking", F.when(F.col("asks"), share)))])
    dealt = sized.join(blocks, "key")
    of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt.select("key", "rep", "root", "main", F.lit(False).alias("asks"), "grams", of("_all").alias("_block"), each("_asking").alias("_query"))
    asking = dealt.where("asks").select("key", "rep", "root", "main", "asks", "grams", of("_asking").alias("_query"), each("_all").alias("_block"))
    met = asked.unionByName(asking)
    return written(met.groupBy("key", "_block", "_query").applyInArrow(_block(threshold), "a long, b long").where("a <> b").distinct(), "links")


def _grams_of(ids: DataFrame, reps: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """rep, grams (sorted shingles) of the nodes with these ids."""
    wanted = written(reps.select("digest", "rep").join(ids, F.col("rep") == F.col("id"), "left_semi"), "wanted")
    texts = maybe_among(keyed.select("digest", "text"), "digest", wanted, "digest")
    each = texts.transform(in_arrow, _grams(words), "digest binary, grams binary").dropDuplicates(["digest"])
    return written(each.join(wanted, "digest").select("rep", "grams"), "grams")


def _verified(pairs: DataFrame, reps: DataFrame, keyed: DataFrame, words: int, threshold: float) -> DataFrame:
    """The links among the pairs, which are a written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return written(_links(pairs, _grams_of(ids, reps, keyed, words), threshold), "links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: doc_id, class_id, class_size (its documents), kept (class_id is its id)."""
    members, classes = _classes(docs, threshold, words, bands, rows)
    found = join_spread(members, classes, ["digest"], "copies")
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The input's rows and columns without near duplicates: of each class, one row with its lowest id stays.

    Rows that are one of a class's rows with that id are told apart by their text (the least digest) and else at random.
    Documents that share no class with another row never move.
    """
    _, classes = _classes(docs, threshold, words, bands, rows)
    several = written(classes.where("class_size > 1"), "several")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    keyed = maybe_flagged(docs.select(row, F.col("doc_id").cast("long").alias("_id"), _digest().alias("digest")), "digest", several, "digest")
    found = join_spread(keyed.where("_may").drop("_may"), several, ["digest"], "copies", "_id", "left")
    alone = found.where("class_size IS NULL").select("_row.*")  # the filter let it pass by chance
    stays = found.where("class_size > 1").where((F.col("digest") == F.col("kept_digest")) & F.col("_id").eqNullSafe(F.col("class_id")))
    return keyed.where("NOT _may").select("_row.*").unionByName(alone).unionByName(stays.dropDuplicates(["digest"]).select("_row.*"))


def _digest() -> Column:
    return F.unhex(F.sha2(text_of().cast("binary"), 256))


def _classes(docs: DataFrame, threshold: float, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest of all documents; and a row for each distinct text: digest, copies (documents that have it),
    class_id, class_size, kept_digest (the least text of those with the class's id)."""
    text = text_of()
    keyed = docs.select(F.col("doc_id").cast("long"), _digest().alias("digest"), text.alias("text"))
    sketches = written(keyed.transform(in_arrow, _sketch(words, bands, rows), "doc_id long, digest binary, bands array<long>"), "sketches")
    # A node is a distinct text; its number is fixed as the table is written. Lower ids get lower numbers: what a bucket's
    # members are compared with first is its oldest text, from which copies are made.
    texts = sketches.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    ordered = texts.orderBy(F.col("least_id").asc_nulls_last(), "digest")
    reps = written(ordered.withColumn("rep", F.monotonically_increasing_id()), "reps")
    filled = reps.where("size(bands) > 0").select("rep", "bands")
    members = _buckets(filled.select(F.explode("bands").alias("key"), "rep"))  # a band's hash holds its number
    tried = written(_pairs(members), "pairs")
    links = _verified(tried, reps, keyed, words, threshold)
    large = members.where(F.col("n") > SMALL)
    if not large.isEmpty():
        # Members of large buckets that aren't like their centre meet again where one of the next NEXT bands agrees, too.
        rest = large.where(F.col("rep") != F.col("least")).join(links.select(F.col("a").alias("least"), F.col("b").alias("rep")), ["least", "rep"], "left_anti")
        at = F.array_position("bands", F.col("key")).cast("int") - 1
        again = rest.join(filled, "rep").withColumn("_at", at).select("rep", F.explode(F.array(*[F.xxhash64("key", F.get("bands", (F.col("_at") + d) % bands)) for d in range(1, NEXT + 1)])).alias("key"))
        more = written(_pairs(_buckets(again)).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_verified(more, reps, keyed, words, threshold))
        links = links.unionByName(_rest(large.select("key", "rep"), written(connected(links), "roots"), reps, keyed, words, threshold))
    rooted = reps.select("digest", "rep", "least_id", "copies").join(connected(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = written(rooted, "rooted")
    first = F.struct(F.col("least_id").isNull(), "least_id", "digest")
    whole = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(first)["digest"].alias("kept_digest"), F.count(F.lit(1)).alias("texts"))
    classes = join_spread(rooted, written(whole, "whole"), ["root"], "texts", "rep")
    return sketches.select("doc_id", "digest"), written(classes.select("digest", "copies", "class_id", "class_size", "kept_digest"), "classes")
