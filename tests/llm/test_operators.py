import base64
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paideia.llm import bpe, common, dart_minhash, exact_dedup, hmm_lm, langid, media, mixing, suffix_dedup, token_cache, toxicity
from paideia.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, copies int, size string, _row int, score string"
LONG = "many words in one line " * 9000
ODD = [
    (1, "the same text", "en", "a"), (2, "the same text", "en", "b"), (2, "the same text", "en", "b"), (3, "", None, None), (4, None, "de", "a"),
    (None, "no id here", "en", "a"), (5, LONG, "en", "a"), (6, "123 ... !!", "en", "b"), (7, "Überaus schöne Wörter", "de", None), (8, "x", None, "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "clash", 7, "s", 1, "t") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_dedup(spark, odd, none):
    rows = exact_dedup.dedup_report(odd).collect()
    assert len(rows) == len(ODD)
    want = {}
    for i, t, *_ in ODD:
        want.setdefault(t or "", []).append(i)
    for r in rows:
        text = next(t or "" for i, t, *_ in ODD if i == r.doc_id)
        ids = [i for i in want[text] if i is not None]
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.group_size == len(want[text]) and r.keep_id == (max(ids) if ids else None) and r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(want)
    assert {r._digest for r in kept.collect()} == {"clash"}
    assert exact_dedup.dedup_report(none).count() == exact_dedup.drop_copies(none).count() == 0
    assert {r.keep_id for r in exact_dedup.dedup_report(odd, keep="smallest").collect() if r.doc_id == 2} == {1}


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken == r.size * r.copies <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) <= 1.5 * sum(r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    docs = documents(spark)
    plan = mixing.mix(docs).collect()
    total, biggest = sum(r.size for r in plan), max(r.size for r in plan)
    assert 1.5 * total - biggest <= sum(r.taken for r in plan) <= 1.5 * total
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert own[0].target <= 2 * own[0].source_size + 1e-6 and abs(sum(r.taken for r in own) - own[0].target) <= 2 * biggest
    assert abs(sum({r.source: r.target for r in plan}.values()) - 1.5 * total) < 1e-3
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in plan)


def tik():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, none):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own, other, rng = bpe.codec(path, pattern), tik(), random.Random(3)
    texts = ["", "a" * 5000, "日本語 \r\n\t é​" * 30, "<|endoftext|>", *("".join(rng.choice("abc é\n1'st🙂") for _ in range(n)) for n in (1, 2, 7, 300, 4000))]
    for t in texts:
        assert own.encode(t) == other.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    got = bpe.encoding_digests(odd, path, pattern).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t or "" for i, t, *_ in ODD if i == r.doc_id)
        ids = other.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(odd, path, pattern), path, pattern).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bpe.encoding_digests(none, path, pattern).count() == 0


def test_bpe_many_pieces_share_little_memory(monkeypatch):
    """The lists of a queue don't grow with the text: memory beyond the caches is what made merges slow."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own, other, rng = bpe.Codec(path, pattern), tik(), random.Random(8)
    pieces = sorted({" " + "".join(rng.choice(["an", "th", "é", "heit", "q", "ou", "z"]) for _ in range(rng.randint(3, 9))) for _ in range(60_000)})
    raw = [p.encode() for p in pieces]
    tracemalloc.start()
    try:
        ids = own.merges.encode(raw)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(pieces) > 40_000 and peak < 50e6, peak
    assert ids == [other.encode_ordinary(p) for p in pieces]
    texts = ["".join(pieces[k : k + 3000]) + " " + "x1" * (k % 700) for k in range(0, len(pieces), 3000)] + ["", " ", "\n"]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5000)
    got = [row for k in range(0, len(texts), 2) for row in own.digests(texts[k : k + 2])]
    assert len(own.ids) < len(pieces)
    for text, row in zip(texts, got, strict=True):
        ids = other.encode_ordinary(text)
        assert row == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    # Ids that stand for other bytes than the text's show in the digest.
    own.ids.clear()
    token = own.merges.ranks[b" an"]
    own.tokens = own.tokens | {token: b" AN"}
    assert own.digests([" an th"])[0][2] == hashlib.sha256(b" AN th").hexdigest()


def test_token_cache(spark, odd, none, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    rows = token_cache.token_counts(odd, path, cache).collect()
    other = tik()
    for r in rows:
        text = next(t or "" for i, t, *_ in ODD if i == r.doc_id)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(other.encode_ordinary(text)), len(other.encode_ordinary(text)) > 1024)
    stored = spark.read.parquet(cache).count()
    assert len(rows) == len(ODD) and stored == len({t or "" for _, t, *_ in ODD})
    assert token_cache.token_counts(odd, path, cache).count() == len(ODD) and spark.read.parquet(cache).count() == stored
    assert token_cache.token_counts(none, path, str(tmp_path / "empty")).count() == 0
    piece = public_tokenizers.path("piece_bpe_32k.model")
    assert token_cache.token_counts(odd, piece, cache).count() == len(ODD) and spark.read.parquet(cache).count() == 2 * stored


def test_language(spark, odd, none):
    truth = {r.doc_id: r.lang for r in documents(spark).collect()}
    rows = Q.op3_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    profiles = langid.learn_profiles(documents(spark))
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, profiles).collect()}
    assert got[3] == got[4] == got[6] == "und" and got[7] == "de" and len(got) == 9
    kept = langid.keep_identified(odd, profiles)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 5, 7, 8}
    assert langid.predict(none, langid.learn_profiles(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.learn_profiles(none)).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op1_toxicity(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.93 * len(held)
    lexicon = toxicity.Lexicon({" scum": 5.0, " idiot ": 4.0}, frozenset({" not scum "}), (-3.0, 2.0, 2.0, 0.0))
    a = lexicon.automaton()
    assert toxicity.measures(a, toxicity.fold("You SCUM, you 1d10t"))[0] == 2  # digits stand for letters
    assert toxicity.measures(a, toxicity.fold("уоu ѕсum"))[0] == 1  # letters of another script
    assert toxicity.measures(a, toxicity.fold("he is not scum at all"))[0] == 0 and toxicity.measures(a, toxicity.fold("idiotic"))[0] == 0
    assert toxicity.score(odd, lexicon).count() == len(ODD) and toxicity.score(none, lexicon).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic long")
    assert toxicity.learn(odd, labels).weights == {}


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_near_duplicates(spark, odd, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((12, 80, 300)))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = "edit"
            texts.append(" ".join(c))
    # One group of near copies that is larger than a bucket's bound, and a passage that many texts share.
    passage = " ".join(base[1])
    texts += [f"{' '.join(base[0])} tail{i}" for i in range(40)] + [f"{passage} " + " ".join(rng.choice(words) for _ in range(400)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in dart_minhash.near_duplicates(docs).collect()}
    grams = [Counter(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or jaccard(grams[i], grams[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert {i: r.class_id for i, r in rows.items()} == {i: find(i) for i in range(len(texts))}
    assert all(r.kept == (i == r.class_id) for i, r in rows.items())
    got = dart_minhash.near_duplicates(odd).collect()
    assert {(r.class_id, r.class_size) for r in got if r.doc_id == 1} == {(1, 3)}
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and {r.class_id for r in got if r.doc_id in (3, 4)} == {3}
    assert dart_minhash.near_duplicates(none).count() == 0


def brute_classes(texts):
    """The lowest index of each text's component, by all pairs."""
    grams = [Counter(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(grams[i], grams[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [dart_minhash.BLOCK, 4000])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, block):
    # Edited forms of one text: many are in common buckets, but only some are near the lowest id, or near any other.
    monkeypatch.setattr(dart_minhash, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = []
    for i in range(160):
        c = list(base)
        for k in range(rng.randrange(1, 6)):
            c[rng.randrange(len(c))] = f"e{rng.randrange(3)}" if i % 2 else f"e{i}x{k}"
        texts.append(" ".join(c))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_classes(texts)
    assert 5 < len(set(expected)) < 120
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()} == dict(enumerate(expected))


def test_joining_links():
    rng = np.random.default_rng(4)
    grams = [np.sort(rng.choice(np.arange(14, dtype="<u4"), int(rng.integers(0, 14)))) for _ in range(60)]
    roots = np.arange(60)
    roots[5:9] = 5
    out = dart_minhash.joining_links(grams, roots, np.flatnonzero(roots != 5), 5, 0.6)
    assert all(dart_minhash.similarity(grams[a], grams[b]) >= 0.6 for a, b in out)

    def classes(links):
        of = roots.copy()
        for a, b in links:
            of[of == of[a]] = of[b]
        return {frozenset(np.flatnonzero(of == r).tolist()) for r in of}

    assert classes(out) == classes((a, b) for a, b in itertools.combinations(range(60), 2) if dart_minhash.similarity(grams[a], grams[b]) >= 0.6)
    assert dart_minhash.joining_links([np.empty(0, "<u4")] * 2, np.arange(2), np.arange(2), 0, 0.8) == []


def test_dart_signatures():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 900).astype(np.uint64)
    for cut in (300, 600):
        a, b = (e[:600], np.ones(600)), (e[cut - 300 : cut + 300], np.full(600, 1.0))
        s = dart_minhash.signatures([a, b], 2000)
        same = len(np.intersect1d(a[0], b[0]))
        assert abs((s[0] == s[1]).mean() - same / (1200 - same)) < 0.05
    s = dart_minhash.signatures([(e[:50], np.full(50, 3.0)), (e[:50], np.full(50, 2.0))], 4000)
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.05  # weights count


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4000, 2])
def test_suffix_dedup(spark, odd, none, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "délta", "aaaa", "b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 10, 60)))) for _ in range(60)] + ["a" * 100, "ab" * 60, "", None, *[f"{i} shared passage of text {i * 7}" for i in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=20, gram=8).collect()}
    for i, want in enumerate(brute_repeats([(t or "").encode() for t in texts], 20)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want
    if most == 4000:
        got = suffix_dedup.remove_repeats(odd).collect()
        assert sorted(r.n_removed for r in got)[-1] > 200_000 and len(got) == len(ODD)
        assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_order():
    rng = random.Random(2)
    for alphabet in ("ab", "abcdefgh", "a"):
        t = "".join(rng.choice(alphabet) for _ in range(700)).encode()
        order = suffix_dedup.suffix_order(t, np.ones(len(t), bool), 700)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_hmm(spark, odd, none):
    model = hmm_lm.Model.first(states=2, classes=3)
    seq = np.array([0, 2, 1, 1], np.uint8)
    exact = sum(
        model.start[path[0]] * model.emit[path[0], seq[0]] * math.prod(model.move[a, b] * model.emit[b, c] for a, b, c in zip(path, path[1:], seq[1:]))
        for path in itertools.product(range(2), repeat=4)
    )
    assert abs(hmm_lm.log_likelihoods(model, [seq, seq[:2]])[0] - math.log10(exact)) < 1e-12
    rng = np.random.default_rng(0)
    train = [np.where(rng.random(60) < 0.9, k % 2, 2).astype(np.uint8) for k in range(40)]
    before = hmm_lm.log_likelihoods(model, train).sum()
    counts = hmm_lm.expected_counts(model, train)
    assert abs(counts[:2].sum() - 40) < 1e-6 and abs(counts[6:].sum() - 2400) < 1e-6
    assert hmm_lm.log_likelihoods(hmm_lm.Model.estimated(counts, 2, 3), train).sum() > before
    rows = Q.op8_hmm_scores(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    tokens = {i: hmm_lm.tokens(t) for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(texts) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm_lm.score(odd, F.lit(False), 1).count() == len(ODD) and hmm_lm.score(none, F.lit(False), 1).count() == 0
    assert {r.train_tokens for r in hmm_lm.score(odd, F.lit(True), 1).collect()} == {0}


def test_media(spark):
    rows = Q.op5_media_copies(spark, SF).where("vec_id < 1000000").collect()
    asked = [r for r in rows if r.asked]
    assert len(asked) >= 20 and sum(r.found_group == r.group_id for r in asked) >= 0.9 * len(asked)
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(64).tolist() for _ in range(6)]
    near = [[x + 0.01 for x in vectors[0]], vectors[0]]
    data = [*enumerate(vectors + near), (20, None), (21, []), (40, vectors[0])]
    frame = spark.createDataFrame(data, "image_id long, vector array<double>")
    got = {r.image_id: r.group_id for r in media.copies_report(frame).collect()}
    assert got[0] == got[6] == got[7] == got[40] == 0 and len({got[i] for i in range(6)}) == 6 and 20 not in got
    assert media.copies_report(frame.limit(0)).count() == 0
    assert media.read_pgm(b"P5 2 2 255\n123") is None and media.read_pgm(None) is None


def _cornered(spark, images):
    """Described images: id -> list of (corner's number, flipped bits); the corners of equal numbers are at equal places."""
    words = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, (200, 2))
    rows = []
    for i, corners in images.items():
        flips = [[sum(1 << (63 - b + o) for b in bits if o <= b < o + 64) for o in (0, 64)] for _, bits in corners]
        words_of = [[int(np.int64(words[n, k]) ^ np.uint64(f[k]).astype(np.int64)) for k in (0, 1)] for (n, _), f in zip(corners, flips)]
        rows.append((i, [(20.0 + 10 * n, 20.0 + 7 * n, 1.0, 3, *w) for (n, _), w in zip(corners, words_of)]))
    return spark.createDataFrame(rows, f"class_id long, corners {media.CORNER}")


@pytest.mark.parametrize("block", [4096, 2])
def test_media_links_beside_the_lowest(spark, monkeypatch, block):
    monkeypatch.setattr(media, "BLOCK", block)
    plain = lambda *n: [(k, ()) for k in n]
    # 3 shares eight corners with 2; the lowest image has four of them.
    images = _cornered(spark, {1: plain(*range(4), *range(50, 60)), 2: plain(*range(8)), 3: plain(*range(8), 20), 4: plain(*range(100, 110))})
    assert {r.class_id: r.group_id for r in media.group_copies(images).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    found = media.find_copies(_cornered(spark, {9: plain(*range(8), *range(50, 56))}), images).collect()
    assert {(r.class_id, r.inliers) for r in found} == {(1, 10), (2, 8), (3, 8)}


def test_media_flipped_bits(spark):
    # Eight flipped bits, some in each third of the descriptor.
    flipped = [(k, (5, 10, 45, 50, 88, 90, 95, 100)) for k in range(8)]
    images = _cornered(spark, {1: [(k, ()) for k in range(8)], 2: flipped, 3: [(k, ()) for k in range(100, 108)]})
    assert {r.class_id: r.group_id for r in media.group_copies(images).collect()} == {1: 1, 2: 1, 3: 3}
    assert [(r.class_id, r.inliers) for r in media.find_copies(_cornered(spark, {9: flipped}), images.where("class_id <> 2")).collect()] == [(1, 8)]


@pytest.mark.parametrize("block", [1 << 19, 200])
def test_media_blocks_agree_as_all_corners_do(spark, monkeypatch, block):
    """What meets in blocks has the places that the comparison of all corners gives."""
    monkeypatch.setattr(media, "BLOCK", block)
    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(16) for _ in range(6)]
    data = [(i, (vectors[i % 6] + 0.02 * (i // 6) * rng.standard_normal(16)).tolist()) for i in range(24)]
    pictures = media.render(spark.createDataFrame(data, "image_id long, vector array<double>"))
    images = common.written(media.classes(media.describe(pictures)), "images")
    queries = common.written(media.classes(media.describe(media.edited(pictures.where("image_id < 8")))), "queries")
    got = {tuple(r) for r in media.find_copies(queries, images).collect()}
    pairs = queries.select(F.col("class_id").alias("query_id")).crossJoin(images.select("class_id"))
    want = {tuple(r) for r in media._verified(pairs, queries, images, media.DISTANCE, media.AGREE).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and {(i, i) for i in range(8)} <= {r[:2] for r in got}


def test_media_that_meets_by_chance_is_not_shuffled(spark):
    # Corners of three kinds, in places of their own: every pair of images meets in three or more, and none is alike.
    rng = np.random.default_rng(6)
    kinds = rng.integers(-(2**63), 2**63 - 1, (3, 2)).tolist()
    rows = [(i, [(float(y), float(x), 1.0, 3, *k) for k, (y, x) in zip(kinds * 2, rng.integers(0, 4000, (6, 2)).tolist())]) for i in range(300)]
    images = spark.createDataFrame(rows, f"class_id long, corners {media.CORNER}")
    sc = spark.sparkContext

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    assert media.group_copies(images).where("class_id <> group_id").count() == 0
    written = sum(n for k, n in shuffled().items() if k not in before)
    assert written < 500_000, written


def test_media_rows_do_not_grow_with_the_square_of_a_group(spark):
    """Python makes a row for each image, and a few for each that is linked, not one for each pair of corners or copies."""
    store = spark._jsparkSession.sharedState().statusStore()
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    before = {x.executionId() for x in seq(store.executionsList())}
    rng = np.random.default_rng(7)
    near = rng.standard_normal(32)
    data = [(i, (near + 0.01 * rng.standard_normal(32)).tolist()) for i in range(60)]
    found = media.copies_report(spark.createDataFrame(data, "image_id long, vector array<double>").coalesce(2), 2).collect()
    assert len(found) == 60 and {r.group_id for r in found} == {0} and sum(r.found_group == 0 for r in found) == 30
    made = []
    for x in (x for x in seq(store.executionsList()) if x.executionId() not in before):
        values = store.executionMetrics(x.executionId())
        for node in seq(store.planGraph(x.executionId()).allNodes()):
            if node.name() == "MapInArrow":
                numbers = [values.apply(m.accumulatorId()) for m in seq(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
                made += [int(n.replace(",", "")) for n in numbers]
    assert len(made) >= 4 and max(made) <= 600, made


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "byte BPE"]
    docs = documents(spark)
    out = {}
    for name, stage in P.STAGES:
        docs = out[name] = stage(spark, docs, SF).checkpoint()
        if name != "byte BPE":
            assert docs.columns == documents(spark).columns
    first = {r.doc_id: r.text for r in out["language ID"].collect()}
    assert set(first) == {r.doc_id for r in documents(spark).collect() if any(c.isalpha() for c in r.text)}
    best = {}
    for i, t in first.items():
        best[t] = max(i, best.get(t, i))
    assert {r.doc_id for r in out["exact dedup"].collect()} == set(best.values())
    assert {r.doc_id for r in out["near dedup"].collect()} <= set(best.values())
    mixed = Counter(r.doc_id for r in out["mixing"].collect())
    assert max(mixed.values()) <= 2 and Counter(r.doc_id for r in out["byte BPE"].collect()) == mixed
    empty = documents(spark).limit(0)
    for name, stage in P.STAGES:
        empty = stage(spark, empty, SF).checkpoint()
        assert empty.count() == 0
