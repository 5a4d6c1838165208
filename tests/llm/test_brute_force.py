"""Operators against plain versions of the same definitions, on odd input, on long texts and on hot groups."""

import hashlib
import itertools
import math
import random
import statistics
import time
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paideia.llm import common, dart_minhash, exact_dedup, hmm_lm, langid, media, mixing, suffix_dedup, token_cache, toxicity
from paideia.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, rep int, class_id string, _salt int"


def rows(spark, data):
    """Documents (doc_id, text, lang, source) with columns that the operators use themselves."""
    return spark.createDataFrame([(*d, 0, "r", "k", 1, "c", 2) for d in data], SCHEMA)


ODD = [
    (1, "one text of six plain words", "en", "a"), (1, "another text under the same id here", "en", "a"), (None, "no id but some words here", "en", "b"), (None, "no id but some words here", "en", "b"),
    (3, None, None, None), (4, "", "de", "a"), (5, "12 34 !!", "en", "a"), (6, "one text of six plain words", "en", None), (6, "one text of six plain words", "en", None), (7, "x", None, "b"),
]


# Exact copies


@pytest.mark.parametrize("fan_in,rounds", [(2, 3), (4, 1), (3, 2)])
def test_runs_of_any_shape(spark, monkeypatch, fan_in, rounds):
    monkeypatch.setattr(common, "SHARE", 4)
    rng = random.Random(3)
    data = [(None if i % 50 == 0 else i, f"t{rng.randrange(40) if i % 3 else 0}", "en", "a") for i in range(300)]
    docs = rows(spark, data).repartition(5)
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(t, []).append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        want = {t: best([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
        got = exact_dedup.dedup_report(docs, keep, fan_in=fan_in, rounds=rounds).collect()
        by = {r.text_sha256: r for r in got}
        assert len(got) == len(data) and all(by[hashlib.sha256(t.encode()).hexdigest()].keep_id == want[t] for t in groups)
        assert sorted(Counter(r.text_sha256 for r in got).items()) == sorted((hashlib.sha256(t.encode()).hexdigest(), len(ids)) for t, ids in groups.items())
        kept = exact_dedup.drop_copies(docs, keep, fan_in=fan_in, rounds=rounds).collect()
        assert sorted((r.text, r.doc_id) for r in kept) == sorted((t, want[t]) for t in groups)
    plan = exact_dedup.merged_runs(docs, fan_in=2, rounds=3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("SortAggregate") >= 3


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARE", 8)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "doc_id long, key string").repartition(4)
    groups = common.written(left.where("key <> 'k9'").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "groups")
    assert common.join_spread(left, groups, ["key"], "n").count() == 199
    outer = common.join_spread(left, groups, ["key"], "n", how="left")
    assert outer.count() == 200 and [r.key for r in outer.where("n IS NULL").collect()] == ["k9"] and sorted(outer.columns) == ["doc_id", "key", "n"]


# Mixing


def test_mixing_of_shared_ids(spark):
    data = [(1, "a b c d e", None, "s"), (1, "f g h i j", None, "s"), (None, "x y", None, "s"), (None, "x y", None, "s"), (None, None, None, None), (2, "", None, "t"), (3, "p q r s t u v w", None, "t"), (3, "p q r s t u v w", None, "t")]
    docs = rows(spark, data)
    for share in (0.4, 0.8, 1.5):
        plan, out = mixing.mix(docs, share=share).collect(), mixing.mixed_documents(docs, share=share).collect()
        assert len(out) == sum(r.copies for r in plan) and sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in plan) <= share * 30
        assert max(Counter((r.doc_id, r.text) for r in out).values(), default=0) <= 4
    assert mixing.mixed_documents(docs).columns == docs.columns


# Token counts


def test_a_later_call_encodes_only_new_texts(spark, tmp_path, monkeypatch):
    import tiktoken  # noqa: F401

    monkeypatch.setattr(Q, "TOKEN_CACHE", f"token-counts-{random.random()}")
    first = Q.op2_token_counts(spark, SF)
    assert first.count() == 200
    cache = spark.read.parquet(f"{common.shared_dir(spark)}/{Q.TOKEN_CACHE}")
    texts = {r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    stored = cache.count()
    assert stored == len(texts)
    folder = tmp_path / "more"
    folder.mkdir()
    more = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, "a new text", "en", "s", 10), (-2, "a new text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long").select(*spark.read.parquet(f"{SF}/documents.parquet").columns))
    more.write.parquet(str(folder / "documents.parquet"))
    counts, encoded = token_cache.fill_cache(more, public_tokenizers.path("byte_bpe_50k.json"), f"{common.shared_dir(spark)}/{Q.TOKEN_CACHE}")
    assert encoded == 1 and counts.count() == stored + 1
    again = Q.op2_token_counts(spark, str(folder))
    assert again.count() == 202 and spark.read.parquet(f"{common.shared_dir(spark)}/{Q.TOKEN_CACHE}").count() == stored + 1
    assert {r.n_tokens for r in again.where("doc_id < 0").collect()} == {3}


# Language


def naive_grams(text):
    kinds = "".join(ch if unicodedata.category(ch)[0] in "LM" else " " for ch in text.lower())
    out = Counter()
    if any(unicodedata.category(ch)[0] == "L" for ch in kinds):
        for word in kinds.split(" "):
            framed = f" {word} "
            if word:
                out.update(word)
                out.update(framed[i : i + 2] for i in range(len(framed) - 1))
                out.update(framed[i : i + 3] for i in range(len(framed) - 2))
    return out


def naive_ranked(counts, size):
    key = lambda g: [ord(c) for c in g]
    packed = lambda g: sum(c << (21 * (len(g) - 1 - i)) for i, c in enumerate(key(g)))
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size]


@pytest.mark.parametrize("piece", [1, 3, langid.PIECE])
def test_gram_counts(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(200):
        text = "".join(rng.choice("abé ß1.ΣÜ  \u0301") for _ in range(rng.randrange(25)))
        grams, counts = langid.gram_counts(text)
        spelt = ["".join(chr(int(g) >> 21 * k & 0x1FFFFF) for k in (2, 1, 0) if int(g) >> 21 * k) for g in grams]
        assert dict(zip(spelt, counts.tolist())) == dict(naive_grams(text))


def test_languages_as_plain_profiles_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.learn_profiles(docs, size=60)).collect()}
    by_lang = {}
    for r in docs.collect():
        if r.lang is not None and r.text is not None:
            by_lang.setdefault(r.lang, Counter()).update(naive_grams(r.text))
    profiles = {k: {g: i for i, g in enumerate(naive_ranked(c, 60))} for k, c in by_lang.items()}
    for r in docs.collect():
        own = naive_ranked(naive_grams(r.text or ""), 60)
        if not own:
            assert found[r.doc_id] == ("und", 0.0)
            continue
        far = {k: sum(abs(p[g] - i) if g in p else 60 for i, g in enumerate(own)) for k, p in profiles.items()}
        order = sorted(far, key=lambda k: (far[k], k))
        assert found[r.doc_id][0] == order[0] and abs(found[r.doc_id][1] - (1 - far[order[0]] / far[order[1]])) < 1e-9


def test_foreign_texts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn_profiles(docs)
    other = rows(spark, [(1, "Это совсем другой язык, и его здесь никто не учил читать", None, None), (2, "The words of this text are like those of others", None, None), (3, "Ω", None, None)])
    assert {r.doc_id for r in langid.keep_identified(other, profiles).collect()} == {2, 3}


# Toxicity


def test_matches_of_a_naive_search():
    rng = random.Random(4)
    words = ["scum", "scummy", "idiot", "idiots", "not", "fool", "a", "box"]
    lexicon = toxicity.Lexicon({" scum": 5.0, " idiot ": 4.0, " foo": 2.5, " fool ": 3.0}, frozenset({" not scum ", " idiot box "}), (0.0, 1.0, 1.0, 1.0))
    automaton = lexicon.automaton()
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randrange(12))))
        spans = [(i, i + len(p) - 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
        hits = {}
        for entry, weight in lexicon.weights.items():
            for i in range(len(folded)):
                if folded.startswith(entry, i) and not any(a <= i < b for a, b in spans):
                    hits[i] = max(weight, hits.get(i, 0.0))
        n, total, rate = toxicity.measures(automaton, folded)
        assert (n, total) == (len(hits), sum(hits.values())) and abs(rate - 100 * total / max(1, len(folded.split()))) < 1e-9


# Hidden Markov model


def slow_counts(model, sequences):
    k = model.emit.shape[0]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for q in sequences:
        a, b = np.zeros((len(q), k)), np.ones((len(q), k))
        a[0] = model.start * model.emit[:, q[0]]
        a[0] /= a[0].sum()
        scale = [1.0]
        for t in range(1, len(q)):
            a[t] = (a[t - 1] @ model.move) * model.emit[:, q[t]]
            scale.append(a[t].sum())
            a[t] /= scale[t]
        for t in range(len(q) - 2, -1, -1):
            b[t] = model.move @ (model.emit[:, q[t + 1]] * b[t + 1]) / scale[t + 1]
        start += a[0] * b[0]
        for t in range(len(q)):
            emit[:, q[t]] += a[t] * b[t]
            if t:
                move += np.outer(a[t - 1], model.emit[:, q[t]] * b[t]) * model.move / scale[t]
    return np.concatenate([start, move.ravel(), emit.ravel()])


def slow_log(model, q):
    total, a = 0.0, model.start * model.emit[:, q[0]]
    for t in range(len(q)):
        a = a if not t else (a @ model.move) * model.emit[:, q[t]]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


@pytest.mark.parametrize("segment,cells", [(4096, 300_000), (4, 40), (1, 1), (7, 100)])
def test_counts_by_segments(monkeypatch, segment, cells):
    monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
    monkeypatch.setattr(hmm_lm, "BATCH_CELLS", cells)
    rng = np.random.default_rng(3)
    model = hmm_lm.Model.first(3, 5)
    sequences = [rng.integers(0, 5, n).astype(np.uint8) for n in (1, 1, 2, 5, 9, 30, 31, 4, 17)]
    assert np.allclose(hmm_lm.expected_counts(model, sequences), slow_counts(model, sequences))
    assert np.allclose(hmm_lm.log_likelihoods(model, sequences), [slow_log(model, q) for q in sequences])


@pytest.mark.parametrize("blocks", [4096, 1])
def test_scores_of_a_plain_model(spark, monkeypatch, blocks):
    monkeypatch.setattr(hmm_lm, "WINDOW_BLOCKS", blocks)
    monkeypatch.setattr(hmm_lm, "BLOCK_BYTES", 400)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Red", "fox", "runs", "home", "Über", "x"]) for _ in range(rng.randrange(9))) for _ in range(30)]
    docs = rows(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    held = F.col("doc_id") % 4 == 0
    got = {r.doc_id: r for r in hmm_lm.score(docs, held, 2).collect()}
    tokens = [[w.lower() if w.isascii() else w.replace("Ü", "Ü").lower().replace("ü", "Ü") for w in t.split()] + ["\n"] for t in texts]
    train = [tokens[i] for i in range(30) if i % 4]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    kind = lambda w: hmm_lm.word_class(w.encode())
    n_class, v_class = Counter(), Counter()
    for w, c in counts.items():
        n_class[kind(w)] += c
        v_class[kind(w)] += 1
    model = hmm_lm.Model.first()
    for _ in range(2):
        model = hmm_lm.Model.estimated(slow_counts(model, [[kind(w) for w in t] for t in train]), hmm_lm.STATES, hmm_lm.CLASSES + 1)
    for i, t in enumerate(tokens):
        inside = sum(math.log10((counts[w] + 1) / (n_class[kind(w)] + v_class[kind(w)] + 1)) for w in t)
        assert got[i].train_tokens == n and got[i].n_known == sum(counts[w] > 0 for w in t)
        assert abs(got[i].base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) < 1e-9
        assert abs(got[i].score - inside - slow_log(model, [kind(w) for w in t])) < 1e-6


# Near duplicates


def test_classes_of_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:k], "edit", *base[k + 1 :]])
    data = [(5, " ".join(base), None, None), (7, near(3), None, None), (7, "something else that has six words", None, None), (None, near(50), None, None), (None, None, None, None), (9, "", None, None), (2, "something else that has six words", None, None), (2, "something else that has six words", None, None)]
    got = dart_minhash.near_duplicates(rows(spark, data)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == sorted([("5", "5", 3), ("7", "5", 3), ("7", "2", 3), ("None", "5", 3), ("None", "9", 2), ("9", "9", 2), ("2", "2", 3), ("2", "2", 3)])
    kept = dart_minhash.drop_near_duplicates(rows(spark, data))
    assert kept.columns == rows(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 9]


def test_levels_agree_as_weights_do():
    rng = np.random.default_rng(8)
    e = rng.integers(0, 2**63, 40).astype(np.uint64)
    for w, x in ((1000.0, 700.0), (5.0, 4.0), (0.5, 0.25), (3.0, 3.0)):
        s = dart_minhash.signatures([(e, np.full(40, w)), (e, np.full(40, x))], 4000)
        assert abs((s[0] == s[1]).mean() - min(w, x) / max(w, x)) < 0.05
    began = time.perf_counter()
    dart_minhash.signatures([(e[:5], np.full(5, 1e6))], 80)
    assert time.perf_counter() - began < 10  # not a step for each unit of weight


# Long texts


LONG = 5 << 20


def test_long_texts():
    words = [f"wörd{i}" for i in range(3000)]
    rng = random.Random(1)
    text = " ".join(rng.choice(words) for _ in range(LONG // 8))
    assert len(text.encode()) > LONG
    began = time.perf_counter()
    grams, counts = langid.gram_counts(text)
    assert counts.sum() == sum(naive_grams(text).values())
    sets = dart_minhash.shingles([text.encode()])
    assert len(sets[0]) == len(text.split()) - 4
    cut = dart_minhash._CHUNK
    dart_minhash._CHUNK = 1 << 30
    try:
        assert np.array_equal(dart_minhash.shingles([text.encode()])[0], sets[0])
    finally:
        dart_minhash._CHUNK = cut
    lexicon = toxicity.Lexicon({" wörd": 3.0}, frozenset({" wörd wördi "}), (0.0, 1.0, 1.0, 1.0))
    assert toxicity.measures(lexicon.automaton(), toxicity.fold(text.translate({ord(c): "i" for c in "0123456789"})))[0] > 1000
    sequence = np.frombuffer(bytes(hmm_lm.word_class(w) for w in hmm_lm.tokens(text)[:200_000]), np.uint8)
    assert hmm_lm.expected_counts(hmm_lm.Model.first(), [sequence, *[sequence[:1]] * 5000])[: hmm_lm.STATES].sum() == pytest.approx(5001)
    assert time.perf_counter() - began < 240


def test_a_long_text_among_others(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    text = " ".join(rng.choice(words) for _ in range(400_000))
    docs = rows(spark, [(1, text, "en", "a"), (2, text + " tail", "en", "a"), (3, "short", "en", "b")])
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.lang_pred for r in langid.predict(docs, langid.learn_profiles(docs)).collect()} == {"en"}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed").collect()} == {1: len(text), 2: len(text), 3: 0}


# Images


def turned(image, quarters):
    return np.rot90(image, quarters)


def naive_best(query, image, distance, agree):
    """The most corners that agree, by all corners and all bins."""
    best = 0
    bins = {}
    for qy, qx, qs, qt, qh, ql in query:
        for y, x, s, t, h, low in image:
            far = ((qh ^ h) & (2**64 - 1)).bit_count() + ((ql ^ low) & (2**64 - 1)).bit_count()
            if far > distance:
                continue
            k = math.floor((t - qt + media.TURNS // 8) / (media.TURNS // 4)) % 4
            zoom = qs / s
            ry, rx = [(qy, qx), (qx, -qy), (-qy, -qx), (-qx, qy)][k]
            dy, dx = y - ry * zoom, x - rx * zoom
            for i, j in itertools.product((0, 1), repeat=2):
                bins.setdefault((round(zoom, 3), k, i, j, math.floor(dx / 4 + i / 2), math.floor(dy / 4 + j / 2)), set()).add((qy, qx))
    best = max(map(len, bins.values()), default=0)
    return best if best >= agree else 0


def test_copies_of_a_naive_comparison(spark):
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(i, rng.standard_normal(32).tolist()) for i in range(14)], "image_id long, vector array<double>")
    pictures = media.render(frame).collect()
    pixels = {r.image_id: media.read_pgm(r.media) for r in pictures}
    edits = [lambda a: a[5:-3, 2:-6] * 0.8 + 20, lambda a: turned(a, 1), lambda a: turned(a[4:, 3:], 2), lambda a: turned(a, 3), lambda a: media._reduced(a.astype(float), 0.75)]
    asked = [(100 + i, media.write_pgm(np.clip(edits[i % 5](pixels[i]), 0, 255))) for i in range(10)]
    images = media.classes(media.describe(media.render(frame)))
    queries = media.classes(media.describe(spark.createDataFrame(asked, "image_id long, media binary")))
    got = {(r.query_id, r.class_id): r.inliers for r in media.find_copies(queries, images).collect()}
    own = {i: media.describe_pixels(p) for i, p in pixels.items()}
    want = {}
    for q, m in asked:
        described = media.describe_pixels(media.read_pgm(m))
        for i, corners in own.items():
            if n := naive_best(described, corners, media.DISTANCE, media.AGREE):
                want[q, i] = n
    assert {k for k in want if k[0] - 100 == k[1]} == {(100 + i, i) for i in range(10)}
    assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got) and len(got) >= 0.9 * len(want)


def naive_place(query, image, distance, agree):
    """(inliers, dx, dy, zoom, quarter) of the best bin, by all corners and all bins."""
    votes = {}
    for (qy, qx, qs, qt, qh, ql), (y, x, s, t, h, low) in itertools.product(query, image):
        if ((qh ^ h) & (2**64 - 1)).bit_count() + ((ql ^ low) & (2**64 - 1)).bit_count() > distance:
            continue
        k = math.floor((t - qt + media.TURNS // 8) / (media.TURNS // 4)) % 4
        ry, rx = [(qy, qx), (qx, -qy), (-qy, -qx), (-qx, qy)][k]
        dy, dx = y - ry * round(qs / s, 3), x - rx * round(qs / s, 3)
        for i, j in itertools.product((0, 1), repeat=2):
            votes.setdefault((round(qs / s, 3), k, i, j, math.floor(dx / 4 + i / 2), math.floor(dy / 4 + j / 2)), {})[qy, qx, qt, y, x, t] = (dx, dy)
    bins = [(len({v[:2] for v in own}), -abs(b[0] - 1), b[0], -b[1], *(math.floor(statistics.fmean(d) * 10 + 0.5) / 10 for d in zip(*own.values()))) for b, own in votes.items()]
    n, _, zoom, k, dx, dy = max(bins, default=(0,) * 6)
    return (n, dx, dy, zoom, -k) if n >= agree else None


def test_places_of_a_naive_comparison(spark):
    rng = np.random.default_rng(10)
    near = rng.standard_normal(32)
    vectors = [(near + 0.02 * (i % 3) * rng.standard_normal(32) if i < 5 else rng.standard_normal(32)).tolist() for i in range(8)]
    pictures = media.render(spark.createDataFrame(list(enumerate(vectors)), "image_id long, vector array<double>"))
    images = common.written(media.classes(media.describe(pictures)), "images")
    queries = common.written(media.classes(media.describe(media.edited(pictures))), "queries")
    corners = lambda df: {r.class_id: [tuple(c) for c in r.corners] for r in df.collect()}
    want = {(q, i): place for (q, a), (i, b) in itertools.product(corners(queries).items(), corners(images).items()) if (place := naive_place(a, b, media.DISTANCE, media.AGREE))}
    pairs = queries.select(F.col("class_id").alias("query_id")).crossJoin(images.select("class_id"))
    got = {tuple(r)[:2]: tuple(r)[2:] for r in media._verified(pairs, queries, images, media.DISTANCE, media.AGREE).collect()}
    assert got.keys() == want.keys() and len(got) >= 10 and all(got[k] == pytest.approx(want[k], abs=0.11) for k in got)
    assert media._verified(pairs, queries, images, media.DISTANCE, media.AGREE, any_=True).count() == len(want)
    found = {tuple(r)[:2]: tuple(r)[2:] for r in media.find_copies(queries, images).collect()}
    best = {q: max((p[0], -i, p[1], p[2]) for (k, i), p in found.items() if k == q) for q in {q for q, _ in found}}
    assert {r.query_id: (r.inliers, -r.class_id, r.dx, r.dy) for r in media.find_best(queries, images).collect()} == best


# The pipeline, stage by stage


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as P

    docs = rows(spark, ODD)
    first = P.language(spark, docs, SF)
    letters = [d for d in ODD if d[1] and any(c.isalpha() for c in d[1])]
    assert sorted(str((r.doc_id, r.text)) for r in first.collect()) == sorted(str(d[:2]) for d in letters)
    second = P.exact(spark, common.written(first, "first"), SF)
    best = {}
    for i, t, *_ in letters:
        best[t] = max((x for x in (i, best.get(t)) if x is not None), default=None)
    assert sorted(str((r.text, r.doc_id)) for r in second.collect()) == sorted(str(x) for x in best.items())
    third = common.written(P.near(spark, common.written(second, "second"), SF), "third")
    assert third.count() == len(best) and third.columns == docs.columns
    mixed = common.written(P.mix(spark, third, SF), "mixed")
    sizes = {(r.doc_id, r.text): len(r.text.split()) for r in third.collect()}
    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(taken) <= set(sizes) and max(taken.values()) <= 2 and sum(sizes[k] * n for k, n in taken.items()) <= 1.5 * sum(sizes.values())
    last = P.encode(spark, mixed, SF)
    assert Counter(r.decoded_sha256 for r in last.collect()) == Counter({hashlib.sha256(t.encode()).hexdigest(): n for (_, t), n in taken.items()})
    unlabelled = rows(spark, [(1, "words without a label", None, None), (2, "?!", None, None)])
    assert [r.doc_id for r in P.language(spark, unlabelled, SF).collect()] == [1]
