import math
import os
import random
import zlib

import numpy as np
import pytest

from callweave.llm import pairwise_quality as pq


def corpus():
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 120))]
        good = rng.random() < 0.7
        if not good:
            words = [w.upper() + rng.choice(("###", "!!")) for w in words] if k % 2 else [words[0]] * len(words)
        docs.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(good)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, "no id"), (5, docs[5][1]), (1003, "long " * 50000)]
    return docs, [*labels, (None, 1), (1, None), (77777, 0)]


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, x string, quality int"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = pq.scored(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if held(r.doc_id) and truth.get(r.doc_id) is not None]
    assert len(judged) > 60 and np.mean([p == y for p, y in judged]) > 0.95
    flipped = [(d, 1 - q if held(d) and q is not None else q) for d, q in labels]
    again = pq.scored(*frames(spark, docs, flipped)).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)  # held-out labels are not learnt from


def test_no_labels_and_empty_table(spark):
    docs, _ = corpus()
    frame, none = frames(spark, docs, [])
    assert {r.score for r in pq.scored(frame, none).collect()} == {0.5}
    assert pq.scored(frame.limit(0), none).count() == 0


def test_weights_minimise_the_loss():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.5, 1, (200, 3)), rng.normal(0, 1, (150, 3))
    w = pq.fit_pairs(good, bad)
    assert (w > 0).all()
    assert np.mean(good @ w) > np.mean(bad @ w)


def plain_features(text):
    """The vector of a text, counted by hand."""
    data = (text or "").encode()
    words, size = data.split(), max(1, len(data))
    if not words:
        return [0.0] * len(pq.NAMES)
    share = lambda chars: sum(data.count(bytes([c])) for c in chars) / size
    lines = [x.strip() for x in data.split(b"\n") if x.strip()]
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    longest = sorted(words, key=lambda w: (len(w), w))[-1]
    out = {
        "words": math.log(1 + n),
        "word_length": math.log(sum(len(w) for w in words) / n),
        "chars_line": math.log(1 + size / len(lines)),
        "symbols": math.sqrt(share(b"#*$%&|<>")),
        "digits": math.sqrt(share(b"0123456789")),
        "capitals": math.sqrt(share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "marks": math.sqrt(share(b".;:")),
        "commas": math.sqrt(share(b",")),
        "calls": math.sqrt(share(b"!?")),
        "other_bytes": math.sqrt(share(bytes(range(128, 256)))),
        "caps_words": sum(w.isupper() for w in words) / n,
        "bare_words": sum(not w.isalpha() for w in words) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n,
        "long_words": sum(len(w) > 12 for w in words) / n,
        "same_words": (n - len(set(words))) / n,
        "same_next": math.sqrt(sum(words[i] == words[i + 1] for i in range(n - 1)) / n),
        "same_lines": math.sqrt((len(lines) - len(set(lines))) / len(lines)),
        "same_windows": math.sqrt((len(windows) - len(set(windows))) / len(windows)) if windows else 0.0,
        "longest_word": words.count(longest) / n,
        "one_line": float(len(lines) == 1),
        "bars": math.sqrt(share(b"|")),
        "blanks": share(b" \t\n\x0b\x0c\r"),
    }
    return [out[k] for k in pq.NAMES]


def test_features_against_plain_counts():
    docs, _ = corpus()
    texts = [t for _, t in docs] + ["A|b, c.\n\nA|b, c.\n 12; é!? é!? é!? x", "one", "ab ab", "WORD 12 a1 thirteenletters", "z\x0b\x0cz\r\n"]
    for text in texts:
        assert pq.features(text).tolist() == pytest.approx(plain_features(text), abs=1e-6), text


def test_weights_against_plain_descent():
    """The weights are where a gradient descent on the same loss ends."""
    rng = np.random.default_rng(1)
    good, bad, partners, ridge = rng.normal(0.4, 1, (40, 3)), rng.normal(0, 1, (25, 3)), 4, 0.7
    w = pq.fit_pairs(good, bad, partners=partners, ridge=ridge)
    draw = np.random.default_rng(20240)
    pairs = [(i, None) for i in range(len(good)) for _ in range(partners)] + [(None, j) for j in range(len(bad)) for _ in range(partners)]
    firsts = draw.integers(0, len(good), len(bad) * partners).tolist()
    seconds = draw.integers(0, len(bad), len(good) * partners).tolist()
    d = np.array([good[i if i is not None else firsts.pop(0)] - bad[j if j is not None else seconds.pop(0)] for i, j in pairs])
    v = np.zeros(3)
    for _ in range(20_000):
        slope = ridge * v
        for k in range(3):
            slope[k] -= (d[:, k] / (1 + np.exp(d @ v))).mean() * (len(good) + len(bad))
        v -= 0.005 * slope
    assert w.tolist() == pytest.approx(v.tolist(), abs=1e-6)


def test_scores_against_plain_python(spark):
    docs, labels = corpus()
    got = {}
    for r in pq.scored(*frames(spark, docs, labels)).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    vectors = {d: np.float32(plain_features(t)).astype(float) for d, t in docs}
    use = [(d, y) for d, y in labels if d is not None and y is not None and d in vectors and zlib.crc32(str(d).encode()) % 4 != 2]
    use += [(d, y) for d, y in use if d == 5]  # document 5 is there twice
    hashes = {r.id: r.h for r in spark.range(2000).selectExpr("id", "xxhash64(id) AS h").collect()}
    use.sort(key=lambda p: (hashes[p[0]], p[0], p[1]))
    x, y = np.array([vectors[d] for d, _ in use]), np.array([q for _, q in use], bool)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)

    def expanded(v):
        z = np.minimum(np.maximum((v - mean) / scale, -6), 6)
        return np.r_[z, abs(z)]

    z = np.array([expanded(v) for v in x])
    w = pq.fit_pairs(z[y], z[~y])
    cut = float(np.quantile([v @ w for v in z], 1 - y.mean()))
    for d, _ in docs:
        want = 1 / (1 + math.exp(min(50, max(-50, -(expanded(vectors[d]) @ w - cut + math.log(0.7 / 0.3))))))
        assert all(s == pytest.approx(want, abs=1e-5) for s in got[d]), d
    # What lies at the threshold itself is predicted good, as are all rows with a score equal to it.
    assert 1 / (1 + math.exp(-math.log(0.7 / 0.3))) == pytest.approx(pq.CUT)


def test_tied_scores_at_the_threshold(spark):
    docs = [(k, "good words here " * 5 if k % 2 else "BAD ### !!! " * 5) for k in range(200)]
    got = pq.scored(*frames(spark, docs, [(k, k % 2) for k in range(200)])).collect()
    assert len({round(r.score, 9) for r in got}) == 2 and all(r.predicted == r.doc_id % 2 for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_ranking_of_held_out_labels(spark):
    got = {r.doc_id: r for r in pq.op10_pairwise_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for s, q in labels if q == 1], [s for s, q in labels if q == 0]
    assert len(good) > 20 and len(bad) > 3
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.98


def labelled_vectors(spark, n, seed):
    """A table of vectors and labels, and the same as arrays."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.7
    x = (rng.normal(0, 1, (n, len(pq.NAMES))) + 0.3 * y[:, None] * np.linspace(-1, 1, len(pq.NAMES))).astype(np.float32)
    ids = np.array([k for k in range(2 * n) if zlib.crc32(str(k).encode()) % 4 != 2][:n])
    vectors = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)], "doc_id long, x array<float>")
    return vectors, spark.createDataFrame([(int(k), int(q)) for k, q in zip(ids, y, strict=True)], "doc_id long, quality int"), x.astype(float), y


def test_every_label_and_pair_counts(spark):
    """Over 20,000 labels: mean, scale and threshold are those of all; the weights those of all pairs."""
    vectors, labels, x, y = labelled_vectors(spark, 21_000, 4)
    mean, scale, w, cut = pq.fit(vectors, labels)
    assert mean.tolist() == pytest.approx(x.mean(0).tolist(), abs=1e-9) and scale.tolist() == pytest.approx(x.std(0).tolist(), abs=1e-9)
    s = pq.expanded(x, mean, scale) @ w
    assert cut == pytest.approx(float(np.quantile(s, 1 - y.mean())), abs=1e-9) and (s >= cut).sum() == y.sum()
    vectors, labels, x, y = labelled_vectors(spark, 700, 5)
    mean, scale, w, _ = pq.fit(vectors, labels)
    z = pq.expanded(x, mean, scale)
    assert w.tolist() == pytest.approx(pq.fit_pairs(z[y], z[~y]).tolist(), abs=1e-7)


@pytest.mark.parametrize("values", [[3.5], [-1.0, -1.0, 2.0], [0.0, -0.5, 1e-300, -7e8, 12.25, 12.25, -3.0, 1e9]])
def test_exact_quantile(spark, values):
    numbers = np.array(values * 3)
    keys = spark.createDataFrame([(int(k), 1) for k in pq.ordered_bits(numbers)], "key long, n long")
    for share in (0.0, 0.3, 0.5, 1.0):
        assert pq.exact_quantile(keys, share, len(numbers)) == pytest.approx(float(np.quantile(numbers, share)), rel=1e-12, abs=1e-12)
