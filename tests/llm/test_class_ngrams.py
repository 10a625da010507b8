import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from callweave.llm import class_ngrams as cn


def corpus():
    rng = random.Random(8)
    langs = [[f"{p}{i}" for i in range(30)] for p in ("En", "fr", "DE")]
    rows = []
    for k in range(300):
        words = rng.choice(langs)
        text = " ".join(rng.choice(words) if rng.random() < 0.9 else f"rare{rng.randrange(400)}" for _ in range(rng.randrange(60)))
        rows.append((k, text))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (None, "en1 en2 unseen"), (5, rows[5][1]), (1003, "É é " * 3000)]


def is_held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")


def test_against_the_formulas(spark, monkeypatch):
    rows, kept = corpus(), {}
    real = cn.exchange

    def watched(bigrams, n_units, *rest):
        kept["classes"], kept["matrix"] = real(bigrams, n_units, *rest)
        return kept["classes"], kept["matrix"]

    monkeypatch.setattr(cn, "exchange", watched)
    # Shares of 1 % and 0.4 % make all ways of looking words up matter.
    got = cn.scores(frame(spark, rows), n_classes=6, rounds=6, unit_share=0.01, table_share=0.004).collect()
    texts = [[*cn.words_of(t), cn.END] for _, t in rows]
    train = [not is_held_out(d) for d, _ in rows]
    c = Counter(w for w, t in zip(texts, train, strict=True) if t for w in w)
    n, v = sum(c.values()), len(c)
    own = [cn.END] + [w for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0])) if k >= 0.01 * n and w != cn.END]
    bucket = lambda w: zlib.crc32(w[-3:]) % cn.BUCKETS
    first = {w: int(kept["classes"][own.index(w) if w in own else len(own) + bucket(w)]) for w in {w for t in texts for w in t}}
    pairs = Counter(p for words, t in zip(texts, train, strict=True) if t for p in zip([cn.END, *words], words, strict=False))
    assert 20 < sum(w not in own for w in c) and sum(w not in c for w in first) > 0

    def matrix(of):
        m = np.zeros((6, 6))
        for (a, b), k in pairs.items():
            m[of[a], of[b]] += k
        return m

    def step(m, a, b):
        return (m[a, b] + cn.SMOOTH * (m.sum(0)[b] + 1) / (m.sum() + 6)) / (m[a].sum() + cn.SMOOTH)

    m = matrix(first)
    assert (m == kept["matrix"]).all()
    # Each pooled training word goes where its neighbours, and a few spread like its bucket's, are likeliest.
    after, before = {}, {}
    for (a, b), k in pairs.items():
        after.setdefault(a, Counter())[first[b]] += k
        before.setdefault(b, Counter())[first[a]] += k
    spread = {}
    for side, name in ((after, "after"), (before, "before")):
        for w in c:
            if w not in own:
                spread.setdefault((bucket(w), name), Counter()).update(side[w])
    final = dict(first)
    for w in c:
        if w in own:
            continue
        gain = []
        for k in range(1, 6):
            total = 0.0
            for side, name in ((after, "after"), (before, "before")):
                pool = spread[bucket(w), name]
                for j in range(6):
                    times = side[w][j] + cn.PRIOR * pool[j] / pool.total()
                    total += times * (math.log(step(m, k, j)) if name == "after" else math.log(step(m, j, k)) - math.log(m.sum(0)[k] + 1))
            gain.append(total)
        final[w] = 1 + int(np.argmax(gain))
    assert sum(final[w] != first[w] for w in c) > 10

    m, types = matrix(final), Counter(final[w] for w in c)
    total, want = m.sum(0), []
    for (d, _), words in zip(rows, texts, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10(step(m, final[a], final[b]) * (c[b] + 1) / (total[final[b]] + types[final[b]] + 1)) for a, b in zip([cn.END, *words], words, strict=False))
        want.append((d, is_held_out(d), len(words), sum(c[w] > 0 for w in words), n, pytest.approx(base), pytest.approx(score), pytest.approx(10 ** (-score / len(words)))))
    key = lambda r: (str(r[0]), r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rounds_against_plain_moves(spark):
    """Every round moves each unit of its third to the class that makes the bigrams likeliest, given the moves before it in its task."""
    rng = np.random.default_rng(3)
    u, c = 40, 5
    n = rng.integers(0, 6, (u, u)) * (rng.random((u, u)) < 0.4)
    bigrams = spark.createDataFrame([(a, b, int(n[a, b])) for a in range(u) for b in range(u) if n[a, b]], "a long, b long, n long")

    def matrix(classes):
        m = np.zeros((c, c))
        for a in range(u):
            for b in range(u):
                m[classes[a], classes[b]] += n[a, b]
        return m

    classes = np.r_[0, 1 + np.arange(u - 1) % (c - 1)]
    seen = [cn.likelihood(matrix(classes))]
    for part in (0, 1, 2, 0):
        want = classes.copy()
        for g in range(cn.GROUPS):
            m = matrix(classes)
            for x in (x for x in range(1, u) if x % 3 == part and x // 3 % cn.GROUPS == g):
                tries = []
                for k in range(c):
                    moved = m.copy()
                    for y in range(u):  # the neighbours' classes are those that the round began with
                        if y != x:
                            for row, col, k_ in ((x, y, n[x, y]), (y, x, n[y, x])):
                                old = (classes[x], classes[y]) if row == x else (classes[y], classes[x])
                                new = (k, classes[y]) if row == x else (classes[y], k)
                                moved[old] -= k_
                                moved[new] += k_
                    moved[classes[x], classes[x]] -= n[x, x]
                    moved[k, k] += n[x, x]
                    tries.append((cn.likelihood(moved), moved))
                best = max(range(1, c), key=lambda k: tries[k][0])
                if tries[best][0] > tries[classes[x]][0] + 1e-9:
                    want[x], m = best, tries[best][1]
        got = cn.moved(bigrams, classes, cn.class_matrix(bigrams, classes, c), part)
        assert (got == want).all()
        classes = got
        assert (cn.class_matrix(bigrams, classes, c) == matrix(classes)).all()
        seen.append(cn.likelihood(matrix(classes)))
    assert seen[-1] > seen[0]
    final, m = cn.exchange(bigrams, u, c, rounds=30)
    assert cn.likelihood(m) == pytest.approx(cn.likelihood(matrix(final))) and cn.likelihood(m) > seen[0]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 50, (7, 7)).astype(float)
    total = m.sum(0)
    share = (total + 1) / (total.sum() + 7)
    step = (m + cn.SMOOTH * share) / (m.sum(1)[:, None] + cn.SMOOTH)
    assert np.allclose(step.sum(1), 1)


def test_best_class_is_the_likeliest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        u, c = 12, 4
        n = rng.integers(0, 9, (u, u)).astype(float)
        classes = np.r_[0, rng.integers(1, c, u - 1)]

        def likelihood(classes, n=n, c=c):
            m = np.zeros((c, c))
            np.add.at(m, (classes[:, None] + 0 * classes, classes[None, :] + 0 * classes[:, None]), n)
            f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
            return f(m) - f(m.sum(0)) - f(m.sum(1)), m

        x = int(rng.integers(1, u))
        _, m = likelihood(classes)
        after, before = np.bincount(classes, n[x], c), np.bincount(classes, n[:, x], c)
        tries = []
        for k in range(1, c):
            other = classes.copy()
            other[x] = k
            tries.append(likelihood(other)[0])
        k = cn.best_class(int(classes[x]), m, after, before, n[x, x])
        assert tries[k - 1] == pytest.approx(max(tries))


def test_empty_table_and_no_training_rows(spark):
    assert cn.scores(frame(spark, []), rounds=1).count() == 0
    held = next(k for k in range(100) if is_held_out(k))
    (row,) = cn.scores(frame(spark, [(held, "a b")]), rounds=1).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
