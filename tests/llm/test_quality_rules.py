import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import quality_rules as qr

DOCS = "doc_id long, text string, lang string, source string, s string, x0 double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in qr.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(400):
        lang, source = rng.choice((("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, None)))
        n = rng.randrange(40, 300)
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
        if k % 9 == 0:
            words = [w + "###" for w in words]
        text = "".join(w + (rng.choice(" \n") if rng.random() < 0.1 else " ") for w in words)
        if k % 11 == 0:
            text = "\n".join([text[:90]] * 3 + [text])
        rows.append((k, text, lang, source))
    rows += [(1000 + k, rows[k][1], "xx", "tiny") for k in range(5)]
    rows += [(3000, " ".join(str(rng.randrange(10**6)) for _ in range(40_000)), "en", "b")]
    return rows + [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, " \n\t\r\x0b", None, "a"), (3, *rows[3][1:]), (None, rows[4][1], "en", "a"), (2003, "a b c " * 20_000, "en", "b"), (2004, "é# 漢字 ünï𝒳", "de", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in rows], DOCS)


def bin_at(values, share):
    v = np.sort(values)
    return v[math.ceil(share * len(v)) - 1]


def plain_mcd(x):
    """The same estimate for one group, with numpy on all points."""
    floors = np.array(qr.FLOORS)
    width = floors / 8
    half_away = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
    mid = np.array([bin_at(half_away(x[:, i] / width[i]), 0.5) for i in range(qr.P)]) * width
    mad = np.array([bin_at(half_away(np.abs(x[:, i] - mid[i]) / width[i]), 0.5) for i in range(qr.P)]) * width * 1.4826
    ridge = np.diag(floors**2)
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    bins = lambda d: np.floor(np.log(d + 1e-6) * 50)
    best = None
    for start in (np.diag(mad**2), np.zeros((qr.P, qr.P))):
        m, c = mid, start + ridge
        for _ in range(qr.STEPS):
            b = bins(dist(m, c))
            inside = x[b <= bin_at(b, 0.5)]
            m, c = inside.mean(0), np.cov(inside.T, bias=True) + ridge
        if best is None or np.linalg.det(c) < best[0] - 1e-15:
            best = np.linalg.det(c), m, c
    _, m, c = best
    c = c * max(1.0, math.exp((bin_at(bins(dist(m, c)), 0.5) + 1) / 50) / qr.CHI2_HALF)
    near = x[dist(m, c) <= qr.CHI2_NEAR]
    m, c = near.mean(0), np.cov(near.T, bias=True) + ridge
    return dist(m, c)


def test_against_numpy(spark):
    rows = corpus()
    docs = frame(spark, rows)
    measured = qr.measured(docs)
    out = qr.judged(measured, qr.fit(qr._points(measured)), "s").collect()
    values = [stats(t) for _, t, *_ in rows]
    assert sorted(tuple(r.s) for r in out) == sorted(values)
    failed = [n < 50 or 100 * rep > 50 * n for n, *_, rep in values]
    groups = Counter((lang, source) for (_, _, lang, source), f in zip(rows, failed, strict=True) if not f)
    members: dict = {}
    for k, ((_, _, lang, source), f) in enumerate(zip(rows, failed, strict=True)):
        if not f:
            members.setdefault((lang, source) if groups[lang, source] >= qr.MIN_GROUP else (lang,), []).append(k)
    want = Counter()
    for at in members.values():
        x = np.array([[math.log((c + 1) / (n + 1)), math.sqrt(s / (c + 1)), math.sqrt(max(d - 1, 0) / (nl + 1)), math.sqrt(r / (n + 1))] for n, c, s, nl, d, r in (values[k] for k in at)])
        far = plain_mcd(x) if len(at) >= qr.MIN_GROUP else np.zeros(len(at))
        for k, d2 in zip(at, far, strict=True):
            want[rows[k][0], bool(d2 <= qr.CUTOFF)] += 1
    for k, f in enumerate(failed):
        if f:
            want[rows[k][0], False] += 1
    assert Counter((r.doc_id, r._cw_kept) for r in out) == want
    assert 20 < sum(n for (_, kept), n in want.items() if not kept) < 150
    left = qr.filter_outliers(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for (d, kept), n in want.items() for _ in range(n) if kept)


def test_one_repeated_line_is_kept(spark):
    rng = random.Random(4)
    text = lambda n: "\n".join(" ".join(rng.choice(("so", "then", "words", "follow")) + str(rng.randrange(999)) for _ in range(12)) for _ in range(n))
    rows = [(k, text(rng.randrange(5, 12)), "en", "a") for k in range(200)]
    one, many = text(6), text(8)
    rows += [(900, one.replace("\n", "\nRead more\n", 2), "en", "a"), (901, many + ("\n" + many.split("\n")[0]) * 5, "en", "a")]
    kept = {r.doc_id for r in qr.filter_outliers(frame(spark, rows)).collect()}
    assert 900 in kept and 901 not in kept and len(kept) >= 199


def test_each_statistic_alone_rejects(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    line = lambda n=10: " ".join(word() for _ in range(n))
    rows = [(k, "\n".join(line() for _ in range(rng.randrange(6, 30))), "en", "a") for k in range(120)]
    # Clean too: one line of many comes again.
    rows += [(500 + k, "\n".join([x := line(), *[line() for _ in range(18)], x]), "en", "a") for k in range(3)]
    rows += [
        (1000, "\n".join(x for _ in range(20) for x in (line(), "abcd")), "en", "a"),  # half of the lines are equal
        (1001, "\n".join([p := " ".join(word() for _ in range(60)), *[line() for _ in range(18)], p + " end"]), "en", "a"),  # 40 % of the words come twice
        (1002, "\n".join(" ".join(word() + word() + word() for _ in range(10)) for _ in range(20)), "en", "a"),
        (1003, "\n".join(" ".join(word()[1:] + "#" for _ in range(10)) for _ in range(20)), "en", "a"),
    ]
    docs = frame(spark, rows)
    half, twice = stats(rows[-4][1]), stats(rows[-3][1])
    assert half[5] == 0 and 2 * half[4] > 0.9 * half[3] and twice[4] == 0 and 0.35 * twice[0] < twice[5] < 0.5 * twice[0]
    assert sorted(r.doc_id for r in qr.filter_outliers(docs).collect()) == [r[0] for r in rows[:-4]]


def test_empty_table(spark):
    assert qr.filter_outliers(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a b a b a b", "x " * 7, "a b c d a b c e b c d", "a b", ""])
def test_repeated_words(spark, text):
    (r,) = spark.createDataFrame([(text,)], "text string").select(qr.text_stats(F.col("text")).alias("s")).collect()
    assert r.s.n_repeat_words == stats(text)[5]
