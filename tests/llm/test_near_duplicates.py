import random
from collections import Counter

import numpy as np
import pytest

from callweave.llm import near_duplicates as nd

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string"


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 40, 120, 400)))] for _ in range(40)]
    rows = []
    for k in range(260):
        w = list(base[k % 40] if k % 3 else base[k % 5])
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "one"), (5, rows[5][1]), (None, rows[6][1]), (None, None)]
    rows += [(2000 + i, " ".join(base[3][:-1] + [f"x{i % 50}"])) for i in range(300)]
    return rows


def sets(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i)) if s[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_against_all_pairs(spark, rows):
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_links_of_large_groups_by_pivot(spark, rows):
    got = nd.near_duplicates(frame(spark, rows), block=7).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_many_texts_of_one_id(spark):
    """Near copies under one id are as many texts as under ids of their own: texts are fetched by row."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for k in range(500):
        w = list(base)
        w[rng.randrange(120)] = f"x{k % 400}"
        texts.append(" ".join(w))
    own, one = [(k, t) for k, t in enumerate(texts)], [(7, t) for t in texts]
    links = lambda rows: sorted((r.n_links for r in nd.near_duplicates(frame(spark, rows)).collect()))
    assert links(one) == links(own) == sorted(n for *_, n in brute(own))
    assert nd.keep_one(frame(spark, one)).count() == nd.keep_one(frame(spark, own)).count() == 1


def test_keep_one(spark, rows):
    kept = nd.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "node"]
    want = Counter(d for d, c, _ in brute(rows) if d == c and d is not None)
    want[None] += 1  # the null text; the row with a text and no id is a copy of one with an id
    want[5] -= want[5] > 1
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k: v for k, v in want.items() if v})


def test_keep_one_of_rows_without_an_id(spark):
    text = "one two three four five six seven eight"
    kept = nd.keep_one(frame(spark, [(None, text), (None, text), (7, "other " * 9), (None, "other " * 9), (8, "other " * 9), (None, None), (None, "")]))
    assert sorted((r.doc_id or 0, r.text == text, not r.text) for r in kept.collect()) == [(0, False, True), (0, False, True), (0, True, False), (7, False, False)]


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(10**9)) for _ in range(200_000)]
    other = [*words[:100], "x", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000])), (4, "a " * 300_000), (5, "a " * 10)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 1), 5: (4, 1)}


def test_empty_table(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0
    assert nd.keep_one(frame(spark, [])).count() == 0


def test_bands_reach_recall():
    bands, rows = nd.choose_bands(0.8, 0.999, 160)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160


def test_shared_counts_match_sets():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 20000, n).astype(np.uint64)) for n in (0, 5, 9000, 3000)]
    b = [np.unique(rng.integers(0, 20000, n).astype(np.uint64)) for n in (7000, 1, 400)]
    assert (nd.shared_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
