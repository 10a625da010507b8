import random
from collections import Counter

import pytest

from callweave.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, size long"


def corpus():
    rng = random.Random(1)
    rows = []
    for k in range(1500):
        source = rng.choice(["a"] * 12 + ["b", "c", "d"] * 2 + [None])
        rows.append((k, " ".join(["w"] * rng.randrange(1, 40)), "en", source, 7))
    return [*rows, (5000, None, "en", "a", 7), (5001, "", "en", "only empty", 7), rows[3], (None, "x y", "en", "b", 7), (5002, "long " * 50_000, "en", "a", 7)]


def targets(sizes):
    """Shares by weight, what is over three times a source going round again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_targets_and_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix_plan(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in plan:
        assert r._cw_mix.size == len((r.text or "").split()) and 0 <= r._cw_mix.copies <= 3
        sizes[r.source] += r._cw_mix.size
        taken[r.source] += r._cw_mix.size * r._cw_mix.copies
    want = targets(sizes)
    for r in plan:
        assert r._cw_mix.source_size == sizes[r.source] and r._cw_mix.target == pytest.approx(want[r.source])
    for s in ("b", "c", "d", None):
        assert abs(taken[s] - want[s]) < 0.15 * want[s]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +sum((Counter({r.doc_id: r._cw_mix.copies}) for r in plan), Counter())
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r._cw_mix.copies) for r in again) == sorted((str(r.doc_id), r._cw_mix.copies) for r in plan)


def test_empty_table_and_no_words(spark):
    assert mixing.mix_plan(spark.createDataFrame([], DOCS)).count() == 0
    (r,) = mixing.mix_plan(spark.createDataFrame([(1, None, None, None, 1)], DOCS)).collect()
    assert (r._cw_mix.size, r._cw_mix.target, r._cw_mix.copies) == (0, 0.0, 0)
