import importlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from callweave.llm import pipeline as corpus_pipeline
from callweave.llm import decontamination, mixing, near_duplicates, quality_rules, wavelet

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {"documents": set(rows)}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = wavelet.saved(stage(spark, frame, SF), "t")
        assert frame.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id for r in frame.select("doc_id").collect()}
        assert frame.count() == len(kept[name])
    judged = {r.doc_id: r for r in quality_rules.op9_quality_outliers(spark, SF).collect()}
    assert kept["quality rules"] == {d for d, r in judged.items() if r.kept}

    # Of each group of texts with Jaccard similarity of 0.8 or more the least id is left.
    grams = {d: set(near_duplicates.ngram_set(rows[d].text).tolist()) for d in kept["quality rules"]}
    root = {d: d for d in grams}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept["near duplicates"] == {d for d in grams if find(d) == d}

    exact = {d for d in kept["near duplicates"] if any(t in rows[d].text for _, t in bench)}
    gone = kept["near duplicates"] - kept["decontamination"]
    assert exact <= gone and gone == {d for d in kept["near duplicates"] if decontamination.search(decontamination.index_of(bench), [decontamination.folded(rows[d].text)])}

    plan = {r.doc_id: r._cw_mix.copies for r in mixing.mix_plan(frame).collect()}
    frame = wavelet.saved(corpus_pipeline.mixing(spark, frame, SF), "t")
    ids = sorted(r.doc_id for r in frame.collect())
    assert ids == sorted(d for d, n in plan.items() for _ in range(n)) and max(plan.values()) <= 3

    tokenizer = Tokenizer.from_file(wavelet.tokenizer_path())
    got = sorted(map(tuple, corpus_pipeline.tokens(spark, frame, SF).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d in ids:
        enc = [*tokenizer.encode(rows[d].text, add_special_tokens=False).ids, 2]
        want.append((d, at, len(enc), zlib.crc32(np.array(enc, "<u4").tobytes())))
        at += len(enc)
    assert got == want


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = wavelet.saved(stage(spark, docs, SF), "t")
    assert docs.count() == 0
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, d string, node string, _o int, x0 double, size int"


def odd_rows():
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(k, prose(80), "en", "a", 1) for k in range(30)]
    rows += [(None, prose(80), "en", "a", None), (40, prose(80), None, None, 1), rows[3], rows[3], (41, rows[4][1], "en", "a", 1), (None, rows[5][1], "en", "a", 1)]
    return [*rows, (50, None, None, None, None), (51, "", "en", "a", 0), (52, " \n", "en", "a", 2), (53, prose(60_000), "en", "a", 3), (None, None, None, None, None)]


def test_odd_rows_in_every_stage(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "d", "n", 1, 0.5, 2) for r in rows], COLUMNS)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        got[name] = out.collect()
    texts = lambda name: sorted((r.text for r in got[name]), key=str)
    worded = [r[1] for r in rows if r[1] and r[1].strip()]
    assert texts("quality rules") == sorted(worded)
    assert texts("near duplicates") == sorted([*set(worded), None, None, "", " \n"], key=str)
    assert {r.doc_id for r in got["near duplicates"] if r.text in (rows[4][1], rows[5][1])} == {4, 5}
    assert texts("decontamination") == sorted((r[1] for r in rows), key=str)
    assert len({r.text for r in got["mixing"]} - {r[1] for r in rows}) == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r.doc_id for r in tokens), key=str) == sorted((r[0] for r in rows), key=str)
    assert sum(r.n_tokens == 1 for r in tokens) == 3 and max(r.n_tokens for r in tokens) > 60_000
