import random

import numpy as np

from callweave.llm import decontamination as dc


def best(window, text):
    """Least edits of the window against any part of the text, by the full table."""
    points, steps = np.array([ord(c) for c in text], np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(window, 1):
        new = np.r_[i, np.minimum(row[:-1] + (points != ord(x)), row[1:] + 1)]
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def prose(rng, n):
    parts = ["the ", "of ", "and ", "in ", "ther", "ing ", "tion", "er", "an ", "Re", "ou, ", "é", "st. "]
    return "".join(rng.choice(parts) for _ in range(n))


def edited(rng, s, k):
    s = list(s)
    for _ in range(k if s else 0):
        at = rng.randrange(max(1, len(s)))
        kind = rng.randrange(3)
        s[at : at + (kind > 0)] = [rng.choice("xyz")] if kind < 2 else []
    return "".join(s)


def whole_words(item, text):
    """Whether the text holds the item with no letter or digit joined to one of the item's own ends."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        left = at > 0 and text[at - 1].isalnum() and item[0].isalnum()
        right = end < len(text) and text[end].isalnum() and item[-1].isalnum()
        if not left and not right:
            return True
        at = text.find(item, at + 1)
    return False


def brute(rows, items):
    out = set()
    for d, text in rows:
        t = "".join(map(chr, dc.folded(text or "")))
        for i, item in items:
            it = "".join(map(chr, dc.folded(item or "")))
            if not it.strip():
                continue
            if len(it) < 40:
                hit = whole_words(it, t)
            else:
                hit = any(best(it[w : w + n], t) <= n // 10 for n in {min(len(it), 96), min(len(it), 72)} if n < 72 or n in (96, 72, len(it)) for w in range(len(it) - n + 1))
            if hit:
                out.add((d, i))
    return out


def test_against_full_tables(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, n)) for k, n in enumerate((12, 15, 25, 30, 40, 70, 90))] + [(90, None), (91, ""), (92, "short"), (93, "Ox"), (94, "  "), (95, "7"), (96, "a short item, 30 characters"), (None, prose(rng, 22)), (0, prose(rng, 20))]
    rows = []
    for k in range(56):
        text = prose(rng, rng.randrange(0, 60))
        if k % 2:
            item = rng.choice(items)[1] or ""
            at = rng.randrange(len(text) + 1)
            cut = rng.randrange(max(1, len(item) // 3)) if k % 3 == 0 else 0
            text = text[:at] + (edited(rng, item[cut:], rng.randrange(0, 14)) if item[cut:] else "") + text[at:]
        rows.append((k, text.upper() if k % 5 == 0 else text))
    rows += [(600, "an ox."), (601, "oxen"), (602, "no. 7"), (603, "77 x7"), (604, "say: A SHORT ITEM, 30 characters!"), (605, "a short item, 31 characters"), (606, "a short item, 30 charactersx"), (607, items[-2][1])]
    rows += [(500, None), (501, ""), (502, items[3][1]), (502, items[3][1]), (None, items[4][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(docs, bench).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {i for _, i in want} >= {2, 3, 4, 5, 6, 93, 95, 96, None} and (601, 93) not in want
    assert len(got) == len({(r.doc_id, r.doc_key, r.item_id) for r in got})
    in_blocks = dc.contaminated(docs, bench, block_chars=150).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == want
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in rows if d not in {x for x, _ in want}), key=str)


def test_a_task_reads_each_block_once(spark, monkeypatch):
    """Several blocks, texts in many parts: each index is read once for all of them, and the matches are those of one block."""
    rng = random.Random(12)
    items = [(k, prose(rng, 60)) for k in range(20)]
    rows = [(k, prose(rng, 30) + (items[k % 20][1] if k % 3 == 0 else "") + prose(rng, 30)) for k in range(120)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r.doc_id, r.item_id, r.n_windows, r.start, r.stop, r.edits) for r in dc.contaminated(docs, bench).collect())
    uris, read, own = dc.written_blocks(bench, block_chars=300), [], dc.read_file
    monkeypatch.setattr(dc, "PART", 500)
    monkeypatch.setattr(dc, "read_file", lambda uri: read.append(uri) or own(uri))
    dc._block.cache_clear()
    found = [tuple(r.values()) for b in dc.look_up(uris, [(d, d) for d, _ in rows], [dc.folded(t) for _, t in rows]) for r in b.to_pylist()]
    assert sorted((d, i, *rest) for d, _, i, *rest in found) == whole
    assert sorted(read) == uris and len(uris) >= 10 and sum(len(t) for _, t in rows) > 20 * 500


def test_place_of_a_passage():
    rng = random.Random(2)
    item, text = prose(rng, 60), prose(rng, 200)
    found = dc.search(dc.index_of([(7, item)]), [dc.folded(text[:300] + item + text[300:])])
    (row,) = found
    assert row[:2] == (0, 0) and row[3:] == (300, 300 + len(item), 0)


def test_parts_of_an_item_at_every_offset():
    rng = random.Random(5)
    item, text = prose(rng, 110)[:230], prose(rng, 200)
    for size in (72, 75, 87, 95, 110):
        cuts = [item[at : at + size] for at in range(len(item) - size + 1)]
        found = dc.search(dc.index_of([(7, item)]), [dc.folded(text[:300] + c + text[300:]) for c in cuts])
        assert [f[0] for f in found] == [*range(len(cuts))]
        assert all(f[3] <= 300 and f[4] >= 300 + size and f[5] == 0 for f in found if size == 72)
    for at in range(0, len(item) - 100, 7):
        (row,) = dc.search(dc.index_of([(7, item)]), [dc.folded(text[:300] + edited(rng, item[at : at + 100], 4) + text[300:])])
        assert row[5] <= 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).count() == 0 and dc.drop_contaminated(docs, none).count() == 1
    assert dc.contaminated(docs.limit(0), spark.createDataFrame([(1, "y" * 100)], "item_id long, text string")).count() == 0


def test_edits_up_to_a_tenth_of_any_length():
    rng = random.Random(8)
    text = prose(rng, 100)
    for n in (40, 47, 50, 59, 60, 70, 71, 72, 80, 96):
        item = prose(rng, 60)[:n]
        for k in range(n // 10 + 1):
            at = set(range(5, 5 + 9 * k, 9)) if n > 60 else set(range(3, 3 + 8 * k, 8))
            other = "".join("\u4e00" if i in at else c for i, c in enumerate(item))
            found = dc.search(dc.index_of([(7, item)]), [dc.folded(text[:200] + other + text[200:])])
            assert len(found) == 1 and found[0][5] <= k


def test_pieces_of_long_items():
    rng = random.Random(3)
    item, text = prose(rng, 3000), prose(rng, 100)
    index = dc.index_of([(7, item)])
    assert len(index.row) > 2
    for at in (0, 1900, 1953, 2000, len(item) - 96):
        (row,) = dc.search(index, [dc.folded(text + item[at : at + 96] + text)])
        assert row[2] >= 1 + 96 - 72 + 1 and row[3] <= len(text) and row[4] >= len(text) + 96 and row[5] == 0
    (row,) = dc.search(index, [dc.folded(item)])
    assert row[2] == 2 * len(item) - 96 - 72 + 2
    again = dc.Index.from_bytes(index.to_bytes())
    assert dc.search(again, [dc.folded(item)]) == dc.search(index, [dc.folded(item)])


def test_repetitive_texts_in_slices(monkeypatch):
    rng = random.Random(4)
    items = [(1, "-" * 120), (2, "ab" * 60), (3, prose(rng, 80))]
    texts = ["-" * 900, "ab" * 300 + "-" * 130, prose(rng, 300) + items[2][1][10:100] + "ab" * 60, ""]
    index, points = dc.index_of(items), [dc.folded(x) for x in texts]
    whole = dc.search(index, points)
    monkeypatch.setattr(dc, "HITS", 500)
    assert sorted(dc.search(index, points)) == sorted(whole)
    assert {(d, r) for d, r, *_ in whole} == {(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)}
    spans = {(d, r): (lo, hi, e) for d, r, _, lo, hi, e in whole}
    assert spans[0, 0] == (0, 900, 0) and spans[1, 0][1] == 730


def test_memory_of_a_very_long_run():
    import subprocess
    import sys

    code = (
        "import resource; from callweave.llm import decontamination as dc\n"
        "index = dc.index_of([(1, '-' * 200)])\n"
        "((_, _, n, lo, hi, e),) = dc.search(index, [dc.folded('-' * 300_000)])\n"
        "assert (n, lo, hi, e) == (105 + 129, 0, 300_000, 0)\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 1000
