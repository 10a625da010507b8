import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from callweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie by prefixes of lists."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def under(p):
        return [p] + [x for q in children[p] for x in under(q)]

    out = []
    for p in members:
        tree = under(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(not children[q] for q in tree), saved, sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(n, deep=0, seed=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        base = rng.choice([["a"], ["a", "b"], ["a", "b", "a"], ["c"]])
        turns = base + [rng.choice("xyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 4))]
        rows += [(c * 3, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    for c in range(deep):
        rows += [(100_000 + c, k, "user", f"t{k}" if k < 40 + c else f"own {c}") for k in range(60)]
    return rows


@pytest.mark.parametrize("most, least", [(pt.MOST_TURNS, pt.LEAST_TURNS), (20, 20), (1, 1)])
def test_equals_prefixes_of_lists(spark, most, least):
    rows = conversations(150, 3)
    rows += [(None, 0, "user", "x"), (7000, None, None, None), (7000, None, "user", None), (7000, 1, "user", "é😀"), (7000, 1, "user", "é😀"), (7001, 5, None, "z" * 50_000), (8000, 0, "user", "a")]
    rows += [(20_000 + k, t, "user", "same") for k in range(0, 60) for t in range(3)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pt.trie(df, most, least)) == plain(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)
    assert pt.trie(df).count() == 0 and pt.trie(df).columns == COLUMNS
    # Turns of a family's first conversation only as far as it has any; nothing is left of shorter ones.
    few = [(c, t, "user", "x") for c in range(500, 512) for t in range(1 + c % 2)]
    assert got(pt.trie(spark.createDataFrame(few, SCHEMA))) == plain(few)
    alone = [(c, 0, "user", "x") for c in range(601, 612)]  # without a first one
    assert got(pt.trie(spark.createDataFrame(alone, SCHEMA))) == plain(alone)


def test_ids_are_hashed_in_numeric_order_over_chunks(spark):
    rows = [(c * 101, 0, "user", "x") for c in range(300)]
    chains = pt.rebuilt_chains(spark.createDataFrame(rows, SCHEMA))
    found = {r.depth: (r.n, r.ends) for r in pt.ended_at(chains, ids=7).collect()}
    ends = [r for r in plain(rows) if r[3] and r[1] in found]
    assert {r[1]: r[7] for r in ends if r[7] != hashlib.sha256(b"").hexdigest()} == {d: s for d, (_, s) in found.items()}


def test_common_beginnings_are_divided(spark):
    rows = [(c, t, "user", "same" if t < 5 else f"{c % 40} {t}") for c in range(400) for t in range(10)]
    ended = pt.ended_at(pt.rebuilt_chains(spark.createDataFrame(rows, SCHEMA)))
    # Forty different conversations of ten turns, of which the first five are all the same.
    assert [pt.division(ended, most) for most in (10**6, 300, 100, 1)] == [0, 3, 6, 6]


def test_query_and_sql(spark, tmp_path):
    rows = conversations(80, 2, seed=3)
    spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA + ", depth int, chain binary").write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(pt.ORACLE["op13_truncation_peeling"])
    assert sorted(want.columns) == sorted(COLUMNS)
    assert sorted(want.select(*COLUMNS).fetchall(), key=str) == got(pt.op13_truncation_peeling(spark, f"file://{tmp_path}")) == plain(rows)
