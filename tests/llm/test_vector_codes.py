import hashlib

import duckdb
import numpy as np
import pytest

from callweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=vc.ROUNDS, entries=vc.ENTRIES):
    """(vec_id, embedding, label) -> sorted (vec_id, code, error, label), and the codebooks, one vector at a time."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : p * w + w] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for part, book in zip(parts, books):
            at = [near(x, book)[1] for x in part]
            for k in set(at):
                own = [x for x, a in zip(part, at) if a == k]
                book[k] = [sum(c) // len(own) for c in zip(*own)]
    last = [[near(x, book) for x in part] for part, book in zip(parts, books)]
    return sorted((str(i), "".join(f"{last[p][r][1]:02x}" for p in range(4)), sum(last[p][r][0] for p in range(4)), str(label)) for r, (i, _, label) in enumerate(kept)), books


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, str(r.label)) for r in df.collect())


def vectors(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    return [(i, [float(np.float32(x)) for x in centre[i % 5] + 0.3 * rng.normal(size=dim)], i % 3) for i in range(n)]


@pytest.mark.parametrize("owned", [7, vc.OWNED])
def test_equals_rounds_by_hand(spark, owned):
    rows = vectors(400)
    rows += [(i, rows[0][1], None) for i in range(1000, 1150)]  # a hot entry, ties
    rows += [(5, rows[5][1], 2), (5, rows[5][1], 2), (5, rows[9][1], 2), (None, rows[3][1], 1)]  # repeated rows and ids, no id
    rows += [(1, None, 0), (2, [], 0), (3, [1.0] * 7 + [None], 0), (4, [float("inf")] + [0.0] * 7, 0), (6, [float("nan")] * 8, 1)]
    coded, books = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), owned=owned)
    want, want_books = plain(rows)
    assert got(coded) == want
    assert books.tolist() == want_books


def test_large_components_stay_exact(spark):
    rows = [(i, [x * s for x in v], k) for (i, v, k), s in zip(vectors(60), [1.0, 900.0, 60_000.0] * 20)]
    coded, _ = vc.compress(spark.createDataFrame(rows, SCHEMA))
    assert got(coded) == plain(rows)[0]
    with pytest.raises(Exception, match="a component is"):
        vc.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], SCHEMA))


def test_first_vectors_of_repeated_ids(spark):
    """Equal ids by their components as numbers, null ids last."""
    rows = [(2, [0.0] * 4, 0), (None, [-1.0] * 4, 0), (1, [0.5, 0.0, 0.0, 300.0], 0), (1, [0.5, 0.0, 0.0, -0.25], 0), (1, [-0.5, 9.0, 9.0, 9.0], 0), (1, [0.5, 0.0, 0.0, 2.0], 0)]
    whole = vc.saved(vc.whole_components(spark.createDataFrame(rows, SCHEMA)), "t")
    want = [(1, [-512, 9216, 9216, 9216]), (1, [512, 0, 0, -256]), (1, [512, 0, 0, 2048]), (1, [512, 0, 0, 307200]), (2, [0] * 4), (None, [-1024] * 4)]
    for n in (2, 4, 5, 9):
        assert [(r.vec_id, list(r.x)) for r in vc.first_vectors(whole, n)] == want[:n]


def test_few_vectors_no_vectors_odd_lengths(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0, 3.0, 4.0], 1), (1, [4.0, 3.0, 2.0, 1.0], 1), (3, [1.0], 1)], SCHEMA)
    assert got(vc.compress(df)[0]) == [("1", "00000000", 0, "1"), ("2", "01010101", 0, "1")]
    assert vc.compress(df.limit(0))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(df.filter("vec_id = 3"))


def test_members_that_stay_are_not_shuffled(spark):
    """Residents and arrivals meet in as many partitions as before: the union is of equal partitionings."""
    df = vc.saved(vc.whole_components(spark.createDataFrame(vectors(600), SCHEMA)), "t")
    books = np.stack([np.frombuffer(r.v, np.int32) for r in df.orderBy("vec_id").limit(16).collect()]).astype(np.int64).reshape(16, 4, -1).transpose(1, 0, 2).copy()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(vc.new_folder(spark, "t"))
    own = vc.Owners(4, 2, 2)
    residents = own.placed(df, books)
    for k in range(3):
        books[:, :, 0] += 40 * k
        residents, both = own.reassigned(residents, books)
        assert residents.getNumPartitions() == 4
        assert sum(n for n, _ in own.sums(residents).values()) == 2400
    moved = both.filter(lambda b: b[2]).map(lambda b: len(b[1][0]) // 8).sum()
    assert 0 < moved < 2400


def test_query_and_sql(spark, tmp_path):
    rows = [(i, v, None if k == 2 else k) for i, v, k in vectors(300, 16)] + [(900, None, 1), (901, [float("nan")] * 16, 1)]
    clash = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA + ", row int, v string, n int")
    clash.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    out = vc.op11_member_resident_lloyd(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(vc.ORACLE["op11_member_resident_lloyd"])
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in out.collect())
    _, books = plain(rows)
    assert out.first().codebooks_sha256 == hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
