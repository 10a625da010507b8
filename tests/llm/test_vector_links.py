import duckdb
import numpy as np
import pytest

from callweave.llm import vector_links as vl

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    unit = []
    for _, v, _ in rows:
        x = np.array([np.nan if c is None else np.float64(np.float32(c)) for c in v or []])
        unit.append(x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None)
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(unit):
        for j in range(i):
            y = unit[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((v, n[i], least.get(find(i)), v == least.get(find(i))) for i, (v, _, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def at_cosine(rng, x, cos):
    y = rng.normal(size=len(x))
    y -= (x @ y) / (x @ x) * x
    return cos * x / np.linalg.norm(x) + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)


def planted(seed=0, dim=48):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(300)]
    rows += [at_cosine(rng, x, c) for x, c in zip(rows[:40], np.linspace(0.88, 0.99, 40))]
    rows += [3.5 * x for x in rows[:5]] + [rows[7]] * 12
    for centre, n, cos in ((rows[60], 150, 0.985), (rows[61], 90, 0.95), (rows[62], 60, 0.93)):
        rows += [at_cosine(rng, centre, cos) for _ in range(n)]
    return [(i, [float(np.float32(c)) for c in x], i % 4) for i, x in enumerate(rows)]


@pytest.mark.parametrize("block", [8, 128])
def test_equals_all_pairs(spark, block):
    rows = planted()
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 48, 0), (5003, [1.0] * 47 + [None], 1), (5004, [float("nan")] * 48, 1), (5005, [float("inf")] + [0.0] * 47, 1)]
    rows += [(5006, [1.0], 0), (5007, [2.0], 0), (5008, [-1.0], 0), (5009, [1e-40, 0.0], 0), (5010, [3e38, 0.0], None)]
    rows += [(None, rows[3][1], None), (3, rows[3][1], 1), (3, rows[3][1], 1), (None, [0.0, 5.0, 5.0], 0), (None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, want = got(vl.near_vectors(df, recall=0.99999, block=block)), brute(rows)
    # Ids that are null count as kept where their component has none either.
    assert out == sorted(((v, n, c, v == c) for v, n, c, _ in want), key=str)


def test_recall_right_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate([*x, *(at_cosine(rng, v, 0.9005) for v in x)])]
    found = vl.near_vectors(spark.createDataFrame(rows, SCHEMA)).filter("n_links > 0").count()
    assert found >= 2 * 392  # 0.98 of pairs that are chosen to be the hardest
    tables, probes, hit = vl.choose_tables(64, 2)
    assert 1 - (1 - hit) ** tables >= vl.RECALL and tables * probes <= 24


def test_hadamard_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 32))
    y = vl.rotated(x, vl.signs(32, 2, 0)[0])
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(x, y)
    own = vl.buckets(x, vl.signs(32, 2, 0), 4)
    assert (own[:, 0] == vl.buckets(x, vl.signs(32, 2, 0), 1)[:, 0]).all() and all(len(set(r)) == 4 for r in own.tolist())
    assert [vl.rotations(64, n) for n in (10, 10**5, 10**6, 10**9)] == [2, 2, 3, 4]


def test_sign_bits_tell_pairs_apart():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([at_cosine(rng, v, 0.9) for v in x])
    a, b = (vl.sketches(v, 64).view(np.uint64) for v in (x, y))
    assert vl.most_bits(0.9) == 23 and np.bitwise_count(a ^ b).max() <= 23
    assert (np.bitwise_count(a ^ np.roll(a, 1)) <= 23).mean() < 0.03
    few = np.pad(x[:50, :5], ((0, 0), (0, 3)))
    assert len(set(vl.sketches(few, 5).tolist())) == 50


def test_double_components(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1.0000001e-200], 0), (3, [1.0, -1.0], 0), (4, [1e308, 1e308], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(vl.near_vectors(df)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vl.near_vectors(df).count() == 0
    assert got(vl.near_vectors(spark.createDataFrame([(4, None, 1)], SCHEMA))) == [(4, 0, 4, True)]


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in planted(3, 16) if r[0] % 3 == 0][:150]
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", node int, row long, v string").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(vl.ORACLE["op12_cross_polytope_links"])
    assert want.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(want.fetchall(), key=str) == got(vl.op12_cross_polytope_links(spark, f"file://{tmp_path}")) == brute(rows)
