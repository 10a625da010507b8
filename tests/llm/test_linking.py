import random

import numpy as np

from callweave.llm import linking


def test_components(spark):
    rng = random.Random(0)
    names = rng.sample(range(-(10**9), 10**9), 900)
    edges = [(names[i], names[i + 1]) for i in range(299)]  # a chain
    edges += [(names[300], names[i]) for i in range(301, 500)]  # a star
    edges += [(names[rng.randrange(500, 900)], names[rng.randrange(500, 900)]) for _ in range(220)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = linking.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_rows_keep_what_keys_join():
    rng = np.random.default_rng(0)
    key, node = rng.integers(0, 400, 500), rng.integers(0, 300, 500)

    def groups(key, node):
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for k, n in zip(key.tolist(), node.tolist(), strict=True):
            root[find(("k", k))] = find(("n", n))
        return {frozenset(m for m in set(node.tolist()) if find(("n", m)) == find(("n", n))) for n in node.tolist()}

    k, n = linking.key_rows(key, node)
    assert groups(k, n) == groups(key, node) and set(key) <= set(k)
    assert [len(x) for x in linking.key_rows(key[:0], node[:0])] == [0, 0]


def test_compared_counts_every_link_of_any_group(spark):
    """Numbers that link where they differ by less than 10, in components of all sizes."""
    rng = random.Random(1)
    rows = [(100 * i + k, comp, 1, rng.randrange(1, 4), rng.randrange(span)) for comp, (n, span) in enumerate(((1, 5), (9, 40), (90, 12), (200, 45))) for i, k in zip(range(n), [comp] * n, strict=True)]
    rows = [(1000 * comp + i, comp, klass, copies, x) for i, (_, comp, klass, copies, x) in enumerate(rows)]

    def links(found, in_first):
        node, weight, x = (found.column(c).to_numpy() for c in ("node", "copies", "x"))
        i, j = np.nonzero(np.abs(x[:, None] - x[None, :]) < 10)
        keep = i < j if in_first is None else in_first[i] & ~in_first[j]
        return linking.local_links(node, weight, i[keep], j[keep])

    def steps(pivot, found):
        return np.abs(found.column("x").to_numpy() - pivot.column("x").to_numpy()[0]).astype(np.int32)

    nodes = spark.createDataFrame(rows, "node long, comp long, klass int, copies long, x long")
    for block in (8, 64):
        got = linking.compared(nodes, links, steps, 10, "t", block).collect()
        count, roots = {}, {}
        for r in got:
            count[r.node] = count.get(r.node, 0) + r.links
            roots.setdefault(r.node, set()).add(r.root)
        for n, comp, _, _, x in rows:
            want = sum(c for m, k, _, c, y in rows if m != n and k == comp and abs(x - y) < 10)
            assert count.get(n, 0) == want




def test_several_pivots_of_a_component(spark):
    """Clusters of numbers, some near each other, and single numbers between them: counts and what is joined."""
    rng = random.Random(2)
    centres = [rng.randrange(2000) for _ in range(7)]
    x = [rng.choice(centres) + rng.randrange(6) for _ in range(500)] + [rng.randrange(2000) for _ in range(200)]
    rows = [(10 * i + 3, 5, 1, rng.randrange(1, 3), v) for i, v in enumerate(x)] + [(100_000 + i, 6, 1, 1, 7 * i) for i in range(300)]  # a chain

    def links(found, in_first):
        node, weight, x = (found.column(c).to_numpy() for c in ("node", "copies", "x"))
        i, j = np.nonzero(np.abs(x[:, None] - x[None, :]) < 10)
        keep = i < j if in_first is None else in_first[i] & ~in_first[j]
        return linking.local_links(node, weight, i[keep], j[keep])

    def steps(pivot, found):
        return np.abs(found.column("x").to_numpy() - pivot.column("x").to_numpy()[0]).astype(np.int32)

    got = linking.compared(spark.createDataFrame(rows, "node long, comp long, klass int, copies long, x long"), links, steps, 10, "t", 8).collect()
    count, root = {}, {n: n for n, *_ in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for r in got:
        count[r.node] = count.get(r.node, 0) + r.links
        root[find(r.node)] = find(r.root)
    for n, comp, _, _, v in rows:
        near = [(m, c) for m, k, _, c, y in rows if m != n and k == comp and abs(v - y) < 10]
        assert count.get(n, 0) == sum(c for _, c in near)
        assert {find(m) for m, _ in near} <= {find(n)}
    by_value = sorted((comp, v, n) for n, comp, _, _, v in rows)
    assert all((find(a[2]) == find(b[2])) == (a[0] == b[0] and b[1] - a[1] < 10) for a, b in zip(by_value, by_value[1:]))
