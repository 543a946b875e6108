import numpy as np
import pytest

from meetpoint.llm import multiindex
from meetpoint.llm.queries import op12_multiindex


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    def unit(x):
        if not x or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            return None
        x = np.array(x, dtype=np.float64)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    vectors = [unit(x) for _, x, _ in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            u, v = vectors[a], vectors[b]
            if rows[a][2] is not None and rows[a][2] == rows[b][2] and u is not None and v is not None and len(u) == len(v) and (u * v).sum() >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    smallest = {}
    for k in range(n):
        if rows[k][0] is not None:
            smallest[root(k)] = min(rows[k][0], smallest.get(root(k), rows[k][0]))
    found = [(rows[k][0], links[k], smallest.get(root(k))) for k in range(n)]
    return sorted(((i, m, c, i == c) for i, m, c in found), key=str)


def groups(rng, n, width=16, noise=0.02):
    """Chains and crowds of near vectors, copies and lone ones, in three labels."""
    rows = []
    while len(rows) < n:
        x = rng.standard_normal(width)
        for _ in range(int(rng.choice([1, 1, 1, 3, 40]))):
            rows.append((len(rows) * 13 % 10_007, (x * float(rng.uniform(0.5, 2))).astype(np.float32).tolist(), int(rng.integers(3)) if rng.random() < 0.1 else len(rows) % 2))
            x = x + noise * rng.standard_normal(width) * float(rng.choice([0, 1, 2, 3]))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("recall, block", [(1.0, 1024), (0.9999, 1024), (1.0, 7)])
def test_equals_brute_force(spark, recall, block):
    rows = groups(np.random.default_rng(block), 500)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    assert got(multiindex.link_vectors(vectors, recall=recall, population=5, block=block)) == want
    assert sum(m for _, m, _, _ in want) > 500 and sum(k for *_, k in want) > 30


def test_the_bound_meets_all_pairs_and_recall_is_as_asked():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.2 * rng.standard_normal(x.shape) / np.sqrt(24)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (x * y).sum(axis=1) >= 0.98
    assert near.sum() > 1000
    for recall, least in ((1.0, 1.0), (0.99, 0.98), (0.9, 0.9)):
        index = multiindex.MultiIndex(x, 12, 0.98, recall)
        _, bounds = index.bounds(x)
        rows, cells = index.traverse(bounds)
        to, _ = index.bounds(y)
        home = to[0] * 12 + to[1]
        met = np.isin(np.arange(4000) * 144 + home, rows * 144 + cells)
        assert met[near].mean() >= least
        assert len(np.unique(rows * 144 + cells)) == len(rows)
    sums = [bounds[0][0][c // 12] + bounds[1][0][c % 12] for r, c in zip(rows, cells, strict=True) if r == 0]
    assert sums == sorted(sums)


def test_forest_keeps_components():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 9, 2)
        close = rng.random((n, m)) < 0.25
        r, c = multiindex.forest(close)
        assert close[r, c].all() and len(r) < n + m

        def labels(a, b, n=n, m=m):
            at = list(range(n + m))
            for _ in range(n + m):
                for x, y in zip(a, b, strict=True):
                    at[x] = at[n + y] = min(at[x], at[n + y])
            return at

        assert labels(r, c) == labels(*np.nonzero(close))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, -0.0], 2), (9, [1.0, 0.0], 2)]
    rows += [(10, [2.0, 0.1], 2), (11, [1.0, 0.0], 3), (12, [1.0, 0.0, 0.0], 2), (13, [1.0], 2), (14, [-1.0], 2), (None, [3.0], 2), (None, [5.0, 5.0], 9), (None, [5.0, 5.0], 9), (15, [1e-30, 1e-30], 2), (16, [1e30, 1e30], 2)]
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'x' as node", "2 as size", "3 as d1", "'y' as links").repartition(3)
    assert got(multiindex.link_vectors(wide)) == brute(rows)
    assert multiindex.link_vectors(wide.limit(0)).count() == 0
    assert got(multiindex.link_vectors(wide.where("vec_id <= 7"))) == brute(rows[:7])


def test_doubles_and_text_labels(spark):
    rows = [(k, [float(np.cos(k / 20)) * 1e200, float(np.sin(k / 20)) * 1e200], f"l{k % 2}") for k in range(120)]
    assert got(multiindex.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), recall=1.0, population=2)) == brute(rows)


def test_query(spark, tmp_path):
    rows = groups(np.random.default_rng(9), 400, 64)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(op12_multiindex(spark, str(tmp_path))) == brute(rows)
