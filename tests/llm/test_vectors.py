"""Exact top-k and vector near-duplicates against brute force."""

import math

import numpy as np
import pytest

from crewline.llm import capfilters, maxscore

SCHEMA = "vec_id long, embedding array<float>, label int, terms string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    rows = [(i, random.standard_normal(64).astype(np.float32).tolist(), int(i % 3)) for i in range(300)]
    base = random.standard_normal(64)
    rows += [(400 + i, (base + (0.12, 0.2, 0.26)[i % 3] * random.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(60)]
    rows += [(500 + i, rows[7][1], 1) for i in range(40)]  # copies across and within labels
    rows += [(0, rows[0][1], 0)]  # a row repeated whole
    rows += [(600, None, 1), (601, [1.0, None] * 4, 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1), (604, [0.0] * 8, 1)]
    rows += [(605, [], 1), (606, [1.0, 2.0], 1), (607, rows[7][1], None)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark, vectors):
    got = {}
    for r in maxscore.top_k_embeddings(table(spark, vectors)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    # Every row, repeated ones as often as they are there; a query's rows meet all rows of other ids.
    own = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vectors if usable(v)]
    want = {}
    for q in sorted({i for i, _ in own if i % 50 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(u, t)), i) for j, u in own if j == q for i, t in own if i != q)[:5]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_top_k_prunes_and_stays_exact():
    random = np.random.default_rng(5)
    weights = np.sign(random.standard_normal((3000, 32))) * np.floor(random.pareto(1.5, (3000, 32)) * 10)
    shard = maxscore.Shard(np.arange(3000), weights)
    for q in range(20):
        terms = weights[q]
        ids, scores = shard.search(q, terms, 5)
        full = weights @ terms
        order = [i for i in np.lexsort((np.arange(3000), -full)) if i != q][:5]
        assert ids.tolist() == order and scores.tolist() == full[order].tolist()


def test_top_k_few_and_large(spark):
    few = table(spark, [(50, [1.0], 0), (7, [2.0], 0), (None, [1.0], 0)])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in maxscore.top_k_embeddings(few).collect()] == [(50, 7, 256 * 512)]
    large = table(spark, [(50, [1e14], 0), (7, [1e14], 0)])
    assert maxscore.top_k_embeddings(large).first()["score"] == 2**63 - 1
    assert maxscore.top_k_embeddings(table(spark, [])).count() == 0


def brute_links(rows, threshold=0.93):
    fine = [(n, i, np.array(v, float), l) for n, (i, v, l) in enumerate(rows) if usable(v) and l is not None and any(v) and i is not None]
    links, up = {}, {i: i for i, _, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i, v, l in fine:
        for m, j, w, k in fine:
            if n != m and l == k and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[n] = links.get(n, 0) + 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted((i, links.get(n, 0), top(i), top(i) == i) for n, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_duplicates(spark, vectors, chunk):
    rows = [r for r in vectors if r[0] != 0]
    found = capfilters.near_duplicates(table(spark, rows), chunk=chunk)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found.collect()) == brute_links(rows)


def test_near_duplicates_of_nothing(spark):
    assert capfilters.near_duplicates(table(spark, [])).count() == 0


def test_recall_at_the_threshold():
    random = np.random.default_rng(9)
    x = random.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random.standard_normal((1500, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    found = []
    for side in (x, y):
        row, number = capfilters.decode(side, capfilters.Code())
        found.append({(int(r), int(f)) for r, f in zip(row, number)})
    assert len({r for r, _ in found[0] & found[1]}) >= 0.99 * 1500


def test_cap_filters_take_labels_of_any_type_and_double_vectors(spark):
    big = [1e300, 2e300, 0.0, 1e300]
    rows = [(1, big, "a"), (2, [x * 1.0000001 for x in big], "a"), (3, big, "b"), (4, [1.0, 0.0, 0.0, 0.0], "a long label " * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in capfilters.near_duplicates(df, threshold=0.93).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
