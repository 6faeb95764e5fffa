"""Codebook compression (op11) against a plain integer k-means."""

import hashlib
import math

import numpy as np
import pytest

from crewline.llm import codebooks as C


def brute(rows):
    """rows: (vec_id, vector, label). The contract's procedure, written plainly."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], l) for i, v, l in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    dim = len(sorted(kept, key=lambda r: (r[0], r[1]))[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    part = dim // 4
    first = sorted(kept, key=lambda r: (r[0], r[1]))[:256]
    books = [[r[1][p * part : (p + 1) * part] for r in first] for p in range(4)]

    def nearest(x, book):
        return min(range(len(book)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, book[j])), j))

    for _ in range(4):
        for p in range(4):
            chosen = [nearest(r[1][p * part : (p + 1) * part], books[p]) for r in kept]
            for j in range(len(books[p])):
                members = [r[1][p * part : (p + 1) * part] for r, c in zip(kept, chosen) if c == j]
                if members:
                    books[p][j] = [sum(col) // len(members) for col in zip(*members)]
    out = []
    for i, v, l in kept:
        code = [nearest(v[p * part : (p + 1) * part], books[p]) for p in range(4)]
        err = sum(sum((a - b) ** 2 for a, b in zip(v[p * part : (p + 1) * part], books[p][code[p]])) for p in range(4))
        out.append((i, "".join(f"{c:02x}" for c in code), err, l))
    sums = {}
    for i, code, err, l in out:
        sums[l] = sums.get(l, 0) + err
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, code, err, sums[l], digest, l) for i, code, err, l in out), digest


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(11)
    centers = random.standard_normal((12, 16)) * 0.3
    out = []
    for i in range(700):
        v = centers[i % 12] + 0.05 * random.standard_normal(16)
        out.append((int(random.integers(0, 5000)), v.astype(np.float32).tolist(), ["a", "b", None][i % 3]))
    out += [(3, out[0][1], "a"), (3, out[0][1], "a")]  # repeated rows and ids
    out += [(9000, None, "a"), (9001, [1.0, None] * 8, "b"), (9002, [float("nan")] * 16, None), (9003, [1.0] * 8, "a")]
    return out


def test_equals_plain_kmeans(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(tuple(r) for r in C.coded(df).collect())
    want, _ = brute(rows)
    assert got == want


def test_bounds_keep_exact_assignment():
    random = np.random.default_rng(2)
    v = random.integers(-300, 300, (500, 16))
    c = random.integers(-300, 300, (64, 16))
    state, full = C._assign(v, c, None, None, 4)
    for _ in range(3):
        moved = c + random.integers(-20, 20, c.shape)
        drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + 1e-9) + 1e-9
        state, full = C._assign(v, moved, state, drift, 4)
        d = ((v[:, None, :] - moved[None, :, :]) ** 2).sum(2)
        assert state[0].tolist() == np.argmin(d, axis=1).tolist()
        c = moved
    assert full < 500


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [float("inf")] * 8, 2)], "vec_id long, embedding array<double>, label int")
    assert C.coded(df).count() == 0
