"""Periodic runs (op12) against a brute-force search, and the digests of the query."""

import hashlib
import random
import zlib
from fractions import Fraction

from crewline.llm import periodic_runs as P


def brute(w):
    """Every maximal stretch of smallest period q and length >= max(6, 4 q), by direct comparison."""
    n, runs = len(w), set()
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, e + q - d)) for d in range(1, q)):
                runs.add((s, e + q - s, q))
            s = e + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    random.seed(7)
    docs = []
    for _ in range(300):
        n, alpha = random.randint(0, 90), random.choice([1, 2, 3, 20])
        w = [str(random.randrange(alpha)) for _ in range(n)]
        if n > 10 and random.random() < 0.5:
            a, p = random.randrange(n), random.randint(1, 7)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        docs.append(w)
    got = P._runs_of_chunk(docs)
    assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [brute(w) for w in docs]


def test_long_and_repeated_documents():
    w = ["x"] * 20000
    assert P._runs_of_chunk([w, w]) == [[(0, 20000, 1)], [(0, 20000, 1)]]
    w = [str(i % 7) for i in range(3000)] + ["y"] + [str(i % 3) for i in range(100)]
    assert sorted(P._runs_of_chunk([w])[0]) == [(0, 3000, 7), (3001, 100, 3)]


def expected(doc_id, text):
    words = P.WORD.findall(text or "")
    words = P.plant(words, doc_id)
    runs = brute(words)
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    best = P.best_run(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    row = {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(words) if i not in gone).encode()).hexdigest(),
    }
    return row


def test_query_digests(spark):
    planted = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    texts = [
        (planted, " ".join(f"w{i}" for i in range(60))),
        (1, "a b a b a b a b a b x"),
        (2, None),
        (3, ""),
        (None, "k k k k k k k"),
        (4, "Über\tdas das\ndas das das das  das ende"),
        (4, "Über\tdas das\ndas das das das  das ende"),
        (5, "q r s " * 3000),
    ]
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, runs string")
    got = sorted((r.asDict() for r in P.digests(P.find_runs(df)).drop("n_words").collect()), key=str)
    assert got == sorted((expected(d, t) for d, t in texts), key=str)
    assert any(r["n_runs"] for r in got if r["doc_id"] == planted)


def test_best_run_ties():
    assert P.best_run([(5, 12, 2), (0, 12, 2), (1, 18, 3)]) == (0, 12, 2)
    assert P.best_run([(0, 13, 2), (3, 20, 3)]) == (3, 20, 3) if Fraction(20, 3) > Fraction(13, 2) else True


def test_empty_table(spark):
    assert P.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
