"""Operators on documents against brute force."""

import collections
import hashlib
import math
import random
import re
import tempfile
import tracemalloc
import types
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from crewline.llm import induced_suffixes, linewindows, mixing, recurrent_lm, sentencepiece_lattice, toxicity, trie_join
from crewline.llm.common import components

SCHEMA = "doc_id long, text string, lang string, score double, n_tokens string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.1, "x") for i, t in rows], SCHEMA)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    pool = [f"w{i}" for i in range(400)]
    base = [r.choice(pool) for _ in range(120)]
    passage = "\n".join(" ".join(r.choice(pool) for _ in range(14)) for _ in range(4))
    rows = []
    for i in range(90):
        own = [r.choice(pool) for _ in range(r.choice([1, 3, 40, 90]))]
        if i % 4 == 0:
            own = base[:]
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = r.choice(pool)
        text = "".join(w + ("\n" if r.random() < 0.1 else " ") for w in own)
        if i % 5 == 0:
            text += "\n" + passage + "\nEnd É漢 " + str(i)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, rows[0][1]), (104, rows[0][1].upper()), (105, "a" * 700), (106, "ab" * 300)]
    return rows


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(None, 3), (5, 5)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((x["id"], x["component"]) for x in got) == sorted((x, top(x)) for x in up)


def brute_lines(rows, width=3):
    seen, out = set(), {}
    full = {i: [(n, re.sub(r"[\x09-\x0D]+", " ", x).strip(" ")) for n, x in enumerate((t or "").split("\n"))] for i, t in rows}
    for i, t in sorted(rows):
        own = [(n, x) for n, x in full[i] if x]
        gone = set()
        for s in range(len(own) - width + 1):
            key = tuple(x for _, x in own[s : s + width])
            if key in seen:
                gone |= {n for n, _ in own[s : s + width]}
            seen.add(key)
        lines = (t or "").split("\n")
        out[i] = (None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone), 0 if t is None else len(lines), len(gone))
    return out


def test_line_dedup(spark, texts):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linewindows.line_dedup(table(spark, texts)).collect()}
    assert got == brute_lines(texts) and any(x[2] for x in got.values())
    assert linewindows.line_dedup(table(spark, [])).count() == 0
    twice = linewindows.line_dedup(table(spark, [(None, "a\nb\nc"), (None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc")])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0, 0, 0] and twice[0].asDict().keys() >= {"lang", "score"}


def brute_groups(rows, n, percent):
    sets = {i: {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, len(sets[i]), top(i)) for i in sets)


@pytest.mark.parametrize("p", [trie_join.Join(), trie_join.Join(words=5, percent=80, trie=2, scouts=1)])
def test_ngram_groups(spark, texts, p):
    got = trie_join.ngram_groups(table(spark, texts), p).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(texts, p.words, p.percent)


def test_ngram_groups_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "A b c\td  e"), (9, None)]
    got = [tuple(r) for r in trie_join.ngram_groups(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2), (9, 0, 9)], key=str)
    assert trie_join.ngram_groups(table(spark, [])).count() == 0


def test_ngram_groups_leave_out_what_cannot_link(spark):
    """Texts that share a passage, but have too many n-grams of their own, meet nobody; near copies do."""
    own = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    passage = " ".join(f"p{j}" for j in range(20))
    rows = [(i, f"{own(i, 100)} {passage}") for i in range(30)] + [(100 + i, f"{own(99, 200)} end{i}") for i in range(4)]
    p = trie_join.Join()
    left = trie_join.not_alone(trie_join.described(table(spark, rows), p), p).select("rep").collect()
    assert {100, 101, 102, 103} <= {r["rep"] for r in left} and len(left) < 10
    got = trie_join.ngram_groups(table(spark, rows), p).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(rows, p.words, p.percent)


def test_sifted_keeps_every_number_wanted(spark):
    rows = spark.range(-3000, 3000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    wanted = rows.where("pmod(doc_id, 7) = 0").select(F.col("doc_id").alias("w"))
    got = {r["doc_id"] for r in trie_join.sifted(rows, "doc_id", wanted).collect()}
    must = {i for i in range(-3000, 3000) if i % 7 == 0}
    assert must <= got and len(got) < 2 * len(must)
    assert trie_join.sifted(rows, "doc_id", wanted.where("false")).count() == 0


def test_ngram_groups_meet_near_copies_through_few_pairs(spark, monkeypatch):
    """A group of near copies meets mostly what they were made of, so pairs grow with the group and not with its square."""
    r = random.Random(8)
    base = [f"b{j}" for j in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = base[:]
        for j in r.sample(range(80), 1):
            own[j] = f"e{i}x{j}"
        rows.append((i, " ".join(own)))
    seen, verify = [], trie_join.verify
    monkeypatch.setattr(trie_join, "verify", lambda pairs, reps, p: (seen.append(pairs.count()), verify(pairs, reps, p))[1])
    got = trie_join.ngram_groups(table(spark, rows)).collect()
    p = trie_join.Join()
    assert sorted(tuple(r) for r in got) == brute_groups(rows, p.words, p.percent)
    assert sum(seen) < 20 * len(rows), seen


def test_toxicity(spark):
    documents, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity(documents, labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    held = got[got["held_out"]]
    score, y = held["score"].to_numpy(), held["y"].to_numpy()
    auc = np.mean([(p > score[y == 0]).mean() + 0.5 * (p == score[y == 0]).mean() for p in score[y == 1]])
    assert auc > 0.97 and (held["predicted"] == y).mean() > 0.96


def test_toxicity_without_anything(spark):
    rows = table(spark, [(1, None), (2, ""), (None, "x"), (2, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(rows, none).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    some = spark.createDataFrame([(1, 1, None), (2, 1, 1), (2, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(rows, some).count() == 4 and toxicity.toxicity(table(spark, []), some).count() == 0


def test_toxicity_learns_in_bounded_memory():
    """Features are held in two bytes each, and what hashing needs beside them does not grow with the batch."""
    rng = np.random.default_rng(4)
    rows = [" ".join(f"w{i}x" for i in rng.integers(0, 10**6, 1500)) for _ in range(300)]
    batch = pd.DataFrame({"doc_id": range(300), "text": rows, "label": [i % 2 for i in range(300)]})
    tracemalloc.start()
    (out,) = toxicity._train(toxicity.Ftrl(passes=1))(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) and peak < 60e6


@pytest.mark.parametrize("numbers", [[], [0], [65535, 65536], [1, 2, 70000, 200000, 2**18]])
def test_packed_features(numbers):
    at = np.array(numbers, np.int64)
    assert toxicity.unpacked(*toxicity.packed(at)).tolist() == numbers


def brute_lm(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = [(i, [*words(t), None]) for i, t in rows]
    c = collections.Counter(w for i, own in tokens if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) for i, own in tokens}


@pytest.mark.parametrize("p", [recurrent_lm.Model(), recurrent_lm.Model(listed=200, modelled=60, rounds=2, lanes=8, window=5)])
def test_lm(spark, texts, p):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = recurrent_lm.score_documents(table(spark, texts), held, p).collect()
    want = brute_lm(texts)
    assert len(got) == len(want)
    for r in got:
        own = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == own[:4]
        assert r["base_score"] == pytest.approx(own[4], rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_lm_is_a_distribution():
    counts = np.array([50, 20, 9, 9, 3, 2, 2], float)
    v = recurrent_lm.Vocabulary(np.arange(7, dtype=np.uint64), counts, 5, np.array([4.0, 0.0, 2.0, 0.0]), recurrent_lm.Model(modelled=12, classes=3))
    w = recurrent_lm.initial(v, recurrent_lm.Model())
    rng = np.random.default_rng(1)
    w["to_class"] += rng.standard_normal(w["to_class"].shape).astype(np.float32)
    state = rng.standard_normal((1, 16)).astype(np.float32)
    every = np.arange(v.inputs)
    logp, _ = recurrent_lm._outputs(w, v, np.repeat(state, v.inputs, axis=0), every)
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_gradient():
    p = recurrent_lm.Model(modelled=40, classes=3, hidden=4, rate=1e-9)
    counts = np.array([50, 20, 9, 9, 3, 2, 2], float)
    v = recurrent_lm.Vocabulary(np.arange(7, dtype=np.uint64), counts, 5, np.zeros(4), p)
    rng = np.random.default_rng(2)
    w = {k: (x + 0.3 * rng.standard_normal(x.shape)).astype(np.float64) for k, x in recurrent_lm.initial(v, p).items()}
    codes, active = rng.integers(0, v.inputs, (6, 3)), np.array([3, 3, 2, 2, 2, 1])
    mask = np.arange(3)[None, :] < active[:, None]

    def loss(w):
        before = recurrent_lm._steps(w, codes, active, np.zeros((3, 4)))
        return -recurrent_lm._outputs(w, v, before[mask], codes[mask])[0].astype(float).mean()

    memory = {k: np.zeros_like(x) for k, x in w.items()}
    recurrent_lm._learn({k: x.copy() for k, x in w.items()}, memory, v, codes, active, np.zeros((3, 4)), p)
    for name, at in (("back", (1, 2)), ("back", (3, 10)), ("gates", (int(codes[0, 0]), 5)), ("to_class", (2, 1)), ("class_bias", (1,))):
        up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        slope = (loss(up) - loss(down)) / 2e-3
        assert math.sqrt(memory[name][at]) == pytest.approx(abs(slope), rel=0.03, abs=2e-4), name


def test_lm_with_far_logits():
    counts = np.array([50, 20, 9, 9, 3, 2, 2], float)
    v = recurrent_lm.Vocabulary(np.arange(7, dtype=np.uint64), counts, 5, np.zeros(4), recurrent_lm.Model(modelled=12, classes=3))
    w = recurrent_lm.initial(v, recurrent_lm.Model())
    w["to_class"][:] = np.linspace(-90, 90, w["to_class"].size, dtype=np.float32).reshape(w["to_class"].shape)
    w["to_word"][:] = np.linspace(90, -90, w["to_word"].size, dtype=np.float32).reshape(w["to_word"].shape)
    logp, _ = recurrent_lm._outputs(w, v, np.ones((v.inputs, 16), np.float32), np.arange(v.inputs))
    assert np.isfinite(logp).all() and np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_scores_in_bounded_memory():
    """What a window needs beside its batch does not grow with the texts of the batch."""
    counts = np.full(300, 40.0)
    p = recurrent_lm.Model()
    v = recurrent_lm.Vocabulary(np.arange(300, dtype=np.uint64), counts, 5, np.zeros(4), p)
    shared, packed = types.SimpleNamespace(value=vars(v)), recurrent_lm._packed(recurrent_lm.initial(v, p))
    batch = pd.DataFrame({"row": range(4000), "doc_id": range(4000), "held_out": False, "text": ["a b c d " * 8] * 4000})
    tracemalloc.start()
    (out,) = recurrent_lm._scored(shared, packed, p)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4000 and peak < 50e6


def test_lm_of_nothing(spark):
    assert recurrent_lm.score_documents(table(spark, []), F.lit(False)).count() == 0
    got = recurrent_lm.score_documents(table(spark, [(1, "a b"), (None, None)]), F.lit(True)).collect()
    assert [r["n_tokens"] for r in got] == [3, 1] and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 50))
def test_suffix_order(letters, limit):
    text = np.array([*letters, 0], np.uint16)
    with tempfile.TemporaryDirectory() as folder:
        got = induced_suffixes.suffix_order(text, folder, limit)
    own = text.tolist()
    assert got.tolist() == sorted(range(len(own)), key=lambda i: own[i:])


def brute_bytes(rows, length=100):
    raw, first = {i: (t or "").encode() for i, t in rows}, {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][s : s + length], (i, s))
    out = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if first[x[s : s + length]] != (i, s):
                gone[s : s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest())
    return out


def test_remove_repeats(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:5] for r in induced_suffixes.remove_repeats(table(spark, texts)).collect()}
    assert got == brute_bytes(texts) and sum(x[1] for x in got.values()) > 1000


def test_remove_repeats_of_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdef ", k=400))
    rows = [(None, long), (5, long), (5, long), (6, long[:99]), (7, None)]
    got = [tuple(r)[:4] for r in induced_suffixes.remove_repeats(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 400, 0, 0), (5, 400, 0, 0), (5, 400, 0, 0), (6, 99, 0, 0), (7, 0, 0, 0)], key=str)
    assert induced_suffixes.remove_repeats(table(spark, [])).count() == 0


def test_windows_of_a_common_passage(spark):
    r = random.Random(7)
    passage = "".join(r.choices("abcdefgh ", k=140))
    texts = [(i, "".join(r.choices("klmnopqr ", k=150)) + (passage if i % 3 else passage[:120]) + "".join(r.choices("stuvwxyz ", k=150))) for i in range(300)]
    texts += [(300, passage * 3), (301, texts[5][1]), (302, "a" * 700), (303, "a" * 650)]
    frame, shard = table(spark, texts + texts[:20]), 1 << 13
    spans = induced_suffixes.repeated_spans(frame, shard).collect()
    raw, first = {i: t.encode() for i, t in texts}, {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - 99):
            first.setdefault(raw[i][s : s + 100], (i, s))
    want = {(i, s) for i, x in raw.items() for s in range(len(x) - 99) if first[x[s : s + 100]] != (i, s)}
    assert {(d, s) for d, b, e in spans for s in range(b, e - 99)} == want
    # Contexts of one anchor exceed the shard; taken apart, what meets by a hash does not.
    rows = induced_suffixes._contexts
    seen = pd.DataFrame({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts], "firsts": [np.arange(len(t)) for _, t in texts]})
    whole = pd.concat(rows(np.zeros(0, np.uint64))(iter([seen]))).dropna(subset=["context"])
    sizes = whole["context"].map(len).groupby(whole["hash"]).sum()
    large = np.unique(sizes.index[sizes > shard].to_numpy(np.int64).view(np.uint64) >> np.uint64(24))
    apart = pd.concat(rows(large)(iter([seen]))).dropna(subset=["context"])
    assert sizes.max() > shard > apart["context"].map(len).groupby(apart["hash"]).sum().max()


def test_mixing(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    labelled = mixing.language_and_quality(documents, labels)
    got = mixing.mixed(documents, labelled, {"en/good": 2.0, "de/good": 1.0, "fr/good": 1.0}).toPandas()
    mass = (np.vstack(got["membership"]) * (got["rate"] * got["n_tokens"]).to_numpy()[:, None]).sum(axis=0)
    assert got["rate"].min() >= 0 and mass / got["n_tokens"].sum() == pytest.approx([0.25, 0.5, 0.25], abs=1e-3)
    assert got["n_tokens"].tolist() == [len(words(t)) for t in got["text"]]
    assert abs((got["copies"] - got["rate"])).max() <= 1 and set(documents.columns) < set(got.columns)
    wide = mixing.mixed(documents, labelled, {"en/good": 2.0, "de/good": 1.0}, cover=True).toPandas()
    assert wide["rate"].min() > 0.7


def test_mixing_without_anything(spark):
    none = spark.createDataFrame([], "doc_id long, label string")
    got = mixing.mixed(table(spark, [(1, None), (2, "a b"), (2, "a b"), (None, "")]), none, {"a": 1.0, "b": 3.0}).collect()
    assert len(got) == 4 and all(r["rate"] >= 0 and list(r["membership"]) == [0.5, 0.5] for r in got)
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 2, 2]
    assert mixing.mixed(table(spark, []), none, {"a": 1.0}).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())


def viterbi(text, pieces):
    scores = {t: (i, s) for t, i, s in pieces.rows}
    best = [(0.0, -1, -1)]
    for end in range(1, len(text) + 1):
        here = None
        for start in range(max(0, end - pieces.longest), end):
            edge = scores.get(text[start:end], (-1, pieces.unknown) if end - start == 1 else None)
            if edge and (here is None or best[start][0] + edge[1] > here[0]):
                here = (best[start][0] + edge[1], start, edge[0])
        best.append(here)
    out, end = [], len(text)
    while end:
        _, start, i = best[end]
        out = ([i] if i >= 0 else [pieces.bytes[b] for b in text[start:end].encode()]) + out
        end = start
    return out


def test_sentencepiece(spark, pieces, texts):
    rows = [*texts[:30], (200, None), (201, ""), (202, "  two  blanks \n\n é漢😀\U00020000.,%%% don't x.y "), (203, "\n"), (204, " "), (None, "q"), (None, "q"), (205, "z!" * 300)]
    coded = sentencepiece_lattice.encode(table(spark, rows), pieces)
    got = coded.select("*", sentencepiece_lattice.decode(F.col("ids"), pieces).alias("back")).collect()
    assert len(got) == len(rows) and all(r["exact"] for r in got)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert r["back"] == text and list(r["ids"]) == (viterbi("▁" + text.replace(" ", "▁"), pieces) if text else [])
    assert sentencepiece_lattice.encode(table(spark, []), pieces).count() == 0


def test_sentencepiece_shuffles_nothing(spark, pieces, texts):
    rows = [*texts[:40], (300, None), (301, "a_b __ x._y e.g. 3.14 \u00e9\u0301 \u2460\u00b2 tab\there\r\n\n  end"), (302, "\U0001f600 " * 50)]
    coded = sentencepiece_lattice.encode(table(spark, rows), pieces, chars=500, words=50)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    for r in coded.collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert r["exact"] and list(r["ids"]) == (viterbi("\u2581" + text.replace(" ", "\u2581"), pieces) if text else [])
