"""Periodic runs of words, found by recompression and grammar LCE queries.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are equal) and a
length of at least max(6, 4 q). Every run of period q and length >= 4 q holds a grid point i = k q with
w[i] = w[i + q] = w[i + 2 q]; grid points of all periods are the harmonic sum of n / q, about n ln n, and
are tested at once with numpy. Each surviving candidate is extended forwards and backwards by exact
longest-common-extension queries on a grammar: recompression alternates block compression (a maximal
block a^k becomes one new symbol) and pair compression (with the alphabet split into left and right by a
hash of each symbol and level, every pair left-right becomes one new symbol) until one symbol is left. Equal
symbols expand to equal words, so a query walks the levels: it climbs while both sides begin equal
parents, skips blocks of equal symbols at once, and descends into children where symbols differ. No
suffix array is built. A run found from a grid point is checked for a smaller period (q / p for each
prime p of q); grid points inside a run already found are skipped.

Documents of a batch are cut into chunks of at most ``CHUNK`` words; the words of a chunk are numbered,
joined with one separator symbol of its own after each document (so nothing matches across documents),
and compressed together, forwards and reversed. Grid points are dealt in blocks of periods whose size
grows with the period, so memory stays linear in the chunk, also for one very long document.

Input: ``doc_id`` and ``text``; words are ``[^\\x20\\x09-\\x0D]+``. Before the search each document is
changed as the contract of op12 says (``plant``). Nulls and edge cases: a null text has no words, no runs,
and the digests of empty strings; a null ``doc_id`` is not changed (no crc32 of it); repeated rows are
judged each; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\x20\x09-\x0d]+")
CHUNK = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def plant(words: list[str], doc_id) -> list[str]:
    """The contract's change: with h = crc32(decimal doc_id), h % 10 = 0 makes the tail periodic."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    g = h // 10
    if h % 10 != 0:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


class Grammar:
    """Recompression levels of one symbol sequence, and exact LCE queries on it."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.sym, self.size, self.par, self.first, self.same, self.child = [], [], [], [], [], [None]
        start = np.arange(n, dtype=np.int64)
        sym = seq.astype(np.int64)
        fresh = int(sym.max()) + 1 if n else 0
        level, idle = 0, 0
        while True:
            size = np.diff(np.append(start, n))
            bounds = np.flatnonzero(sym[1:] != sym[:-1]) + 1
            heads = np.concatenate(([0], bounds)) if len(sym) else bounds
            run = np.diff(np.append(heads, len(sym)))
            same = np.repeat(run, run) - (np.arange(len(sym)) - np.repeat(heads, run))
            self.sym.append(sym)
            self.size.append(size)
            self.same.append(same)
            if len(sym) <= 1 or idle > 16:
                self.par.append(None)
                self.first.append(None)
                break
            if (run > 1).any():  # block compression
                key = (sym[heads] << 32) | np.minimum(run, (1 << 32) - 1)
                codes, _ = pd.factorize(key)
                new = np.where(run > 1, fresh + codes, sym[heads])
                fresh += int(codes.max()) + 1
                parent = np.repeat(np.arange(len(heads)), run)
                first = np.zeros(len(sym), bool)
                first[heads] = True
                nxt_sym, nxt_start = new, start[heads]
            else:  # pair compression
                level += 1
                salt = np.uint64((level * 0xBF58476D1CE4E5B9) % (1 << 64))
                side = ((sym.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(33)) & np.uint64(1)
                pair = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
                if len(pair) == 0:
                    idle += 1
                    self.sym.pop(), self.size.pop(), self.same.pop()
                    continue
                idle = 0
                keep = np.ones(len(sym), bool)
                keep[pair + 1] = False
                codes, _ = pd.factorize((sym[pair] << 32) | sym[pair + 1])
                new = sym.copy()
                new[pair] = fresh + codes
                fresh += int(codes.max()) + 1
                parent = np.cumsum(keep) - 1
                first = keep
                nxt_sym, nxt_start = new[keep], start[keep]
            self.par.append(parent)
            self.first.append(first)
            self.child.append(np.flatnonzero(first))
            sym, start = nxt_sym, nxt_start
        self.levels = len(self.sym)

    def lce(self, x: int, y: int) -> int:
        """Length of the longest common extension of the sequence from x and from y."""
        total, level, a, b = 0, 0, x, y
        sym, size, par, first, same, child = self.sym, self.size, self.par, self.first, self.same, self.child
        top = self.levels - 1
        while True:
            s = sym[level]
            if a >= len(s) or b >= len(s):
                return total
            if s[a] == s[b]:
                if level < top and first[level][a] and first[level][b]:
                    pa, pb = par[level][a], par[level][b]
                    if sym[level + 1][pa] == sym[level + 1][pb]:
                        a, b, level = pa, pb, level + 1
                        continue
                step = int(min(same[level][a], same[level][b]))
                total += step * int(size[level][a])
                a += step
                b += step
            else:
                if level == 0:
                    return total
                a, b, level = int(child[level][a]), int(child[level][b]), level - 1


def _primes(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    if q > 1:
        out.append(q)
    return out


def _grid(ns: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
    """Grid points (document, q, global place) for periods in [lo, hi) of all documents."""
    qmax = np.minimum(ns // 4, hi - 1)
    nq = np.maximum(qmax - lo + 1, 0)
    doc = np.repeat(np.arange(len(ns)), nq)
    if len(doc) == 0:
        return doc, doc, doc
    q = np.arange(len(doc)) - np.repeat(np.cumsum(nq) - nq, nq) + lo
    count = (ns[doc] - 3 * q) // q + 1
    doc2, q2 = np.repeat(doc, count), np.repeat(q, count)
    k = np.arange(len(doc2)) - np.repeat(np.cumsum(count) - count, count)
    return doc2, q2, offsets[doc2] + k * q2


def _runs_of_chunk(docs: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    ns = np.array([len(d) for d in docs], dtype=np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not len(ns) or ns.max() < 6:
        return found
    codes, _ = pd.factorize(pd.Series([w for d in docs for w in d], dtype=object))
    vocab = int(codes.max()) + 1 if len(codes) else 0
    seq = np.empty(int(ns.sum()) + len(docs), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(ns + 1)[:-1])).astype(np.int64)
    places = np.repeat(offsets, ns) + (np.arange(len(codes)) - np.repeat(np.cumsum(ns) - ns, ns))
    seq[places] = codes
    seq[offsets + ns] = vocab + np.arange(len(docs))
    forward = backward = None
    total = len(seq)
    lo = 1
    while lo <= int(ns.max()) // 4:
        hi = 64 if lo == 1 else 2 * lo
        doc, q, x = _grid(ns, offsets, lo, hi)
        lo = hi
        if len(x) == 0:
            continue
        hit = (seq[x] == seq[x + q]) & (seq[x + q] == seq[x + 2 * q])
        doc, q, x = doc[hit], q[hit], x[hit]
        if len(x) == 0:
            continue
        if forward is None:
            forward, backward = Grammar(seq), Grammar(seq[::-1].copy())
        order = np.lexsort((x, q, doc))
        last: dict[tuple[int, int], int] = {}
        for j, p, g in zip(doc[order].tolist(), q[order].tolist(), x[order].tolist()):
            if g + p < last.get((j, p), -1):
                continue
            ahead = forward.lce(g, g + p)
            behind = backward.lce(total - g, total - g - p) if g > 0 else 0
            s, e = g - behind, g + p + ahead
            last[(j, p)] = e
            if e - s < max(6, 4 * p):
                continue
            if any(np.array_equal(seq[s : e - p // r], seq[s + p // r : e]) for r in _primes(p)):
                continue
            found[j].append((s - int(offsets[j]), e - s, p))
    return found


def _chunks(words: list[list[str]]):
    chunk, size = [], 0
    for i, w in enumerate(words):
        if chunk and size + len(w) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(i)
        size += len(w)
    if chunk:
        yield chunk


def _batches(batches):
    for frame in batches:
        ids = [None if k is None else int(k) for k in frame["key"].tolist()]
        words = [plant(WORD.findall(t) if isinstance(t, str) else [], d) for d, t in zip(ids, frame["text"].tolist())]
        runs: list[list] = [[] for _ in words]
        for chunk in _chunks(words):
            for i, found in zip(chunk, _runs_of_chunk([words[i] for i in chunk])):
                runs[i] = sorted(found, key=lambda r: (r[0], r[2]))
        collapsed = []
        for w, found in zip(words, runs):
            gone = np.zeros(len(w) + 1, np.int64)
            for s, length, p in found:
                gone[s + p] += 1
                gone[s + length] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            collapsed.append(" ".join(x for x, k in zip(w, kept) if k))
        yield pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "n_words": [len(w) for w in words],
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs],
                "collapsed": collapsed,
            }
        )


def find_runs(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs`` (start, length, period; by start, then period), ``collapsed`` text.

    ``collapsed`` keeps every word that no run holds after its first period, joined by one space.
    """
    # The id travels as text: pandas would turn a column of longs with nulls into doubles.
    keyed = documents.select(F.col("doc_id").cast("long").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    return keyed.mapInPandas(_batches, SCHEMA)


def best_run(runs: list[tuple[int, int, int]]):
    """The run of greatest length / period; ties: smallest start, then period."""
    if not runs:
        return None
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def digests(found: DataFrame) -> DataFrame:
    """The columns of op12 from ``find_runs``: best run, exponent, and the two sha256 digests."""
    # Exact order of length / period: compare length * other period in a sort of (ratio, -start, -period).
    ranked = F.array_sort(
        "runs",
        lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1)
        .when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .when(a["period"] < b["period"], -1)
        .when(a["period"] > b["period"], 1)
        .otherwise(0),
    )
    best = F.try_element_at(ranked, F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        ((best["length"] * 1000 - F.pmod(best["length"] * 1000, best["period"])) / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
