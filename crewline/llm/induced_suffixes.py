"""Removal of repeated byte strings by induced suffix sorting, in memory by shards, of the places that can repeat."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from crewline.llm.common import materialize
from crewline.llm.hashing import BASE, BYTE_KEYS, mix, powers, slices

LENGTH = 100
GRAM = 32
# Contexts taken apart at a time; equal windows of as many meet before the shuffle.
APART = 2000
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def _inverse_powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = INVERSE
    return np.multiply.accumulate(out)


def anchors(raw: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """The anchor of each window of ``length`` bytes: the place of its least ``gram``-byte hash.

    Equal windows have anchors of equal hash. Consecutive windows share anchors, so one row stands for a run of
    windows: hash, text, first window (from the text's start), number of windows, and a hash of all their bytes.
    """
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n, span = len(data), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * powers(n), out=sums[1:])
    back = _inverse_powers(n)
    h = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    ranked = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    # Least of each stretch of ``span`` grams: from blocks of that size, the least up to and from each place.
    blocks = np.full(-(-len(h) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(h)] = ranked
    blocks = blocks.reshape(-1, span)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[: n - length + 1], upto[span - 1 : span + n - length])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - np.array([len(r) for r in raw])
    of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])[: len(place)]
    whole = np.flatnonzero(np.arange(len(place)) + length <= ends[of])
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    p, t = place[whole], of[whole]
    opens = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (t[1:] != t[:-1]) | (whole[1:] != whole[:-1] + 1)))
    counts = np.diff(np.append(opens, len(whole)))
    begin = whole[opens]
    around = (sums[begin + counts + length - 1] - sums[begin]) * back[begin] + counts.astype(np.uint64)
    return h[p[opens]], t[opens], begin - starts[t[opens]], counts, around


def _raw(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def _scan(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Anchors of a batch, packed by bucket of their hash. What repeats within the batch is known at once (bucket -1)."""
        for batch in batches:
            texts, parts = batch["text"].tolist(), []
            ids = batch["doc_id"].to_numpy(np.int64)
            for start, end in slices(texts):
                h, t, first, _, around = anchors(_raw(texts[start:end]))
                parts.append((h, ids[start + t], first, around))
            if not parts:
                continue
            h, doc, first, around = (np.concatenate([q[i] for q in parts]) for i in range(4))
            if not len(h):
                continue
            # How many different contexts each hash has in the batch.
            order = np.lexsort((around, h))
            fresh = np.append(True, h[order][1:] != h[order][:-1])
            other = fresh | np.append(True, around[order][1:] != around[order][:-1])
            kinds = np.minimum(np.add.reduceat(other.astype(np.int64), np.flatnonzero(fresh)), 65535).astype(np.uint16)
            order = np.lexsort((first, doc, h))
            h, doc, first = h[order], doc[order], first[order].astype(np.int32)
            again = np.append(False, h[1:] == h[:-1])
            sure = again | np.append(again[1:], False)
            # One row of each hash goes to its bucket, so a very common one adds a row per batch at most.
            lead = ~again
            key = h >> np.uint64(24)  # 40 bits tell hashes apart well enough: others only cost a comparison
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            rows = []
            where = np.flatnonzero(sure)
            if len(where):
                rows.append((-1, b"", doc[where].tobytes(), first[where].tobytes(), b""))
            where = np.flatnonzero(lead)
            turn = np.argsort(bucket[where], kind="stable")
            where, kinds = where[turn], kinds[turn]
            cuts = np.flatnonzero(np.diff(bucket[where])) + 1
            for own, many in zip(np.split(where, cuts), np.split(kinds, cuts)) if len(where) else []:
                rows.append((int(bucket[own[0]]), key[own].tobytes(), doc[own].tobytes(), first[own].tobytes(), many.tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "keys", "docs", "firsts", "kinds"])

    return run


def _survivors(shard: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """``doc_id, firsts`` of anchors whose hash is there twice, and ``key`` of hashes whose contexts may exceed a shard. Buckets come one after another."""

        def out(doc, first):
            order = np.argsort(doc, kind="stable")
            doc, first = doc[order], first[order]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            ids = doc[np.append(0, cuts)] if len(doc) else doc
            return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "firsts": pd.Series(np.split(first, cuts) if len(doc) else [], dtype=object), "key": pd.Series([None] * len(ids), dtype="Int64")})

        def close(rows):
            key, doc, first, kinds = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in ((0, np.uint64), (1, np.int64), (2, np.int32), (3, np.uint16)))
            order = np.argsort(key, kind="stable")
            fresh = np.append(True, np.diff(key[order]) != 0)
            again = ~fresh
            twice = order[again | np.append(again[1:], False)]
            found = out(doc[twice], first[twice])
            opens = np.flatnonzero(fresh)
            large = key[order][opens][np.add.reduceat(kinds[order].astype(np.int64), opens) * (2 * LENGTH - GRAM) > shard]
            none = [None] * len(large)
            return pd.concat((found, pd.DataFrame({"doc_id": pd.Series(none, dtype="Int64"), "firsts": pd.Series(none, dtype=object), "key": pd.Series(large.view(np.int64), dtype="Int64")})))

        current, rows = None, []
        for batch in batches:
            for bucket, keys, docs, firsts, kinds in zip(batch["bucket"], batch["keys"], batch["docs"], batch["firsts"], batch["kinds"]):
                if bucket < 0:
                    yield out(np.frombuffer(docs, np.int64), np.frombuffer(firsts, np.int32))
                    continue
                if bucket != current and rows:
                    yield close(rows)
                    rows = []
                current = bucket
                rows.append((keys, docs, firsts, kinds))
        if rows:
            yield close(rows)

    return run


COLUMNS = ["hash", "doc_id", "first", "windows", "context"]


def _single_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Contexts taken apart: of equal windows the earliest with its 128-bit hash, the others, joined where they follow one another, as repeats for certain."""
    count = rows["windows"].to_numpy(np.int64)
    hashes = b"".join(xxhash.xxh3_128_digest(c[i : i + LENGTH]) for c, n in zip(rows["context"], count) for i in range(n))
    pair = np.frombuffer(hashes, np.int64).reshape(-1, 2)
    doc = np.repeat(rows["doc_id"].to_numpy(np.int64), count)
    first = np.repeat(rows["first"].to_numpy(np.int64), count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((first, doc, pair[:, 1], pair[:, 0]))
    pair, doc, first = pair[order], doc[order], first[order]
    same = np.append(False, (pair[1:] == pair[:-1]).all(axis=1))
    # A repeated row is the same place and no earlier one.
    place = same & np.append(False, (doc[1:] == doc[:-1]) & (first[1:] == first[:-1]))
    lead, later = ~same, same & ~place
    digests = np.ascontiguousarray(pair[lead])
    earliest = pd.DataFrame(dict(zip(COLUMNS, (digests[:, 0], doc[lead], first[lead], 1, [d.tobytes() for d in digests]))))
    doc, first = doc[later], first[later]
    order = np.lexsort((first, doc))
    doc, first = doc[order], first[order]
    opens = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    runs = first[np.append(opens[1:], len(first)) - 1] - first[opens] + 1 if len(doc) else opens
    sure = pd.DataFrame(dict(zip(COLUMNS, (doc[opens], doc[opens], first[opens], runs, None))))
    return pd.concat((earliest, sure)).astype({"context": object})


def _contexts(large: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bytes of all windows of each surviving anchor. Of equal ones in a batch only the first is compared; the others are repeats for certain.

        Where contexts of a hash would exceed a shard (``large``), single windows are dealt, each by its own hash.
        """
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for start, end in slices(texts):
                raw = _raw(texts[start:end])
                h, t, first, count, _ = anchors(raw)
                rows = batch.iloc[start:end]
                ids = rows["doc_id"].to_numpy(np.int64)
                live = [np.asarray(f, np.int64) for f in rows["firsts"]]
                wanted = np.concatenate([np.int64(i) << np.int64(40) | f for i, f in enumerate(live)]) if live else np.zeros(0, np.int64)
                here = np.isin(t.astype(np.int64) << np.int64(40) | first, wanted)
                for x, i, s, c in zip(h[here].view(np.int64), t[here], first[here], count[here]):
                    out.append((x, ids[i], s, c, raw[i][s : s + c + LENGTH - 1]))
            rows = pd.DataFrame(out, columns=COLUMNS)
            if len(rows):
                rows = rows.sort_values(["doc_id", "first"], kind="stable")
                # A repeated row is the same place and no earlier one.
                rows = rows.drop_duplicates(["doc_id", "first", "context"])
                known = rows.duplicated(["hash", "context"])
                rows.loc[known, "context"] = None
                # Nothing is compared with them, so they need not meet.
                rows.loc[known, "hash"] = mix(rows.loc[known, "doc_id"].to_numpy(np.int64).view(np.uint64)).view(np.int64)
                apart = ~known.to_numpy() & np.isin(rows["hash"].to_numpy(np.int64).view(np.uint64) >> np.uint64(24), large)
                yield rows[~apart]
                rows = rows[apart]
                for at in range(0, len(rows), APART):
                    yield _single_windows(rows.iloc[at : at + APART])

    return run


class Spool:
    """A queue for each letter: what is appended in order comes out in order. Beyond ``limit`` items it lies on disk."""

    def __init__(self, folder: str, limit: int, kind=np.int32):
        self.folder, self.limit, self.kind = tempfile.mkdtemp(dir=folder), limit, kind
        self.held: dict[int, list[np.ndarray]] = {}
        self.size = 0

    def push(self, letter: int, items: np.ndarray) -> None:
        self.held.setdefault(letter, []).append(items)
        self.size += len(items)
        if self.size > self.limit:
            for c, parts in self.held.items():
                with open(f"{self.folder}/{c}", "ab") as file:
                    np.concatenate(parts).astype(self.kind).tofile(file)
            self.held, self.size = {}, 0

    def spread(self, items: np.ndarray, letters: np.ndarray) -> None:
        """Deal items to the queues of their letters, in order."""
        if len(items):
            order = np.argsort(letters, kind="stable")
            items, letters = items[order], letters[order]
            cuts = np.flatnonzero(np.diff(letters)) + 1
            for part, c in zip(np.split(items, cuts), letters[np.append(0, cuts)]):
                self.push(int(c), part)

    def take(self, letter: int) -> np.ndarray:
        parts = self.held.pop(letter, [])
        self.size -= sum(map(len, parts))
        path = f"{self.folder}/{letter}"
        if os.path.exists(path):
            parts.insert(0, np.fromfile(path, self.kind))
            os.remove(path)
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, folder: str, limit: int) -> np.ndarray:
    """All suffixes in order, given the order of the leftmost small ones (``seeds``).

    Letter by letter upwards each suffix, once placed, hands its left neighbour on to the queue of the neighbour's letter if that
    is a large one; downwards the same for the small ones. Queues are filled in order, so nothing is compared.
    """
    letters = int(text.max()) + 1
    first = text[seeds]
    bounds = np.searchsorted(first, np.arange(letters + 1))
    kind = seeds.dtype
    queue, large = Spool(folder, limit, kind), Spool(folder, limit, kind)
    for c in range(letters):
        batch = queue.take(c)
        while len(batch):
            large.push(c, batch)
            left = batch[batch > 0] - 1
            left = left[~small[left]]
            same = text[left] == c
            queue.spread(left[~same], text[left[~same]])
            batch = left[same]
        left = seeds[bounds[c] : bounds[c + 1]]
        left = left[left > 0] - 1
        queue.spread(left, text[left])
    queue, out = Spool(folder, limit, kind), []
    for c in range(letters - 1, -1, -1):
        batch, own = queue.take(c), []
        while len(batch):
            own.append(batch)
            left = batch[batch > 0] - 1
            left = left[small[left]]
            same = text[left] == c
            queue.spread(left[~same], text[left[~same]])
            batch = left[same]
        down = large.take(c)[::-1]
        left = down[down > 0] - 1
        left = left[small[left]]
        queue.spread(left, text[left])
        if c == 0:
            own = [np.array([len(text) - 1], kind)]  # the end mark
        out.extend(own)
        out.append(down)
    return np.concatenate(out)[::-1]


def _names(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal pieces, which lie side by side in ``order``, get equal numbers; ``ends`` is where each piece ends."""
    a, b = order[:-1], order[1:]
    differ = (ends[order][:-1] - a) != (ends[order][1:] - b)
    open_pairs = np.flatnonzero(~differ)
    for step in range(int((ends[order] - order).max(initial=0)) + 1):
        more = a[open_pairs] + step <= ends[a[open_pairs]]
        open_pairs = open_pairs[more]
        if not len(open_pairs):
            break
        unlike = text[a[open_pairs] + step] != text[b[open_pairs] + step]
        differ[open_pairs[unlike]] = True
        open_pairs = open_pairs[~unlike]
    return np.append(0, np.cumsum(differ))


def suffix_order(text: np.ndarray, folder: str, limit: int = 1 << 24) -> np.ndarray:
    """Suffix array of ``text``, whose last letter is 0 and its only 0, by induced sorting.

    The leftmost small suffixes are put in order by inducing once from their letters, which sorts the pieces between
    them; pieces get numbers, and the string of numbers, a third as long at most, is ordered by doubling. From
    there all other suffixes are induced.
    """
    n = len(text)
    kind = np.int32 if n < 2**31 else np.int64
    step = np.sign(np.diff(text.astype(np.int16)))
    change = np.flatnonzero(step)
    # A letter equal to its right neighbour takes the neighbour's kind.
    spans = np.diff(np.append(-1, change))
    small = np.append(np.repeat(step[change] > 0, spans), True)  # the last letter differs from all others
    left = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    if not len(left):
        return np.arange(n)[::-1]
    rough = left[np.argsort(text[left], kind="stable")]
    sorted_pieces = _induce(text, small, rough, folder, limit)
    mark = np.zeros(n, dtype=bool)
    mark[left] = True
    pieces = sorted_pieces[mark[sorted_pieces]]
    ends = np.zeros(n, np.int64)
    ends[left] = np.append(left[1:], n - 1)
    rank = np.zeros(n, np.int64)
    rank[pieces] = _names(text, pieces.astype(np.int64), ends)
    name, span = rank[left] + 1, 1
    while name.max() < len(left):
        ahead = np.append(name[span:], np.zeros(min(span, len(name)), np.int64))[: len(name)]
        key = name * (len(left) + 2) + ahead
        name = np.unique(key, return_inverse=True)[1] + 1
        span *= 2
        if span > len(left):
            break
    seeds = left[np.argsort(name, kind="stable")]
    return _induce(text, small, seeds, folder, limit)


def _same_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from ``a`` and from ``b`` are equal, looked at eight at a time."""
    same, open_pairs = np.zeros(len(a), dtype=bool), np.arange(len(a))
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for step in [*range(0, length - 8, 8), length - 8]:
        equal = (words[a[open_pairs] + step] == words[b[open_pairs] + step]).all(axis=1)
        open_pairs = open_pairs[equal]
        if not len(open_pairs):
            return same
    same[open_pairs] = True
    return same


def _repeats(doc: np.ndarray, first: np.ndarray, windows: np.ndarray, contexts: list[bytes], folder: str, length: int = LENGTH):
    """Runs of windows that also start earlier: document, begin and end of the bytes they cover."""
    order = np.lexsort((first, doc))
    doc, first, windows, contexts = doc[order], first[order], windows[order], [contexts[i] for i in order]
    sizes = np.array([len(c) for c in contexts])
    raw = np.frombuffer(b"\0".join(contexts) + b"\0" * 9, dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = raw[: int(starts[-1] + sizes[-1]) + 2].astype(np.uint16) + 2
    text[starts + sizes] = 1
    text[-1] = 0
    begin = np.zeros(len(text), np.int64)
    owner = np.repeat(np.arange(len(doc)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin[starts[owner] + at] = np.arange(1, len(owner) + 1)  # number of the window that starts here, in order of document and place
    ranked = suffix_order(text, folder)
    ranked = ranked[begin[ranked] > 0]
    alike = np.append(False, _same_prefix(raw, ranked[:-1], ranked[1:], length))
    opens = np.flatnonzero(~alike)
    number = begin[ranked]
    earliest = np.repeat(np.minimum.reduceat(number, opens), np.diff(np.append(opens, len(number))))
    later = np.sort(number[number != earliest]) - 1
    d, s = doc[owner[later]], first[owner[later]] + at[later]
    # A repeated row is the same place, not an earlier one.
    e = earliest[number != earliest][np.argsort(number[number != earliest])] - 1
    own = (doc[owner[e]] == d) & (first[owner[e]] + at[e] == s)
    d, s = d[~own], s[~own]
    if not len(d):
        return d, s, s
    cut = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1))
    opens = np.flatnonzero(cut)
    return d[opens], s[opens], s[np.append(opens[1:], len(s)) - 1] + length


def _sorted_shards(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of hash; a shard is cut between hashes once it holds ``size`` bytes."""
        held, bytes_held = [], 0

        def whole(rows):
            return pd.DataFrame({"doc_id": rows["doc_id"], "begin": rows["first"], "end": rows["first"] + rows["windows"] + LENGTH - 1})

        def close(rows):
            # Of equal contexts only the earliest is sorted; the others are repeats as a whole.
            rows = rows.sort_values(["doc_id", "first"], kind="stable").drop_duplicates(["doc_id", "first", "context"])
            known = rows.duplicated("context")
            spans, rows = whole(rows[known]), rows[~known]
            rows = rows[rows["context"].map(len) >= LENGTH]  # a single window that is left has no equal
            if not len(rows):
                return spans
            with tempfile.TemporaryDirectory() as folder:
                found = _repeats(*[rows[c].to_numpy(np.int64) for c in ("doc_id", "first", "windows")], rows["context"].tolist(), folder)
            return pd.concat((spans, pd.DataFrame(dict(zip(("doc_id", "begin", "end"), found)))))

        for batch in batches:
            known = batch["context"].isna()
            sure = batch[known]
            if len(sure):
                yield whole(sure)
            rows = batch[~known]
            while len(rows):
                lengths = np.cumsum(rows["context"].map(len).to_numpy())
                hashes = rows["hash"].to_numpy()
                full = int(np.searchsorted(lengths, max(size - bytes_held, 0)))
                change = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
                if held and bytes_held >= size and hashes[0] != held[-1]["hash"].iloc[-1]:
                    cut = 0
                else:
                    later = change[change > full]
                    cut = int(later[0]) if len(later) else len(rows)
                if cut:
                    held.append(rows.iloc[:cut])
                    bytes_held += int(lengths[cut - 1])
                rows = rows.iloc[cut:]
                if len(rows):
                    yield close(pd.concat(held, ignore_index=True))
                    held, bytes_held = [], 0
        if held:
            yield close(pd.concat(held, ignore_index=True))

    return run


def _merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in np.argsort(begins, kind="stable"):
        if out and begins[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(ends[i]))
        else:
            out.append([int(begins[i]), int(ends[i])])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
            raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
            runs = [] if spans is None else _merged(np.array([s["begin"] for s in spans]), np.array([s["end"] for s in spans]))
            kept, at = [], 0
            for begin, end in runs:
                kept.append(raw[at:begin])
                at = end
            kept.append(raw[at:])
            removed = sum(b - a for a, b in runs)
            out.append((doc, len(raw), removed, len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})


def _ordered(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")


def repeated_spans(documents: DataFrame, shard: int = 2 << 20) -> DataFrame:
    """``doc_id, begin, end``: bytes covered by strings of 100 bytes that also start earlier. Spans of a document may overlap.

    1. Each window of 100 bytes has an anchor; only anchors whose hash is there twice can belong to a repeat.
    2. The bytes around those anchors (at most about 170 each) are dealt by the anchor's hash, so equal windows meet.
       Where those of one hash may exceed a shard, which is known from the first step, each window is dealt alone by its own
       128-bit hash, equal ones of a few thousand contexts folded before.
    3. A shard of them is put in order by induced suffix sorting, in memory; windows that
       share 100 bytes lie side by side, and all but the earliest are repeats.
    Contexts that are equal within a batch are settled there, so a passage that very many documents share sends one row per batch.
    """
    spark = documents.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _ordered(documents)
    packed = texts.mapInPandas(_scan(buckets), "bucket long, keys binary, docs binary, firsts binary, kinds binary")
    spread = F.when(F.col("bucket") < 0, F.xxhash64("docs")).otherwise(F.col("bucket"))
    dealt = packed.repartition(buckets // 4, spread).sortWithinPartitions("bucket")
    known = materialize(dealt.mapInPandas(_survivors(shard), "doc_id long, firsts array<int>, key long"))
    # At most one key for each shard that all contexts would fill.
    large = np.array(sorted(r["key"] for r in known.where("key IS NOT NULL").select("key").collect()), np.uint64)
    found = known.where("key IS NULL").groupBy("doc_id").agg(F.flatten(F.collect_list("firsts")).alias("firsts"))
    rows = texts.join(found, "doc_id").mapInPandas(_contexts(large), "hash long, doc_id long, first long, windows long, context binary")
    rows = rows.repartition(buckets // 4, "hash").sortWithinPartitions("hash")
    return rows.mapInPandas(_sorted_shards(shard), "doc_id long, begin long, end long")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document.

    A text is its UTF-8 bytes (null: none). A byte goes when a string of 100 bytes over it also starts earlier: in a smaller
    ``doc_id``, or before in the same document; all on the input. ``kept`` holds the bytes left. Rows with a null ``doc_id``
    have no order, are compared with nothing and stay whole. A repeated row is the same document and no repeat of itself. Texts under
    100 bytes stay whole; an empty table gives no rows; other columns play no part.
    """
    spans = repeated_spans(documents).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    # The same frame as in the search for spans, so that one shuffle of the texts serves both joins.
    texts = _ordered(documents).join(spans, "doc_id", "left")
    alone = documents.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.mapInPandas(_cut, schema).unionByName(alone.mapInPandas(_cut, schema))
