"""Words and word n-grams of many texts as 64-bit numbers, a whole batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# White space of the word rule is mapped to a blank and A-Z to a-z.
FOLD = bytes(0x20 if 0x09 <= i <= 0x0D else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
SPACED = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in range(256))
_RANDOM = np.random.Generator(np.random.PCG64(20240131))
BYTE_KEYS = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = _RANDOM.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def word_hashes(texts: Sequence[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and where each text's words begin (one entry more than texts)."""
    h, bounds, _ = word_and_stem_hashes(texts, (), fold)
    return h, bounds


def word_and_stem_hashes(texts: Sequence[str | None], stems: Sequence[int], fold: bool = True):
    """As ``word_hashes``, and for each number of bytes in ``stems`` the words that have as many: (word, hash of its beginning)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raw) + b" "
    data = np.frombuffer(joined.translate(FOLD if fold else SPACED), dtype=np.uint8)
    inside = data != 0x20
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    limits = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))) if raw else np.zeros(1, np.int64)
    bounds = np.searchsorted(begins, limits)
    if not len(begins):
        return np.zeros(0, np.uint64), bounds, [(np.zeros(0, np.int64), np.zeros(0, np.uint64)) for _ in stems]
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, begins)
    lengths = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, lengths)
    scaled = BYTE_KEYS[data[where]] * powers(int(lengths.max()))[place]
    starts = []
    if len(stems):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scaled)))
        for n in stems:
            long = np.flatnonzero(lengths >= n)
            starts.append((long, mix(sums[first[long] + n] - sums[first[long]] + PLACES[13] * np.uint64(n))))
    return mix(np.add.reduceat(scaled, first) + lengths.astype(np.uint64)), bounds, starts


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words and the text each belongs to; a shorter text with words counts as one gram."""
    sizes = np.diff(bounds)
    total = len(hashes)
    sums = np.zeros(total, dtype=np.uint64)
    for i in range(n):
        sums[: total - i] += hashes[i:] * PLACES[i] if total > i else 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.arange(total) + n <= bounds[1:][owner]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    grams, of = mix(sums[whole]), owner[whole]
    if len(short):
        extra = []
        for t in short:
            own = hashes[bounds[t] : bounds[t + 1]]
            extra.append((own * PLACES[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own)))
        grams, of = np.concatenate((grams, mix(np.array(extra, np.uint64)))), np.concatenate((of, short))
    return grams, of


def distinct_sets(grams: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct grams in ascending order, end to end, and where each text's begin."""
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[fresh], of[fresh]
    return grams, np.searchsorted(of, np.arange(texts + 1))


def slices(texts: Sequence[str | None], most: int = 1 << 20):
    """Ranges of texts of about ``most`` characters together (a longer text comes alone), so that a batch stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        own = len(t) if t is not None else 0
        if i > start and size + own > most:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(texts):
        yield start, len(texts)
