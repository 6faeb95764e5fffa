"""Document log-likelihood under a gated recurrent language model with a class-factored output."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crewline.llm.common import materialize
from crewline.llm.hashing import FOLD, slices, word_hashes

KINDS = 4
# Characters hashed, and texts scored side by side, at a time: few enough for what comes between to stay in the processor's cache.
SLICE = 1 << 18
SCORED = 512


@dataclass(frozen=True)
class Model:
    """Sizes and training of the network; ``listed`` and ``modelled`` bound the word lists by share of all tokens."""

    hidden: int = 16
    window: int = 32
    lanes: int = 128
    rounds: int = 4
    rate: float = 0.05
    # Words with at least one part in so many of all tokens are sent to every task; the counts of others are joined.
    listed: int = 2**21
    # Words with at least one part in so many have outputs of their own.
    modelled: int = 2**12
    classes: int = 32
    seed: int = 5


def _kinds(texts: list[str | None]) -> np.ndarray:
    """Kind of each word: whether it ends in a letter or digit of ASCII, and whether it is all ASCII."""
    joined = b" ".join(b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts) + b" "
    data = np.frombuffer(joined.translate(FOLD), np.uint8)
    inside = data != 0x20
    begins = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if not len(begins):
        return np.zeros(0, np.int8)
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False))
    last, wide = data[ends], np.maximum.reduceat(data, begins) >= 0x80
    plain = ((last >= 0x30) & (last <= 0x39)) | ((last >= 0x61) & (last <= 0x7A)) | (last >= 0x80)
    return wide.astype(np.int8) * np.int8(2) + plain


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for start, end in slices(texts, SLICE):
        h, bounds = word_hashes(texts[start:end])
        parts.append((h, _kinds(texts[start:end]), np.diff(bounds)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        h, kind, _ = _words(batch["text"].tolist())
        values, first, counts = np.unique(h, return_index=True, return_counts=True)
        yield pd.DataFrame({"hash": values.view(np.int64), "kind": kind[first].astype(np.int64), "n": counts})


def count_words(training: DataFrame) -> DataFrame:
    """``hash, kind, n`` of every word of the training texts; batches are summed before they are shuffled."""
    return training.select("text").mapInPandas(_counted, "hash long, kind long, n long").groupBy("hash").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))


class Vocabulary:
    """Listed words with their counts, their number among the modelled words or the class they fall into.

    Classes: first those of the modelled words, each a stretch of words in order of count; then bands of listed words
    by count; then the kinds of words not listed. Within a band or kind a word has its add-one share.
    The end of a text is a modelled word. Inputs are the modelled words, then one number per other class.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, rest: np.ndarray, p: Model):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.float64)
        total = float(self.counts.sum() + ends + rest.sum())
        own = self.counts >= max(2.0, total / p.modelled)
        listed = np.flatnonzero(own)
        sizes = np.append(self.counts[listed], ends)
        by_count = np.argsort(-sizes, kind="stable")
        number = np.empty(len(sizes), np.int64)
        number[by_count] = np.arange(len(sizes))
        self.end = int(number[-1])
        sizes = sizes[by_count]
        # Stretches of about equal mass under the square root: few frequent words, many rarer ones.
        mass = np.cumsum(np.sqrt(sizes + 1))
        group = np.minimum((mass / mass[-1] * p.classes - 1e-9).astype(np.int64), p.classes - 1)
        group = np.unique(group, return_inverse=True)[1]
        self.class_of_word, self.heads = group, int(group[-1]) + 1
        self.class_begin = np.searchsorted(group, np.arange(self.heads + 1))
        band = np.log2(self.counts[~own]).astype(np.int64) if (~own).any() else np.zeros(0, np.int64)
        self.bands, in_band = np.unique(band, return_inverse=True)
        self.code = np.zeros(len(self.hashes), np.int64)
        self.code[listed] = number[:-1]
        self.words = len(sizes)
        self.code[~own] = self.words + in_band
        self.classes = self.heads + len(self.bands) + KINDS
        self.inputs = self.words + len(self.bands) + KINDS
        band_mass = np.bincount(in_band, weights=self.counts[~own] + 1, minlength=len(self.bands))
        # Each kind keeps room for one word never seen.
        self.kind_mass = rest + 1.0
        self.static = np.zeros(len(self.hashes))
        self.static[~own] = np.log(self.counts[~own] + 1) - np.log(band_mass[in_band]) if (~own).any() else 0
        head_mass = np.bincount(group, weights=sizes + 1)
        self.class_log = np.log(np.concatenate((head_mass, band_mass, self.kind_mass)) / (head_mass.sum() + band_mass.sum() + self.kind_mass.sum()))
        self.word_log = np.log((sizes + 1) / head_mass[group])

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From what is sent to the tasks: the attributes."""
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self

    def look_up(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input number of each word, and its place in the list or -1."""
        if not len(self.hashes):
            return (self.words + len(self.bands) + kind).astype(np.int32), np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1).astype(np.int32)
        known = self.hashes[at] == h
        rare = np.int32(self.words + len(self.bands)) + kind
        return np.where(known, self.code[at].astype(np.int32), rare), np.where(known, at, np.int32(-1))

    def class_of(self, code: np.ndarray) -> np.ndarray:
        return np.where(code < self.words, self.class_of_word[np.minimum(code, self.words - 1)], code - self.words + self.heads)


def initial(v: Vocabulary, p: Model) -> dict[str, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(p.seed))
    normal = lambda *size: (0.1 * random.standard_normal(size)).astype(np.float32)
    return {
        "gates": normal(v.inputs, 3 * p.hidden), "back": normal(p.hidden, 3 * p.hidden),
        "to_class": np.zeros((p.hidden, v.classes), np.float32), "class_bias": v.class_log.astype(np.float32),
        "to_word": np.zeros((v.words, p.hidden), np.float32), "word_bias": v.word_log.astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _sorted(numbers: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of numbers below ``limit``; numpy sorts those of 16 bits by digits."""
    return np.argsort(numbers.astype(np.min_scalar_type(limit)), kind="stable")


def _by_gate(x: np.ndarray) -> np.ndarray:
    """Columns of the three gates, side by side, as one table for each gate."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


def _steps(w: dict, codes: np.ndarray, active: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Run the cell over a window (steps x lanes); lanes are active from the left. Returns the state before each step.

    Without ``keep`` the state is carried on in place; ``keep`` gets what learning needs, with zeros for lanes not active.
    """
    shape = (*codes.shape, h.shape[1])
    before = np.empty(shape, np.float32)
    given, back = _by_gate(w["gates"]), _by_gate(w["back"])
    if keep is not None:
        h = h.copy()
        kind = np.result_type(h, back)
        keep |= {"zr": np.zeros((2, *shape), kind), "c": np.zeros(shape, kind), "b": np.zeros(shape, kind)}
    for t in range(len(codes)):
        n = int(active[t])
        before[t] = h
        own = h[:n]
        a, b = given.take(codes[t, :n], axis=1), own @ back
        a[:2] += b[:2]
        z, r = _sigmoid(a[:2])
        c = a[2]
        c += r * b[2]
        np.tanh(c, out=c)
        if keep is not None:
            keep["zr"][:, t, :n], keep["c"][t, :n], keep["b"][t, :n] = a[:2], c, b[2]
        own -= c
        own *= z
        own += c
    return before


def _outputs(w: dict, v: Vocabulary, states: np.ndarray, code: np.ndarray, grads: dict | None = None):
    """Natural log-probability of each code given the state before it, up to the static share within a band or kind; gradient of the states."""
    cls, rows, size = v.class_of(code), np.arange(len(code)), states.shape[1]
    # In order of class, so that each class has a stretch of the rows; those of classes that are no words come last.
    order = _sorted(cls, v.classes)
    cls, code = cls[order], code[order]
    # One column more meets the biases.
    s = np.ones((len(order), size + 1), states.dtype)
    s[:, :size] = states.take(order, axis=0)
    to_class = np.concatenate((w["to_class"], w["class_bias"][None]))
    to_word = np.concatenate((w["to_word"], w["word_bias"][:, None]), axis=1)
    most = np.abs(s).max(axis=0, initial=1)

    def shares(logits, weights, at):
        """Log-share of each row's own column. For learning the logits become the gradient: the shares, less one in the own column."""
        # Where no exponential can leave the range of the type, the greatest logit is not taken off.
        if (most @ np.abs(weights)).max() > 60:
            logits -= logits.max(axis=1, keepdims=True)
        found = logits[rows[: len(at)], at]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        if grads is not None:
            logits /= total[:, None]
            logits[rows[: len(at)], at] -= 1
        return found - np.log(total)

    logits = s @ to_class
    found = shares(logits, to_class, cls)
    back = None
    if grads is not None:
        g = s.T @ logits
        grads["to_class"], grads["class_bias"] = g[:size], g[size]
        back = logits @ w["to_class"].T
        g = np.zeros_like(to_word)
    cuts = np.searchsorted(cls, np.arange(v.heads + 1))
    for k, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:])):
        span = slice(v.class_begin[k], v.class_begin[k + 1])
        if begin == end or span.stop - span.start == 1:
            continue
        own, weights = s[begin:end], to_word[span]
        logits = own @ weights.T
        found[begin:end] += shares(logits, weights.T, code[begin:end] - span.start)
        if grads is not None:
            g[span] = logits.T @ own
            back[begin:end] += logits @ w["to_word"][span]
    logp = np.empty_like(found)
    logp[order] = found
    if grads is None:
        return logp, None
    grads["to_word"], grads["word_bias"] = g[:, :size], g[:, size]
    in_place = np.empty_like(back)
    in_place[order] = back
    return logp, in_place


def _learn(w: dict, memory: dict, v: Vocabulary, codes: np.ndarray, active: np.ndarray, h: np.ndarray, p: Model) -> np.ndarray:
    """One step of truncated backpropagation through a window; returns the state to carry on."""
    keep: dict = {}
    before = _steps(w, codes, active, h, keep)
    size, lanes = p.hidden, codes.shape[1]
    flatly = lambda x: x.reshape(-1, size)
    used = np.flatnonzero(np.arange(lanes)[None, :] < active[:, None])
    flat = codes.ravel()[used]
    grads: dict = {}
    _, back = _outputs(w, v, flatly(before).take(used, axis=0), flat, grads)
    d_before = np.zeros_like(before)
    flatly(d_before)[used] = back
    (z, r), c, b = keep["zr"], keep["c"], keep["b"]
    # What does not depend on later steps, for the whole window at once.
    shut = 1 - z
    by_z, by_c, by_r = (before - c) * z * shut, shut * (1 - c * c), b * r * (1 - r)
    # Gradients of the gates, as the state before meets them and, of the last, as the input does.
    to_back, d_c = np.zeros((3, *before.shape), np.float32), np.zeros(before.shape, np.float32)
    from_back = np.ascontiguousarray(_by_gate(w["back"]).transpose(0, 2, 1))
    dh = np.zeros_like(h)
    for t in range(len(codes) - 1, -1, -1):
        n = int(active[t])
        d, g, dc = dh[:n], to_back[:, t, :n], d_c[t, :n]
        dc[...] = d * by_c[t, :n]
        g[0], g[1], g[2] = d * by_z[t, :n], dc * by_r[t, :n], dc * r[t, :n]
        d *= z[t, :n]
        for part in g @ from_back:
            d += part
        dh += d_before[t]
    grads["back"] = np.concatenate([flatly(before).T @ flatly(g) for g in to_back], axis=1)
    order = _sorted(flat, v.inputs)
    ascending, by_code = flat[order], used[order]
    opens = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1]))
    d_gates = np.concatenate([flatly(g).take(by_code, axis=0) for g in (to_back[0], to_back[1], d_c)], axis=1)
    rows, sums = ascending[opens], np.add.reduceat(d_gates, opens, axis=0)
    scale = np.float32(1 / max(1, len(flat)))
    for name, g in grads.items():
        g = g * scale
        memory[name] += g * g
        w[name] -= p.rate * g / (np.sqrt(memory[name]) + 1e-6)
    g = sums * scale
    seen = memory["gates"][rows] + g * g
    memory["gates"][rows] = seen
    w["gates"][rows] -= p.rate * g / (np.sqrt(seen) + 1e-6)
    # The state after the window, with the new weights left for the next one.
    last = before[-1].copy()
    n = int(active[-1])
    last[:n] = c[-1, :n] + z[-1, :n] * (last[:n] - c[-1, :n])
    return last


def _lanes(codes: np.ndarray, sizes: np.ndarray, group: np.ndarray, end: int, start: int, stop: int, offsets: np.ndarray):
    """Steps start..stop of the texts of a group (longest first): codes by step and lane, and how many lanes are active."""
    lengths = sizes[group] + 1
    stop = min(stop, int(lengths[0]))
    active = np.searchsorted(-lengths, -np.arange(start, stop), side="left")
    steps = np.arange(start, stop)[:, None]
    at = offsets[group][None, :] + steps
    inside = steps < sizes[group][None, :]
    if len(codes):
        out = np.where(inside, codes.take(at, mode="clip"), end)
    else:
        out = np.full(at.shape, end)
    return out, active


def _packed(w: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as found:
        return {k: found[k].copy() for k in found.files}


def _trained(shared, weights: bytes, p: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w, tokens = Vocabulary.of(shared.value), _unpacked(weights), 0
        memory = {k: np.zeros_like(x) for k, x in w.items()}
        for batch in batches:
            h, kind, sizes = _words(batch["text"].tolist())
            codes, _ = v.look_up(h, kind)
            offsets = np.cumsum(sizes) - sizes
            order = np.argsort(-sizes, kind="stable")
            groups = [order[i : i + p.lanes] for i in range(0, len(order), p.lanes)]
            for g in np.random.Generator(np.random.PCG64(p.seed)).permutation(len(groups)):
                group, state = groups[g], np.zeros((len(groups[g]), p.hidden), np.float32)
                for start in range(0, int(sizes[group[0]]) + 1, p.window):
                    own, active = _lanes(codes, sizes, group, v.end, start, start + p.window, offsets)
                    n = int(active[0])
                    state = _learn(w, memory, v, own[:, :n], active, state[:n], p)
            tokens += int(sizes.sum()) + len(sizes)
        yield pd.DataFrame({"tokens": [tokens], "weights": [_packed(w)]})

    return run


def _averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean of weights by tokens seen, a few at a time."""
    total, sums = 0, None
    for batch in batches:
        for tokens, raw in zip(batch["tokens"], batch["weights"]):
            if tokens:
                w = {k: x.astype(np.float64) * tokens for k, x in _unpacked(raw).items()}
                sums = w if sums is None else {k: sums[k] + w[k] for k in w}
                total += tokens
    if sums is not None:
        yield pd.DataFrame({"tokens": [total], "weights": [_packed({k: x / total for k, x in sums.items()})]})


def train(training: DataFrame, shared, v: Vocabulary, p: Model) -> dict[str, np.ndarray]:
    """All training texts are learned once, in rounds; each task learns its part from the common weights, which are then averaged."""
    w = initial(v, p)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(p.rounds))
    for r in range(p.rounds):
        learned = training.where(part == r).select("text").mapInPandas(_trained(shared, _packed(w), p), "tokens long, weights binary")
        # A bounded number of means of bounded size comes to the driver.
        means = learned.repartition(16).mapInPandas(_averaged, "tokens long, weights binary").toPandas()
        for mean in _averaged([means]):
            w = {k: x.astype(np.float32) for k, x in _unpacked(mean["weights"].iloc[0]).items()}
    return w


def _scored(shared, weights: bytes, p: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w = Vocabulary.of(shared.value), _unpacked(weights)
        for batch in batches:
            h, kind, sizes = _words(batch["text"].tolist())
            codes, listed = v.look_up(h, kind)
            offsets = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            known = listed >= 0
            static, ones = np.zeros(len(h)), np.zeros(len(h))
            static[known] = v.static[listed[known]]
            ones[known] = np.log(v.counts[listed[known]] + 1)
            static[~known] = -np.log(v.kind_mass[kind[~known]])
            per = lambda x: np.bincount(of, weights=x, minlength=len(sizes))
            score = per(static).astype(np.float64)
            order = np.argsort(-sizes, kind="stable")
            for first in range(0, len(order), SCORED):
                group = order[first : first + SCORED]
                state = np.zeros((len(group), p.hidden), np.float32)
                for start in range(0, int(sizes[group[0]]) + 1, p.window):
                    own, active = _lanes(codes, sizes, group, v.end, start, start + p.window, offsets)
                    n = int(active[0])
                    own, state = own[:, :n], state[:n].copy()
                    before = _steps(w, own, active, state)
                    used = np.flatnonzero(np.arange(n)[None, :] < active[:, None])
                    logp, _ = _outputs(w, v, before.reshape(-1, p.hidden).take(used, axis=0), own.ravel()[used])
                    score[group[:n]] += np.bincount(used % n, weights=logp, minlength=n)
            out = batch[["row", "doc_id", "held_out"]].assign(
                n_tokens=sizes + 1, listed=per(known.astype(float)).astype(np.int64), log_counts=per(ones), log_model=score
            )
            cuts = np.cumsum(np.bincount(of[~known], minlength=len(sizes)))[:-1]
            out["rest"] = pd.Series(np.split(h[~known].view(np.int64), cuts) if len(sizes) else [], index=out.index, dtype=object)
            yield out

    return run


def score_documents(documents: DataFrame, held_out: Column, p: Model = Model()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text (null: empty).

    Tokens are words, A-Z lower-cased, and one end. Counts come from all texts that are not held out. ``base_score`` is the sum of
    log10 of the add-one shares; ``score`` the log10 probability under the network, which gives a class, then a
    word of it; words without an output of their own have their add-one share of their class, so both are
    distributions over the same tokens: every word of the training texts, and words never seen as one
    (``score``: one for each of four kinds). The state is carried through the whole text.

    Listed words are sent to all tasks (bounded by a share of all tokens); the counts of all others are joined. A
    null ``doc_id`` counts as not held out. With no training text all words are unseen. Repeated rows are scored
    alike; an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(count_words(training))
    ends = training.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (totals["n"] or 0) + ends, totals["v"] + (1 if ends else 0)
    least = max(2, -(-tokens // p.listed))
    listed = counts.where(F.col("n") >= least).select("hash", "n").toPandas()
    rest = np.zeros(KINDS)
    for r in counts.where(F.col("n") < least).groupBy("kind").agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        rest[r["kind"]] = r["mass"]
    v = Vocabulary(listed["hash"].to_numpy(np.int64).view(np.uint64), listed["n"].to_numpy(np.float64), ends, rest, p)
    shared = documents.sparkSession.sparkContext.broadcast(vars(v))
    w = train(training, shared, v, p)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, listed long, log_counts double, log_model double, rest array<long>"
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = materialize(numbered.mapInPandas(_scored(shared, _packed(w), p), schema))
    others = scored.select("row", F.explode("rest").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("times"))
    found = others.join(counts.where(F.col("n") < least).select("hash", "n"), "hash")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") + 1)).alias("log_rest"), F.sum("times").alias("known"))
    out = scored.join(sums, "row", "left")
    end, log10 = float(np.log(ends + 1)), float(np.log(10))
    per_token = float(np.log(tokens + distinct + 1))
    late = F.coalesce("log_rest", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("listed") + F.coalesce("known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        ((F.col("log_counts") + late + end - F.col("n_tokens") * per_token) / log10).alias("base_score"),
        ((F.col("log_model") + late) / log10).alias("score"),
    )
