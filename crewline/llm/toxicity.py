"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from crewline.llm.hashing import PLACES, mix, slices, word_and_stem_hashes


STEMS = (3, 4, 5, 6, 7, 8)
# Characters hashed at a time: what comes between stays small beside the texts.
SLICE = 1 << 18


@dataclass(frozen=True)
class Ftrl:
    """``bits`` of hash space, per-coordinate learning rates ``alpha / (beta + sqrt(n))``, penalties, passes.

    At most ``max_rows`` labelled rows are used, those with the smallest hash of their id.
    """

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    passes: int = 4
    # Weight of a row of label 1, the rarer one.
    positive: float = 2.0
    max_rows: int = 20_000


def features(texts: Sequence[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (repeated ones included) and the text of each: words, their beginnings, pairs, and pairs around one word.

    Beginnings of some bytes stand for the word in its other forms and with other punctuation behind it.
    """
    h, bounds, stems = word_and_stem_hashes(texts, STEMS)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    numbers, owners = [mix(h * PLACES[8])], [of]
    for word, begin in stems:
        numbers.append(begin)
        owners.append(of[word])
    for apart, (left, right) in ((1, (PLACES[9], PLACES[10])), (2, (PLACES[11], PLACES[12]))):
        same = np.flatnonzero(of[apart:] == of[:-apart]) if len(of) > apart else np.zeros(0, np.int64)
        numbers.append(mix(h[same] * left + h[same + apart] * right))
        owners.append(of[same])
    return (np.concatenate(numbers) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def packed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers by their lower 16 bits, and how many have each upper part: half the memory of 32 bits."""
    return at.astype(np.uint16), np.bincount(at >> 16).astype(np.int32)


def unpacked(low: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return low + np.repeat(np.arange(len(parts)) << 16, parts)


class Learner:
    """FTRL-proximal: one accumulated gradient ``z`` and one sum of squares ``n`` per coordinate; the last is the bias."""

    def __init__(self, p: Ftrl):
        self.p, self.z, self.n = p, np.zeros(2**p.bits + 1), np.zeros(2**p.bits + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= self.p.positive if label else 1.0
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def _train(p: Ftrl):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[tuple[np.ndarray, np.ndarray], float]] = []
        for batch in batches:
            for start, end in slices(batch["text"].tolist(), SLICE):
                part = batch.iloc[start:end]
                number, of = features(part["text"].tolist(), p.bits)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(1, len(part)))
                for own, label in zip(np.split(number[order], cuts), part["label"]):
                    rows.append((packed(np.append(np.unique(own), 2**p.bits)), float(label)))
        learner, random = Learner(p), np.random.Generator(np.random.PCG64(11))
        for _ in range(p.passes):
            for i in random.permutation(len(rows)):
                numbers, label = rows[i]
                learner.learn(unpacked(*numbers), label)
        w = learner.weights()
        at = np.flatnonzero(w)
        yield pd.DataFrame({"feature": at.astype(np.int64), "weight": w[at]})

    return run


def labelled_sample(documents: DataFrame, labels: DataFrame, label: Column, max_rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``max_rows`` labelled documents. Null labels are left out; of several labels of one document the greatest counts."""
    named = labels.select("doc_id", label.alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    chosen = named.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select("doc_id", "text")
    # The sample has at most max_rows small rows, so it may be sent to every executor.
    found = texts.join(F.broadcast(chosen), "doc_id")
    # A repeated document is learned once.
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def train(sample: DataFrame, p: Ftrl = Ftrl()) -> dict[int, float]:
    """Non-zero weights by feature number. The sample is bounded, so one task learns it in a fixed order."""
    ordered = sample.select("doc_id", "text", "label").coalesce(1).sortWithinPartitions("doc_id")
    return {r["feature"]: r["weight"] for r in ordered.mapInPandas(_train(p), "feature long, weight double").collect()}


def dense(weights: dict[int, float], bits: int) -> np.ndarray:
    out = np.zeros(2**bits + 1)
    out[list(weights)] = list(weights.values())
    return out


def margins(texts: Sequence[str | None], w: np.ndarray, bits: int) -> np.ndarray:
    """Sum of the weights of each text's distinct features, with the bias."""
    number, of = features(texts, bits)
    live = np.flatnonzero(w[number])
    pairs = np.unique(of[live] * np.int64(2**bits) + number[live])
    return w[-1] + np.bincount(pairs >> bits, weights=w[pairs & (2**bits - 1)], minlength=len(texts))


def score(documents: DataFrame, weights: dict[int, float], p: Ftrl = Ftrl()) -> DataFrame:
    """``documents`` with a new ``score`` from 0 to 1 of each whole text; a null or empty text gets the bias alone."""
    # The weights are few: L1 leaves at most 2 ** bits, as a rule some hundreds.
    table, bits = documents.sparkSession.sparkContext.broadcast(weights), p.bits
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c != "score"])
    wanted = StructType([*documents.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = dense(table.value, bits)
        for batch in batches:
            texts = batch["text"].tolist()
            parts = [margins(texts[start:end], w, bits) for start, end in slices(texts, SLICE)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            yield batch.assign(score=1 / (1 + np.exp(-np.clip(value, -500, 500))))

    return documents.mapInPandas(run, wanted)


def toxicity(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), parts: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Learned from labelled rows whose ``crc32(doc_id) % parts`` is not 0; lang, source and ids are no input of
    the score. A null or empty text gets the bias alone, and so does everything when there is no label to learn
    from (score 0.5). A null ``doc_id`` is scored like any other and is not held out. Rows stay as they are
    repeated; other columns of either table play no part.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    sample = labelled_sample(documents, labels.where(remainder != 0), F.col("toxic"), p.max_rows)
    scored = score(documents.select("doc_id", "text"), train(sample, p), p)
    held = F.coalesce(remainder == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
