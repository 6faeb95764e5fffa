"""Mixing to target weights by soft membership: domain posteriors and nonnegative document rates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from crewline.llm.common import materialize
from crewline.llm.hashing import PLACES, mix, slices, word_hashes
from crewline.llm.toxicity import labelled_sample


@dataclass(frozen=True)
class Mixing:
    """``bits`` of hash space for words; at most ``max_rows`` labelled rows are used; steps of the descent."""

    bits: int = 14
    max_rows: int = 20_000
    steps: int = 30
    tolerance: float = 1e-4


def _bins(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, bounds = word_hashes(texts)
    return (mix(h * PLACES[14]) >> np.uint64(64 - bits)).astype(np.int64), np.diff(bounds)


def _counts(domains: list[str], bits: int):
    place = {d: i for i, d in enumerate(domains)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, rows = np.zeros((len(domains), 2**bits), np.int64), np.zeros(len(domains), np.int64)
        for batch in batches:
            own = batch["label"].map(place).to_numpy()
            rows += np.bincount(own, minlength=len(domains))
            texts = batch["text"].tolist()
            for start, end in slices(texts):
                number, sizes = _bins(texts[start:end], bits)
                which = np.repeat(own[start:end], sizes) * 2**bits + number
                sums += np.bincount(which, minlength=sums.size).reshape(sums.shape)
        yield pd.DataFrame({"domain": np.arange(len(domains)), "n": rows, "words": [s.tobytes() for s in sums]})

    return run


class Classifier:
    """Multinomial naive Bayes over hashed words: log of the prior and of each word's share, by domain."""

    def __init__(self, prior: np.ndarray, shares: np.ndarray, bits: int):
        self.prior, self.shares, self.bits = prior, shares, bits

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text and its membership of each domain. The evidence of a text is divided by the root of its length, which keeps memberships soft."""
        p, counts = [], []
        for start, end in slices(texts):
            number, sizes = _bins(texts[start:end], self.bits)
            of = np.repeat(np.arange(end - start), sizes)
            logs = np.stack([np.bincount(of, weights=s[number], minlength=end - start) for s in self.shares], axis=1)
            logs = self.prior + logs / np.sqrt(np.maximum(sizes, 1))[:, None]
            logs = np.exp(logs - logs.max(axis=1, keepdims=True))
            p.append(logs / logs.sum(axis=1, keepdims=True))
            counts.append(sizes)
        if not p:
            return np.zeros(0, np.int64), np.zeros((0, len(self.prior)))
        return np.concatenate(counts), np.concatenate(p)


def fit(sample: DataFrame, domains: list[str], p: Mixing) -> Classifier:
    """From ``text, label`` rows; the sample is bounded, and each task sends one row of counts for each domain."""
    known = sample.where(F.col("label").isin(domains)).select("text", "label")
    sums, rows = np.ones((len(domains), 2**p.bits)), np.ones(len(domains))
    for part in known.mapInPandas(_counts(domains, p.bits), "domain long, n long, words binary").toLocalIterator():
        sums[part["domain"]] += np.frombuffer(part["words"], np.int64)
        rows[part["domain"]] += part["n"]
    return Classifier(np.log(rows / rows.sum()), np.log(sums / sums.sum(axis=1, keepdims=True)), p.bits)


def _with_memberships(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """``documents`` with ``n_tokens`` and ``membership``."""
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("n_tokens", "membership")])
    parts = (classifier.prior, classifier.shares, classifier.bits)
    table = documents.sparkSession.sparkContext.broadcast(parts)
    fields = [StructField("n_tokens", LongType()), StructField("membership", ArrayType(DoubleType()))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(*table.value)
        for batch in batches:
            counts, p = own.posteriors(batch["text"].tolist())
            yield batch.assign(n_tokens=counts, membership=pd.Series(list(p), index=batch.index, dtype=object))

    return documents.mapInPandas(run, StructType([*documents.schema.fields, *fields]))


def _rate(steps: list[np.ndarray]) -> Column:
    """Rate of a document after some steps of the descent; each is cut off at 0."""
    rate = F.lit(1.0)
    for step in steps:
        moved = rate - sum((F.get("membership", i) * float(x) for i, x in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), moved)
    return rate


def solve(known: DataFrame, targets: np.ndarray, p: Mixing, total: float | None = None, cover: bool = False) -> list[np.ndarray]:
    """Steps of projected gradient descent on the squared gap between expected and wanted tokens of the domains.

    ``known`` has ``n_tokens`` and ``membership``. Each step is a sum over all documents; a rate depends on its own
    document and the steps so far only, so rates are never stored. The gradient is taken in the metric of the
    documents' sizes and scaled by the matrix of shared memberships, so few steps are needed.
    """
    k = range(len(targets))
    share = [F.get("membership", i) for i in k]
    first = known.agg(
        F.sum("n_tokens").alias("all"),
        *[F.sum(F.col("n_tokens") * share[i]).alias(f"m{i}") for i in k],
        *[F.sum(F.col("n_tokens") * share[i] * share[j]).alias(f"s{i}_{j}") for i in k for j in k if j <= i],
    ).first()
    if not first["all"]:
        return []
    mass = np.array([first[f"m{i}"] for i in k])
    shared = np.array([[first[f"s{max(i, j)}_{min(i, j)}"] for j in k] for i in k])
    weights = targets / targets.sum()
    if cover:  # so much in all that no domain has to shrink
        total = float((mass / np.maximum(weights, 1e-12)).max())
    wanted = weights * (float(first["all"]) if total is None else total)
    scale = np.linalg.pinv(shared, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    now = mass
    for _ in range(p.steps):
        gap = now - wanted
        if np.abs(gap).sum() <= p.tolerance * wanted.sum():
            break
        steps.append(scale @ gap)
        row = known.select("n_tokens", "membership", _rate(steps).alias("rate")).agg(*[F.sum(F.col("rate") * F.col("n_tokens") * share[i]).alias(f"m{i}") for i in k]).first()
        now = np.array([row[f"m{i}"] for i in k])
    return steps


def mixed(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float], p: Mixing = Mixing(), cover: bool = False) -> DataFrame:
    """``documents`` with ``n_tokens``, ``membership`` (by domain, in order of name), ``rate`` and ``copies``.

    ``labelled`` has ``doc_id, label``; ``targets`` gives each domain its weight. A classifier learned from labelled
    texts predicts each document's membership of the domains; rates are nonnegative and their expected domain tokens
    match the targets as closely as rates allow, at the present number of tokens, or with ``cover`` at the number at which no
    domain shrinks. ``copies`` is the rate rounded up or down by a hash of the document, so its expectation is the rate.

    Labels that are null or outside the targets are not learned; without labels every membership is even. A null or
    empty text has the prior membership and no tokens. Repeated rows get equal rates; columns of the same names are
    replaced; an empty table stays empty.
    """
    domains = sorted(targets)
    sample = labelled_sample(documents, labelled, F.col("label"), p.max_rows)
    known = _with_memberships(documents, fit(sample, domains, p))
    steps = solve(materialize(known.select("n_tokens", "membership")), np.array([float(targets[d]) for d in domains]), p, cover=cover)
    even = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return known.withColumn("rate", _rate(steps)).withColumn("copies", F.floor(F.col("rate") + even).cast("int"))


# Weights of languages and quality as wanted in a training set.
TARGETS = {
    "en/good": 0.45, "en/poor": 0.10, "de/good": 0.14, "de/poor": 0.03, "fr/good": 0.14, "fr/poor": 0.03, "es/good": 0.09, "es/poor": 0.02,
}


def language_and_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, label`` of labelled documents: their language and whether their quality is good."""
    quality = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = documents.select("doc_id", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL").join(quality, "doc_id")
    return named.select("doc_id", F.concat("lang", F.when(F.col("quality") == 1, "/good").otherwise("/poor")).alias("label"))
