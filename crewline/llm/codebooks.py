"""Vector code compression: integer k-means codebooks per part, assigned with Drake-Hamerly adaptive bounds.

Each kept vector becomes integers floor(1024 x) and is cut into ``PARTS`` equal consecutive parts. A part
position's codebook starts as that part of the rows with the ``ENTRIES`` smallest vec_ids. Each of
``ROUNDS`` rounds assigns every part to its nearest entry (squared Euclidean distance, ties to the lower
index) and replaces every used entry by the componentwise floor of its parts' mean; a last pass assigns
again. The result is the exact result of that procedure; the bounds only skip work.

Bounds (Drake and Hamerly's adaptive k-means): every part keeps an upper bound on the distance to its
entry, the ``b`` nearest other entries with lower bounds in ascending order, and one outer lower bound
for all entries not listed. When entries move, the upper bound grows by the move of its entry, each
listed lower bound shrinks by the move of its entry and the outer bound by the largest move. A part whose
upper bound is below every lower bound keeps its entry without any distance; otherwise the distance to
its entry is computed exactly in integers; if still uncertain, the listed entries are measured exactly,
and only when the outer bound does not exclude the rest are all entries measured and the list rebuilt.
``b`` adapts per round: it doubles when more than ``WIDEN`` of the parts needed all entries and halves
when fewer than ``NARROW`` did. Bounds are floating point with a safety margin, so every decision they
allow is exact; distances are int64 where the integers are small enough, Python integers otherwise.

State (vector, entry, bounds) is written to the shared folder after each round, so a lost executor
costs one round, and the folder of the round before is deleted. Per round only the partial sums per
(part, entry, position) are shuffled; the codebooks (parts x entries x width integers) go to the driver
and back to the tasks: their size is fixed by the parameters, not by the data.

Nulls and edge cases: rows whose vector is null, holds nulls or non-finite numbers are dropped; so are
vectors whose length differs from that of the row with the smallest vec_id, is zero or is not divisible
by ``PARTS``, and vectors with a component whose integer exceeds 2^52 in size (not a long after
scaling). Labels may be of any type and null (nulls form one group). Repeated rows are rows each; ties of
vec_id among the first entries are ordered by the vector. An empty table gives an empty result with the
same columns. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from crewline.llm.common import finite_vector, materialize
from crewline.session import shared_dir

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
B_START = 4
WIDEN = 0.10
NARROW = 0.01
SALT = 16
SLACK = 1e-9
SMALL = 1 << 20  # products and sums of 16 stay exact in float64 below this
SAFE = 1 << 28  # squared distances of 16 stay in int64 below this


def _delete(spark, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows v (n x w) to rows c (k x w)."""
    big = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if big < SMALL:
        vf, cf = v.astype(np.float64), c.astype(np.float64)
        d = (vf * vf).sum(1)[:, None] - 2 * vf @ cf.T + (cf * cf).sum(1)[None, :]
        return np.rint(d).astype(np.int64)
    if big < SAFE:
        return ((v[:, None, :] - c[None, :, :]) ** 2).sum(2)
    vo, co = v.astype(object), c.astype(object)
    return ((vo[:, None, :] - co[None, :, :]) ** 2).sum(2)


def _pair(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of row i of v to row i of c."""
    big = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if big < SAFE:
        return ((v - c) ** 2).sum(1)
    return ((v.astype(object) - c.astype(object)) ** 2).sum(1)


def _root(d) -> np.ndarray:
    return np.sqrt(np.asarray(d, dtype=np.float64))


def _order(d: np.ndarray) -> np.ndarray:
    """Per row, entries by distance, ties to the lower index."""
    if d.dtype != object:
        return np.argsort(d, axis=1, kind="stable")
    return np.array([sorted(range(d.shape[1]), key=lambda j: (d[r, j], j)) for r in range(d.shape[0])], dtype=np.int64).reshape(d.shape)


def _full(v, c, width):
    """Entry, exact distance, listed entries with exact lower bounds, and outer bound, by measuring all."""
    d = _squared(v, c)
    k = c.shape[0]
    order = _order(d)
    rows = np.arange(len(v))[:, None]
    best = order[:, 0]
    dist = d[rows[:, 0], best]
    w = min(width, k - 1)
    listed = order[:, 1 : 1 + w]
    low = _root(d[rows, listed]) if w else np.zeros((len(v), 0))
    outer = _root(d[rows[:, 0], order[:, 1 + w]]) if w < k - 1 else np.full(len(v), np.inf)
    return best, dist, listed, low, outer


def _down(x):
    return x * (1 - SLACK) - SLACK


def _up(x):
    return x * (1 + SLACK) + SLACK


def _fit(listed, low, outer, width):
    """Lists of exactly ``width`` places: padded with no entry, or cut with the cut bounds in ``outer``."""
    n, w = listed.shape
    if width > w:
        return np.concatenate([listed, np.full((n, width - w), -1)], 1), np.concatenate([low, np.full((n, width - w), np.inf)], 1), outer
    if width < w:
        return listed[:, :width], low[:, :width], np.minimum(outer, low[:, width:].min(axis=1, initial=np.inf))
    return listed, low, outer


def _assign(v, c, state, drift, width):
    """One assignment of parts ``v`` to codebook ``c``.

    ``state`` is (entry, upper, listed, lower, outer) of the round before, or None in the first round.
    Returns the new state, lists of exactly ``width`` places, and the number of parts that measured all.
    """
    n, k = len(v), c.shape[0]
    width = min(width, k - 1)
    if state is None:
        best, dist, listed, low, outer = _full(v, c, width)
        return (best, _up(_root(dist)), listed, _down(low), _down(outer)), n
    entry, upper, listed, low, outer = (np.array(x, copy=True) for x in state)
    listed, low, outer = _fit(listed, low, outer, width)
    has = listed >= 0
    upper = _up(upper + drift[entry])
    low = np.where(has, _down(low - drift[np.where(has, listed, 0)]), np.inf)
    outer = _down(outer - float(drift.max(initial=0.0)))
    bound = np.minimum(low.min(axis=1, initial=np.inf), outer)
    open_ = ~(upper < bound)
    if open_.any():
        i = np.flatnonzero(open_)
        upper[i] = _up(_root(_pair(v[i], c[entry[i]])))
        open_[i] = ~(upper[i] < bound[i])
    # The listed entries settle a part when the outer bound excludes all the others: measure only them.
    near = open_ & (outer > upper)
    if near.any():
        i = np.flatnonzero(near)
        cand = np.concatenate([entry[i][:, None], np.where(has[i], listed[i], entry[i][:, None])], axis=1)
        valid = np.concatenate([np.ones((len(i), 1), bool), has[i]], axis=1)
        d = np.stack([_pair(v[i], c[cand[:, j]]) for j in range(cand.shape[1])], axis=1)
        if d.dtype == object:
            key = np.where(valid, d, None)
            order = np.array([sorted(range(cand.shape[1]), key=lambda j: (key[r, j] is None, key[r, j] or 0, cand[r, j])) for r in range(len(i))], dtype=np.int64).reshape(cand.shape)
        else:
            order = np.lexsort((cand, np.where(valid, d, np.iinfo(np.int64).max)), axis=1)
        rows = np.arange(len(i))[:, None]
        entry[i] = cand[rows[:, 0], order[:, 0]]
        upper[i] = _up(_root(d[rows[:, 0], order[:, 0]]))
        rest = order[:, 1:]
        keep = valid[rows, rest]
        listed[i] = np.where(keep, cand[rows, rest], -1)
        low[i] = np.where(keep, _down(_root(np.where(keep, d[rows, rest], 0))), np.inf)
        open_[i] = False
    full = np.flatnonzero(open_)
    if len(full):
        best, d, lst, lw, ot = _full(v[full], c, width)
        entry[full] = best
        upper[full] = _up(_root(d))
        listed[full] = lst
        low[full] = _down(lw)
        outer[full] = _down(ot)
    return (entry, upper, listed, low, outer), len(full)


def _round(codebook, drift, width, dim, final):
    part = dim // PARTS

    def column(frame, name, p, n, dtype):
        return np.array([x[p] for x in frame[name].tolist()], dtype=dtype).reshape(n, -1)

    def run(batches):
        for frame in batches:
            n = len(frame)
            v = np.array(frame["v"].tolist(), dtype=np.int64).reshape(n, dim)
            out = pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "v": frame["v"]})
            states, fulls, error = [], 0, [0] * n
            for p in range(PARTS):
                vp, c = v[:, p * part : (p + 1) * part], codebook[p]
                state = None
                if drift is not None:
                    state = (
                        column(frame, "entry", p, n, np.int64)[:, 0],
                        column(frame, "upper", p, n, np.float64)[:, 0],
                        column(frame, "listed", p, n, np.int64),
                        column(frame, "lower", p, n, np.float64),
                        column(frame, "outer", p, n, np.float64)[:, 0],
                    )
                new, full = _assign(vp, c, state, None if drift is None else drift[p], width)
                states.append(new)
                fulls += full
                if final:
                    error = [e + int(x) for e, x in zip(error, _pair(vp, c[new[0]]).tolist())]
            out["entry"] = np.stack([s[0] for s in states], 1).tolist()
            out["upper"] = np.stack([s[1] for s in states], 1).tolist()
            out["listed"] = np.stack([s[2] for s in states], 1).tolist()
            out["lower"] = np.stack([s[3] for s in states], 1).tolist()
            out["outer"] = np.stack([s[4] for s in states], 1).tolist()
            out["full"] = fulls
            if final:
                out["error"] = pd.array([e if e < 2**63 else None for e in error], dtype="Int64")
            yield out

    return run


def _state_schema(label: T.DataType, final: bool) -> T.StructType:
    fields = [
        T.StructField("vec_id", T.LongType()),
        T.StructField("label", label),
        T.StructField("v", T.ArrayType(T.LongType())),
        T.StructField("entry", T.ArrayType(T.LongType())),
        T.StructField("upper", T.ArrayType(T.DoubleType())),
        T.StructField("listed", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("lower", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("outer", T.ArrayType(T.DoubleType())),
        T.StructField("full", T.LongType()),
    ]
    if final:
        fields.append(T.StructField("error", T.LongType()))
    return T.StructType(fields)


def _updated(state: DataFrame, codebook: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """New entries: floor of the mean of their parts per component; unused entries stay."""
    part = dim // PARTS
    sums = (
        state.select("entry", F.posexplode("v").alias("pos", "x"))
        .select((F.col("pos") / part).cast("int").alias("part"), "pos", "entry", "x")
        .select("part", (F.col("pos") % part).alias("pos"), F.element_at("entry", F.col("part") + 1).alias("idx"), "x")
        .groupBy("part", "idx", "pos")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    new = [c.astype(object).copy() for c in codebook]
    for r in sums:
        new[r["part"]][r["idx"], r["pos"]] = int(r["s"]) // int(r["n"])
    return [_typed(c) for c in new]


def _typed(c: np.ndarray) -> np.ndarray:
    big = max((abs(int(x)) for x in c.ravel()), default=0)
    return c.astype(np.int64) if big < 2**62 else c.astype(object)


def _drift(old: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    return [_root(((o.astype(object) - n.astype(object)) ** 2).sum(1).astype(np.float64)) * (1 + SLACK) + SLACK for o, n in zip(old, new)]


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, v``: usable rows with integer components, all of one length divisible by ``PARTS``."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").alias("label"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    rows = rows.where(finite_vector(F.col("e")) & F.forall("e", lambda x: F.abs(x) < F.lit(2.0**52 / SCALE)))
    return rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * SCALE)).alias("v"))


def compress(embeddings: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, entry`` (per part), ``error``; and the final codebooks (one array per part)."""
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings)
    first = vectors.orderBy("vec_id", "v").limit(ENTRIES).collect()
    label_type = vectors.schema["label"].dataType
    if not first:
        empty = spark.createDataFrame([], _state_schema(label_type, True))
        return empty.select("vec_id", "label", "entry", "error"), []
    dim = len(first[0]["v"])
    if dim == 0 or dim % PARTS:
        empty = spark.createDataFrame([], _state_schema(label_type, True))
        return empty.select("vec_id", "label", "entry", "error"), []
    part = dim // PARTS
    starts = [r["v"] for r in first if len(r["v"]) == dim]
    codebook = [_typed(np.array([s[p * part : (p + 1) * part] for s in starts], dtype=object)) for p in range(PARTS)]
    state = materialize(vectors.where(F.size("v") == dim))
    drift, width, paths = None, B_START, []
    for r in range(ROUNDS + 1):
        final = r == ROUNDS
        step = state.mapInPandas(_round(codebook, drift, width, dim, final), _state_schema(label_type, final))
        path = shared_dir(spark)
        state = materialize(step, path)
        for old in paths:
            _delete(spark, old)
        paths = [path]
        if final:
            break
        stats = state.agg(F.sum("full").alias("full"), F.count(F.lit(1)).alias("n")).first()
        share = (stats["full"] or 0) / max(1, (stats["n"] or 0) * PARTS)
        new = _updated(state, codebook, dim)
        drift = _drift(codebook, new)
        codebook = new
        if share > WIDEN:
            width = min(2 * width, ENTRIES - 1)
        elif share < NARROW:
            width = max(1, width // 2)
    return state.select("vec_id", "label", "entry", "error"), codebook


def codebooks_sha256(codebook: list[np.ndarray]) -> str:
    """sha256 of all entries' decimal components by part, entry, position, joined by commas."""
    text = ",".join(str(int(x)) for c in codebook for row in c for x in row)
    return hashlib.sha256(text.encode()).hexdigest()


def coded(embeddings: DataFrame) -> DataFrame:
    """The columns of op11: ``vec_id, code, error, label_error, codebooks_sha256``, plus ``label``."""
    spark = embeddings.sparkSession
    rows, codebook = compress(embeddings)
    digest = codebooks_sha256(codebook)
    code = F.array_join(F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    # Sums per label are few rows; joined back salted, so a label with a third of all rows is spread.
    salt = F.pmod(F.xxhash64("vec_id", "error"), F.lit(SALT))
    sums = rows.groupBy("label").agg(F.try_sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = sums.select(F.col("label").alias("l"), F.col("label_error").cast("decimal(38,0)").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = rows.withColumn("salt", salt)
    out = out.join(sums, out["label"].eqNullSafe(sums["l"]) & (out["salt"] == sums["salt"]), "left")
    fits = F.col("label_error") < F.lit(str(2**63)).cast("decimal(38,0)")
    return out.select(
        "vec_id",
        code.alias("code"),
        "error",
        F.when(fits, F.col("label_error").cast("long")).alias("label_error"),
        F.lit(digest).alias("codebooks_sha256"),
        "label",
    )
