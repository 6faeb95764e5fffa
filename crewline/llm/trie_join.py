"""Jaccard join of word n-gram sets by prefixes and tries in a global order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crewline.llm.common import components, materialize
from crewline.llm.hashing import distinct_sets, gram_hashes, mix, slices, word_hashes


@dataclass(frozen=True)
class Join:
    """Sets of distinct ``words``-word n-grams link when ``100 * intersection >= percent * union``."""

    words: int = 4
    percent: int = 85
    # First, sets show their prefix by hash and so many percent of their n-grams beyond it.
    spare: int = 10
    # A probe meets its candidates in tries of about so many sets.
    trie: int = 128
    # Rounds in which sets look for partners, the n-grams by which each looks, and the partners that each n-gram offers.
    rounds: int = 3
    scouts: int = 4
    heads: int = 3


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in an ascending table."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams as ascending hashes."""
    h, bounds = word_hashes(texts)
    grams, cuts = distinct_sets(*gram_hashes(h, bounds, words), len(texts))
    for i in range(len(texts)):
        yield grams[cuts[i] : cuts[i + 1]]


def _share(n, percent: int):
    """``ceil(percent * n / 100)``."""
    return -(-percent * n // 100)


def _described(p: Join, whole: bool, keep: tuple[str, ...] = ()):
    """Size and fingerprints of each text's set with its n-grams: all of them, or those that it shows first; ``keep`` are columns that stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for start, end in slices(texts):
                sizes, sums, marks, grams = [], [], [], []
                for own in _sets(texts[start:end], p.words):
                    n = len(own)
                    sizes.append(n)
                    sums.append(np.add.reduce(mix(own)))
                    marks.append(np.bitwise_xor.reduce(mix(own * np.uint64(3))))
                    grams.append((own if whole else own[: n - _share(n, p.percent) + _share(n, p.spare)]).view(np.int64))
                out = pd.DataFrame({c: batch[c].iloc[start:end].to_numpy() for c in ("doc_id", *keep)})
                out["n"] = np.array(sizes, np.int64)
                out["f1"], out["f2"] = np.array(sums, np.uint64).view(np.int64), np.array(marks, np.uint64).view(np.int64)
                out["grams"] = pd.Series(grams, dtype=object)
                yield out

    return run


def described(documents: DataFrame, p: Join, whole: bool = False) -> DataFrame:
    """``doc_id, n, grams, set`` of every row; ``set`` is a number made of size and fingerprints, equal for equal sets."""
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_described(p, whole), "doc_id long, n long, f1 long, f2 long, grams array<long>")
    return found.select("doc_id", "n", "grams", F.xxhash64("n", "f1", "f2").alias("set"))


def sifted(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose number in ``column`` is among those of ``wanted`` (its only column), and a few others.

    The numbers wanted are one bit each of bitmaps of 32,768, of about 32 bits a number and at most 8 MB together, which
    are sent to the rows, so that rows not wanted leave where they are read. With ever more numbers more of the others stay.
    """
    pieces, n = 1, wanted.count()
    while pieces < 2048 and pieces * 1024 < n:
        pieces *= 2
    hashed = lambda name: (F.pmod(F.xxhash64(name), F.lit(pieces)).alias("piece"), F.pmod(F.shiftright(F.xxhash64(name), 12), F.lit(32768)).alias("bit"))
    marks = wanted.select(*hashed(wanted.columns[0])).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("marks"))
    among = F.expr("shiftright(cast(conv(hex(substring(marks, cast(bit div 8 AS int) + 1, 1)), 16, 10) AS int), cast(bit % 8 AS int)) & 1 = 1")
    return rows.select("*", *hashed(column)).join(F.broadcast(marks), "piece").where(among).select(*rows.columns)


def not_alone(sets: DataFrame, p: Join) -> DataFrame:
    """``set, n, rep`` of the sets that may link: enough of the n-grams that they show first are shown by another set too.

    Each set shows, in order of hash, as many n-grams as a partner may lack and a share ``k`` of its size more. The first ``k``
    n-grams that two linked sets have in common, ``k`` of the smaller one, are then shown by both.
    """
    shown = sets.select("set", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("set").alias("set"), F.max("set").alias("other"))
    single = shown.where("set = other").groupBy("set").agg(F.count("*").alias("single"))
    every = sets.groupBy("set", "n").agg(F.min("doc_id").alias("rep"), F.max(F.size("grams")).alias("shown"))
    least = F.expr(f"(({p.percent} * n + 99) div 100 * {p.spare} + 99) div 100")
    return every.join(single.hint("merge"), "set", "left").where(F.col("shown") - F.coalesce("single", F.lit(0)) >= least).select("set", "n", "rep")


def _gathered(p: Join):
    """Rows of ``id, n, gram`` in that order to one row for each set; of a repeated n-gram one is taken."""

    def closed(ids, sizes, grams):
        begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        bodies = np.split(grams, begins[1:])
        held = np.array([len(x) for x in bodies], np.int64)
        n = sizes[begins]
        fine = np.flatnonzero(held >= _share(n, p.percent))
        bodies, held, n = [bodies[i] for i in fine], held[fine], n[fine]
        out = pd.DataFrame({"id": ids[begins][fine], "n": n, "held": held})
        out["body"] = pd.Series(bodies, dtype=object)
        out["prefix"] = pd.Series([x[: k + 1] for x, k in zip(bodies, held - _share(n, p.percent))], dtype=object)
        # The least by another hash: two sets share each with the chance of their similarity.
        out["scouts"] = pd.Series([x[np.argsort(mix(x.view(np.uint64) * np.uint64(5)))[: p.rounds * p.scouts]] for x in bodies], dtype=object)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            ids, sizes, grams = [np.append(x, batch[c].to_numpy(np.int64)) for x, c in zip(held, ("id", "n", "gram"))]
            fresh = np.append(True, (ids[1:] != ids[:-1]) | (grams[1:] != grams[:-1]))[: len(ids)]
            ids, sizes, grams = ids[fresh], sizes[fresh], grams[fresh]
            last = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            held = [ids[last:], sizes[last:], grams[last:]]
            if last:
                yield closed(ids[:last], sizes[:last], grams[:last])
        if len(held[0]):
            yield closed(*held)

    return run


def in_order(documents: DataFrame, left: DataFrame, p: Join) -> DataFrame:
    """``id, n, held, body, prefix, scouts`` of the sets ``left`` that may link: their ``held`` n-grams that others of them have, rarest first.

    The others are known to match nothing, so they come first in the global order and are only counted. The order is
    that of the number of sets which have an n-gram (within half a power of two), then of its hash.
    """
    ours = left.select(F.col("rep").alias("doc_id"), "id", F.col("set").alias("own"))
    texts = sifted(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ours.select("doc_id"))
    # Joins are merged at every size, so that what is shuffled grows with the input and not with the end of a broadcast.
    held = texts.join(ours.hint("merge"), "doc_id").mapInPandas(_described(p, True, ("id", "own")), "doc_id long, id long, own long, n long, f1 long, f2 long, grams array<long>")
    whole = materialize(held.where(F.xxhash64("n", "f1", "f2") == F.col("own")).select("id", "n", "grams"))
    # Dealt once by n-gram, both to be counted and to meet the counts; so both read the same columns.
    grams = whole.select("id", "n", F.explode("grams").alias("gram")).repartition("gram")
    often = grams.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("n").alias("times")).where("lo <> hi")
    rank = F.expr("shiftleft(cast(floor(2 * log2(times)) AS bigint), 56) | shiftrightunsigned(gram, 8)").alias("gram")
    ranked = grams.join(often.select("gram", "times").hint("merge"), "gram").select("id", "n", rank)
    return ranked.repartition("id").sortWithinPartitions("id", "n", "gram").mapInPandas(
        _gathered(p), "id long, n long, held long, body array<long>, prefix array<long>, scouts array<long>"
    )


def _traverse(probe: np.ndarray, n: int, held: int, sets: list[np.ndarray], sizes: list[int], helds: list[int], ids: list[int], p: Join) -> list[int]:
    """Ids of the sets that can link with the probe, as far as the members given tell; of whole sets, those that do.

    ``probe`` and ``sets`` are the n-grams of sets that other sets have too, all of them or the first in the global order;
    ``held`` and ``helds`` say how many there are, ``n`` and ``sizes`` are the sizes of the whole sets. The sets, in lexicographic order, are the paths of a trie: neighbours share the nodes of their common
    beginning, and so the count of unmatched members up to there. A node with more unmatched members than the longest
    set could afford is pruned with everything below it.
    """
    need = [-(-p.percent * (n + m) // (100 + p.percent)) for m in sizes]
    most = max(m - k for m, k in zip(helds, need))
    last = probe[-1] if len(probe) else np.uint64(0)
    order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
    found, path, unmatched, pruned = [], np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    for i in order:
        own = sets[i]
        short = min(len(own), len(path))
        apart = np.flatnonzero(own[:short] != path[:short])
        common = int(apart[0]) if len(apart) else short
        if pruned is not None and common > pruned:
            continue  # below a pruned node
        rest = own[common:]
        before = unmatched[common - 1] if common else 0
        whole = len(probe) == held
        # Beyond the end of the probe's prefix nothing is known.
        missing = ~_isin(rest, probe) if whole else ~_isin(rest, probe) & (rest <= last)
        path, unmatched = own, np.concatenate((unmatched[:common], before + np.cumsum(missing)))
        over = np.flatnonzero(unmatched > most)
        pruned = int(over[0]) if len(over) else None
        if pruned is None and len(own):
            seen = own if whole else own[own <= last]
            mine = probe if len(own) == helds[i] else probe[probe <= own[-1]]
            shared = len(seen) - int(unmatched[-1])
            if shared + min(held - len(mine), helds[i] - len(seen)) >= need[i]:
                found.append(ids[i])
    return found


def _probed(p: Join):
    """Probes and candidates in order of probe, trie and role: first the probe itself, then its candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, probe, n, held, sets, sizes, helds, ids = None, None, 0, 0, [], [], [], []

        def close():
            hits = _traverse(probe, n, held, sets, sizes, helds, ids, p) if sets and probe is not None else []
            return pd.DataFrame({"a": np.full(len(hits), key[0] if key else 0, np.int64), "b": np.array(hits, np.int64)})

        for batch in batches:
            out = []
            for a, t, role, own_id, size, some, body in zip(*[batch[c] for c in ("a", "trie", "role", "id", "n", "held", "body")]):
                own = np.asarray(body, np.int64).view(np.uint64)
                if (a, t) != key:
                    out.append(close())
                    key, probe, sets, sizes, helds, ids = (a, t), None, [], [], [], []
                if role == 0:
                    probe, n, held = own, size, some
                else:
                    sets.append(own)
                    sizes.append(size)
                    helds.append(some)
                    ids.append(own_id)
            if out:
                yield pd.concat(out, ignore_index=True)
        yield close()

    return run


def probe_tries(pairs: DataFrame, bodies: DataFrame, p: Join) -> DataFrame:
    """The pairs ``a, b`` that pass ``_traverse``. ``bodies`` has ``id, n, held, body``; a probe with many candidates gets several tries."""
    tries = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.trie).cast("int").alias("tries"))
    members = pairs.join(tries, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tries").cast("long")).cast("int").alias("trie"), F.lit(1).alias("role"), F.col("b").alias("id"))
    probes = tries.select("a", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("trie"), F.lit(0).alias("role"), F.col("a").alias("id"))
    met = sifted(bodies, "id", pairs.select("a").union(pairs.select("b")))
    rows = members.unionByName(probes).join(met.hint("merge"), "id")
    dealt = rows.select("a", "trie", "role", "id", "n", "held", "body").repartition("a", "trie").sortWithinPartitions("a", "trie", "role")
    return materialize(dealt.mapInPandas(_probed(p), "a long, b long"))


def verify(pairs: DataFrame, reps: DataFrame, p: Join) -> DataFrame:
    """The pairs whose sets link: prefixes sort out nearly all others, then whole sets decide."""
    likely = probe_tries(materialize(pairs), reps.select("id", "n", "held", F.col("prefix").alias("body")), p)
    return probe_tries(likely, reps.select("id", "n", "held", "body"), p)


def ngram_groups(documents: DataFrame, p: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, linked at the similarity of ``p``.

    Words are runs without white space, A-Z lower-cased; a text with fewer words than an n-gram counts as one
    n-gram; a text without words (or null) has an empty set and links with nothing. Equal sets are folded first.

    A set of which too many n-grams are in no other set links with nothing. Most such sets are found by the first of their
    n-grams in order of hash, the others by all; what is left is in one global order, the rarest n-grams first. Two
    sets that link share an n-gram of their prefixes. First, in a few rounds, every set looks for partners with a few n-grams
    chosen by hash: of the sets of about its size that share one and are in other groups yet, it meets a few. What links so is
    a group. Then all prefixes are compared, but only across groups, so a large group of near copies does not grow into
    all its pairs, and no link between groups is lost. Candidates meet in tries, of prefixes and then of whole sets (see
    ``_traverse``). N-grams are told apart by hashes of 64 bits, and of 56 beside their rank among the sets that are left.

    Rows with a null ``doc_id`` link with nothing and have a null component. Rows that share a ``doc_id`` are
    grouped by their own texts. Repeated rows stay; other columns play no part; an empty table gives no rows.
    """
    sets = materialize(described(documents, p))
    linked = sets.where("n > 0 AND doc_id IS NOT NULL")
    left = materialize(not_alone(linked, p).withColumn("id", F.monotonically_increasing_id()))
    reps = materialize(in_order(documents, left, p))

    band = F.floor(F.log("n") / float(-np.log(p.percent / 100))).cast("int").alias("band")
    # Whole sets stay behind; only what looks for partners is written again with its group.
    seekers = reps.drop("body")
    first, grouped = None, seekers.withColumn("grp", F.col("id"))
    for turn in range(p.rounds):
        scouts = grouped.select("id", "grp", band, (F.col("n") - F.col("held")).alias("own"), F.explode(F.slice("scouts", turn * p.scouts + 1, p.scouts)).alias("gram"))
        # The first has the fewest n-grams of its own: near copies differ less from what they were made of than from each other.
        offered = [F.min(F.struct((F.col("own") * int(i == 0)).alias("own"), F.xxhash64("id", "gram", F.lit(i)).alias("by"), "id", "grp")) for i in range(p.heads)]
        heads = scouts.groupBy("gram", "band").agg(F.array(*offered).alias("heads"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi")
        stars = scouts.join(heads, ["gram", "band"]).select("id", "grp", F.explode("heads").alias("head")).where("grp <> head.grp")
        stars = stars.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct()
        found = verify(stars, reps, p)
        first = found if first is None else first.unionByName(found)
        near = components(first)
        grouped = materialize(seekers.join(near, "id", "left").withColumn("grp", F.coalesce("component", "id")).drop("component"))

    posts = grouped.select("id", "n", "held", "grp", F.posexplode("prefix").alias("place", "gram"))
    crossed = posts.groupBy("gram").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo != hi").select("gram")
    shared = materialize(posts.join(crossed, "gram", "left_semi"))
    a, b = [shared.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "held", "grp", "place")]) for side in "ab"]
    alike = (F.col("a_n") * p.percent <= F.col("b_n") * 100) & (F.col("b_n") * p.percent <= F.col("a_n") * 100)
    # Before their first common n-gram two sets share nothing: what is left from there on must reach the overlap needed.
    ahead = F.least(F.col("a_held") - F.col("a_place"), F.col("b_held") - F.col("b_place"))
    reaches = ahead * (100 + p.percent) >= (F.col("a_n") + F.col("b_n")) * p.percent
    # The smaller set (then the smaller id) is the probe.
    ordered = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_id") < F.col("b_id")))
    met = a.join(b, "gram").where((F.col("a_grp") != F.col("b_grp")) & alike & reaches & ordered)
    second = verify(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct(), reps, p)

    groups = left.join(components(first.unionByName(second)), "id").select("set", F.col("component").alias("grp"))
    named = materialize(linked.select("doc_id", "n", "set").join(groups, "set", "left"))
    # A group is named by its number, a set without links by its own; then by the smallest id of its documents.
    named = named.select("doc_id", "n", "grp", F.when(F.col("grp").isNull(), F.col("set")).alias("own"))
    least = named.groupBy("grp", "own").agg(F.min("doc_id").alias("component_id"))
    same = named.alias("x").join(least.alias("y"), F.expr("x.grp <=> y.grp AND x.own <=> y.own"))
    verdicts = same.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return verdicts.unionByName(alone)
