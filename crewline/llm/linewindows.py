"""Removal of passages that repeat, by overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WIDTH = 3


def _windows(documents: DataFrame, width: int) -> DataFrame:
    """One row per window of ``width`` consecutive lines: two hashes of its lines, its number and its lines' places."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    placed = F.transform(split, lambda line, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(line, "[\\x09-\\x0D]+", " ")).alias("line")))
    full = F.filter(placed, lambda x: x["line"] != "")
    lines = documents.select("doc_id", F.xxhash64("text").alias("version"), full.alias("full"))
    lines = lines.where("doc_id IS NOT NULL")

    def window(i):
        own = F.slice("full", i + 1, width)
        texts = F.transform(own, lambda x: x["line"])
        return F.struct(
            F.xxhash64(texts).alias("h1"), F.xxhash64(F.lit(1), texts).alias("h2"), i.alias("start"), F.transform(own, lambda x: x["at"]).alias("at")
        )

    # Asked here and not in a filter, which would build the list once more; null gives no rows.
    windows = F.when(F.size("full") >= width, F.transform(F.sequence(F.lit(0), F.size("full") - width), window))
    return lines.select("doc_id", "version", F.explode(windows).alias("w")).select("doc_id", "version", "w.*")


def covered_lines(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, version, covered``: places of the lines that later occurrences of repeated windows cover, each once."""
    windows = _windows(documents, width)
    place = F.struct("doc_id", "version", "start")
    # Only a minimum and a count are aggregated, so a very common window combines before the shuffle.
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("covered"))


def line_dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` with ``text`` freed of repeated passages, and ``n_lines`` and ``n_removed``.

    Three consecutive lines that are not blank make a window. Of equal windows the first by (``doc_id``, place)
    stays; the lines of all others go, overlapping ones merged. Lines are compared without white space at their
    ends and with other white space as blanks. Blank lines make no window and stay. Texts with fewer than three
    lines that are not blank, empty and null texts, and rows with a null ``doc_id`` come back as they are
    (``n_lines`` of null text is 0). Rows that repeat a document whole are that document and are treated alike.
    All other columns are kept, but for earlier ``n_lines`` and ``n_removed``; an empty table stays empty.
    """
    covered = covered_lines(documents.select("doc_id", "text"), width).withColumnsRenamed({"doc_id": "__doc_id", "version": "__version"})
    rest = [c for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    lines = documents.select(
        *[F.col(f"`{c}`") for c in rest], F.col("doc_id").alias("__doc_id"), F.xxhash64("text").alias("__version"), F.split("text", "\n").alias("__lines")
    )
    joined = lines.join(covered, ["__doc_id", "__version"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    counts = {
        "text": text,
        "n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")),
        "n_removed": F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")),
    }
    named = [F.col(f"`{c}`") if c != "text" else counts["text"].alias("text") for c in documents.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*named, counts["n_lines"].alias("n_lines"), counts["n_removed"].alias("n_removed"))
