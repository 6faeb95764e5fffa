"""Scans of the declared tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from crewline.sources import schemas


def differences(found: T.DataType, declared: T.DataType, path: str = "") -> list[str]:
    """What of a declared type is missing or of another type; further columns do not matter."""
    if isinstance(declared, T.StructType) and isinstance(found, T.StructType):
        have = {f.name: f.dataType for f in found}
        out = []
        for field in declared:
            at = f"{path}.{field.name}" if path else field.name
            out += differences(have[field.name], field.dataType, at) if field.name in have else [f"{at} is missing"]
        return out
    if isinstance(declared, T.ArrayType) and isinstance(found, T.ArrayType):
        return differences(found.elementType, declared.elementType, f"{path}[]")
    return [] if found == declared else [f"{path} is {found.simpleString()}, not {declared.simpleString()}"]


def _checked(found: T.StructType, name: str, where: str) -> None:
    problems = differences(found, schemas.source_schema(name))
    if problems:
        raise ValueError(f"{where} is not a {name}: {'; '.join(problems)}")


def read(spark: SparkSession, name: str, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Scan a declared table from Parquet, with the column names of the marts; fails early when the files differ from what is declared.

    The folder may be partitioned by declared columns (``date`` of the supply positions, ``ds`` of the
    reliability snapshots): filters on them become partition filters, also a latest-day scalar subquery,
    which prunes the days when it runs.
    """
    _checked(spark.read.parquet(path).schema, name, path)
    declared = schemas.source_schema(name)
    # A table partitioned by a declared column (a snapshot day) lists it last; keep the declared order.
    df = spark.read.schema(declared).parquet(path).select(*declared.names)
    df = df.withColumnsRenamed(schemas.renames(name))
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, name: str, table: str) -> DataFrame:
    """Same from the catalog."""
    df = spark.table(table)
    _checked(df.schema, name, table)
    return df.select(*schemas.source_schema(name).names).withColumnsRenamed(schemas.renames(name))


def conform(df: DataFrame, name: str, *extra: str) -> DataFrame:
    """Bring a frame to a mart schema: cast what is there, add what is not as NULL."""
    have = set(df.columns)

    def cast(field: T.StructField) -> str:
        source = f"`{field.name}`" if field.name in have else "NULL"
        return f"CAST({source} AS {field.dataType.simpleString()}) AS `{field.name}`"

    return df.selectExpr(*[cast(field) for field in schemas.mart_schema(name)], *extra)


def with_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Scan an optional source; an absent path gives an empty frame, any other error surfaces."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def partner_column(name: str) -> str | None:
    """The stored column of a declared table that the marts call ``partner_id``, or None."""
    if "partner_id" not in schemas.mart_schema(name).names:
        return None
    back = {target: source for source, target in schemas.renames(name).items()}
    return back.get("partner_id", "partner_id")


def save_bucketed(spark: SparkSession, base: str, database: str, buckets: int, names: Iterable[str] | None = None) -> None:
    """Copy the declared tables of ``base`` into catalog tables of ``database``; those with a partner key are
    bucketed and sorted by it into ``buckets`` buckets.

    Tables bucketed alike by the join key meet without an exchange: the funnel joins its partners with five
    facts per partner (offers, checks, reliability, shifts, first shifts elsewhere) without shuffling any of
    them. Choose ``buckets`` so that a bucket of the largest table fits a task (about 128 MB). Absent tables
    are skipped.
    """
    for name in names or schemas.TABLES:
        path = f"{base.rstrip('/')}/{name}"
        try:
            df = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        key = partner_column(name)
        writer = df.write.mode("overwrite").format("parquet")
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
