"""Saved zone lists, CSV export and written marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from crewline.session import shared_dir
from crewline.sources.tables import with_optional

ZONE_LIST = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("company", T.StringType()),
    ]
)


def save_zones(zones: DataFrame, path: str, updated_at) -> None:
    """Write zone lists; only the companies present in ``zones`` are replaced."""
    (
        zones.select("label", "value", F.lit(updated_at).cast("timestamp_ntz").alias("updated_at"), "company")
        .hint("rebalance", "company")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("company")
        .parquet(path)
    )


def load_zones(spark: SparkSession, path: str, company: str) -> DataFrame | None:
    """The saved list of one company, or None when the caller has to build it.

    None means: nothing saved, nothing for this company, or a list without labels.
    """
    saved = with_optional(spark, path, ZONE_LIST).where(F.col("company") == company)
    usable = saved.where(F.col("label").isNotNull() & F.col("value").isNotNull())
    return usable if usable.take(1) else None


def export_csv(df: DataFrame, path: str) -> None:
    """Write one CSV folder with a header; part files stay as parallel as the input."""
    df.write.mode("overwrite").option("header", True).csv(path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a mart once and read it back for several consumers.

    The copy lies in the shared folder, so it outlives lost executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
