"""The declared tables of one warehouse, read on demand."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from crewline.sources import schemas, tables

OPTIONAL = ("bgc_override",)


class Warehouse(Mapping):
    """Table name -> frame, from ``<base>/<table>`` folders or, with ``database``, from the catalog."""

    def __init__(self, spark: SparkSession, base: str | None = None, database: str | None = None):
        if (base is None) == (database is None):
            raise ValueError("give either a base folder or a database")
        self.spark, self.base, self.database = spark, base, database

    def __getitem__(self, name: str) -> DataFrame:
        if name not in schemas.TABLES:
            raise KeyError(name)
        if self.base is not None:
            path = f"{self.base.rstrip('/')}/{name}"
            if name in OPTIONAL:
                return tables.with_optional(self.spark, path, schemas.source_schema(name))
            return tables.read(self.spark, name, path)
        table = f"{self.database}.{name}"
        if name in OPTIONAL and not self.spark.catalog.tableExists(table):
            return self.spark.createDataFrame([], schemas.mart_schema(name))
        return tables.read_table(self.spark, name, table)

    def __iter__(self) -> Iterator[str]:
        return iter(schemas.TABLES)

    def __len__(self) -> int:
        return len(schemas.TABLES)
