"""Registration of a query together with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, types as T

from crewline.params import FunnelParams
from registry.staging import Staged
from registry.staging_sql import FUNNEL, STAGING

# Test parameters of FIXTURES.md.
P = FunnelParams(
    company="BUILDING",
    as_of_date=date(2024, 1, 31),
    as_of_ts=datetime(2024, 1, 31, 6),
    dispatch_days=180,
    supply_days=7,
    active_days=14,
    adjudication_from=date(2024, 1, 10),
)
COMPANIES = ["BUILDING", "FURNITURE", "MACHINERY"]
NAMES = {"1-URGENT": "Urgent Works", "2-HIGH": "High Works", "unit_0": "Unit Zero", "unit_1": "Unit One"}
EVENT_TIE = ("event_id",)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain comparable types: amounts as doubles, days and moments as text, counts as longs."""

    def plain(field: T.StructField) -> str:
        name = f"`{field.name}`"
        match field.dataType:
            case T.DecimalType():
                return f"CAST({name} AS DOUBLE) AS {name}"
            case T.DateType():
                return f"CAST({name} AS STRING) AS {name}"
            case T.TimestampNTZType():
                return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {name}"
            case T.IntegerType() | T.ShortType() | T.ByteType():
                return f"CAST({name} AS BIGINT) AS {name}"
            case T.BooleanType() | T.LongType() | T.DoubleType() | T.StringType():
                return name
        raise TypeError(f"{field.name}: {field.dataType.simpleString()} has no plain form")

    return df.selectExpr(*[plain(field) for field in df.schema.fields])


def check(sql: str, name: str | None = None):
    """Register ``fn(staged) -> DataFrame`` with the oracle that must give the same rows."""

    def add(fn: Callable[[Staged], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: present(fn(Staged(spark, folder)))
        ORACLES[key] = oracle(sql)
        return fn

    return add


def oracle(body: str) -> str:
    body = body.strip()
    steps = STAGING.strip() + ("," + FUNNEL.rstrip() if "o_" in body else "")
    joint = ", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {steps}{joint}"


def day(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def moment(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
