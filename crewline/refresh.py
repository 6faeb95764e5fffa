"""Write all marts for one as-of day.

``python -m crewline.refresh --base /lake/raw --out /lake/marts --company "..." --as-of 2024-01-31T06:00``

Each mart is a Parquet table partitioned by ``as_of``, the client marts by ``company`` as well; running a day again
replaces that day (and company) only, also when the new result is empty: a mart is written to a staging folder
beside the table and swapped in for its partition (``Publisher``). Marts that other marts are built from
(offers, bonuses, assignments, nearest stores, funnel v2, zone lists) are published first and read back from the
table, so every mart is computed and written once. ``--company`` may be repeated. Rows are ranged and sorted by the
key of their look-ups (``LAYOUT``), and point look-ups get Parquet bloom filters, so file statistics and filters
let a look-up of one partner, zone, store or shift skip files and row groups. Scratch copies of a run are deleted
at its end.
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewline.operators import calendars, counts
from crewline.params import FunnelParams
from crewline.plans import bonuses, checks, funnel, markets, partners, shifts, stores, zones
from crewline.session import build_session, scratch
from crewline.sources import sinks
from crewline.sources.dimensions import COMPANY_NAMES
from crewline.sources.warehouse import Warehouse

# Marts of one client company; all others hold every company.
CLIENT = frozenset(
    "target_markets priority_markets funnel_summary funnel_roster funnel_v2 funnel_kpis funnel_breakdown zone_summary store_summary zone_kpis".split()
)
# Columns by which a mart is looked up, the first that it has; newest rows of a partner first where it has days.
LOOKUP = ("partner_id", "shift_id", "zone_hex", "zone_description")
NEWEST = ("ds", "shift_start", "shift_date", "updated_at")
# Marts whose look-ups are not by the first of LOOKUP: the columns rows are ranged and sorted by.
LAYOUT = {
    "shift_detail": ("shift_id",),
    "market_shifts": ("company_name", "zone", "shift_date", "store_number"),
    "zone_shifts": ("company_name", "zone_description", "shift_date", "store_number"),
}
# Columns looked up by one value: a Parquet bloom filter per row group lets a reader skip row groups whose
# range holds the value but whose rows do not.
BLOOM = ("shift_id", "store_number", "partner_id")


@dataclass(frozen=True)
class Windows:
    """Days of the look-ups back and ahead, and of the summaries back; None leaves a side open."""

    back: int | None = 90
    ahead: int | None = 30
    summary: int | None = 7

    def days(self, p: FunnelParams) -> tuple[date, date]:
        return (date.min.replace(year=1900) if self.back is None else p.day(-self.back), date.max if self.ahead is None else p.day(self.ahead))

    def since(self, p: FunnelParams) -> date | None:
        return None if self.summary is None else p.day(-self.summary)


def marts(
    src: Mapping[str, DataFrame],
    p: FunnelParams,
    companies: Sequence[str],
    names: Mapping[str, str] = COMPANY_NAMES,
    cleared_tag: str = funnel.dims.CLEARED_TAG,
    checks_tie: Sequence[str] = checks.TIE,
    windows: Windows = Windows(),
    publish: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Builders by mart name. Frames that several marts need are written once, when first asked for.

    With ``publish``, a mart that other marts are built from is published as itself and read back from the
    table; without it (queries and tests), it is kept in a scratch copy.
    """
    kept: dict[str, DataFrame] = {}
    first, last = windows.days(p)
    start, end = (datetime.combine(day, datetime.min.time()) for day in (first, last))

    def once(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in kept:
            kept[name] = sinks.materialize(build())
        return kept[name]

    def shared(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if publish is None:
            return once(name, build)
        if name not in kept:
            kept[name] = publish(name, build)
        return kept[name]

    def coded():
        return once("coded", lambda: funnel.cohorted(src, p, checks_tie))

    def v2():
        return shared("funnel_v2", lambda: funnel.funnel_v2_overrides(src["partner_throughput"], src["user_certs"], src["bgc_override"], p, cleared_tag))

    def client_rows():
        window = shifts.shift_filter(src["shift_assignments"], p.company, windows.since(p), p.as_of_date)
        return once("client", lambda: zones.zone_rows(window))

    def sent():
        return shared("shifts_sent", lambda: partners.shifts_sent(src["user_shifts"], start, end, p.as_of_ts, names))

    def own_bonuses():
        return shared("partner_bonuses", lambda: bonuses.partner_bonuses(src["bonus_eligible_users"], src["bonus_progress"], names))

    def assigned():
        return shared("assignments", lambda: partners.assignments(src["shift_assignments"], first, last))

    def near():
        return shared("nearest_stores", lambda: stores.nearest_stores(src["partner_throughput"], src["locations"], companies))

    return {
        "target_markets": lambda: markets.target_markets(src["supply_daily_position"], src["store_crm"], p),
        "priority_markets": lambda: markets.priority_markets(src["supply_daily_position"], src["store_crm"], p.company),
        "funnel_summary": lambda: funnel.funnel_summary(coded()),
        "funnel_roster": lambda: funnel.funnel_roster(coded(), p),
        "funnel_v2": v2,
        "funnel_kpis": lambda: funnel.funnel_kpis(v2()),
        "funnel_breakdown": lambda: funnel.funnel_breakdown(v2()),
        "partner_profile": lambda: partners.partner_profile(src["partner_throughput"], p.as_of_ts),
        "bgc_status": lambda: checks.bgc_status(src["background_checks"], p.adjudication_from, checks_tie),
        "deactivation_status": lambda: partners.deactivation_status(src["partner_deactivations"], names),
        "deactivation_history": lambda: partners.deactivation_history(src["partner_deactivations"], names),
        "shifts_sent": sent,
        "shifts_sent_kpis": lambda: partners.offer_kpis(sent()),
        "partner_bonuses": own_bonuses,
        "bonus_kpis": lambda: counts.bonus_kpis(own_bonuses()),
        "assignments": assigned,
        "assignment_kpis": lambda: counts.assignment_kpis(assigned()),
        "assignment_calendar": lambda: calendars.with_entries(
            calendars.calendar_grid(calendars.day_marks(assigned(), "partner_id"), "partner_id"),
            calendars.day_lists(assigned(), ["partner_id", "shift_date"], ["company_name", "shift_type", "assignment_status", "store_number"]),
            "partner_id",
        ),
        "partner_tags": lambda: partners.partner_tags(src["user_certs"]),
        "partner_assessments": lambda: partners.partner_assessments(src["partner_assessment_status"]),
        "nearest_stores": near,
        "nearby_outlook": lambda: stores.nearby_outlook(near(), stores.store_outlook(src["shift_assignments"], companies, p.as_of_date)),
        "market_shifts": lambda: shifts.market_shifts(shifts.shift_filter(src["shift_assignments"], None, windows.since(p), p.as_of_date)),
        "zone_shifts": lambda: shifts.market_shifts(
            shifts.zoned_shifts(
                shifts.shift_filter(src["shift_assignments"], None, windows.since(p), p.as_of_date), shifts.zone_bridge(src["supply_daily_position"])
            ),
            "zone_description",
        ),
        "shift_detail": lambda: shifts.shift_detail(src["shift_assignments"]),
        "zone_summary": lambda: zones.zone_summary(client_rows()),
        "store_summary": lambda: zones.store_summary(client_rows()),
        "zone_kpis": lambda: counts.shift_kpis(client_rows()),
        "zone_list": lambda: shared("zone_list", lambda: zones.zone_list(src["supply_daily_position"], src["locations"], None, p.as_of_date)),
    }


def _clustered(df: DataFrame, name: str = "") -> DataFrame:
    keys = [c for c in LAYOUT.get(name, ()) if c in df.columns] or [c for c in LOOKUP if c in df.columns][:1]
    if not keys:
        return df
    newest = [F.desc(c) for c in NEWEST if c in df.columns and keys == ["partner_id"]][:1]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys, *newest)


class Publisher:
    """Writes one mart partition (``as_of``, and ``company`` for client marts) and swaps it in.

    The rows go to a staging folder beside the table first; then the old partition folder is moved aside,
    the new one moved in and the old one deleted. An empty result replaces the partition as well (its folder
    holds a file with the schema and no rows). Both folders are on the table's file system, so the moves are
    renames. ``published`` lists the marts written by this publisher.
    """

    def __init__(self, spark: SparkSession, out: str, p: FunnelParams):
        self.spark, self.base, self.p = spark, out.rstrip("/"), p
        self.published: list[str] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def partition(self, name: str) -> str:
        parts = [f"as_of={self._escape(str(self.p.as_of_date))}"]
        if name in CLIENT:
            parts.append(f"company={self._escape(self.p.company)}")
        return "/".join([self.base, name, *parts])

    def __call__(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        df = _clustered(build(), name)
        staging = f"{self.base}/_staging/{name}-{uuid.uuid4().hex}"
        writer = df.write.mode("overwrite")
        for column in BLOOM:
            if column in df.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(staging)
        target, aside = self._path(self.partition(name)), self._path(f"{staging}-old")
        self._fs.mkdirs(target.getParent())
        moved = self._fs.exists(target) and self._fs.rename(target, aside)
        if not self._fs.rename(self._path(staging), target):
            if moved:
                self._fs.rename(aside, target)
            raise OSError(f"could not publish {name} to {target}")
        if moved:
            self._fs.delete(aside, True)
        self.published.append(name)
        return self.spark.read.schema(df.schema).parquet(self.partition(name))


def refresh(builders: Mapping[str, Callable[[], DataFrame]], p: FunnelParams, out: str, only: Iterable[str] = (), publisher: Publisher | None = None) -> None:
    """Write the marts named, or all; scratch copies made on the way are deleted, also after a failure.

    ``builders`` made with ``publish=publisher`` publish their shared marts when first asked for; those are
    not written again.
    """
    base = out.rstrip("/")
    with scratch():
        publish = publisher or Publisher(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), base, p)
        for name in list(only) or builders:
            if name in publish.published:
                df = publish.spark.read.parquet(publish.partition(name))
            else:
                df = builders[name]()  # a shared mart publishes itself here
                if name not in publish.published:
                    df = publish(name, lambda built=df: built)
            if name == "zone_list":
                sinks.save_zones(df, f"{base}/saved_zones", p.as_of_ts)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--base", help="folder of the source tables")
    args.add_argument("--database", help="or: catalog database of the source tables")
    args.add_argument("--out", required=True)
    args.add_argument("--company", required=True, action="append", help="client company of the funnel; may be repeated")
    args.add_argument("--store-company", action="append", default=[], help="company for nearest stores; may be repeated")
    args.add_argument("--as-of", required=True, type=datetime.fromisoformat, help="wall-clock time, without zone")
    days = lambda text: None if text == "all" else int(text)
    for name, default in (("back", 90), ("ahead", 30), ("summary", 7)):
        args.add_argument(f"--{name}", type=days, default=default, help="days of the look-ups or summaries, or 'all'")
    args.add_argument("mart", nargs="*", help="marts to write; all when none is named")
    given = args.parse_args()
    spark = build_session("crewline-refresh")
    src = Warehouse(spark, given.base, given.database)
    windows = Windows(given.back, given.ahead, given.summary)
    for i, company in enumerate(given.company):
        p = FunnelParams(company, given.as_of.date(), given.as_of)
        publisher = Publisher(spark, given.out, p)
        builders = marts(src, p, given.store_company or given.company, windows=windows, publish=publisher)
        wanted = [m for m in given.mart or builders if i == 0 or m in CLIENT]
        if wanted:
            refresh(builders, p, given.out, wanted, publisher)


if __name__ == "__main__":
    main()
