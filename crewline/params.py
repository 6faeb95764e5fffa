"""Arguments that the marts share. No operator reads the system clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class FunnelParams:
    company: str
    as_of_date: date
    as_of_ts: datetime
    dispatch_days: int = 7
    supply_days: int = 1
    active_days: int = 14
    adjudication_from: date = date(2025, 7, 31)
    completed_from: date = date(2020, 1, 1)

    def day(self, offset: int) -> date:
        return self.as_of_date + timedelta(days=offset)

    def midnight(self, offset: int) -> datetime:
        return datetime.combine(self.day(offset), datetime.min.time())

    def ago(self, **span: int) -> datetime:
        return self.as_of_ts - timedelta(**span)
