"""Report ranges; now and the time zone are always arguments."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

# Days before today's midnight at which a range starts.
DAYS_BACK = {"today": 0, "7d": 6, "30d": 29}


def range_start(name: str, now: datetime, zone: str = "UTC") -> datetime | None:
    """Start of a range as naive UTC: local midnight less whole 24-hour days; None for all."""
    local = now.replace(tzinfo=UTC).astimezone(ZoneInfo(zone))
    midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == "all":
        return None
    if name == "month":
        return midnight.replace(day=1).astimezone(UTC).replace(tzinfo=None)
    return midnight.astimezone(UTC).replace(tzinfo=None) - timedelta(days=DAYS_BACK[name])
