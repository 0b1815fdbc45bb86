"""Pages by the place of their last row instead of by an offset.

A cursor is the last row's values of the order's columns, the last of which should tell rows apart. The next page is the
rows behind it, by a predicate on each row, so its cost does not grow with its number; the bound on the first
column stands alone, so scans and partitions are pruned by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class By:
    """A column of an order; nulls come last."""

    column: str
    descending: bool = False

    def sort(self) -> Column:
        return F.desc_nulls_last(self.column) if self.descending else F.asc_nulls_last(self.column)

    def _behind(self, value, kind) -> Column:
        """Whether a row's value comes after one."""
        if value is None:
            return F.lit(False)
        bound = F.lit(value).cast(kind)
        beyond = F.col(self.column) < bound if self.descending else F.col(self.column) > bound
        return beyond | F.col(self.column).isNull()


def behind(rows: DataFrame, order: Sequence[By], cursor: Sequence) -> Column:
    """Whether a row comes after a cursor."""
    kinds = [rows.schema[by.column].dataType for by in order]
    same, parts = F.lit(True), []
    for by, value, kind in zip(order, cursor, kinds):
        parts.append(same & by._behind(value, kind))
        same &= F.col(by.column).eqNullSafe(F.lit(value).cast(kind))
    first = order[0]._behind(cursor[0], kinds[0]) | F.col(order[0].column).eqNullSafe(F.lit(cursor[0]).cast(kinds[0]))
    return first & reduce(lambda a, b: a | b, parts)


def page(rows: DataFrame, order: Sequence[By], limit: int, cursor: Sequence | None = None, day: str | None = None) -> DataFrame:
    """The first ``limit`` rows behind a cursor, in order. day: a column with the date of the order's first column, if rows are partitioned by it."""
    if cursor is not None:
        if day is not None and cursor[0] is not None:
            date = F.lit(cursor[0]).cast("timestamp_ntz").cast("date")
            rows = rows.where((F.col(day) <= date if order[0].descending else F.col(day) >= date) | F.col(day).isNull())
        rows = rows.where(behind(rows, order, cursor))
    return rows.orderBy(*(by.sort() for by in order)).limit(limit)


def cursor_of(row: Row, order: Sequence[By]) -> tuple:
    return tuple(row[by.column] for by in order)


def end_of(found: DataFrame, order: Sequence[By]) -> tuple | None:
    """The cursor of a page: of its last row; none if it is empty."""
    last = found.orderBy(*((F.asc_nulls_first if by.descending else F.desc_nulls_first)(by.column) for by in order)).select(*(by.column for by in order)).first()
    return None if last is None else cursor_of(last, order)


#: Orders of the lists that are shown in pages.
ACTIVITY = (By("occurred_at", True), By("id", True))
SESSIONS = {
    name: (*(By(c, True) for c in columns), By("native_session_id"), By("source"), By("provider"))
    for name, columns in {"recent": ["last_activity_at"], "tokens": ["total_tokens", "last_activity_at"], "value": ["value_usd_micros", "last_activity_at"], "duration": ["duration_seconds", "last_activity_at"]}.items()
}
TIMELINE = (By("occurred_at"), By("id"))
