"""Table functions: one row to many, for lateral joins."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_SCHEMA = "slot_start date, days int"


class SlotsOf:
    """The ten-day slots (days 1-10, 11-20, 21 to the month's end) that [first, last] touches, with the days inside; none if either is null or last is before first."""

    def eval(self, first: datetime.date, last: datetime.date):
        while first is not None and last is not None and first <= last:
            start = first.replace(day=min(21, (first.day - 1) // 10 * 10 + 1))
            after = start + datetime.timedelta(10) if start.day < 21 else (start + datetime.timedelta(12)).replace(day=1)
            end = min(last, after - datetime.timedelta(1))
            yield start, (end - first).days + 1
            first = after


def fan_out(df: DataFrame, function: type, schema: str, *args: Column) -> DataFrame:
    """`df` joined laterally with the rows that a table function makes of each of its rows; a row that gives none is left out."""
    made = F.udtf(function, returnType=schema, useArrow=True)
    return df.lateralJoin(made(*[a.outer() for a in args]))
