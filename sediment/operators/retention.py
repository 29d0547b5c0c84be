"""Two retention rules: by the eviction date of the rows, and by the age of the day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.sources.day_table import DayTable


def expired_days(rows: DataFrame, as_of: str, day: str = "event_date", inclusive: bool = True) -> DataFrame:
    """Days whose every row has expired. ``inclusive``: a row expires on its eviction date.

    A row without an eviction date never expires and keeps its day.
    """
    today = F.lit(as_of).cast("date")
    expired = F.col("eviction_date") <= today if inclusive else F.col("eviction_date") < today
    return (
        rows.groupBy(day)
        .agg(
            F.count(F.lit(1)).alias("partition_rows"),
            F.max("eviction_date").alias("last_eviction"),
            F.min(F.coalesce(expired, F.lit(False))).alias("_all"),
        )
        .where("_all")
        .drop("_all")
    )


def expire_by_eviction_date(table: DayTable, as_of: str, inclusive: bool = True) -> list[str]:
    found = expired_days(table.read(), as_of, table.day, inclusive)
    return table.drop_days(table.days_of(found))


def retained(day: Column, as_of: str, keep_days: int = 90) -> Column:
    return day >= F.date_sub(F.lit(as_of).cast("date"), keep_days)


def drop_old_days(table: DayTable, as_of: str, keep_days: int = 90) -> list[str]:
    """Drop days by age alone. Only the list of days is read; eviction dates do not matter."""
    first = (dt.date.fromisoformat(as_of) - dt.timedelta(days=keep_days)).isoformat()
    return table.drop_days([d for d in table.days() if d < first])
