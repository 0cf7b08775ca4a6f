"""Joins with counted groups that stay even where one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with more than this share of the rows are joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 500


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with one row per group; ``n`` is the column of ``counted`` with the rows that the group has.

    ``counted`` should be materialised: it is read three times.
    """
    most = (counted.agg(F.sum(n)).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(counted.where(F.col(n) > most))
    often = rows.join(hot, on)
    seldom = rows.join(hot.select(*on), on, "left_anti").join(counted.where(F.col(n) <= most), on)
    return often.unionByName(seldom)
