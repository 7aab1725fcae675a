"""Conditions that rows must meet, checked where the rows are made and not by a job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(rows: DataFrame, condition: Column, message: str | Column, keep: Column | None = None) -> DataFrame:
    """`rows`, whose computation fails with the message at one that doesn't meet the condition; null counts as met.

    Of those that meet it, rows go that `keep` isn't true of. A filter of its own after this one could be
    applied first (after an outer join: by making it an inner one) and take the bad rows away unseen.
    """
    message = F.lit(message) if isinstance(message, str) else message
    return rows.filter(F.coalesce(F.when(~condition, F.raise_error(message).cast("boolean")), F.lit(True) if keep is None else keep))
