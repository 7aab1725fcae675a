"""Text that is passed on in other languages' queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Only characters from `-` (45) to `z` (122), without brackets."""
    return F.regexp_replace(text, r"[^\x2D-\x7A]|[\[\]]", "")
