"""Joins that stay balanced whatever the size of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keep_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``members``.

    The lists of this analysis come from stored tables, so the planner knows their size in bytes and broadcasts one that is
    below the session's threshold. A larger one is joined by key, and adaptive execution cuts the rows
    of a hot key into several tasks, which a left semi join allows.
    """
    return rows.join(members, key, "left_semi")
