"""Incremental sync: state rows by connector, and the rows that are new since then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import insert_if_absent, upsert

STATE = "connector string, last_sync_at timestamp_ntz"


def new_rows(rows: DataFrame, state: DataFrame, ts: str = "valid_at") -> DataFrame:
    """Rows later than their connector's last sync; all rows of a connector without one."""
    out = rows.join(state, "connector", "left")
    return out.filter(F.col("last_sync_at").isNull() | (F.col(ts) > F.col("last_sync_at"))).drop("last_sync_at")


def advanced(state: DataFrame, rows: DataFrame, ts: str = "valid_at") -> DataFrame:
    """The state after rows were stored: the latest source time of each connector (not the wall clock, so that rows that
    change during a sync aren't passed over)."""
    return upsert(state, rows.groupBy("connector").agg(F.max(ts).alias("last_sync_at")), ["connector"])


def sync(target: DataFrame, rows: DataFrame, state: DataFrame, ts: str = "valid_at") -> tuple[DataFrame, DataFrame]:
    """The target with the new episodes, and the new state."""
    fresh = new_rows(rows, state, ts)
    return insert_if_absent(target, fresh, ["source_type", "source_id"], ts), advanced(state, fresh, ts)
