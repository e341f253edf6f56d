"""Streams with arbitrary keyed state: intervals that late facts split, and expiry by timers.

State lives in RocksDB, as these operators ask; `stateful` sets that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Width of a piece of a key's history, in microseconds: a late fact reads and writes the pieces around it only.
PIECE = 7 * 86_400_000_000


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Intervals(StatefulProcessor):
    """A key's facts by time, in pieces of PIECE; a fact holds until the next one of its key.

    Emits what changed: a row with change - for an interval that no longer holds as it was, and one with + for each new or changed
    one.  With a watermark, pieces before it that no row can reach any more are forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "piece long", "at array<long>, id array<string>")
        self.order = handle.getValueState("order", "pieces array<long>")

    def _piece(self, number: int) -> list[tuple[int, str]]:
        at, ids = self.pieces.getValue((number,))
        return list(zip(map(int, at), ids, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted({(int(at), str(i)) for frame in rows for at, i in zip(frame["at"], frame["id"], strict=True)})
        order = [int(x) for x in self.order.get()[0]] if self.order.exists() else []
        had = set(order)
        touched = sorted({at // PIECE for at, _ in new})
        order = sorted(had | set(touched))
        # pieces that the new facts stand in, and the nearest ones with facts on either side, whose ends they move
        near = {p for t in touched for i in [bisect_left(order, t)] for p in order[max(0, i - 1) : i + 2]}
        before, after = {}, {}
        run_old = [f for p in sorted(near & had) for f in self._piece(p)]
        known = set(run_old)
        fresh = [f for f in new if f not in known]
        run_new = sorted([*run_old, *fresh])
        for run, ends in ((run_old, before), (run_new, after)):
            for one, following in zip(run, [*run[1:], None], strict=False):
                ends[one] = following[0] if following else None
        # the last fact of a stretch of pieces ends where the next piece outside of it begins
        for run, ends, pieces in ((run_old, before, sorted(had)), (run_new, after, order)):
            for n, one in enumerate(run):
                p = one[0] // PIECE
                beyond = [q for q in pieces[bisect_left(pieces, p) + 1 :][:1] if q not in near]
                if beyond and (n + 1 == len(run) or run[n + 1][0] // PIECE != p):
                    ends[one] = self._piece(beyond[0])[0][0]
        for p in sorted({at // PIECE for at, _ in fresh}):
            own = [f for f in run_new if f[0] // PIECE == p]
            self.pieces.updateValue((p,), ([at for at, _ in own], [i for _, i in own]))
        order = self._forget(order, timerValues)
        self.order.update((order,))
        out = []
        for one in run_new:
            end = after[one]
            if one not in before:
                out.append(("+", one[1], one[0], end))
            elif before[one] != end:
                out += [("-", one[1], one[0], before[one]), ("+", one[1], one[0], end)]
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "change": [x[0] for x in out], "id": [x[1] for x in out], "at": pd.array([x[2] for x in out], "int64"), "until": pd.array([x[3] for x in out], "Int64")})

    def _forget(self, order: list[int], timers) -> list[int]:
        """Rows before the watermark don't come any more: of the pieces before its own the last one stays."""
        mark = timers.getCurrentWatermarkInMs() if self.event_time else 0
        own = mark * 1000 // PIECE
        gone = [p for p in order if p < own][:-1]
        for p in gone:
            self.pieces.removeKey((p,))
        return [p for p in order if p not in set(gone)]

    event_time = False

    def close(self) -> None:
        pass


class _TimedIntervals(_Intervals):
    event_time = True


def intervals(stream: DataFrame, key: str, at: str, name: str, delay: str | None = None) -> DataFrame:
    """The validity intervals of a stream's facts as changes: key, change (- or +), id, valid_at, invalid_at.

    Facts (key, at, name) may come in any order and any number of times: at any time the rows with + that no later - took back
    are those of operators.temporal.supersede over what has come.  delay: how late they may be; what is older goes unheard, and
    the state forgets what such facts alone could change."""
    stateful(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col(name).cast("string").alias("id")).filter("key is not null and ts is not null and id is not null")
    rows = rows.withWatermark("ts", delay) if delay else rows
    rows = rows.withColumn("at", F.unix_micros("ts"))
    out = rows.groupBy("key").transformWithStateInPandas(_TimedIntervals() if delay else _Intervals(), "key string, change string, id string, at long, until long", "append", "eventTime" if delay else "none")
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("key", "change", "id", moment(F.col("at")).alias("valid_at"), moment(F.col("until")).alias("invalid_at"))


class _Expiry(StatefulProcessor):
    """An episode's timer, cancelled when something rests on it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "ends long")
        self.kept = handle.getValueState("kept", "kept boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for rests, ends in zip(frame["rests"], frame["ends"], strict=True):
                if rests:
                    self.kept.update((True,))
                    if self.ends.exists():
                        self.handle.deleteTimer(self.ends.get()[0] + 1)
                        self.ends.clear()
                elif pd.notna(ends) and not self.kept.exists() and not self.ends.exists():
                    self.ends.update((int(ends),))
                    self.handle.registerTimer(int(ends) + 1)  # over when the time is past it
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ends.exists():
            ends = self.ends.get()[0]
            self.ends.clear()
            yield pd.DataFrame({"id": [key[0]], "expired_at": [pd.Timestamp(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(ends)))]})

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, days: int = 14, delay: str = "0 seconds") -> DataFrame:
    """Ids of ephemeral episodes as their time is over: id, expired_at.

    stream: id, ts (its event time), retention and ttl_days of an episode (days by default), or rests = true for a fact or
    memory object that rests on it.  An episode expires when the watermark passes ts + ttl, unless something that came before
    rests on it; durable ones never do.  The state of an expired episode is dropped, but for the mark that something rested on one."""
    stateful(stream.sparkSession)
    ttl = F.coalesce(F.col("ttl_days"), F.lit(days))
    rests = F.coalesce(F.col("rests"), F.lit(False))
    ends = F.when((F.col("retention") == "ephemeral") & ~rests, F.unix_millis(F.col("ts")) + ttl.cast("long") * 86_400_000)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("id", "ts", rests.alias("rests"), ends.alias("ends"))
    return rows.groupBy("id").transformWithStateInPandas(_Expiry(), "id string, expired_at timestamp", "append", "eventTime").withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz"))
