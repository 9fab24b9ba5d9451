"""Chat sessions in event time: turns may come late and out of order, and sessions end.

State of a conversation is the turns that the watermark has not passed yet, whether a diagnosis has been named, whether the user has
left, and the time of the last turn. Turns wait until the watermark has passed them and are then judged in the order of time
and turn, so what comes out doesn't depend on how the stream was cut into batches. A conversation that has been silent for GAP
beyond the watermark ends: its state goes, and a later turn opens another session. Turns that the watermark has passed before
they come are dropped, as a stream must; the delay says how late a turn may be.
"""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfind.operators.dialog import DIAGNOSIS, EXIT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "conv_id long, began long, turn long, notice boolean, gone boolean"
WAITING = "at long, turn long, hit boolean, leaves boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """``gap``: microseconds of silence after which a session ends."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.known = handle.getValueState("known", "said boolean, left boolean, last long, began long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, passed = [], timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            part = part[part["at"] >= passed]
            new += list(zip(part["at"].tolist(), part["turn"].tolist(), part["hit"].tolist(), part["leaves"].tolist(), strict=True))
        if new:
            self.waiting.appendList([(int(a), int(t), bool(h), bool(x)) for a, t, h, x in new])
            for at in {a // 1000 + 1 for a, *_ in new}:  # just behind each turn
                self.handle.registerTimer(int(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        said, left, last, began = self.known.get() if self.known.exists() else (False, False, None, None)
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        out = []
        for at, turn, hit, leaves in ready:
            if last is None or at - last > self.gap:
                said, left, began = False, False, at
            left = left or leaves
            out.append((None if key[1] else key[0], began, turn, hit and not said and not left, left))
            said, last = said or (hit and not left), at
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        if last is not None and not later and last + self.gap < now:
            self.known.clear()
        elif last is not None:
            self.known.update((said, left, last, began))
            self.handle.registerTimer(int((last + self.gap) // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "began", "turn", "notice", "gone"])

    def close(self) -> None:
        pass


def session_for(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with the state store that timers and lists need; the settings of ``spark`` stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    return own


def any_word(text, words):
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return F.coalesce(out, F.lit(False))


def sessions(turns: DataFrame, delay: str = "10 minutes", gap_minutes: int = 60, words=DIAGNOSIS, leave=EXIT) -> DataFrame:
    """(conv_id, began, turn, notice, gone) of a stream of turns (conv_id, turn, role, text, ts): began is the time of the session's
    first turn in microseconds, notice marks the session's first reply that names a diagnosis, and gone the turns from the one
    on in which the user leaves. What a turn says is decided by columns; only flags go to the state. The stream must be of a
    session that session_for() gives."""
    said, user = F.col("role") == "assistant", F.col("role") == "user"
    rows = turns.withWatermark("ts", delay).select(
        # A null among the keys would make numbers with a fraction of all that are in its Arrow batch, and so lose their state.
        F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("unknown"), "turn", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.coalesce(said, F.lit(False)) & any_word(F.col("text"), words)).alias("hit"),
        F.coalesce(user & F.lower(F.regexp_replace("text", r"^\s+|\s+$", "")).isin(*leave), F.lit(False)).alias("leaves"), "ts",
    )
    return rows.groupBy("conv_id", "unknown").transformWithStateInPandas(statefulProcessor=Sessions(gap_minutes * 60_000_000), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
