"""Streams of texts: consecutive duplicates, newest-wins, and analysis of micro-batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kana import should_parse

ACCEPTED = "user_id long, ts timestamp, text string"


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    out = []
    for row in rows.itertuples(index=False):
        if row.text != last:
            last = row.text
            out.append((row.user_id, row.ts, row.text))
    state.update((last,))
    yield pd.DataFrame(out, columns=["user_id", "ts", "text"])


def without_repeats(stream: DataFrame) -> DataFrame:
    """A stream ``(user_id, ts, seq, text)`` without texts equal to the user's last accepted one; state is one text for each user."""
    return stream.groupBy("user_id").applyInPandasWithState(_accept, ACCEPTED, "last string", "append", GroupStateTimeout.NoTimeout)


def without_repeats_batch(rows: DataFrame) -> DataFrame:
    """The same of a bounded table: as rejected rows equal the last accepted, the row before decides."""
    own = Window.partitionBy("user_id").orderBy("ts", "seq")
    before = F.lag("text").over(own)
    first = F.row_number().over(own) == 1
    return rows.withColumn("fresh", first | ~F.col("text").eqNullSafe(before)).where("fresh").select("user_id", "ts", "text")


def latest(rows: DataFrame) -> DataFrame:
    """Newest-wins: of each user's waiting texts the last; those it overtakes are never analysed."""
    return rows.groupBy("user_id").agg(F.max_by("text", F.struct("ts", "seq")).alias("text"), F.max("ts").alias("ts"))


def worth_parsing(rows: DataFrame, last: str | None = None) -> DataFrame:
    return rows.where(should_parse(F.col("text"), F.lit(last).cast("string")))


#: What a source of dictionaries is doing.
PHASES = ("downloading", "building", "ready", "error")


class Readiness:
    """Which dictionary there is, for the driver of a stream; several threads may use it.

    :meth:`prepare` runs one acquisition at a time: a second one while the first
    still runs is refused.  Each change of phase is a row ``(phase, detail, at)``
    in ``log``.  A new dictionary replaces the old one for the next micro-batch;
    after an error the old one stays.
    """

    def __init__(self) -> None:
        self.dictionary: Any = None
        self.paused = False
        self.log: list[tuple[str, str, float]] = []
        self._busy = threading.Lock()

    def tell(self, phase: str, detail: str = "") -> None:
        if phase not in PHASES:
            raise ValueError(f"no such phase: {phase}")
        self.log.append((phase, detail, time.time()))

    def prepare(self, fetch: Callable[[], Any] | None, build: Callable[[Any], Any]) -> bool:
        """Fetches, if there is something to fetch, and builds; false if another acquisition is under way."""
        if not self._busy.acquire(blocking=False):
            return False
        try:
            found = None
            if fetch is not None:
                self.tell("downloading")
                found = fetch()
            self.tell("building")
            self.dictionary = build(found)
            self.tell("ready")
        except Exception as error:  # noqa: BLE001  told, not raised: the stream goes on with what it has
            self.tell("error", str(error)[:500])
        finally:
            self._busy.release()
        return True

    def status(self, spark: SparkSession) -> DataFrame:
        """``(phase, detail, at)`` of every change."""
        return spark.createDataFrame(self.log, "phase string, detail string, at double")


def _analysed(rows: DataFrame, analysis: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], depth: int = 0) -> None:
    """Hands an analysis to the sink; one that fails is tried again in parts, so that a text which can't be analysed is alone in its error row."""
    try:
        made = analysis(rows).persist()
        made.count()  # what can fail, fails here and not in the sink
    except Exception as error:  # noqa: BLE001  one bad text mustn't end the stream
        if depth == PARTS_DEPTH or len(rows.take(2)) < 2:
            sink(rows.select("user_id", F.lit(str(error)[:500]).alias("error")))
            return
        half = F.shiftrightunsigned(F.xxhash64("user_id"), depth).bitwiseAND(F.lit(1).cast("long"))
        for k in (0, 1):
            part = rows.where(half == k)
            if not part.isEmpty():
                _analysed(part, analysis, sink, depth + 1)
        return
    sink(made)
    made.unpersist()


#: Times that a failing micro-batch is halved at most.
PARTS_DEPTH = 20


def analyse(
    stream: DataFrame, analysis: Callable[..., DataFrame], sink: Callable[[DataFrame, int], None], trigger: str = "200 milliseconds", readiness: Readiness | None = None
):
    """Starts a query that keeps each user's newest text of a micro-batch, analyses it and hands the rows to a sink.

    With ``readiness`` the analysis is given the dictionary of the moment as its
    second argument, so a newer one serves from the next batch on; batches that
    come before there is one, or while it is paused, are dropped.  A text that
    can't be analysed becomes a row ``(user_id, error)``, whatever came with it.
    """

    def each(batch: DataFrame, number: int) -> None:
        dictionary = readiness.dictionary if readiness else None
        if readiness and (readiness.paused or dictionary is None):
            return
        newest = latest(worth_parsing(batch)).persist()
        try:
            if not newest.isEmpty():
                _analysed(newest, (lambda rows: analysis(rows, dictionary)) if readiness else analysis, lambda rows: sink(rows, number))
        finally:
            newest.unpersist()

    return stream.writeStream.foreachBatch(each).trigger(processingTime=trigger).start()
