"""Pages as they arrive: an extension; the batch operators are the same.

State is keyed by doc, model and page and holds the last ord seen of each, and whether it has a text: a row that comes again
is dropped, a later one goes on and replaces the earlier one where pages are read. State of pages that haven't come for a while is dropped
by a timer in the rows' own time (a timer in machine time would keep a run that reads what is there from ending).
Each micro-batch is standardised and written under the run's name and the batch's number, so a replayed batch replaces itself. The
query's checkpoint takes the place of the resume file: resume_state reads what it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioscope.operators.standardize import standardize_pages
from folioscope.sources.sinks import append_pages

KEY = ("doc", "model", "page")
#: How long a page's state is kept after its last row, in milliseconds of the rows' own time.
KEEP = 7 * 24 * 3600 * 1000
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: State stores that keep timers and several variables.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastPage(StatefulProcessor):
    """Lets a page's row through if its ord is above all seen; of several in a batch the last."""

    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ord long, filled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, arrived = None, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            arrived = max(arrived, int(frame["arrived_ms"].max()))
            top = frame.loc[[frame["ord"].idxmax()]]
            if best is None or top["ord"].iloc[0] > best["ord"].iloc[0]:
                best = top
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(arrived + self.keep)
        if best is None or self.last.exists() and self.last.get()[0] >= best["ord"].iloc[0]:
            return
        self.last.update((int(best["ord"].iloc[0]), bool(best["filled"].iloc[0])))
        yield best[[*KEY, "payload"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def last_pages(raw: DataFrame, time: str = "arrived", late: str = "1 hour", keep: int = KEEP) -> DataFrame:
    """A stream of raw pages (doc, model, page, ord, a time column, raw fields) without rows that an equal or later ord of their page preceded, or that come late."""
    whole = raw.schema
    raw = raw.withWatermark(time, late)
    filled = (F.coalesce("text", F.lit("")) != "") if "text" in raw.columns else F.lit(False)
    packed = raw.select(*[F.col(c).cast("string").alias(c) for c in KEY], F.col("ord").cast("long").alias("ord"), filled.alias("filled"), F.col(time), F.coalesce(F.unix_millis(time), F.lit(0).cast("long")).alias("arrived_ms"), F.to_json(F.struct(*raw.columns), _TIMES).alias("payload"))
    kept = packed.groupBy(*KEY).transformWithStateInPandas(LastPage(keep), "doc string, model string, page string, payload string", "Update", "EventTime")
    return kept.select(F.from_json("payload", whole, _TIMES).alias("row")).select("row.*")


def standardized_stream(raw: DataFrame, time: str = "arrived", late: str = "1 hour", keep: int = KEEP) -> DataFrame:
    """last_pages as standard pages."""
    return standardize_pages(last_pages(raw, time, late, keep))


def append_stream(raw: DataFrame, path: str, checkpoint: str, time: str = "arrived", run: str = "stream", keep: int = KEEP) -> StreamingQuery:
    """Writes the stream's pages where sinks.read_pages reads them, a folder a batch; ends when all that is there has been read."""
    raw.sparkSession.conf.set(*STATE_STORE)
    writer = standardized_stream(raw, time, keep=keep).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda df, batch: append_pages(df, path, run, batch)).trigger(availableNow=True).start()


def resume_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """doc, model, page, ord, filled: what a stopped or running stream knows of each page."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return state.select("key.*", "value.*")
