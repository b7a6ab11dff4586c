"""Job status and document arrival as streams."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docframe.operators.jobs import TERMINAL, latest_status, status_feed
from docframe.session import ship, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "job_id string, status string, progress double, error_message string, connection_string string, ts timestamp"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false")
    return reader.parquet(path)


def stream_latest_status(events: DataFrame) -> DataFrame:
    """SM1 on a stream, for update mode: the aggregate of the stored twin."""
    return latest_status(events)


class _UntilTerminal(StatefulProcessor):
    """Passes a job's events on until the first terminal one; keeps only that it has closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if self.closed.exists():
            return
        # of events that tie, terminal ones come last
        batch = batch.assign(_last=batch["status"].isin(TERMINAL)).sort_values(["ts", "_last", "status"], kind="stable").drop(columns="_last").reset_index(drop=True)
        ends = batch.index[batch["status"].isin(TERMINAL)]
        if len(ends):
            batch = batch.iloc[: ends[0] + 1]
            self.closed.update((True,))
        yield batch

    def close(self) -> None:
        pass


def stream_until_terminal(events: DataFrame) -> DataFrame:
    """SM2 on a stream, for append mode; needs the RocksDB state store."""
    ship(events.sparkSession)
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_UntilTerminal(), outputStructType=events.schema, outputMode="Append", timeMode="None")


class _Feed(StatefulProcessor):
    """A job's state by the time that a reader came, once and first; then its events until the first terminal one.

    Kept are the states that nobody has been told yet and, for ``keep_ms`` of event time after its end,
    that a job has closed.
    """

    def __init__(self, schema: StructType, order: Sequence[str], keep_ms: int):
        self.schema, self.order, self.keep_ms = schema, list(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", StructType([*self.schema.fields, StructField("told", BooleanType()), StructField("end_ms", LongType())]))

    def _rows(self, event: tuple, current: bool) -> pd.DataFrame:
        return pd.DataFrame([(*event, current)], columns=[*self.schema.names, "current"])

    def _close(self, event: tuple, told: bool, end: int) -> None:
        self.kept.update((*event, told, end))
        self.handle.registerTimer(end + self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        event = _plain(initialState[self.schema.names].iloc[0])
        ends = event[self.schema.names.index("status")] in TERMINAL
        self.kept.update((*event, False, _ms(event[self.schema.names.index(self.order[0])]) if ends else None))
        self.handle.registerTimer(1)  # as soon as the first batch is over

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))[self.schema.names]
        kept = self.kept.get() if self.kept.exists() else None
        event, told, end = (kept[:-2], kept[-2], kept[-1]) if kept else (None, True, None)
        if not told:
            yield self._rows(event, True)
            self.kept.update((*event, True, end)) if end is not None else self.kept.clear()
        if end is not None:
            return
        batch = batch.assign(_last=batch["status"].isin(TERMINAL)).sort_values([*self.order, "_last", "status"], kind="stable").drop(columns="_last").reset_index(drop=True)
        ends = batch.index[batch["status"].isin(TERMINAL)]
        if len(ends):
            batch = batch.iloc[: ends[0] + 1]
            last = _plain(batch.iloc[-1])
            self._close(last, True, _ms(last[self.schema.names.index(self.order[0])]))
        yield batch.assign(current=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        kept = self.kept.get()
        event, told, end = kept[:-2], kept[-2], kept[-1]
        if not told:
            yield self._rows(event, True)
        if end is None or timerValues.getCurrentWatermarkInMs() >= end + self.keep_ms:
            self.kept.clear()
        else:
            self._close(event, True, end)

    def close(self) -> None:
        pass


def _plain(row: pd.Series) -> tuple:
    return tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in row)


def _ms(ts: datetime.datetime) -> int:
    return int(ts.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def stream_feed(events: DataFrame, stored: DataFrame, since: datetime.datetime, order: Sequence[str] = ("ts",), keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """SM2 on a stream, for append mode: what a reader gets who comes at ``since``, the present state first.

    stored: the events by then (later ones are ignored); their states are the stream's initial state.
    Every job's state comes once, with ``current`` true, before its later events; a job that has ended
    by then gives that row only.  Events may be late by ``late``; a closed job is forgotten ``keep``
    after its end, and what comes of it still later counts as a new job's.  The first column of order is
    a timestamp.  Needs the RocksDB state store.
    """
    ship(events.sparkSession)
    schema, ts = events.schema, order[0]
    state = status_feed(stored.select(*schema.names).filter(F.col(ts) <= F.lit(since)), F.lit(since), order=order).filter("current").drop("current")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    later = events.filter(F.col(ts) > F.lit(since)).withWatermark(ts, late)
    out = StructType([*schema.fields, StructField("current", BooleanType())])
    return later.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_Feed(schema, order, keep_ms), outputStructType=out, outputMode="Append", timeMode="EventTime", initialState=state.groupBy("job_id"))


#: Column of a document's digest; a name without an underscore in front reaches the state's functions unchanged.
DIGEST = "docframe_digest"


class _Versions(StatefulProcessor):
    """Passes a document on if its content differs from what was last seen, with the next version number."""

    def __init__(self, names: list[str], order: list[str]):
        self.names, self.order = names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "digest string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        last = batch.sort_values([*self.order, DIGEST], kind="stable").iloc[[-1]]
        digest = last[DIGEST].iloc[0]
        seen, version = self.seen.get() if self.seen.exists() else (None, 0)
        if digest != seen:
            self.seen.update((digest, version + 1))
            yield last[self.names].assign(_version=version + 1)

    def close(self) -> None:
        pass


def stream_documents(spark: SparkSession, path: str, schema: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "doc_id", order: Sequence[str] = (), files_per_batch: int | None = None) -> StreamingQuery:
    """SM5: newly arrived documents run the batch pipeline ``process``, once for each content of each document.

    A document is its ``key``; its content is all other columns but those of ``order``.  One that comes
    again as it was, in whatever file, changes nothing; one that has changed takes the place of what
    it gave before, see read_processed.  Of several contents of a document in one batch the greatest by
    ``order`` counts (ties by a digest); rows without a key are left out.  process keeps the key in its
    rows.  A batch writes folders of its own, so one that runs again after a failure changes nothing.
    Needs the RocksDB state store.
    """
    ship(spark)
    reader = spark.readStream.schema(schema)
    docs = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    content = [c for c in docs.columns if c != key and c not in order]
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in content]), {"ignoreNullFields": "false"}), 256)
    rows = docs.filter(F.col(key).isNotNull()).withColumn(DIGEST, digest)
    kinds = StructType([*docs.schema.fields, StructField("_version", LongType())])
    fresh = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Versions(docs.columns, list(order)), outputStructType=kinds, outputMode="Append", timeMode="None")

    def run(batch: DataFrame, epoch: int) -> None:
        arrived = stage(batch, "arrived")  # the state is asked once
        versions = arrived.select(key, "_version")
        process(arrived.drop("_version")).join(versions, key).write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")
        versions.write.mode("overwrite").parquet(f"{out}/versions/batch={epoch}")

    return fresh.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_processed(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """What stream_documents has made of the last content of each document."""
    last = spark.read.parquet(f"{out}/versions").groupBy(key).agg(F.max("_version").alias("_version"))
    return spark.read.parquet(f"{out}/rows").join(last, [key, "_version"]).drop("_version", "batch")
