"""Structured Streaming ingest: a persist loop by micro-batches and stateful ordered admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.ingest import DUPLICATE, OK, OUT_OF_ORDER


def persist_loop(points: DataFrame, engine, checkpoint: str, every: str | None = "100 milliseconds", name: str = "persist-loop") -> StreamingQuery:
    """Each micro-batch is logged and flushed into the engine's store, whose log is truncated after that only. A batch that comes
    again after a failure is known by its number, so every point is stored once. every=None drains what is there and stops."""

    def persist(batch: DataFrame, batch_id: int) -> None:
        if "arrival" not in batch.columns:
            batch = batch.withColumn("arrival", F.monotonically_increasing_id() % (1 << 40))
        engine.write_batch(batch, stream=name, batch=batch_id)
        engine.flush()

    writer = points.writeStream.foreachBatch(persist).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def admit_stream(points: DataFrame, order: str = "arrival") -> DataFrame:
    """Adds status to a stream of points: in each series a time must pass the last accepted one. State is one LONG per series;
    within a micro-batch a series' points are taken in `order`."""
    schema = f"series_id string, ts_nanos bigint, value double, {order} bigint, status string"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        held = [f for f in frames if len(f)]
        if not held:
            return
        rows = pd.concat(held).sort_values(order)
        out = []
        for t in rows["ts_nanos"].tolist():
            if last is None or t > last:
                out.append(OK)
                last = t
            else:
                out.append(DUPLICATE if t == last else OUT_OF_ORDER)
        if last is not None:
            state.update((last,))
        yield rows[["series_id", "ts_nanos", "value", order]].assign(status=out)

    return points.select("series_id", "ts_nanos", "value", order).groupBy("series_id").applyInPandasWithState(run, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def late_filter(points: DataFrame, delay: str, time_col: str = "event_time") -> DataFrame:
    """Each (series_id, ts_nanos) once, as far back as the watermark's delay; older points are dropped."""
    timed = points.withColumn(time_col, F.timestamp_micros(F.expr("ts_nanos div 1000")))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["series_id", "ts_nanos"]).drop(time_col)
