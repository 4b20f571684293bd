"""Write policies: upsert, append in arrival order, strictly ordered admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.rank import place

OK, OUT_OF_ORDER, DUPLICATE, INVALID = "OK", "OUT_OF_ORDER", "DUPLICATE", "INVALID"


def upsert(points: DataFrame, order: str = "seq", stored: DataFrame | None = None) -> DataFrame:
    """The last write of each (series_id, ts_nanos) by `order`; stored points lose to any new one.

    An aggregation, not a window: the map side keeps one value per key, so a hot key sends one row per task."""
    if stored is not None:
        points = stored.select("series_id", "ts_nanos", "value", F.lit(None).cast("bigint").alias(order)).unionByName(points.select("series_id", "ts_nanos", "value", order))
    # value takes part in the order only among writes of the same place in the order
    rank = F.struct(F.col(order), F.col("value"))
    return points.groupBy("series_id", "ts_nanos").agg(F.max_by("value", rank).alias("value"))


def append(points: DataFrame, order: str = "arrival", after: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Points with their 1-based place in their series' arrival order, duplicates and disorder kept; points of equal order stand by
    time, then value, those of no order last.

    after: (series_id, n) places already taken. block: as in rank.place, for hot series."""
    out = place(points, ["series_id"], [order, "ts_nanos", "value"], block)
    if after is not None:
        out = out.join(after.select("series_id", F.col("n").alias("__n")), "series_id", "left").withColumn("place", F.col("place") + F.coalesce("__n", F.lit(0))).drop("__n")
    return out


def status(previous: Column, ts: Column) -> Column:
    return F.when(previous.isNull() | (ts > previous), OK).when(ts == previous, DUPLICATE).otherwise(OUT_OF_ORDER)


def admit(points: DataFrame, order: str = "arrival", epoch: str | None = None, block: int | None = None, abort_batch: bool = False, after: DataFrame | None = None) -> DataFrame:
    """Adds status: OK if ts_nanos is past the last accepted one of the series (and epoch, as a flush starts a fresh encoder).

    A rejected time never exceeds the last accepted one, so that is the running maximum of all earlier rows. With `block`, a
    series is cut into runs of that many order values: run maxima are aggregated and scanned first, so a hot series spreads over
    tasks. abort_batch also rejects, per epoch, what comes after the first failure of any series (status ABORTED).
    after: (series_id, last_ns) times accepted before these points."""
    if after is not None:
        points = points.join(after.select("series_id", F.col("last_ns").alias("__last")), "series_id", "left")
    last = F.col("__last") if after is not None else F.lit(None).cast("bigint")
    keys = ["series_id", *([epoch] if epoch else [])]
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if block is None:
        out = points.withColumn("status", status(F.greatest(F.max("ts_nanos").over(before), last), F.col("ts_nanos")))
    else:
        rows = points.withColumn("__run", F.floor(F.col(order) / block))
        runs = rows.groupBy(*keys, "__run").agg(F.max("ts_nanos").alias("__most"))
        runs = runs.withColumn("__earlier", F.max("__most").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))).drop("__most")
        own = F.max("ts_nanos").over(Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        out = rows.join(runs, [*keys, "__run"]).withColumn("status", status(F.greatest(own, F.col("__earlier"), last), F.col("ts_nanos"))).drop("__run", "__earlier")
    if after is not None:
        out = out.drop("__last")
    if abort_batch:
        batch = [epoch] if epoch else []
        first = out.where(F.col("status") != OK).groupBy(*batch).agg(F.min(order).alias("__first"))
        out = out.join(F.broadcast(first) if not batch else first, batch, "left") if batch else out.crossJoin(F.broadcast(first))  # one row
        out = out.withColumn("status", F.when(F.col(order) > F.col("__first"), "ABORTED").otherwise(F.col("status"))).drop("__first")
    return out


def last_encoded(points: DataFrame, order: str = "arrival") -> DataFrame:
    """Per series the point written last."""
    last = F.max_by(F.struct("ts_nanos", "value"), order).alias("last")
    return points.groupBy("series_id").agg(last).select("series_id", "last.ts_nanos", "last.value")
