"""Places of rows in an order, also of keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place(rows: DataFrame, keys: list[str], order: list[str], block: int | None = None, out: str = "place") -> DataFrame:
    """Adds the 1-based place of each row among those of its keys; nulls stand last.

    With `block`, keys are cut into runs of that many values of the first order column (a whole number): runs are counted
    (pre-aggregated) and scanned first, rows are ranked within their run, so a hot key spreads over tasks."""
    by = [F.asc_nulls_last(c) for c in order]
    if block is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("bigint"))
    # One struct, as joins leave out null columns but not structs that hold some.
    rows = rows.withColumn("__run", F.struct(*keys, F.floor(F.col(order[0]) / block).alias("__no")))
    runs = rows.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*[f"__run.{k}" for k in keys]).orderBy(F.asc_nulls_last("__run.__no")).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__run").orderBy(*by))
    return rows.join(runs, "__run").withColumn(out, (F.col("__before") + own).cast("bigint")).drop("__run", "__before")
