"""Period aggregation of an event stream, with a watermark for late rows. An extension: the batch form is ``operators.series.aggregate``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum for each period and kind; a period is put out once the watermark has passed its end."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = x.groupBy(F.window(ts, width).alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")
