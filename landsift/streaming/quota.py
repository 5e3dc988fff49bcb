"""Streaming forms of the fixed-window quota and of watch alerts.

The batch forms are in ``operators.reports`` and ``operators.spatial``; these keep running counts
with a watermark, so state of closed windows is dropped.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from landsift.operators.filters import watch_predicate
from landsift.operators.spatial import EVERY_LEVEL, met_at_home, placed


def attempts_by_window(stream: DataFrame, window: str = "1 hour", late: str = "2 hours", limit: int = 100) -> DataFrame:
    """Attempts of each client and route in tumbling windows, with how many are over the limit."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window), "client", "route").agg(F.count(F.lit(1)).alias("attempts"))
    return counted.select(F.col("window.start").alias("window_start"), "client", "route", "attempts", F.greatest(F.col("attempts") - limit, F.lit(0)).alias("rejected"))


def alerts(records: DataFrame, watches: DataFrame, cell: float = 0.05) -> DataFrame:
    """Alerts of a stream of records (public_id, status, development_type, box) against a table of watches.

    An equi-join on the places of the batch form: each record meets the watches of its own cells only, and the
    watches may be any number and any size. A record stands in all grids, as a stream can't know which of them watches own.
    """
    every = F.lit(EVERY_LEVEL)
    w = placed(watches.select("watch_id", "statuses", "types", F.col("box").alias("watch_box")), "watch_box", cell, 0.0, False, every)
    r = placed(records, "box", cell, 0.0, True, every)
    wanted = watch_predicate(F.col("status"), F.col("development_type"), F.col("statuses"), F.col("types"))
    met = met_at_home(F.col("box"), F.col("watch_box"), cell, F.col("place_"))
    return r.join(w, "place_").where(met & wanted).select("watch_id", "public_id")
