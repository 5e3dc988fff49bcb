"""The outbox as a stream: keyed state, and timers that end leases nobody completed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from landsift.operators.deliveries import Delivery, Policy

OUT = "delivery string, seq bigint, kind string, state string, attempts int, outcome string"
_STATE = "state string, attempts int, next_at bigint, token bigint, expires_at bigint"


def _lived(policy: Policy) -> Callable:
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [None if v is None or v != v else v for v in state.get] if state.exists else []
        d, out = Delivery(*held), []
        if state.hasTimedOut:
            after = d.expired(state.getCurrentWatermarkMs() // 1000, policy)
            if after != d:
                out.append((key[0], None, "expired", after.state, after.attempts, "done"))
            d = after
        else:
            for e in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
                d, outcome = d.step(e.kind, int(e.at), None if pd.isna(e.token) else int(e.token), policy)
                out.append((key[0], e.seq, e.kind, d.state, d.attempts, outcome))
        state.update(astuple(d))
        if d.state == "leased":
            state.setTimeoutTimestamp(max(d.expires_at * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            rows = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            rows["seq"] = rows["seq"].astype("Int64")
            yield rows

    return run


def outbox(events: DataFrame, late: str = "10 minutes", policy: Policy = Policy()) -> DataFrame:
    """A row an event (delivery, seq, kind, ts, token) and a row a lease that a timer ended, with the delivery's state behind it.

    ``late``: how much later than others an event may come; a timer waits for it.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("delivery", "seq", "kind", "ts", F.unix_seconds("ts").alias("at"), F.col("token").cast("long").alias("token"))
    return rows.groupBy("delivery").applyInPandasWithState(_lived(policy), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
