"""What becomes of a watch's matches as records change: enter, stay, exit, retract."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def match_transitions(versions: DataFrame, matches: DataFrame) -> DataFrame:
    """key, version, watch_id and transition of each version against the one before.

    ``versions``: key, version (1, 2, ...), retracted; ``matches``: key, version, watch_id, one row a pair. A match enters
    with the first version that has it, stays while the next has it too, and exits with the first that hasn't; where that version
    retracts the record, the match is retracted. A retracted version matches nothing. A record that is published again enters anew.

    Versions are compared by one outer join of the matches with themselves, a version on; no window holds a record's history.
    """
    live = matches.join(versions.where(~F.coalesce("retracted", F.lit(False))).select("key", "version"), ["key", "version"], "left_semi")
    now, before = live.select("key", "version", "watch_id", F.lit(True).alias("now")), live.select("key", (F.col("version") + 1).alias("version"), "watch_id", F.lit(True).alias("before"))
    both = now.join(before, ["key", "version", "watch_id"], "full_outer").join(versions.select("key", "version", "retracted"), ["key", "version"])
    kind = F.when(F.col("now") & F.col("before"), "stay").when(F.col("now"), "enter").when(F.coalesce("retracted", F.lit(False)), "retract").otherwise("exit")
    return both.select("key", "version", "watch_id", kind.alias("transition"))


def notices(transitions: DataFrame, watches: DataFrame, occurred: DataFrame) -> DataFrame:
    """key, version, watch_id and transition of what a watch is told of: not that a match stays, and nothing from before its confirmation.

    ``watches``: watch_id, state, confirmed_at; ``occurred``: key, version, occurred_at.
    """
    active = watches.where("state = 'active' AND confirmed_at IS NOT NULL").select("watch_id", "confirmed_at")
    told = transitions.where("transition <> 'stay'").join(active, "watch_id").join(occurred, ["key", "version"])
    return told.where("confirmed_at <= occurred_at").select("key", "version", "watch_id", "transition")
