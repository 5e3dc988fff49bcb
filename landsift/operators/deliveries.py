"""The life of a queued message: leases, retries with growing delays, suppression, dead letters.

The same rules run over a table of events (``replay``, an aggregate in the JVM) and over a stream (``streaming.outbox``, with timers).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

STATES = ("queued", "leased", "retry", "sent", "suppressed", "dead")
KINDS = ("queue", "claim", "sent", "failed", "unsubscribe")
STATE = "struct<state:string,attempts:int,next_at:bigint,token:bigint,expires_at:bigint,outcome:string>"


@dataclass(frozen=True)
class Policy:
    """Seconds of a lease, of the first delay (each is twice the one before) and of the longest, and how many attempts there are."""

    lease: int = 900
    delay: int = 60
    longest: int = 3600
    attempts: int = 5

    def after(self, attempts: int) -> int:
        return min(self.longest, self.delay * 2 ** (attempts - 1))


@dataclass(frozen=True)
class Delivery:
    state: str | None = None
    attempts: int = 0
    next_at: int | None = None
    token: int | None = None
    expires_at: int | None = None

    def failed(self, at: int, policy: Policy) -> Delivery:
        if self.attempts >= policy.attempts:
            return Delivery("dead", self.attempts)
        return Delivery("retry", self.attempts, at + policy.after(self.attempts))

    def expired(self, now: int, policy: Policy) -> Delivery:
        """A lease that ran out is a failure at that time."""
        return self.failed(self.expires_at, policy) if self.state == "leased" and now >= self.expires_at else self

    def step(self, kind: str, at: int, token: int, policy: Policy) -> tuple[Delivery, str]:
        """The delivery after an event, and what became of the event: done, or refused."""
        d = self.expired(at, policy)
        if kind == "queue" and d.state is None:
            return Delivery("queued", 0, at), "done"
        if kind == "claim" and d.state in ("queued", "retry") and at >= d.next_at:
            return Delivery("leased", d.attempts + 1, None, token, at + policy.lease), "done"
        if kind in ("sent", "failed") and d.state == "leased" and token == d.token:  # the lease may be another's by now
            return (Delivery("sent", d.attempts) if kind == "sent" else d.failed(at, policy)), "done"
        if kind == "unsubscribe" and d.state in ("queued", "retry", "leased"):
            return Delivery("suppressed", d.attempts), "done"
        return d, "refused"


def replay(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """delivery, seq, kind, state, attempts and outcome after each event (delivery, seq, kind, at in seconds, token), in order of at and seq.

    A delivery has few events: attempts are bounded, and what comes after its end is refused.
    """
    delay = f"least({policy.longest}L, {policy.delay}L * shiftleft(1L, d.attempts - 1))"
    dead = f"d.attempts >= {policy.attempts}"
    struct = lambda state, attempts="d.attempts", next_at="NULL", token="NULL", expires="NULL", outcome="'done'": f"named_struct('state', {state}, 'attempts', {attempts}, 'next_at', CAST({next_at} AS BIGINT), 'token', CAST({token} AS BIGINT), 'expires_at', CAST({expires} AS BIGINT), 'outcome', {outcome})"
    failed = lambda at: f"IF({dead}, {struct(chr(39) + 'dead' + chr(39))}, {struct(chr(39) + 'retry' + chr(39), next_at=f'{at} + {delay}')})"
    current = f"CAST(IF(d.state = 'leased' AND e.at >= d.expires_at, {failed('d.expires_at')}, d) AS {STATE})"
    ends = "d.state = 'leased' AND e.token = d.token"
    after = f"""CASE WHEN e.kind = 'queue' AND d.state IS NULL THEN {struct("'queued'", "0", "e.at")}
      WHEN e.kind = 'claim' AND d.state IN ('queued', 'retry') AND e.at >= d.next_at THEN {struct("'leased'", "d.attempts + 1", token="e.token", expires=f"e.at + {policy.lease}")}
      WHEN e.kind = 'sent' AND {ends} THEN {struct("'sent'")}
      WHEN e.kind = 'failed' AND {ends} THEN {failed("e.at")}
      WHEN e.kind = 'unsubscribe' AND d.state IN ('queued', 'retry', 'leased') THEN {struct("'suppressed'")}
      ELSE {struct("d.state", next_at="d.next_at", token="d.token", expires="d.expires_at", outcome="'refused'")} END"""
    start = "named_struct('state', CAST(NULL AS STRING), 'attempts', 0, 'next_at', CAST(NULL AS BIGINT), 'token', CAST(NULL AS BIGINT), 'expires_at', CAST(NULL AS BIGINT), 'outcome', 'done')"
    # the last state leads the list; d is bound by a list of one
    one = f"transform(array(element_at(told, -1)), d -> {current})"
    step = f"concat(told, transform(transform({one}, d -> CAST({after} AS {STATE})), d -> d))"
    told = f"aggregate(events, CAST(array({start}) AS array<{STATE}>), (told, e) -> CAST({step} AS array<{STATE}>))"
    kept = events.groupBy("delivery").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "kind", "token"))).alias("events"))
    rows = kept.select("delivery", F.explode(F.expr(f"arrays_zip(events, slice({told}, 2, size(events)))")).alias("x"))
    event, state = F.col("x.events"), F.col("x")["1"]
    return rows.select("delivery", event["seq"].alias("seq"), event["kind"].alias("kind"), state["state"].alias("state"), state["attempts"].alias("attempts"), state["outcome"].alias("outcome"))
