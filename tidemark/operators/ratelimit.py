"""Per-client rate limiting with blocking, over a table of requests."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import MICROS, micros, ordered_fold
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class RateConfig:
    """Limits are request counts; windows and block times are in seconds."""

    per_minute: int = 100
    per_hour: int = 1000
    burst: int = 20
    minute: int = 60
    hour: int = 3600
    burst_window: int = 10
    minute_block: int = 60
    hour_block: int = 3600
    burst_block: int = 30

    @property
    def memory(self) -> int:
        """Seconds after which an idle client's past can no longer matter."""
        return max(self.minute, self.hour, self.burst_window, self.minute_block, self.hour_block, self.burst_block)


class ClientState:
    """Accepted request times inside the longest window, and the block's end.

    Holds at most ``per_hour`` times, because denied requests are not recorded.
    """

    __slots__ = ("accepted", "blocked_until")

    def __init__(self, accepted=(), blocked_until: int = 0):
        self.accepted = deque(accepted)
        self.blocked_until = blocked_until


def decide(state: ClientState, times: list[int], cfg: RateConfig) -> list[str]:
    """Verdict for each time (microseconds, ascending); updates ``state``."""
    horizon = max(cfg.minute, cfg.hour, cfg.burst_window) * MICROS
    limits = (
        ("minute_exceeded", cfg.minute * MICROS, cfg.per_minute, cfg.minute_block),
        ("hour_exceeded", cfg.hour * MICROS, cfg.per_hour, cfg.hour_block),
        ("burst_exceeded", cfg.burst_window * MICROS, cfg.burst, cfg.burst_block),
    )
    kept, verdicts, i = state.accepted, [], 0
    while i < len(times):
        now = times[i]
        if now < state.blocked_until:
            skip = bisect_left(times, state.blocked_until, i)
            verdicts += ["blocked"] * (skip - i)
            i = skip
            continue
        while kept and now - kept[0] >= horizon:
            kept.popleft()
        verdict = "allowed"
        for name, span, limit, block in limits:
            # reached exactly when the limit-th newest accepted request is still inside
            if limit <= 0 or (len(kept) >= limit and now - kept[-limit] < span):
                verdict, state.blocked_until = name, now + block * MICROS
                break
        else:
            kept.append(now)
        verdicts.append(verdict)
        i += 1
    return verdicts


def with_episode(df: DataFrame, client: str, at: str, memory: int, calm: int = -1) -> DataFrame:
    """Cut a client's history where what came before cannot matter; adds ``_episode`` and its ``_size``.

    Time is cut into slots of ``memory`` seconds, the longest that a window or a block lasts. A client starts
    afresh after an empty slot, and in a slot that makes up at most ``calm`` requests with the slot before, if
    that one did so too: no request there is denied, and no block reaches it. Works on (client, slot) pairs,
    which are few, so that the busiest client costs no more than the number of its slots.
    """
    slot = F.floor(micros(F.col(at)) / F.lit(memory * MICROS))
    tagged = df.withColumn("_slot", slot)
    slots = tagged.groupBy(F.col(client).alias("_of"), F.col("_slot").alias("_at_slot")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_of").orderBy("_at_slot")
    follows = F.coalesce(F.col("_at_slot") - F.lag("_at_slot").over(order) == 1, F.lit(False))
    pair = F.col("_n") + F.when(follows, F.lag("_n").over(order)).otherwise(0)
    paired = slots.withColumn("_follows", follows).withColumn("_calm", pair <= calm)
    fresh = ~F.col("_follows") | (F.col("_calm") & F.lag("_calm").over(order))
    numbered = paired.withColumn("_new", F.when(fresh, 1).otherwise(0)).withColumn(
        "_episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    sized = numbered.select("_of", "_at_slot", "_episode", F.sum("_n").over(Window.partitionBy("_of", "_episode")).alias("_size"))
    return tagged.join(sized, F.col(client).eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at_slot"))).drop("_slot", "_of", "_at_slot")


def rate_limit(
    df: DataFrame, config: RateConfig = RateConfig(), client: str = "client_id", at: str = "timestamp", tie: str = "id"
) -> DataFrame:
    """(client, id, verdict): blocked, then minute, hour and burst limits, else allowed.

    Each verdict depends on the client's earlier verdicts, so a client's busy
    episode is one ordered stream with a state of at most ``per_hour`` times;
    episodes that cannot influence each other run in parallel, and one with no
    more requests than the least limit is allowed as it is, without a fold.
    """
    kinds = dict(df.dtypes)
    least = min(config.per_minute, config.per_hour, config.burst)
    cut = cut_lineage(with_episode(df.select(client, tie, at), client, at, config.memory, least).select(
        client, "_episode", "_size", tie, micros(F.col(at)).alias("_at")
    ))
    quiet = F.col("_size") <= least

    def step(state: ClientState, times: list[int]):
        return state, (decide(state, times, config),)

    schema = f"{client} {kinds[client]}, {tie} {kinds[tie]}, verdict string"
    busy = ordered_fold(cut.filter(~quiet).drop("_size"), [client, "_episode"], ["_at", tie], ["_at"], ClientState, step, schema)
    return busy.unionByName(cut.filter(quiet).select(client, tie, F.lit("allowed").alias("verdict")))
