"""Streams: masking as texts arrive, windows over events, and sessions that expire on their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from maskwright.operators.patterns import pattern_hits
from maskwright.plans.rules import RULES, Rule


def hits_of_stream(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A stream of texts (doc_id, text) with one row per value, stateless: doc_id, start, end, entity_type, value."""
    rows = texts.select("doc_id", "text", F.explode(pattern_hits(F.col("text"), rules)).alias("h"))
    return rows.select("doc_id", "h.start", "h.end", F.col("h.type").alias("entity_type"), F.substring(F.col("text"), F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("value"))


def counts_by_window(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """window_start, key, n: tumbling or sliding counts; rows later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions_by_gap(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """key, session_start, session_end, n: session windows closed by a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


_STATE = "expires_ms bigint, n bigint"
_OUT = "session_id string, status string, n bigint"


def _live(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        _, n = state.get
        state.remove()
        yield pd.DataFrame({"session_id": [key[0]], "status": ["expired"], "n": [n]})
        return
    expires, n = state.get if state.exists else (0, 0)
    for frame in frames:
        n += len(frame)
        expires = max(expires, int(frame["expires_at"].max().timestamp() * 1000))
    state.update((expires, n))
    state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"session_id": [key[0]], "status": ["live"], "n": [n]})


def expiring_sessions(entries: DataFrame, late: str = "1 minute") -> DataFrame:
    """session_id, status, n from a stream (session_id, created_at, expires_at): live on each change, expired once the watermark passes the expiry; the state goes then."""
    keyed = entries.withWatermark("created_at", late).groupBy("session_id")
    return keyed.applyInPandasWithState(_live, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def mask_stream(texts: DataFrame, mask: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through a batch plan and is written under its own batch id, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        mask(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
