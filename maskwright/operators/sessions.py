"""Sessions: what each token stood for, kept encrypted for a time.

sessions: session_id, created_at, expires_at, payload (AES-GCM of the tokens' JSON). A timestamp
without expiry never expires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default lives, and the least and most days that a setting may name.
TTL_HOURS, SESSION_DAYS, MARKUP_DAYS, LEAST_DAYS, MOST_DAYS = 24, 7, 30, 1, 365
TOKENS = "array<struct<token:string,entity_type:string,original_text:string,canonical:string,occurrences:array<string>,n:bigint>>"
MAGIC = "MWV1"


def retention(settings: dict | None = None) -> dict[str, int]:
    """Days that sessions and markup live; anything that isn't a number of 1 to 365 counts as the default."""
    read = lambda k, d: v if isinstance(v := (settings or {}).get(k), int) and not isinstance(v, bool) and LEAST_DAYS <= v <= MOST_DAYS else d
    return {"sessions": read("sessions", SESSION_DAYS), "markup": read("markup", MARKUP_DAYS)}


def save_sessions(tokens: DataFrame, key: Column, now: Column | None = None, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """One session per document of tokens (doc_id, token, entity_type, original_text, canonical, occurrences, n). The key is a column of 16, 24 or 32 bytes."""
    now = F.current_timestamp() if now is None else now
    entry = F.struct("token", "entity_type", "original_text", "canonical", "occurrences", "n")
    packed = tokens.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("json"))
    return packed.select(
        F.col("doc_id").cast("string").alias("session_id"), now.alias("created_at"), (now + F.make_dt_interval(hours=F.lit(ttl_hours))).alias("expires_at"),
        F.concat(F.lit(MAGIC).cast("binary"), F.aes_encrypt(F.col("json").cast("binary"), key, F.lit("GCM"))).alias("payload"),
    )


def read_payload(payload: Column, key: Column) -> Column:
    """JSON of a payload; one without the mark is plain text; null where the key doesn't fit."""
    marked = F.substring(payload, 1, len(MAGIC)).cast("string") == MAGIC
    return F.when(marked, F.try_aes_decrypt(F.expr(f"substring(payload, {len(MAGIC) + 1})"), key, F.lit("GCM")).cast("string")).otherwise(payload.cast("string"))


def load_sessions(sessions: DataFrame, key: Column, now: Column) -> DataFrame:
    """Live sessions' tokens: session_id, token, entity_type, original_text, canonical, occurrences, n. Expired and unreadable ones are left out."""
    live = sessions.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live.select("session_id", F.inline(F.from_json(read_payload(F.col("payload"), key), TOKENS)))


def purge_expired(sessions: DataFrame, now: Column, keep: str | None = None) -> DataFrame:
    """Sessions without those that have expired, but for the one to keep."""
    kept = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return sessions.where(kept if keep is None else kept | (F.col("session_id") == keep))


def list_sessions(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """session_id, created_at, expires_at, n_tokens, newest first."""
    n = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    joined = sessions.select("session_id", "created_at", "expires_at").join(n, "session_id", "left").fillna(0, ["n_tokens"])
    return joined.orderBy(F.col("created_at").desc(), "session_id")


def delete_session(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def orphans(sidecars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records that belong to no session any more."""
    return sidecars.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def replace_entities(sessions: DataFrame, changed: DataFrame) -> DataFrame:
    """Sessions with the payloads of changed (session_id, payload); times stay."""
    new = changed.select("session_id", F.col("payload").alias("_new"))
    return sessions.join(new, "session_id", "left").withColumn("payload", F.coalesce("_new", "payload")).drop("_new")


def purge_markup(markup: DataFrame, now: Column, days: int = MARKUP_DAYS) -> DataFrame:
    """Markup records younger than ``days``; undated ones stay."""
    return markup.where(F.col("created_at").isNull() | (F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days))))


def markup_summary(markup: DataFrame) -> DataFrame:
    return markup.agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("entries"), F.min("created_at").alias("oldest"))


def merge_markup(existing: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both, by id; what exists wins."""
    return existing.unionByName(legacy.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti").select(*existing.columns))
