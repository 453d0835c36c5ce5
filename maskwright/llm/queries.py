"""The queries of the ten operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, fingerprints, licenses, sentencepiece, token_counts
from .common import documents, new_path
from .lines import dedup_lines
from .mixing import mix_shares
from .quality import judged
from .simhash import near_duplicate_classes
from .substrings import remove_repeats


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(documents(spark, sf_dir)).select(*names)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.replay(documents(spark, sf_dir), new_path(spark, "token-rollup")).totals()


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), with_counts=True, whole=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(documents(spark, sf_dir))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.to_hex(F.col("fp")).alias("fingerprint"),
        fingerprints.to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, cut = remove_repeats(documents(spark, sf_dir), new_path(spark, "substring-index"))
    digest = cut.select("doc_id", "text_key", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    joined = facts.join(digest, ["doc_id", "text_key"], "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256"))
    return joined.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = classifier.score(docs, classifier.train(docs, labels))
    return scored.select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: What SQL can state of the ten. Of the others: mixing (1), SimHash (4, 5), fingerprints (6), Viterbi
#: (3, 7), the machine (9) and template votes (10) need hashes or models that it lacks; tests/llm hold
#: them against plain loops.
SQL: dict[str, str] = {
    "op8_substring_dedup": f"""
with d as (select doc_id, {_WORDS} as w from documents),
 starts as (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20),
 windows as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as key from starts),
 later as (select doc_id, i from (select *, row_number() over (partition by key order by doc_id, i) as n from windows) where n > 1),
 gone as (select distinct doc_id, i + k as p from later, generate_series(0, 19) g(k)),
 words as (select doc_id, unnest(generate_series(1, len(w))) as p, unnest(w) as word from d where len(w) > 0),
 kept as (select doc_id, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id),
 n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)""",
    "op2_quality_rules": f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as w from documents),
 starts as (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d where len(w) >= 8),
 windows as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as key from starts),
 twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, key) as n from windows) where n > 1),
 repeats as (select doc_id, count(distinct i + k) as n_repeat_words from twice, generate_series(0, 7) g(k) group by doc_id),
 lines as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
 dups as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lines group by doc_id),
 base as (select doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
   coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines from d left join repeats using (doc_id) left join dups using (doc_id)),
 judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base),
 rates as (select *, unnest([{{'r': 'symbols', 'x': (case when n_words > 0 then 1000 * n_symbols // n_words else 0 end)::bigint, 'least': 100, 'low': false}}, {{'r': 'dup_lines', 'x': (case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end)::bigint, 'least': 500, 'low': false}},
   {{'r': 'repeats', 'x': (case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end)::bigint, 'least': 250, 'low': false}}, {{'r': 'word_length', 'x': (case when n_words > 0 then 100 * word_chars // n_words else 0 end)::bigint, 'least': 300, 'low': true}}], recursive := true) from judged),
 buckets as (select *, x // (1::bigint << greatest(length(bin(x)) - 6, 0)) * (1::bigint << greatest(length(bin(x)) - 6, 0)) as b from rates where not base_failed),
 ranked as (select lang, source, r, least, b, row_number() over (partition by lang, source, r order by b) as i0, count(*) over (partition by lang, source, r) as c0, row_number() over (partition by lang, r order by b) as i1, count(*) over (partition by lang, r) as c1,
   row_number() over (partition by r order by b) as i2, count(*) over (partition by r) as c2 from buckets),
 f0 as (select lang, source, r, any_value(c0) as c, min(b) filter (4 * i0 >= c0) as q1, min(b) filter (4 * i0 >= 3 * c0) as q3 from ranked group by all),
 f1 as (select lang, r, any_value(c1) as c, min(b) filter (4 * i1 >= c1) as q1, min(b) filter (4 * i1 >= 3 * c1) as q3 from ranked group by all),
 f2 as (select r, min(b) filter (4 * i2 >= c2) as q1, min(b) filter (4 * i2 >= 3 * c2) as q3 from ranked group by all),
 fences as (select f0.lang, f0.source, f0.r, case when f0.c >= 50 then f0.q1 when f1.c >= 50 then f1.q1 else f2.q1 end as q1, case when f0.c >= 50 then f0.q3 when f1.c >= 50 then f1.q3 else f2.q3 end as q3
   from f0 left join f1 on f1.lang is not distinct from f0.lang and f1.r = f0.r join f2 on f2.r = f0.r),
 verdict as (select a.doc_id, bool_and(coalesce(x <= q3 + greatest(3 * (q3 - q1), least) and (not low or x >= q1 - greatest(3 * (q3 - q1), least)), false)) as good
   from rates a left join fences f on f.lang is not distinct from a.lang and f.source is not distinct from a.source and f.r = a.r group by a.doc_id)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and good as kept from judged join verdict using (doc_id)""",
}
