"""Work on few bytes is shared by tasks: neither a file's one split nor the merging of small partitions puts it all into one."""

import random

from pyspark.sql import functions as F

from maskwright import queries
from maskwright.operators import metrics, multispan, normalize, resolve, structural


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_conflicts_are_settled_by_many_tasks(spark):
    rows = [(d, 0, i, s, e, "abcdef"[s:e], "INN", "regex", 1.0) for d in range(64) for i, (s, e) in enumerate(((0, 4), (2, 6)))]
    entities = resolve.as_entities(spark.createDataFrame(rows, "doc_id bigint, seg_ord int, ent_seq bigint, start int, end int, original_text string, entity_type string, detector string, confidence double").coalesce(1))
    settled = resolve.resolve_overlaps(entities)
    assert tasks(settled) > 1
    got = {(r.doc_id, r.start, r.end, r.original_text, len(r.shadowed or [])) for r in settled.collect()}
    assert got == {(d, s, e, "abcdef"[s:e], n) for d in range(64) for s, e, n in ((0, 4, 1), (4, 6, 0))}
    assert settled.where(F.size("shadowed") > 0).select("shadowed.entity_type").first()[0] == ["INN"]


def test_names_are_read_by_many_tasks(spark):
    texts = ["генеральный директор Петров П.С. тут", "с ним и Петрова", "ничего"]
    segments = spark.createDataFrame([(d, k, t) for d in range(64) for k, t in enumerate(texts)] + [(1000, 0, "ничего"), (1001, 0, None)], "doc_id bigint, seg_ord int, text string").coalesce(1)
    people = structural.detect_structural(normalize.with_view(segments))
    assert tasks(people) > 1
    got = sorted((r.doc_id, r.seg_ord, r.original_text, r.group_key) for r in people.collect())
    assert got == sorted((d, k, t, "per:0") for d in range(64) for k, t in ((0, "Петров П.С."), (1, "Петрова")))


def test_built_lines_are_read_by_many_tasks(spark, sf):
    lines = queries.built(queries.table(spark, sf, "customer"), F.col("c_custkey"), F.lit("a"), F.lit("b"))
    assert tasks(lines) > 1
    assert lines.count() == 2 * queries.table(spark, sf, "customer").count()


def test_a_value_is_made_once_however_often_it_is_used(spark):
    plan = lambda c: spark.createDataFrame([("", "")], "a string, b string").select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(multispan._pieces(F.col("a"), "x", "y", F.lit(0))).count("regexp_extract_all") == 1
    assert plan(metrics.leak_numeric(F.col("a"), F.col("b"))).count("[^0-9]") == 1


def test_longest_window_is_that_of_all_windows(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("12") for _ in range(rng.randrange(9))), " ".join("".join(rng.choice("12") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3)))) for _ in range(300)]

    def window(core, field):
        best = ""
        for run in field.split():
            parts = [core[i : i + n] for n in range(len(core), 0, -1) for i in range(len(core) - n + 1) if core[i : i + n] in run]
            if parts and (parts[0] == core or len(parts[0]) >= metrics.RUN_SHARE * len(run)) and len(parts[0]) > len(best):
                best = parts[0]
        return best

    got = spark.createDataFrame(rows, "core string, field string").select("core", "field", metrics.longest_window(F.col("core"), F.col("field")).alias("w")).collect()
    assert all(r.w == window(r.core, r.field) for r in got)


def test_words_of_documents_are_recorded_by_many_tasks(spark, sf):
    assert tasks(queries.structural_records(spark, sf)) > 1
