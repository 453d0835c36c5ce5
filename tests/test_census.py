"""The census counts rows and distinct documents per type, per detector and in all, in one shuffle of rows."""

from maskwright.operators import report


def test_census_is_that_of_a_cube(spark):
    rows = [(d, t, k) for d, t, k in [(1, "INN", "regex"), (1, "INN", "regex"), (1, "INN", "ner"), (2, "SUM", "ner"), (2, "INN", None), (None, "INN", "ner"), (3, None, None), (3, None, None)]]
    masks = spark.createDataFrame(rows, "doc_id bigint, entity_type string, detector string")
    masks.createOrReplaceTempView("census_masks")
    cube = spark.sql("select entity_type, detector, count(*) as n, count(distinct doc_id) as docs from census_masks group by cube (entity_type, detector)")
    assert sorted(map(repr, report.census(masks).collect())) == sorted(map(repr, cube.collect()))


def test_census_reads_no_row_four_times(spark):
    masks = spark.createDataFrame([(1, "INN", "ner")], "doc_id bigint, entity_type string, detector string")
    plan = report.census(masks)._jdf.queryExecution().executedPlan().toString()
    # Spark's own distinct counts expand each row before the shuffle; here only counts are expanded, after it.
    assert plan.count("hashpartitioning(doc_id") == 1 and plan.index("Expand") < plan.index("hashpartitioning(doc_id")
