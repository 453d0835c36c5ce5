"""Queries over documents work on every word of the whole texts."""

import collections
import json

from maskwright import queries


def text_lines(text):
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def test_structural_records(spark, sf):
    got = collections.Counter((r.doc_id, json.loads(r.record)["length"]) for r in queries.structural_records(spark, sf).collect())
    want = collections.Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", "text").collect():
        want.update((r.doc_id, len(w)) for line in text_lines(r.text) for w in line.split(" ") if w)
    assert got == want


def test_whole_queries_count_every_word(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()]
    assert sum(r.n for r in queries.case_shapes_whole(spark, sf).collect()) == sum(len(t.split(" ")) for t in texts)
