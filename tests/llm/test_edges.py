"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: no crash, defined results."""

import pytest
from pyspark.sql import functions as F

from maskwright.llm import classifier, fingerprints, licenses, lines, mixing, quality, sentencepiece, simhash, substrings, token_counts
from maskwright.llm.common import new_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, fp bigint, size int, copies int, ids string, component_id int, doc int, label int, score string"
LONG = "слово " * 40_000 + "конец."
ODD = [
    (None, None, None, None), (None, "text without an id " * 8, "en", "a"), (1, None, "en", None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (5, "one", "en", "b"),
    (5, "one", "en", "b"), (6, LONG, "ru", "b"), (7, LONG, "ru", "b"), (8, "A b\nA b\nA b c d e\n\n", "en", "c"), (9, "漢字 😀 \x00 ▁ x", "zh", "c"), (9, "other text, same id", "zh", "c"),
]
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 7, 7, 7, 7, "x", 7, 7, 1, "s") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(docs):
    return docs.select("doc_id", "label")


#: Each operator on a table: a frame with a row per row of the table.
PER_ROW = {
    "mixing": lambda d: mixing.mix_shares(d),
    "quality": lambda d: quality.judged(d),
    "simhash": lambda d: simhash.near_duplicate_classes(d),
    "fingerprints": lambda d: fingerprints.edited_fingerprints(d),
    "sentencepiece": lambda d: sentencepiece.round_trip(d),
    "classifier": lambda d: classifier.score(d, classifier.train(d, labels(d))),
    "licenses": lambda d: licenses.scan(d),
    "lines": lambda d: lines.dedup_lines(d),
}
#: Those that return rows of the table with all its columns.
KEEPING = {"mixing": mixing.mix_sources, "quality": quality.keep_quality, "simhash": simhash.near_dedup, "lines": lines.dedup_lines}


@pytest.mark.parametrize("name", list(PER_ROW))
def test_a_row_for_each_row(odd, empty, name):
    assert len(PER_ROW[name](odd).collect()) == len(ODD)
    assert PER_ROW[name](empty).collect() == []


@pytest.mark.parametrize("name", list(KEEPING))
def test_columns_are_kept(odd, empty, name):
    assert KEEPING[name](odd).columns == NAMES
    assert all(r.size == 7 and r.score == "s" for r in KEEPING[name](odd).collect())
    assert KEEPING[name](empty).collect() == []


def test_substrings(spark, odd, empty):
    facts, cut = substrings.remove_repeats(odd, new_path(spark, "t"))
    assert facts.count() == len(ODD)
    copy = {r.doc_id: r.copy for r in facts.collect()}
    assert copy[7] and not copy[6] and not copy[5]
    removed = {r.doc_id: r.n_removed for r in cut.collect()}
    assert removed == {6: 40_001 - 2}  # later windows cover all but the first word, and the last is in none of them
    facts, cut = substrings.remove_repeats(empty, new_path(spark, "t"))
    assert facts.collect() == [] and cut.collect() == []


def test_token_counts(spark, odd, empty):
    rollup = token_counts.replay(odd, new_path(spark, "t"))
    words = rollup.totals().where("tokenizer = 'words@1'").agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert words[0] == len(ODD) - 3  # both rows of document 5 repeat 4's text, and 7 repeats 6's
    assert token_counts.replay(empty, new_path(spark, "t")).totals().collect() == []


def test_defined_results(odd):
    mixed = {r.doc_id: r for r in mixing.mix_shares(odd).collect()}
    assert mixed[2].size == 0 and mixed[2].taken == 0 and mixed[2].copies == 1
    prints = {r.doc_id: r for r in simhash.near_duplicate_classes(odd).collect()}
    assert prints[1].fp == prints[2].fp == prints[3].fp == 0 and prints[2].component_id == 1
    judged = [r for r in quality.judged(odd).collect() if r.doc_id in (1, 2, 3)]
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in judged)
    kept = {r.doc_id: r.text for r in lines.dedup_lines(odd).collect()}
    assert kept[1] is None and kept[2] == "" and kept[7] == "" and kept[8] == "A b\nA b\nA b c d e\n\n"
    assert all(r.exact for r in sentencepiece.round_trip(odd).collect())
    scanned = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert scanned[1].n_words == 0 and scanned[1].labels == "" and scanned[1].first_word is None and scanned[1].score == 0
    near = {r.doc_id: r for r in fingerprints.edited_fingerprints(odd).select("doc_id", "edited", fingerprints.likeness(F.col("fp"), F.col("fp")).alias("self")).collect()}
    assert near[1].edited == "" and all(r.self == 1.0 for r in near.values())
