"""Removal of repeated passages where rows share a doc_id, and an index that grows by many batches."""

import hashlib

import numpy as np

from maskwright.llm import queries, substrings
from maskwright.llm.common import new_path


def expected(rows):
    """Per row: (doc_id, number of words, removed, hash of the kept words). Rows of one doc_id are one document."""
    first = {}
    for d, text in rows:
        w = (text or "").split()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, text in rows:
        w = (text or "").split()
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 30))
    rows = []
    for d in range(24):
        own = list(rng.choice(words, 25))
        at = int(rng.integers(0, 25))
        rows.append((d, " ".join(own[:at] + passage + own[at:]) if d % 2 else " ".join(own)))
    return rows, passage, words, rng


def test_rows_that_share_an_id(spark, tmp_path):
    rows, passage, words, rng = corpus()
    other = " ".join(list(rng.choice(words, 7)) + passage + list(rng.choice(words, 3)))
    rows += [(5, other), (5, other), (9, rows[3][1]), (9, " ".join(rng.choice(words, 40))), (11, None), (11, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op8_substring_dedup(spark, f"file://{tmp_path}").collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected(rows)


def test_many_batches_and_compaction(spark):
    rows, *_ = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    root = new_path(spark, "t")
    facts, cut = substrings.remove_repeats(docs, root, batches=6)
    removed = {r.doc_id: r.n_removed for r in cut.collect()}
    assert {d: n for d, _, n, _ in expected(rows) if n} == removed
    index = substrings.SubstringIndex(spark, root)
    _, manifest = index.log.latest()
    assert sorted(r["level"] for r in manifest["runs"]) == [0, 0, 1]
    assert index._read(manifest["runs"]).select("doc_id").distinct().count() == len(rows)
    assert index.add(manifest["batches"][0], docs, docs) is None
