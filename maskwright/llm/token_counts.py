"""Operator 3: token counts kept up to date by signed changes.

``TokenRollup`` holds totals of documents and tokens by source, language and tokenizer version. A
batch of changes (inserts, deletes, revised counts) is summed to one row per group and written as a
table of its own; a batch counts once the next manifest names it. Manifests are numbered files that
are created, never overwritten, so of two writers one fails and tries again, a batch id that is
already in the manifest is left alone, and a run that broke off before its manifest leaves nothing
that counts. Totals are sums of the named tables; ``compact`` folds those into one.

Defined results: null source and lang are groups of their own. A null count before means an insert,
a null count after a delete; both null is nothing. Groups whose totals have come to zero are left
out. An empty batch commits and adds nothing. Repeated rows in a batch count each.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Manifests, Words, materialize, rejoin, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = ("source", "lang", "tokenizer")


class TokenRollup:
    """Totals under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Manifests(spark, self.root, {"tables": [], "batches": []})

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit changes (source, lang, tokenizer, before, after); False if the batch was there already."""
        number, manifest = self.log.latest()
        if batch_id in manifest["batches"]:
            return False
        one = lambda c: F.col(c).isNotNull().cast("long")
        delta = changes.groupBy(*GROUP).agg(
            F.sum(one("after") - one("before")).alias("n_docs"), F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("n_tokens")
        )
        table = f"{self.root}/deltas/{uuid.uuid4().hex}"
        delta.repartition(1).write.parquet(table)  # a row per group at most
        self.log.publish(number + 1, {"tables": [*manifest["tables"], table], "batches": [*manifest["batches"], batch_id]})
        return True

    def totals(self) -> DataFrame:
        tables = self.log.latest()[1]["tables"]
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
        rows = self.spark.read.schema(schema).parquet(*tables) if tables else self.spark.createDataFrame([], schema)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the tables into one; batch ids stay known."""
        number, manifest = self.log.latest()
        table = f"{self.root}/deltas/{uuid.uuid4().hex}"
        self.totals().repartition(1).write.parquet(table)
        self.log.publish(number + 1, {"tables": [table], "batches": manifest["batches"]})


@lru_cache(1)
def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def counted(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id, lang, source, text_key and three counts of every row: words, word_like (words with a letter, digit or non-ASCII character) and bpe."""
    with open(ranks_path, "rb") as file:  # on the driver; its size is that of the vocabulary
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    like = np.zeros(256, bool)
    like[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value)
        keep = ("doc_id", "lang", "source", "text_key")
        for batch in batches:
            text = batch.column("text")
            for at, to, data, bounds in slices(text):
                words = Words(data, bounds)
                upto = np.concatenate(([0], np.cumsum(like[data])))
                good = np.concatenate(([0], np.cumsum(upto[words.end] > upto[words.start])))
                bpe = [len(encoding.encode_ordinary(t)) if t else 0 for t in text.slice(at, to - at).to_pylist()]
                columns = [*(batch.column(c).slice(at, to - at) for c in keep), pa.array(words.counts), pa.array(np.diff(good[words.first])), pa.array(bpe, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "words", "word_like", "bpe"])

    keyed = docs.select("doc_id", "lang", "source", F.md5("text").alias("text_key"), "text")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {doc_type}, lang string, source string, text_key string, words bigint, word_like bigint, bpe bigint")


def _changes(rows: DataFrame, pairs: dict[str, tuple]) -> DataFrame:
    """pairs: tokenizer -> (count before, count after), column names or None."""
    side = lambda c: F.lit(None).cast("bigint") if c is None else F.col(c)
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), side(a).alias("before"), side(b).alias("after")) for k, (a, b) in pairs.items()])
    return rows.select("source", "lang", F.explode(each).alias("c")).select("source", "lang", "c.tokenizer", "c.before", "c.after")


def replay(docs: DataFrame, root: str) -> TokenRollup:
    """A corpus's history as four batches, one of them sent twice, kept in a rollup under root.

    All documents come in under words@1 and bpe_50k@1; documents whose text an earlier doc_id has
    are deleted; words@1 is revised for those that stay, symbols on their own being no words any
    more; bpe_50k@1 is left as it is.
    """
    rows = materialize(counted(docs), "token-counts")
    keys = materialize(rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "token-copies")
    marked = rejoin(rows, keys, "text_key", how="left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    marked = materialize(marked.select("source", "lang", "words", "word_like", "bpe", "copy"), "token-marked")
    rollup = TokenRollup(docs.sparkSession, root)
    rollup.apply("load", _changes(rows, {"words@1": (None, "words"), "bpe_50k@1": (None, "bpe")}))
    copies = _changes(marked.where("copy"), {"words@1": ("words", None), "bpe_50k@1": ("bpe", None)})
    rollup.apply("copies", copies)
    rollup.apply("revision", _changes(marked.where("not copy"), {"words@1": ("words", "word_like")}))
    rollup.apply("copies", copies)
    rollup.compact()
    return rollup
