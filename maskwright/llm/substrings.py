"""Operator 8: removal of passages that stand earlier in the corpus, by a log-structured fingerprint index.

A window is ``WIDTH`` consecutive words. Of the short word sequences (grams) in a window, the one of
the least hash is its anchor; equal windows have equal anchors in the same place, so a window that
repeats has an anchor that repeats. The index holds the anchors of all documents so far, about one
in eight words, as immutable runs sorted by hash. A batch is added in these steps:

1. Merge: the batch's anchors become a run of their own. Rows of the earlier runs that a bit table of
   the batch's anchors lets through are merged with it in hash order; older runs are read, not
   shuffled or written again. An anchor met before, or twice in the batch, is a hit, for the earlier
   documents too. ``FANOUT`` runs of one level are merged into one of the next (compaction), so a row
   is rewritten as often as the logarithm of the corpus says. A manifest names the runs that count.
2. Verify: hashes of the whole windows at hit anchors are taken from the texts of the documents
   concerned. A task reports windows that it has met itself right away and passes on only the first
   of them; what is passed on meets by anchor, in the order of doc_id and place, and every window
   but the first is reported.
3. Remove: reported windows become ranges of words, which are cut out of the batch's documents.

Anchors go to tasks by ranges of (hash, document), so one that a third of all documents share is
read by many tasks; groups that run over a task's edge count as hits, which step 2 sets right.
Documents equal word for word to an earlier one are settled by a hash of their words and never
reach the index. Windows are compared by 64-bit hashes of their words' 64-bit hashes.

Defined results: a null text has no words. Documents of fewer than ``WIDTH`` words keep all. Rows
with a null doc_id are left whole and aren't indexed. Rows that share a doc_id count as one document,
whose windows are told apart by their place only, so none is a copy of the other at the same place;
what is removed is removed from the row that has it. Adding a batch id again changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Manifests, Words, bounded, materialize, might_match, mix64, rolling, shuffle_partitions, slices

WIDTH, GRAM = 20, 6
#: Document ids that may be sent to every executor to pick their texts; more are joined by a shuffle.
PICKED_IDS = 1_000_000
#: Anchors keep 48 bits: what they miss to tell apart is told apart in the second step.
_ANCHOR = np.uint64((1 << 48) - 1)
RUN = "anchor bigint, old boolean, doc_id bigint, n int"
#: Runs of one level that are merged into one of the next.
FANOUT = 4


def _windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first word within it, window hash, place of the anchor in the slice, anchor) of all windows of a slice."""
    words = Words(data, bounds)
    hashes = words.hashes()
    doc = np.repeat(np.arange(len(bounds) - 1), words.counts)
    if len(hashes) < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    own = np.flatnonzero(doc[: len(hashes) - WIDTH + 1] == doc[WIDTH - 1 :])
    whole = rolling(hashes, WIDTH)
    grams = rolling(hashes, GRAM) & _ANCHOR
    place = sliding_window_view(grams, WIDTH - GRAM + 1).argmin(axis=1) + np.arange(len(whole))
    place = place[own]
    return doc[own], own - words.first[doc[own]], whole[own], place, grams[place]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct anchors, and at how many places each stands."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for at, _, data, bounds in slices(batch.column("text")):
            doc, _, _, place, anchor = _windows(data, bounds)
            once = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
            doc, anchor = doc[once], anchor[once]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))) if len(doc) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(doc))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first].view(np.int64)), pa.array(np.zeros(len(first), bool)), pa.array(ids[at + doc[first]]), pa.array(n)], names=["anchor", "old", "doc_id", "n"]
            )


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark hits among rows sorted by (anchor, old, doc_id).

    A group is a hit if its first row is new and it has another row, or another place in that row.
    Groups at the task's edges may go on elsewhere, so they count as hits.
    """
    last: tuple[int, bool] | None = None  # the open group's anchor, and whether it is a hit for sure
    held: pa.RecordBatch | None = None

    def marked(batch: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
        nonlocal last
        anchor = batch.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.append(first, len(anchor)))
        new = ~batch.column(1).to_numpy(zero_copy_only=False)[first]
        hit = new & ((size > 1) | (batch.column(3).to_numpy()[first] > 1))
        if last is None or last[0] == anchor[0]:
            hit[0] = last is None or last[1]
        if ends:
            hit[-1] = True
        last = (int(anchor[-1]), bool(new[-1] or hit[-1]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.repeat(hit, size))], names=[*batch.schema.names, "hit"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:  # a group's first row waits for the second
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        anchor = batch.column(0).to_numpy()
        alone = last is None or last[0] != anchor[-1]
        keep = 1 if alone and (len(anchor) == 1 or anchor[-2] != anchor[-1]) else 0
        if len(anchor) > keep:
            yield marked(batch.slice(0, len(anchor) - keep), False)
        held = batch.slice(len(anchor) - keep) if keep else None
    if held is not None:
        yield marked(held, True)


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows where runs of consecutive starts in a document and text begin, and how long they are; rows in order."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1))))
    return first, np.diff(np.append(first, len(doc)))


def _first_of(value: np.ndarray) -> np.ndarray:
    """For each position the first position that has the same value."""
    order = np.argsort(value, kind="stable")
    head = np.concatenate(([True], value[order[1:]] != value[order[:-1]])) if len(value) else np.zeros(0, bool)
    out = np.empty(len(value), np.int64)
    out[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(value) else 0
    return out


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at hit anchors, from documents in ascending doc_id.

    A row is a run of consecutive windows with one anchor: their hashes go on to meet those of other
    tasks. A row without hashes is a run of windows already found to stand earlier.
    """
    met = np.zeros(0, np.uint64)  # hashes met in this task, sorted, by the documents that had them first
    met_at = np.zeros(0, np.uint64)  # and where that was, as one number
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys_of = batch.column("text_key").to_numpy(zero_copy_only=False)
        lists = batch.column("anchors")
        for at, to, data, bounds in slices(batch.column("text")):
            doc, start, whole, place, anchor = _windows(data, bounds)
            asked = lists.slice(at, to - at)
            owner = np.repeat(np.arange(to - at), np.diff(asked.offsets.to_numpy()))
            salt = lambda d, a: mix64(a ^ (d.astype(np.uint64) << np.uint64(48)))
            wanted = np.sort(salt(owner, asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(wanted):
                continue
            keys = salt(doc, anchor)
            hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
            doc, own, start, whole, anchor = ids[at + doc[hit]], keys_of[at + doc[hit]], start[hit], whole[hit], anchor[hit]
            if not len(doc):
                continue
            here = mix64(mix64(doc.astype(np.uint64)) + start.astype(np.uint64))
            before = np.minimum(np.searchsorted(met, whole), max(len(met) - 1, 0))
            known = met[before] == whole if len(met) else np.zeros(len(whole), bool)
            first = _first_of(whole)
            later = ~known & (here[first] != here)
            if len(met):
                later |= known & (met_at[before] != here)
            fresh = np.flatnonzero(~known & (first == np.arange(len(whole))))
            fresh = fresh[np.argsort(whole[fresh])]
            into = np.searchsorted(met, whole[fresh])
            met, met_at = np.insert(met, into, whole[fresh]), np.insert(met_at, into, here[fresh])

            a, n = _ranges(doc[later], own[later], start[later])
            told = [mix64(doc[later][a].astype(np.uint64) + start[later][a].astype(np.uint64)).view(np.int64), doc[later][a], own[later][a], start[later][a], start[later][a] + n]
            d, t, s, w, k = doc[~later], own[~later], start[~later], whole[~later], anchor[~later]
            a = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1) | (k[1:] != k[:-1])))) if len(d) else np.zeros(0, np.int64)
            n = np.diff(np.append(a, len(d)))
            ends = np.concatenate((a, [len(d)])).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(w.tobytes())])
            columns = [np.concatenate(x) for x in zip([k[a].view(np.int64), d[a], t[a], s[a], s[a] + n], told, strict=True)]
            hashes = pa.concat_arrays([packed, pa.nulls(len(told[0]), pa.binary())])
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), hashes], names=["anchor", "doc_id", "text_key", "start", "stop", "hashes"])


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that stand earlier, from rows sorted by (anchor, doc_id, start)."""
    open_anchor, seen, seen_doc, seen_start = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, doc, key, start, stop = (batch.column(k).to_numpy() for k in range(5))
        told = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        packed = batch.column(5).filter(pa.array(~told))
        out = [np.stack([doc[told], key[told], start[told], stop[told]])]
        rows = np.flatnonzero(~told)
        if len(rows):
            n = stop[rows] - start[rows]
            whole = np.frombuffer(b"".join(packed.to_pylist()), np.uint64)
            owner = np.repeat(rows, n)
            place = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            goes_on = open_anchor == anchor[rows[0]]
            if not goes_on:
                seen, seen_doc, seen_start = seen[:0], seen_doc[:0], seen_start[:0]
            every = np.concatenate((seen, whole))
            docs, places = np.concatenate((seen_doc, doc[owner])), np.concatenate((seen_start, place))
            first = _first_of(every)
            later = ((docs[first] != docs) | (places[first] != places))[len(seen) :]
            a, length = _ranges(doc[owner][later], key[owner][later], place[later])
            out.append(np.stack([doc[owner][later][a], key[owner][later][a], place[later][a], place[later][a] + length]))
            open_anchor = anchor[rows[-1]]
            still = np.concatenate((np.full(len(seen), goes_on and anchor[rows[0]] == open_anchor), anchor[owner] == open_anchor)) & (first == np.arange(len(every)))
            seen, seen_doc, seen_start = every[still], docs[still], places[still]
        d, t, a, b = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(a), pa.array(b + WIDTH - 1)], names=["doc_id", "text_key", "start", "stop"])


def _fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, bounds in slices(batch.column("text")):
            raw = data.tobytes()
            split = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [*(batch.column(c).slice(at, to - at) for c in ("doc_id", "text_key")), pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "sha256"])


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text, which tells rows of one doc_id apart) and text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def word_facts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words and the SHA-256 of the words joined by one space."""
    return _slim(docs).mapInArrow(_fact_batches, "doc_id bigint, text_key bigint, n_words bigint, sha256 string")


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        cuts = batch.column("cuts").to_pylist()
        for at, to, data, bounds in slices(texts):
            raw = data.tobytes()
            kept, total, removed = [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                words = raw[a:b].split()
                gone = np.zeros(len(words) + 1, np.int32)
                for cut in cuts[at + i]:
                    gone[min(cut["start"], len(words))] += 1
                    gone[min(cut["stop"], len(words))] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
                total.append(len(words))
                removed.append(int(gone.sum()))
            columns = [*(batch.column(c).slice(at, to - at) for c in ("doc_id", "text_key")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "n_removed", "kept"])


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (a materialized table of distinct ids)."""
    return docs.join(bounded(ids, PICKED_IDS), "doc_id", "left_semi")


class SubstringIndex:
    """The index of a corpus that grows by batches of documents with ever larger doc_ids, in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Manifests(spark, self.root, {"runs": [], "batches": []})

    def _sorted(self, rows: DataFrame) -> DataFrame:
        order = ["anchor", "old", "doc_id"]
        return rows.repartitionByRange(shuffle_partitions(self.spark), *order).sortWithinPartitions(*order)

    def _run(self, rows: DataFrame) -> str:
        """Write rows as a sorted run under a path of its own."""
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        self._sorted(rows).write.parquet(path)
        return path

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*[r["path"] for r in runs])

    def add(self, batch_id: str, batch: DataFrame, history: DataFrame) -> DataFrame | None:
        """Index a batch (doc_id, text); history holds the texts of earlier batches, which are read again only where they are hit.

        Returns (doc_id, text_key, start, stop), ranges of words of the batch's documents that stand
        earlier; None if the batch id is known.
        """
        number, manifest = self.log.latest()
        if batch_id in manifest["batches"]:
            return None
        batch, history = (_slim(d.where("doc_id is not null")) for d in (batch, history))
        runs = manifest["runs"]
        path = self._run(batch.mapInArrow(_anchor_batches, RUN))
        new = self.spark.read.schema(RUN).parquet(path)
        old = might_match(self._read(runs).withColumn("old", F.lit(True)), new, "anchor") if runs else None
        merged = self._sorted(new.unionByName(old) if runs else new)
        hits = materialize(merged.mapInArrow(_merge_batches, RUN + ", hit boolean").where("hit").select("doc_id", "anchor"), "substring-hits")
        asked = hits.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        ids = materialize(hits.select("doc_id").distinct(), "substring-hit-ids")
        texts = picked(batch.unionByName(history) if runs else batch, ids)
        records = texts.join(asked, "doc_id").sortWithinPartitions("doc_id").mapInArrow(
            _record_batches, "anchor bigint, doc_id bigint, text_key bigint, start bigint, stop bigint, hashes binary"
        )
        met = records.repartition(shuffle_partitions(self.spark), "anchor").sortWithinPartitions("anchor", "doc_id", "start")
        found = met.mapInArrow(_settle_batches, "doc_id bigint, text_key bigint, start bigint, stop bigint")
        least = batch.agg(F.min("doc_id")).first()[0]
        ranges = materialize(found.where(F.col("doc_id") >= F.lit(least)), "substring-ranges")
        runs, merged_away = self._compacted([*runs, {"path": path, "level": 0}])
        self.log.publish(number + 1, {"runs": runs, "batches": [*manifest["batches"], batch_id]})
        for r in merged_away:
            self.log.remove(r["path"])
        return ranges

    def _compacted(self, runs: list[dict]) -> tuple[list[dict], list[dict]]:
        """(runs, those merged away): FANOUT runs of one level become one of the next."""
        away: list[dict] = []
        while full := [lv for lv, n in Counter(r["level"] for r in runs).items() if n >= FANOUT]:
            some = [r for r in runs if r["level"] == min(full)]
            runs = [r for r in runs if r not in some] + [{"path": self._run(self._read(some)), "level": min(full) + 1}]
            away += some
        return runs, away


def remove_repeats(docs: DataFrame, root: str, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """Run a corpus through a new index in ``batches`` batches of ascending doc_id.

    Returns (facts, cut): facts has doc_id, text_key, n_words, sha256 and copy (equal to an earlier
    document of WIDTH words or more, so that nothing is left) of every row; cut has doc_id, text_key,
    n_words, n_removed and kept (text) of the other rows that lose words, rows of one doc_id and text
    once. Rows in neither way keep all their words.
    """
    spark = docs.sparkSession
    facts = materialize(word_facts(docs), "substring-facts")
    twins = facts.where(F.col("n_words") >= WIDTH).groupBy("sha256").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    facts = materialize(
        facts.join(twins.drop("n"), "sha256", "left").select("doc_id", "text_key", "n_words", "sha256", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")),
        "substring-copies",
    )
    row = ["doc_id", "text_key"]
    copies = materialize(facts.where("copy").select(*row).distinct(), "substring-gone")
    unique = _slim(docs).join(bounded(copies, PICKED_IDS), row, "left_anti")
    low, high = facts.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = SubstringIndex(spark, root)
    ranges = None
    for k in range(batches if low is not None else 0):
        a, b = (low + (high + 1 - low) * i // batches for i in (k, k + 1))
        if a == b:
            continue
        found = index.add(f"ids {a} to {b}", unique.where(F.col("doc_id").between(a, b - 1)), unique.where(F.col("doc_id") < a))
        ranges = found if ranges is None else ranges.unionByName(found)
    if ranges is None:
        ranges = spark.createDataFrame([], "doc_id bigint, text_key bigint, start bigint, stop bigint")
    cuts = ranges.groupBy(*row).agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))
    ids = materialize(ranges.select("doc_id").distinct(), "substring-cut-ids")
    cut = picked(unique, ids).join(cuts, row).mapInArrow(_cut_batches, "doc_id bigint, text_key bigint, n_words bigint, n_removed bigint, kept string")
    return facts, cut.dropDuplicates(row)
