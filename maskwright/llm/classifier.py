"""Operator 9: a quality classifier, a factorisation machine over hashed words and structure.

The score of a document with features x is sigmoid(b + w.x + sum over pairs of <v_i, v_j> x_i x_j).
With the sum-of-squares identity the pairs cost one pass over the non-zero features:
sum over pairs = 1/2 * sum over factors of ((sum v x)^2 - sum (v x)^2).

Features: words (ASCII letters lower-cased) hashed into 2**WORD_BITS slots, with weight
sqrt(count) scaled so that their squares sum to one; figures of the text's structure (lengths,
shares of symbols, capitals, digits and punctuation, repeated words, lines and windows); and the
text's size as metadata. Labels, lang, source and doc_id never enter.

It is fitted on a bounded sample of labelled rows (``sample_rows``, those of the least hash of
doc_id), by AdaGrad on the driver; scoring runs over all rows in Arrow batches. The model has a fixed
size whatever the input.

Defined results: a null text counts as empty; empty texts get the score of their structure figures.
A doc_id labelled twice counts with its larger label; null labels are ignored. Without any labelled
rows every score is 0.5. A null doc_id isn't held out. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, bounded, mix64, rolling, slices

WORD_BITS, FACTORS = 16, 8
STRUCTURE = ("log_words", "log_bytes", "word_bytes", "symbols", "capitals", "digits", "stops", "commas", "distinct", "same_as_last", "repeats", "line_words", "high_bytes")
SIZE = (1 << WORD_BITS) + len(STRUCTURE)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _members(*codes: int) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(codes)] = True
    return found


_KINDS = {
    "symbols": _members(*b"#*$%&|<>!@^~_=+{}[]\\/"),
    "capitals": _members(*range(0x41, 0x5B)),
    "digits": _members(*range(0x30, 0x3A)),
    "stops": _members(*b".?"),
    "commas": _members(*b",;:"),
    "high_bytes": _members(*range(0xC0, 0x100)),
}
_NEWLINE = _members(10)


@dataclass
class Features:
    """Rows of sparse features: indices and values of row i at first[i] .. first[i + 1]."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray) -> Features:
    """Features of each text of a slice."""
    rows = len(bounds) - 1
    words = Words(data, bounds)
    words.data = _LOWER[data]
    hashes, n = words.hashes(), words.counts
    doc = np.repeat(np.arange(rows), n)
    slot = (doc.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS))
    slot, count = np.unique(slot, return_counts=True)
    owner = (slot >> np.uint64(WORD_BITS)).astype(np.int64)
    weight = np.sqrt(count / np.maximum(n, 1)[owner])

    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
    length, size = np.maximum(n, 1), np.diff(bounds)
    kinds = {k: per(t[data]) / length for k, t in _KINDS.items()}
    last = np.zeros(len(hashes), bool)
    last[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    windows = rolling(hashes, 3)
    repeats = np.zeros(rows)
    if len(windows):
        where = np.flatnonzero(doc[: len(windows)] == doc[2:])
        keys = windows[where] ^ mix64(doc[where].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
        repeats = np.bincount(doc[where[order[again]]], minlength=rows) / length
    figures = {
        "log_words": np.log1p(n) / 8, "log_bytes": np.log1p(size) / 10, "word_bytes": np.bincount(doc, words.end - words.start, minlength=rows) / length / 10,
        "distinct": np.bincount(owner, minlength=rows) / length, "same_as_last": np.bincount(doc[last], minlength=rows) / length,
        "repeats": repeats, "line_words": np.log1p(n / (per(_NEWLINE[data]) + 1)) / 5,
    } | kinds
    dense = np.clip(np.stack([figures[k] for k in STRUCTURE], axis=1), 0, 3)
    k = len(STRUCTURE)
    per_row = np.bincount(owner, minlength=rows)
    first = np.concatenate(([0], np.cumsum(per_row + k)))
    index, value = np.empty(first[-1], np.int32), np.empty(first[-1], np.float32)
    at = np.arange(len(slot)) + k * owner  # words stand before the figures of their row
    index[at], value[at] = (slot & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32), weight
    at = (first[1:] - k)[:, None] + np.arange(k)
    index[at], value[at] = (1 << WORD_BITS) + np.arange(k), dense
    return Features(first, index, value)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, x: Features) -> np.ndarray:
        """Scores before the sigmoid; every row has features."""
        starts = x.first[:-1]
        out = self.bias + np.add.reduceat(self.w[x.index] * x.value, starts)
        for f in range(self.v.shape[1]):
            part = self.v[x.index, f] * x.value
            out = out + 0.5 * (np.add.reduceat(part, starts) ** 2 - np.add.reduceat(part * part, starts))
        return out

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30).astype(np.float64)))


def fit(rows: list[Features], labels: np.ndarray, steps: int = 750, batch: int = 64, rate: float = 0.1, ridge: float = 1e-4, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss, about ``steps`` steps however many rows there are; rows: one Features of a single row each."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    if not len(rows):
        return Machine(0.0, machine.w, np.zeros_like(machine.v))
    gw, gv, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(-(-steps * batch // max(len(rows), batch))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            sizes = np.array([len(rows[i].index) for i in some])
            x = Features(np.concatenate(([0], np.cumsum(sizes))), np.concatenate([rows[i].index for i in some]), np.concatenate([rows[i].value for i in some]))
            error = (machine.scores(x) - labels[some]).astype(np.float32) / len(some)
            of_row = np.repeat(np.arange(len(some)), sizes)
            vx = machine.v[x.index] * x.value[:, None]
            sums = np.add.reduceat(vx, x.first[:-1], axis=0)
            used, back = np.unique(x.index, return_inverse=True)
            pull = error[of_row] * x.value
            step = np.bincount(back, pull, minlength=len(used)).astype(np.float32) + ridge * machine.w[used]
            gw[used] += step * step
            machine.w[used] -= rate * step / np.sqrt(gw[used])
            for f in range(FACTORS):
                step = np.bincount(back, pull * (sums[of_row, f] - vx[:, f]), minlength=len(used)).astype(np.float32) + ridge * machine.v[used, f]
                gv[used, f] += step * step
                machine.v[used, f] -= 0.3 * rate * step / np.sqrt(gv[used, f])
            step = float(error.sum())
            gb += step * step
            machine.bias -= rate * step / gb**0.5
    return machine


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, bounds in slices(batch.column("text")):
            x = features(data, bounds)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(x.first.astype(np.int32)), pa.array(v))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, to - at), lists(x.index), lists(x.value)], names=["label", "index", "value"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> Machine:
    """A machine fitted on labels (doc_id, label) that aren't held out, ``sample_rows`` of them at most."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(bounded(sample), "doc_id").select("label", "text")
    table = chosen.mapInArrow(_feature_batches, "label int, index array<int>, value array<float>").toArrow()
    if not table.num_rows:
        return fit([], np.zeros(0))
    table = table.combine_chunks()
    index, value = table.column("index").combine_chunks(), table.column("value").combine_chunks()
    ends = index.offsets.to_numpy()
    index, value = index.values.to_numpy(), value.values.to_numpy()
    rows = [Features(np.array([0, b - a]), index[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    label = table.column("label").to_numpy()
    # Tasks return in any order; the fit must not depend on it.
    order = sorted(range(len(rows)), key=lambda i: (int(label[i]), rows[i].index.tobytes(), rows[i].value.tobytes()))
    return fit([rows[i] for i in order], label[order].astype(np.float32))


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score (0 to 1) of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, to, data, bounds in slices(batch.column("text"), SLICE_BYTES):
                out[at:to] = model.value.scores(features(data, bounds))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])

    kept = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep]
    return docs.select(*keep, "text").mapInArrow(score_batches, ", ".join([*kept, "score double"]))
