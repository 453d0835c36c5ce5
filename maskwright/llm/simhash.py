"""Operator 5: SimHash near-duplicates through a segment-popcount embedding.

A document's fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 hashes of
the document's word shingles. Two documents link if their fingerprints differ in at most 3 bits.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors never exceeds the number of differing bits, so it is a lower bound. The vector is cut
into GRIDS = 6 sub-grids; a pair at distance 3 or less differs in at most 3 of them and so meets in
one cell of at least one choice of 3 sub-grids. Each distinct fingerprint goes to its 20 cells,
cells are read as sorted runs, pairs in a cell pass the Manhattan bound and then the exact test.
Of a cell only a spanning forest of its links is passed on, never all pairs. A cell with more than
CELL fingerprints is dealt out as pairs of blocks, so that no task holds it whole.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which
links like any other; fewer words than a shingle takes make one shingle. Rows that repeat a doc_id
each get their own row. A null doc_id is never a component_id unless nothing else is in its
component (then component_id is null). Extra columns pass through ``near_dedup``; names beginning
with ``_sim_`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, rejoin, shuffle_partitions, slices
from .components import connected_components

BITS = 3
#: First segment of each sub-grid, and the end: 32 segments of two bits in six sub-grids.
GRIDS = (0, 6, 12, 17, 22, 27, 32)
AGREE = 3
#: Fingerprints of one cell that are compared in one block.
CELL = 4096
_LANES = np.uint64(0x0101010101010101)


def votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes (counts[i] > 0 of them each).

    Bits are summed in byte lanes: 255 hashes at most in one lane sum, then sums of those sums.
    """
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    parts = -(-counts // 255)
    part_first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    starts = np.repeat(first - 255 * part_first, parts) + 255 * np.arange(parts.sum())
    sums = np.empty((len(starts), 8, 8), np.int64)  # part, byte, bit
    for j in range(8):
        lane = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        sums[:, :, j] = lane.view(np.uint8).reshape(-1, 8)
    bits = 2 * np.add.reduceat(sums.reshape(-1, 64), part_first, axis=0) > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def simhashes(texts: list[bytes], shingle: int, at_once: int = 1 << 17) -> np.ndarray:
    """Fingerprints of UTF-8 texts. bytes.lower() and bytes.split() know ASCII only, as the rule does."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    rows, counts, blocks, held = [], [], [], 0

    def flush() -> None:
        if rows:
            out[rows] = votes(np.concatenate(blocks), np.array(counts))
            rows.clear(), counts.clear(), blocks.clear()

    for i, text in enumerate(texts):
        if not text or not (words := text.lower().split()):
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes = np.array([digest(joined, 42)], np.uint64)
        else:
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
            stops = [*ends[shingle - 1 :].tolist(), len(joined)]
            hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
        rows.append(i), counts.append(len(hashes)), blocks.append(hashes)
        held += len(hashes)
        if held >= at_once:
            flush()
            held = 0
    flush()
    return out


def _hash_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [n for n in batch.schema.names if n != "text"]
        for at, to, data, bounds in slices(batch.column("text")):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            fp = simhashes(texts, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(at, to - at) for n in keep), pa.array(fp)], names=[*keep, "fp"])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with fp (the fingerprint as a signed 64-bit number) in place of text."""
    kept = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in docs.columns if n != "text"]
    return docs.mapInArrow(partial(_hash_batches, shingle=shingle), ", ".join([*kept, "fp bigint"]))


def _cell_of(grid: int) -> Column:
    """The cell of a sub-grid: the bit counts of its segments as digits to base 3."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 2 * s).bitwiseAND(F.lit(3))).cast("long") for s in range(GRIDS[grid], GRIDS[grid + 1])]
    cell = counts[0]
    for c in counts[1:]:
        cell = cell * 3 + c
    return cell


def _embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, as bytes: fp (n,) -> (n, 32)."""
    pairs = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return ((pairs[:, None] >> shifts) & np.uint64(3)).astype(np.int8)


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what all links at ``bits`` or fewer differing bits join, in one cell."""
    links, left, spread = [], fp[1:], [fp[0]]
    while len(left) or spread:
        if not spread:
            spread, left = [left[0]], left[1:]
        at = spread.pop()
        if not len(left):
            break
        near = np.flatnonzero(np.bitwise_count(left ^ at) <= 2 * bits) if len(left) > 256 else np.arange(len(left))
        if len(near):  # the Manhattan bound, then the exact test
            near = near[np.abs(_embed(left[near]) - _embed(at[None])).sum(axis=1, dtype=np.int16) <= bits]
            near = near[np.bitwise_count(left[near] ^ at) <= bits]
        if len(near):
            found = left[near]
            links += [(int(at), int(x)) for x in found]
            spread += list(found)
            left = np.delete(left, near)
    return links


def _cell_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of cells, from rows (cell, fp) sorted by both; a cell may go on in the next batch."""
    cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(cell)))
        twos = first[size == 2]
        twos = twos[np.abs(_embed(fp[twos]) - _embed(fp[twos + 1])).sum(axis=1, dtype=np.int16) <= bits] if len(twos) else twos
        twos = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= bits]
        found = list(zip(fp[twos].tolist(), fp[twos + 1].tolist(), strict=True))
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += _forest(np.unique(fp[a : a + n]), bits)
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        cell = np.concatenate((cell, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
        if len(cell):
            whole = int(np.searchsorted(cell, cell[-1]))
            yield links(cell[:whole], fp[:whole])
            cell, fp = cell[whole:], fp[whole:]
    yield links(cell, fp)


def fingerprint_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that join just what all links at ``bits`` join."""
    if bits > AGREE:
        raise ValueError(f"{len(GRIDS) - 1} sub-grids of which {AGREE} must agree find distances up to {AGREE}")
    grids = distinct.select("fp", *[_cell_of(g).alias(f"g{g}") for g in range(len(GRIDS) - 1)])
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"g{g}") for g in chosen]) for k, chosen in enumerate(combinations(range(len(GRIDS) - 1), AGREE))])
    cells = grids.select(F.explode(keys).alias("cell"), "fp")
    large = materialize(cells.groupBy("cell").count().where(F.col("count") > CELL), "sim-large")
    # A large cell's fingerprints fall into blocks, and each pair of blocks is a cell of its own.
    blocks = F.ceil(F.col("count") / (CELL // 2)).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    with_other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.xxhash64("cell", F.least(o, own), F.greatest(o, own)))
    dealt = cells.join(bounded(large), "cell", "left").select(
        F.explode(F.when(F.col("count").isNull(), F.array("cell")).otherwise(with_other)).alias("cell"), "fp"
    )
    dealt = dealt.repartition(shuffle_partitions(distinct.sparkSession), "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(partial(_cell_links, bits=bits), "a bigint, b bigint")


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of every document."""
    prints = materialize(with_fingerprint(docs.select("doc_id", "text"), shingle), "sim-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "sim-distinct")
    component = connected_components(fingerprint_links(distinct.select("fp"), bits), "sim-components")
    grouped = distinct.join(component, distinct.fp == component.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(grouped.join(least, "component").select("fp", "n", "component_id"), "sim-classes")
    return rejoin(prints, classes, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 5, bits: int = BITS) -> DataFrame:
    """docs without those near duplicates that have a smaller doc_id in their group.

    Of rows that share the group's least doc_id all stay: they are one document.
    """
    classes = near_duplicate_classes(docs, shingle, bits)
    gone = bounded(materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_sim_doc")).distinct(), "sim-gone"))
    return docs.join(gone, docs.doc_id == F.col("_sim_doc"), "left_anti")
