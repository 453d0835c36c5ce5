"""Operator 7: SentencePiece encoding and decoding by batched numpy Viterbi.

A text gets one space in front and falls into units: a run of spaces with the word behind it, or a
line end. No piece of the vocabulary reaches across the edge of a unit, so units are encoded on
their own; so are the parts of a long unit between neighbouring characters that no piece has side by
side. Units that were not met before are encoded together: those of equal length advance one end
position at a time, every start position's substring hashes are looked up in the sorted hashes of
the pieces, and vectorised maxima keep the best score and the back pointer. Of equal scores the
longer last piece wins, as in the public library's unigram encoder. Parts of over ALONE characters are
looked up by themselves, all positions at once. Characters that are no piece
become their UTF-8 bytes' pieces.

The best path maximises the sum of the scores that the model file holds. A file of another kind
(merge order) is read the same way: its vocabulary, ids and scores, not its merges.

Defined results: a null or empty text has no ids and decodes to an empty text. Decoding gives every
text back exactly, any characters, the piece sign U+2581 itself included (it is encoded as bytes).
Repeated rows each get a row; extra columns pass through ``encode`` where asked for.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, powers, ragged, slices, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units longer than this are cut where no piece can reach across.
LONG = 48
#: Parts longer than this are encoded by themselves, all positions of one at once.
ALONE = 256
#: Units whose ids a worker keeps in memory.
KEPT_UNITS = 100_000
#: Slices of texts after which a worker gives back the memory that it has freed.
TRIM_SLICES = 8
BUCKET_BITS = 18

_NEVER = -1e18


@dataclass
class Pieces:
    """A vocabulary: text pieces by hash, their scores, and the bytes of each id."""

    keys: np.ndarray  # sorted hashes of the text pieces
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray  # id of each byte's piece
    flat: np.ndarray  # bytes of all ids, one after the other
    first: np.ndarray
    size: np.ndarray
    neighbours: frozenset[str]  # pairs of characters that stand side by side in a piece
    units: str  # pattern of the parts of a text that no piece reaches across
    bucket: np.ndarray  # first key of each value of the leading BUCKET_BITS bits
    deepest: int  # most keys of one bucket


def load(path: str = MODEL) -> Pieces:
    """Read a model file on the driver; tasks get the arrays, whose size is that of the vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    texts, byte_ids, spelled = {}, np.zeros(256, np.int32), []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            texts[piece.replace("▁", " ")] = (i, model.get_score(i))
            spelled.append(piece.replace("▁", " ").encode())
    hashes = np.array([_hash(p) for p in texts], np.uint64)
    order = np.argsort(hashes)
    size = np.array([len(b) for b in spelled])
    neighbours = frozenset(p[i : i + 2] for p in texts for i in range(len(p) - 1))
    buckets = np.searchsorted(hashes[order] >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
    return Pieces(
        hashes[order], np.array([i for i, _ in texts.values()], np.int32)[order], np.array([s for _, s in texts.values()])[order], max(map(len, texts)), byte_ids,
        np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size, neighbours, _unit_pattern(neighbours), buckets[:-1], int(np.diff(buckets).max()),
    )


def _unit_pattern(neighbours: frozenset[str]) -> str:
    """Runs of marks (anything but letters) and runs of the rest, each with the spaces before it, and line ends.

    Only marks count that no piece has beside another character than a mark or the space before it.
    """
    marks = {c for c in {*map(chr, range(33, 127)), *chain.from_iterable(neighbours)} if c != "\n" and unicodedata.category(c)[0] not in "LMZ"}
    while out := {c for a, b in neighbours if a != " " and (a in marks) != (b in marks) for c in (a, b) if c in marks}:
        marks -= out
    inside = "".join(map(re.escape, sorted(marks)))
    return rf"\n| *[{inside}]+| *[^ \n{inside}]+| +" if marks else r"\n| *[^ \n]+| +"


def _hash(piece: str) -> np.uint64:
    codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    return mix64(np.array([np.sum(codes * powers(len(codes)))]) ^ np.uint64(len(codes) << 56))[0]


def _look_up(keys: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Place of each key among the sorted keys, -1 where it isn't one: a bucket by the leading bits, then its few keys in turn."""
    at = pieces.bucket[(keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    out = np.full(len(keys), -1, np.int64)
    for step in range(pieces.deepest):
        here = np.minimum(at + step, len(pieces.keys) - 1)
        hit = pieces.keys[here] == keys
        out[hit] = here[hit]
    return out


def viterbi(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units of one length, all at once: (ids of all units, one after the other; how many each has)."""
    length, rows = len(units[0]), len(units)
    codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(rows, length)
    total = np.zeros((length + 1, rows), np.uint64)
    np.cumsum(((codes.astype(np.uint64) + np.uint64(1)) * powers(length)).T, axis=0, out=total[1:])
    back = powers(length, inverse=True)
    best = np.full((length + 1, rows), _NEVER)
    best[0] = 0
    start, chosen = np.zeros((length + 1, rows), np.int32), np.full((length + 1, rows), -1, np.int32)
    for end in range(1, length + 1):
        best[end], start[end] = best[end - 1] - 1e12, end - 1  # any character can stand for itself, at a price
        for begin in range(max(0, end - pieces.longest), end):
            key = mix64((total[end] - total[begin]) * back[begin] ^ np.uint64((end - begin) << 56))
            at = _look_up(key, pieces)
            hit = np.flatnonzero(at >= 0)
            score = best[begin][hit] + pieces.scores[at[hit]]
            better = score > best[end][hit]
            hit = hit[better]
            best[end][hit] = score[better]
            start[end][hit] = begin
            chosen[end][hit] = pieces.ids[at[hit]]
    end, live = np.full(rows, length), np.arange(rows)
    of_row, ids, place = [], [], []
    while len(live):
        begins = start[end[live], live]
        of_row.append(live), ids.append(chosen[end[live], live]), place.append(begins)
        end[live] = begins
        live = live[begins > 0]
    of_row, ids, place = np.concatenate(of_row), np.concatenate(ids), np.concatenate(place)
    order = np.lexsort((place, of_row))
    of_row, ids, place = of_row[order], ids[order], place[order]
    ids, times = _spelled(ids, codes[of_row, place], pieces)
    return ids, np.bincount(of_row, times, minlength=rows).astype(np.int64)


def _spelled(ids: np.ndarray, codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids with the bytes' pieces in place of -1 (no piece has the character ``codes``), and how many ids each became."""
    times, unknown = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = [pieces.byte_ids[list(chr(c).encode())] for c in codes[unknown].tolist()]
        times[unknown] = [len(x) for x in spelled]
        first = np.cumsum(times) - times
        ids = np.repeat(ids, times)
        ids[ragged(first[unknown], times[unknown])] = np.concatenate(spelled)
    return ids.astype(np.int32), times


def viterbi_long(unit: str, pieces: Pieces) -> np.ndarray:
    """Ids of one unit of any length, the same as ``viterbi`` gives.

    All start positions' substrings of one size are looked up at once, so the numpy calls are as many
    as the longest piece has characters; what is left for each position is the choice among its pieces.
    """
    n = len(unit)
    codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    back = powers(n, inverse=True)
    begins, ends, found = [], [], []
    for size in range(1, min(pieces.longest, n) + 1):
        key = mix64((total[size:] - total[:-size]) * back[: n - size + 1] ^ np.uint64(size << 56))
        at = _look_up(key, pieces)
        hit = np.flatnonzero(at >= 0)
        begins.append(hit), ends.append(hit + size), found.append(at[hit])
    begins, ends, found = np.concatenate(begins), np.concatenate(ends), np.concatenate(found)
    order = np.lexsort((begins, ends))  # the longest piece of an end comes first, so it wins a tie
    begins, found = begins[order], found[order]
    first = np.searchsorted(ends[order], np.arange(1, n + 2)).tolist()
    scores, begin_of, id_of = pieces.scores[found].tolist(), begins.tolist(), pieces.ids[found].tolist()
    best, start, chosen = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    for end in range(1, n + 1):
        top, from_, id_ = best[end - 1] - 1e12, end - 1, -1
        for k in range(first[end - 1], first[end]):
            score = best[begin_of[k]] + scores[k]
            if score > top:
                top, from_, id_ = score, begin_of[k], id_of[k]
        best[end], start[end], chosen[end] = top, from_, id_
    ids, place, end = [], [], n
    while end:
        ids.append(chosen[end]), place.append(start[end])
        end = start[end]
    return _spelled(np.array(ids[::-1], np.int32), codes[np.array(place[::-1])], pieces)[0]


class _Numbers(dict):
    """Numbers of units; a unit that is asked for the first time gets the next one and is put on a list."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.fresh.append(unit)
        return number


class Encoder:
    """Encodes texts, keeping the ids of the units it has met."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pattern = re.compile(pieces.units)
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _parts(self, unit: str) -> list[str]:
        pair = self.pieces.neighbours
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pair), len(unit)]
        return [unit[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, fresh: list[str]) -> None:
        """Append the ids of units to what is known, in the order of their numbers."""
        parts = [[u] if len(u) <= LONG else self._parts(u) for u in fresh]
        flat = [p for x in parts for p in x]
        length = np.array([len(p) for p in flat])
        counts, blocks, members = np.zeros(len(flat), np.int64), [], []
        for i in np.flatnonzero(length > ALONE).tolist():
            ids = viterbi_long(flat[i], self.pieces)
            counts[i] = len(ids)
            blocks.append(ids), members.append(np.array([i]))
        for n in np.unique(length[length <= ALONE]).tolist():
            same = np.flatnonzero(length == n)
            step = max(1, (1 << 18) // (n + 1))
            for a in range(0, len(same), step):
                some = same[a : a + step]
                ids, many = viterbi([flat[i] for i in some.tolist()], self.pieces)
                counts[some] = many
                blocks.append(ids), members.append(some)
        members, ids = np.concatenate(members), np.concatenate(blocks)
        begin = np.empty(len(flat), np.int64)  # where each part's ids begin in what Viterbi gave
        begin[members] = np.cumsum(counts[members]) - counts[members]
        self.flat = np.concatenate((self.flat, ids[ragged(begin, counts)]))
        ends = np.cumsum(counts)[np.cumsum([len(x) for x in parts]) - 1]
        self.sizes = np.concatenate((self.sizes, np.diff(ends, prepend=0)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each text has)."""
        if len(self.number) > KEPT_UNITS:
            self._forget()
        split = [self.pattern.findall(" " + t) if t else [] for t in texts]
        used = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        if self.number.fresh:
            self._learn(self.number.fresh)
            self.number.fresh = []
        first = np.cumsum(self.sizes) - self.sizes
        ids = self.flat[ragged(first[used], self.sizes[used])]
        ends = np.concatenate(([0], np.cumsum(self.sizes[used])))
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum([len(u) for u in split])))])


def decode_ids(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> list[bytes]:
    """The UTF-8 texts of consecutive runs of ids."""
    size = pieces.size[ids]
    data = pieces.flat[ragged(pieces.first[ids], size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoder: tuple[object, Encoder] | None = None


def _worker_encoder(model) -> Encoder:  # noqa: ANN001
    """One encoder per Python worker and model."""
    global _encoder
    if _encoder is None or _encoder[0] != model.id:
        _encoder = (model.id, Encoder(model.value))
    return _encoder[1]


class _Model:
    def __init__(self, broadcast, name: str):  # noqa: ANN001
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> Pieces:
        return self.broadcast.value


def _share(df: DataFrame, path: str) -> _Model:
    return _Model(df.sparkSession.sparkContext.broadcast(load(path)), path)


def _trimmed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The slices of texts; memory goes back to the system every TRIM_SLICES, not only once a task is through."""
    for k, part in enumerate(slices(texts), 1):
        yield part
        if k % TRIM_SLICES == 0:
            trim()


def _columns(docs: DataFrame, keep: tuple[str, ...]) -> list[str]:
    return [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep]


def encode(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids (array<int>) of every row's text."""
    model = _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(model)
        for batch in batches:
            text = batch.column("text")
            for at, to, _, _ in _trimmed(text):
                ids, counts = encoder(text.slice(at, to - at).to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in keep), lists], names=[*keep, "ids"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*_columns(docs, keep), "ids array<int>"]))


def decode(encoded: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text of rows with ids."""
    model = _share(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            counts = np.diff(lists.offsets.to_numpy())
            texts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False), counts, model.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([t.decode() for t in texts], pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([*_columns(encoded, keep), "text string"]))


def round_trip(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``keep``, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, exact, and if asked for the ids."""
    model = _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(model)
        is_byte = np.zeros(len(encoder.pieces.size), bool)
        is_byte[encoder.pieces.byte_ids] = True
        for batch in batches:
            text = batch.column("text")
            for at, to, data, bounds in _trimmed(text):
                raw = data.tobytes()
                ids, counts = encoder(text.slice(at, to - at).to_pylist())
                decoded = decode_ids(ids, counts, encoder.pieces)
                ends = np.concatenate(([0], np.cumsum(counts)))
                n_bytes = np.diff(np.concatenate(([0], np.cumsum(is_byte[ids])))[ends])
                exact = [t == raw[a:b] for t, a, b in zip(decoded, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                sha = lambda b: hashlib.sha256(b).hexdigest()
                own = [sha(ids[a:b].astype("<i4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, to - at) for c in keep), pa.array(counts), pa.array(n_bytes), pa.array(own), pa.array([sha(t) for t in decoded]), pa.array(exact), *lists],
                    names=[*keep, "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "exact", *["ids"] * with_ids],
                )
        trim()

    types = "n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*_columns(docs, keep), types]))
