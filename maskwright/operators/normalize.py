"""Detection views: texts made plain for the pattern layer, with a map back to the source.

``with_view`` adds ``norm`` and ``omap`` (norm index -> source index, null where norm is the text
itself). Most texts need nothing; a native test finds those that may, and only they go to Python.

Rules, in this order: format characters go, typographic spaces become plain ones but are remembered
as soft; "()" after something like a digit is a zero; letters that look like digits become digits
inside numbers; separators inside numbers go; numbers broken into many small groups are joined;
Latin letters inside words that also have Cyrillic ones become Cyrillic.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ----- fixed values ------------------------------------------------------------------------------
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "-\u2010\u2011\u2012\u2013\u2212"
DIGIT_LIKE = {"О": "0", "о": "0", "O": "0", "o": "0", "З": "3", "з": "3", "Ч": "4", "ч": "4", "І": "1", "і": "1", "б": "6"}
STRONG_LIKE = "ОЗЧІOб"
LATIN_TO_CYRILLIC = dict(zip("ABCEHKMOPTXYaeocpxykmbht", "АВСЕНКМОРТХУаеосрхукмвнт", strict=True))
LONG_DIGITS, LONG_LENGTH, LONG_REAL, EDGE_LENGTH, SPLIT_GROUPS, SPLIT_DIGITS = 6, 6, 2, 6, 4, 8
# ----- end of the fixed values -------------------------------------------------------------------

_LIKE = "".join(DIGIT_LIKE)
_RUN = re.compile(f"[0-9{_LIKE}]+")
_HY = "\\-" + HYPHENS[1:]  # for use inside a character class
_SEPARATORS = re.compile(f"[ {_HY}]+")
_LINK = re.compile(rf"[ {_HY}]*[.,]?[ {_HY}]*")
_WORD = re.compile(r"[^\W\d_]+")
#: What a text must have, in one place or another, to be changed.
NEEDS_VIEW = "|".join(
    (
        rf"[\p{{Cf}}{SPACES}]",
        r"\(\)",
        rf"[0-9][ .,{_HY}]*[{_LIKE}]",
        rf"[{_LIKE}][ .,{_HY}]*[0-9]",
        rf"[0-9](?: {{2,}}| *[{_HY}][ {_HY}]*)[0-9]",
        r"[0-9](?: [0-9]+){2,} [0-9]",
        r"[A-Za-z]\p{L}*[Ѐ-ӿ]",
        r"[Ѐ-ӿ]\p{L}*[A-Za-z]",
    )
)


def _thousands(groups: list[int]) -> bool:
    return len(groups) >= 2 and groups[0] <= 3 and all(g == 3 for g in groups[1:])


def _real(token: str) -> int:
    return sum(c in "0123456789" for c in token)


class _Line:
    """A text under work: its characters, where each came from, and which were typographic spaces."""

    def __init__(self, text: str):
        self.at = [i for i, c in enumerate(text) if c in SPACES or c in HYPHENS or unicodedata.category(c) != "Cf"]
        self.soft = [text[i] in SPACES for i in self.at]
        self.text = "".join(" " if s else text[i] for i, s in zip(self.at, self.soft, strict=True))

    def keep(self, places: list[int]) -> None:
        self.at, self.soft = [self.at[i] for i in places], [self.soft[i] for i in places]
        self.text = "".join(self.text[i] for i in places)

    def put(self, changes: dict[int, str]) -> None:
        if changes:
            self.text = "".join(changes.get(i, c) for i, c in enumerate(self.text))

    def letter(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.text[i].isalpha()

    def zeros(self) -> None:
        """() becomes 0 where a digit-like character stands before it, spaces aside."""
        before = ""
        places, changes, i = [], {}, 0
        while i < len(self.text):
            pair = self.text[i : i + 2] == "()" and (before.isascii() and before.isdigit() or before in DIGIT_LIKE) and before != ""
            places.append(i)
            if pair:
                changes[i] = "0"
                before = "0"
            elif self.text[i] != " ":
                before = self.text[i]
            i += 2 if pair else 1
        if changes:
            self.put(changes)
            self.keep(places)

    def numbers(self) -> None:
        """Digits for look-alikes in numbers, and separators out of them."""
        tokens = [(m.start(), m.end()) for m in _RUN.finditer(self.text)]

        def joins(a: int, b: int) -> bool:
            token = self.text[a:b]
            short = b - a <= 2 and all(c in STRONG_LIKE for c in token)
            return _real(token) > 0 or (short and not self.letter(a - 1) and not self.letter(b))

        chains: list[list[tuple[int, int]]] = []
        for a, b in tokens:
            if not joins(a, b):
                chains.append([])
            elif chains and chains[-1] and a > chains[-1][-1][1] and _LINK.fullmatch(self.text, chains[-1][-1][1], a):
                chains[-1].append((a, b))
            else:
                chains.append([(a, b)])
        chain_of = {t: c for c in chains for t in c}
        number = [False] * len(self.text)
        changes: dict[int, str] = {}
        for a, b in tokens:
            token, chain = self.text[a:b], chain_of.get((a, b), [])
            real = sum(_real(self.text[x:y]) for x, y in chain)
            long = real >= LONG_DIGITS or (real >= LONG_REAL and sum(y - x for x, y in chain) >= LONG_LENGTH)
            if not (_real(token) or long):
                continue
            number[a:b] = [True] * (b - a)
            if _real(token) < 2 and not long:
                continue
            for i in range(a, b):
                edge = self.text[i] == "б" and i in (a, b - 1)
                safe = b - a >= EDGE_LENGTH or (long and i < chain[-1][1] - 1) or (long and i == chain[0][0])
                if self.text[i] in DIGIT_LIKE and (not edge or safe):
                    changes[i] = DIGIT_LIKE[self.text[i]]
        like = [c in DIGIT_LIKE or c in "0123456789" for c in self.text]
        drop = set()
        for m in _SEPARATORS.finditer(self.text):
            a, b = m.span()
            soft = any(self.soft[a:b])
            left, right = a > 0 and number[a - 1], b < len(self.text) and number[b]
            if left and right and (soft or b - a >= 2 or any(c in HYPHENS for c in m[0])):
                drop.update(range(a, b))
            elif soft and ((a > 0 and like[a - 1]) or (b < len(self.text) and like[b])) and not self.letter(a - 1) and not self.letter(b):
                drop.update(i for i in range(a, b) if self.soft[i])
        drop |= self._split_groups(drop, like)
        self.put(changes)
        if drop:
            self.keep([i for i in range(len(self.text)) if i not in drop])

    def _split_groups(self, gone: set[int], like: list[bool]) -> set[int]:
        """The spaces in numbers of four groups and eight digits or more that aren't thousands."""
        alive = [i for i in range(len(self.text)) if i not in gone]
        runs: list[list[int]] = []
        for k, i in enumerate(alive):
            if not like[i]:
                continue
            if k and runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        fits = lambda r: _real("".join(self.text[alive[k]] for k in r)) and not self.letter(alive[r[0]] - 1) and not self.letter(alive[r[-1]] + 1)
        out: set[int] = set()
        rows: list[list[list[int]]] = []
        for r in runs:
            if not fits(r):
                rows.append([])
            elif rows and rows[-1] and r[0] - rows[-1][-1][-1] == 2 and self.text[alive[r[0] - 1]] == " " and not self.soft[alive[r[0] - 1]]:
                rows[-1].append(r)
            else:
                rows.append([r])
        for row in rows:
            sizes = [len(r) for r in row]
            if len(row) >= SPLIT_GROUPS and sum(sizes) >= SPLIT_DIGITS and not _thousands(sizes):
                out.update(alive[r[0] - 1] for r in row[1:])
        return out

    def words(self) -> None:
        """One alphabet in words that mix Cyrillic with Latin look-alikes."""
        changes = {}
        for m in _WORD.finditer(self.text):
            if any("Ѐ" <= c <= "ӿ" for c in m[0]):
                changes.update({m.start() + k: LATIN_TO_CYRILLIC[c] for k, c in enumerate(m[0]) if c in LATIN_TO_CYRILLIC})
        self.put(changes)


def normalize(text: str) -> tuple[str, list[int]]:
    """(norm, map): each character of norm comes from one of text, in order."""
    line = _Line(text)
    line.zeros()
    line.numbers()
    line.words()
    return line.text, line.at


def _view_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [normalize(t) for t in batch.column("_base").to_pylist()]
        columns = [*batch.columns[:-1], pa.array([n for n, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "norm", "omap"])


def with_view(segments: DataFrame, base: str = "text") -> DataFrame:
    """segments with norm and omap of the column ``base`` (null counts as empty)."""
    plain = F.coalesce(F.col(base), F.lit(""))
    needs = plain.rlike(NEEDS_VIEW)
    same = segments.where(~needs).withColumn("norm", plain).withColumn("omap", F.lit(None).cast("array<int>"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema]
    changed = segments.where(needs).withColumn("_base", plain).mapInArrow(_view_batches, ", ".join([*kept, "norm string", "omap array<int>"]))
    return same.unionByName(changed)


def source_start(start: Column, omap: Column = None) -> Column:
    """Source index of a norm index."""
    omap = F.col("omap") if omap is None else omap
    return F.when(omap.isNull(), start).otherwise(F.element_at(omap, start + 1))


def source_end(end: Column, omap: Column = None) -> Column:
    """Source end of a norm end (exclusive)."""
    omap = F.col("omap") if omap is None else omap
    return F.when(omap.isNull(), end).otherwise(F.element_at(omap, end) + 1)


def view_place(omap: Column, place: Column) -> Column:
    """Norm index of a source index: the first kept character at or behind it."""
    return F.when(omap.isNull(), place).otherwise(F.size(F.filter(omap, lambda x: x < place)))
