"""People and organisations by structure, and the barriers that keep roles and groups open.

A document is one group: what is learned from an anchored mention (a quoted name behind a legal form,
a full name) is looked for in all its segments, so references share one token (``group_key``). All
word knowledge comes from a Lexicon.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.lexicon import COLLECTIVE_WORDS, ORG_FORMS, ROLE_WORDS, Lexicon
from maskwright.plans.groups import dealt, in_batches, whole_groups

SCHEMA = "doc_id bigint, seg_ord int, ent_seq bigint, start int, end int, original_text string, entity_type string, detector string, confidence double, group_key string, canonical string"
COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])

_FORM = r"\b(?:" + "|".join(sorted(map(re.escape, ORG_FORMS), key=len, reverse=True)) + r")\b"
_QUOTED = r"«([^«»\n]{1,60})»|“([^“”\n]{1,60})”|„([^„“”\n]{1,60})[“”]|\"([^\"\n]{1,60})\""
_ORG = re.compile(rf"(?i:({_FORM}))[^.!?\n;,«“„\"]{{0,45}}(?:{_QUOTED})")
_PLAIN_ORG = re.compile(rf"(?i:({_FORM}))\s+((?:[А-ЯЁA-Z][\w-]+)(?:\s+[А-ЯЁA-Z][\w-]+){{0,2}})")
_ALIAS = re.compile(rf"(?i:именуем\w*|далее|в\s+дальнейшем)[^\n«“„\"]{{0,40}}(?:{_QUOTED})")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_INITIALS = r"[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.)?"
_SHORT_NAME = re.compile(rf"\b([А-ЯЁ][а-яё-]{{2,}})\s+({_INITIALS})|({_INITIALS})\s?([А-ЯЁ][а-яё-]{{2,}})\b")
_PERSON_MARK = re.compile(r"(?i)\b(?:гражданин\w*|гражданк\w*|господин\w*|директор\w*|в\s+лице|представител\w*|ип)\s+$")


def _inside(m: re.Match, first: int) -> tuple[int, int]:
    return next(m.span(g) for g in range(first, first + 4) if m.group(g) is not None)


def find_organisations(text: str, lex: Lexicon) -> list[tuple[int, int, str, str, float]]:
    """(start, end, key, canonical, strength) of anchored organisations; the span is the form and the quoted name, or the form and a name run."""
    out = []
    for m in _ORG.finditer(text):
        a, b = _inside(m, 2)
        words = _WORD.findall(text[a:b])
        if words and words[0].lower() not in ROLE_WORDS and not re.match(r"\s*(?:означа|понима)", text[m.end() :]):
            out.append((m.start(1), m.end(), " ".join(map(lex.lemma, words)), text[a:b], 3.0))
    taken = [(a, b) for a, b, *_ in out]
    for m in _PLAIN_ORG.finditer(text):
        words = _WORD.findall(m[2])
        if m[1].lower() in ("ип", "индивидуальный предприниматель") or any(a < m.end() and m.start() < b for a, b in taken):
            continue
        if words[0].lower() not in COLLECTIVE_WORDS and words[0].lower() not in ROLE_WORDS:
            out.append((m.start(1), m.end(), " ".join(map(lex.lemma, words)), m[2], 2.0))
    return out


def find_people(text: str, lex: Lexicon) -> list[tuple[int, int, tuple[str, ...], str, float]]:
    """(start, end, parts, canonical, strength): name runs with two name roles or more, surname with initials, or a marked surname. parts: surname, name, patronymic lemmas or initials."""
    out = []
    for m in _SHORT_NAME.finditer(text):
        surname, initials = (m[1], m[2]) if m[1] else (m[4], m[3])
        if "surn" in lex.roles(surname) or not lex.roles(surname):
            letters = re.findall(r"[А-ЯЁ]", initials)
            out.append((m.start(), m.end(), (lex.lemma(surname), *letters), f"{surname} {'.'.join(letters)}.", 2.0))
    taken = [(a, b) for a, b, *_ in out]
    words = list(_WORD.finditer(text))
    k = 0
    while k < len(words):
        if words[k][0].isupper() and 1 < len(words[k][0]) <= 3:  # a legal form or another abbreviation
            k += 1
            continue
        run = [words[k]]
        while len(run) < 4 and k + len(run) < len(words) and re.fullmatch(r"[ \t]+", text[run[-1].end() : words[k + len(run)].start()] or "x"):
            run.append(words[k + len(run)])
        run = run[: next((i for i, w in enumerate(run) if not w[0][0].isupper()), len(run))]
        roles = [lex.roles(w[0]) for w in run]
        while run and not roles[-1]:
            run, roles = run[:-1], roles[:-1]
        own = {x for r in roles for x in r}
        size = min(len(run), 3)
        if size >= 2 and ({"name", "patr"} <= own or {"name", "surn"} <= own):
            a, b = run[0].start(), run[size - 1].end()
            if not any(x < b and a < y for x, y in taken):
                pick = lambda role: next((w[0] for w, r in zip(run[:size], roles, strict=False) if role in r), None)  # noqa: E731, B023
                parts = [pick("patr"), pick("name")]
                surname = next((w[0] for w, r in zip(run[:size], roles, strict=False) if w[0] not in parts), None)
                named = [x for x in (surname, parts[1], parts[0]) if x]
                out.append((a, b, tuple(lex.lemma(x) for x in named), " ".join(named), 3.0))
                taken.append((a, b))
            k += size
        elif run and "surn" in roles[0] and _PERSON_MARK.search(text[: run[0].start()]):
            a, b = run[0].span()
            if not any(x < b and a < y for x, y in taken):
                out.append((a, b, (lex.lemma(run[0][0]),), run[0][0], 1.0))
            k += 1
        else:
            k += 1
    return out


class Book:
    """The people of one document: mentions that don't contradict each other are one person."""

    def __init__(self) -> None:
        self.people: list[list[str]] = []

    @staticmethod
    def fits(known: list[str], parts: tuple[str, ...]) -> bool:
        same = lambda x, y: x == y or (min(len(x), len(y)) == 1 and x[0].lower() == y[0].lower())
        return all(same(x, y) for x, y in zip(known, parts, strict=False))

    def number(self, parts: tuple[str, ...]) -> int:
        fitting = [i for i, p in enumerate(self.people) if p[0] == parts[0] and self.fits(p, parts)]
        if len(fitting) > 1:  # one shared person for what could be several
            marker = [parts[0], "?"]
            if marker not in self.people:
                self.people.append(marker)
            return self.people.index(marker)
        if not fitting:
            self.people.append(list(parts))
            return len(self.people) - 1
        known = self.people[fitting[0]]
        for i, x in enumerate(parts):
            if i >= len(known):
                known.append(x)
            elif len(x) > len(known[i]):
                known[i] = x
        return fitting[0]


def _document(frame: list[dict], lex: Lexicon) -> list[dict]:
    """The entities of one document; its segments come in order."""
    segments = [(r["seg_ord"], r["norm"], r["text"], r["omap"]) for r in frame]
    doc, source_of = frame[0]["doc_id"], {r["seg_ord"]: r["text"] for r in frame}
    rows: list[tuple] = []
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def emit(seg: int, text: str, omap, a: int, b: int, kind: str, strength: float, group: str | None, canonical: str | None) -> None:  # noqa: ANN001
        while b > a and text[b - 1].isspace():
            b -= 1
        if any(x < b and a < y for x, y in taken[seg]):
            return
        taken[seg].append((a, b))
        s, e = (a, b) if omap is None else (int(omap[a]), int(omap[b - 1]) + 1)
        rows.append((doc, seg, 200_000_000 + len(rows), s, e, source_of[seg][s:e], kind, "ner", 1.0, group, canonical))

    orgs: dict[str, tuple[float, str]] = {}
    for seg, norm, _, omap in segments:
        for a, b, key, canonical, strength in find_organisations(norm, lex):
            if strength > orgs.get(key, (0.0, ""))[0]:
                orgs[key] = (strength, canonical)
            emit(seg, norm, omap, a, b, "ORG", strength, f"org:{key}", canonical)
    book, names = Book(), []
    for seg, norm, _, omap in segments:
        for a, b, parts, canonical, strength in find_people(norm, lex):
            n = book.number(parts)
            names.append((n, parts, canonical))
            emit(seg, norm, omap, a, b, "PERSON", strength, f"per:{n}", canonical)
    # Second pass: bare mentions of what the first one learned, in any case form, capital first.
    surnames = {p[0]: i for i, p in enumerate(book.people) if len(p) > 1}
    by_first = defaultdict(list)
    for key, (strength, canonical) in orgs.items():
        by_first[key.split(" ")[0]].append((key.split(" "), strength, canonical))
    for seg, norm, _, omap in segments:
        words = list(_WORD.finditer(norm))
        lemmas = [lex.lemma(w[0]) for w in words]
        for i, w in enumerate(words):
            if not w[0][0].isupper():
                continue
            for key, strength, canonical in by_first.get(lemmas[i], ()):
                if lemmas[i : i + len(key)] == key and (strength >= 3.0 or len(key) > 1):
                    emit(seg, norm, omap, w.start(), words[i + len(key) - 1].end(), "ORG", 1.0, "org:" + " ".join(key), canonical)
            if lemmas[i] in surnames:
                emit(seg, norm, omap, w.start(), w.end(), "PERSON", 1.0, f"per:{surnames[lemmas[i]]}", None)
    return [dict(zip(COLUMNS, r, strict=True)) for r in rows]


def _documents(batches: Iterator[pa.RecordBatch], lex: Lexicon, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    return in_batches((_document(rows, lex) for rows in whole_groups(batches, ("doc_id",))), schema)


def detect_structural(views: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """ORG and PERSON entities of views (doc_id, seg_ord, text, norm, omap), document by document.

    Python sees only documents with a legal form or a capital Cyrillic letter before a small one or a
    dot: without one nothing is learned, so there is nothing to look for. A task takes its documents
    one after the other from a sorted partition.
    """
    slim = dealt(views.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("seg_ord").cast("int").alias("seg_ord"), "text", "norm", "omap"), "doc_id")
    document = Window.partitionBy("doc_id").orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    may = slim.withColumn("_may", F.max(F.col("norm").rlike(rf"[А-ЯЁ](?:[а-яё]|\.)|(?iu){_FORM}")).over(document)).where("_may").drop("_may")
    read = partial(_documents, lex=lexicon or Lexicon(), schema=_ARROW)
    return may.sortWithinPartitions("doc_id", "seg_ord").mapInArrow(read, SCHEMA)


def _barriers(frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for doc, seg, text, norm, omap in zip(frame["doc_id"], frame["seg_ord"], frame["text"], frame["norm"], frame["omap"], strict=True):
        spans = []
        for m in _ALIAS.finditer(norm):
            a, b = _inside(m, 1)
            if not re.search(_FORM, norm[a:b].lower()):
                spans.append((a, b, "ROLE_TERM"))
        for m in re.finditer(rf"(?i:{_FORM})\s+(?i:({'|'.join(COLLECTIVE_WORDS)}))\b", norm):
            spans.append((m.start(), m.end(), "COLLECTIVE"))
        for k, (a, b, kind) in enumerate(spans):
            s, e = (a, b) if omap is None else (int(omap[a]), int(omap[b - 1]) + 1)
            rows.append((doc, seg, 800_000_000 + k, s, e, text[s:e], kind, "ner", 1.0, None, None))
    return pd.DataFrame(rows, columns=COLUMNS)


def detect_barriers(views: DataFrame) -> DataFrame:
    """ROLE_TERM (a quoted alias behind "named" or "hereinafter") and COLLECTIVE (a form before a plural) entities."""
    slim = views.select("doc_id", "seg_ord", "text", "norm", "omap").where(F.col("norm").rlike(rf"(?iu)именуем|далее|дальнейшем|{_FORM}"))
    return slim.mapInPandas(lambda frames: map(_barriers, frames), SCHEMA)


def suppress_inside_organisations(entities: DataFrame) -> DataFrame:
    """entities without ADDRESS and PERSON values that lie inside an ORG and have no word that it lacks."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))
    orgs = entities.where("entity_type = 'ORG'").select("doc_id", "seg_ord", F.col("start").alias("os"), F.col("end").alias("oe"), words(F.col("original_text")).alias("ow"))
    inside = (entities.doc_id == orgs.doc_id) & (entities.seg_ord == orgs.seg_ord) & (orgs.os <= entities.start) & (entities.end <= orgs.oe)
    subset = F.size(F.array_except(words(entities.original_text), orgs.ow)) == 0
    return entities.join(orgs, inside & entities.entity_type.isin("ADDRESS", "PERSON") & subset, "left_anti")


def merge_compounds(entities: DataFrame, segments: DataFrame, most_gap: int = 3) -> DataFrame:
    """A sole trader's form directly before a person, up to ``most_gap`` characters apart, makes one ORG of both.

    entities as from ``resolve.as_entities``; the person stays in ``shadowed``, so a profile that masks
    people but no organisations gets the name back.
    """
    form = rf"(?iu)(?<![\p{{L}}\d])(?:ип|индивидуальн(?:ый|ого|ому|ым|ом)\s+предпринимател(?:ь|я|ю|ем|е))[\s«\"]{{1,{most_gap}}}$"
    people = entities.where("entity_type = 'PERSON'").join(segments.select("doc_id", "seg_ord", F.col("text").alias("_text")), ["doc_id", "seg_ord"])
    lead = F.regexp_extract(F.substring(F.col("_text"), F.lit(1), F.col("start")), form, 0)
    met = people.withColumn("_lead", lead).where("_lead <> ''")
    shadow = F.array(F.struct("start", "end", "original_text", "entity_type", "detector", "confidence", "group_key", "canonical"))
    start = F.col("start") - F.length("_lead")
    merged = met.select(
        "doc_id", "seg_ord", "ent_seq", start.cast("int").alias("start"), "end", F.substring(F.col("_text"), start + 1, F.col("end") - start).alias("original_text"), F.lit("ORG").alias("entity_type"), "detector", "confidence",
        F.concat(F.lit("org:"), F.coalesce("group_key", F.lower("original_text"))).alias("group_key"), "canonical", shadow.alias("shadowed"),
    )
    rest = entities.join(met.select("doc_id", "seg_ord", "ent_seq"), ["doc_id", "seg_ord", "ent_seq"], "left_anti")
    return rest.withColumn("shadowed", F.lit(None).cast(merged.schema["shadowed"].dataType)).unionByName(merged, allowMissingColumns=True)
