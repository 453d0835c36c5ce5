"""Postal addresses from seeds that grow: index, places, streets and premises by a table of markers."""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.lexicon import LOCALITY, PREMISE, STREET, Lexicon

from .structural import COLUMNS, SCHEMA

# ----- fixed values ------------------------------------------------------------------------------
CLUSTER_GAP, EXPAND = 35, 48
_WORDS = {"street": STREET, "premise": PREMISE, "locality": LOCALITY}
# ----- end of the fixed values -------------------------------------------------------------------

_TOKEN = re.compile(r"\d+[а-яА-Я]?(?:/\d+)?|[^\W\d_]+(?:-[^\W\d_]+)*")
SEED = (
    r"(?iU)(?<!\d)\d{6}(?!\d)|а/я|\b(?:" + "|".join(re.escape(w) for w in (*STREET, *PREMISE, *LOCALITY) if len(w) > 2) + r")\b|\b(?:г|ул|д|кв|обл|пер|пр|оф|стр|корп)\.|\b(?:москв|санкт-петербург)"
)


def category(token: str, dotted: bool, before_number: bool) -> str | None:
    """street, premise or locality of a marker; one of one or two letters needs its dot, or a number behind it."""
    low = token.lower()
    for name, words in _WORDS.items():
        if low in words and (len(low) > 2 or dotted or (name == "premise" and before_number)):
            return name
        if dotted and len(low) >= 2 and any(len(w) >= 5 and w.startswith(low) for w in words):
            return name
    return None


def tokens(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind): index, number, street, premise, locality, place, name (a capital) or other."""
    found = list(_TOKEN.finditer(text))
    out = []
    for k, m in enumerate(found):
        dotted = text[m.end() : m.end() + 1] == "."
        nxt = found[k + 1][0] if k + 1 < len(found) else ""
        if m[0][0].isdigit():
            kind = "index" if re.fullmatch(r"\d{6}", m[0]) else "number"
        else:
            kind = category(m[0], dotted, nxt[:1].isdigit()) or ("place" if lex.is_place(m[0]) else "name" if m[0][0].isupper() else "other")
        out.append((m.start(), m.end() + (dotted and kind in _WORDS), kind))
    return out


def strong(kinds: list[str]) -> bool:
    """Enough of an address: a street or place with a premise or number, or an index beside a place."""
    has = set(kinds)
    if "street" in has and has & {"number", "name"}:
        return True
    if "premise" in has and "number" in has and has & {"street", "locality", "place", "name"}:
        return True
    return any(a == "index" and b in ("locality", "place", "street", "name") for a, b in zip(kinds, kinds[1:], strict=False)) and bool(has & {"locality", "place", "street"})


def find_addresses(text: str, lex: Lexicon) -> list[tuple[int, int]]:
    """Spans of addresses: runs of address tokens with short gaps of space, comma, dot or quote, ends trimmed, strong ones only."""
    runs: list[list[tuple[int, int, str]]] = []
    for t in tokens(text, lex):
        between = text[runs[-1][-1][1] : t[0]] if runs and runs[-1] else None
        if t[2] == "other":
            runs.append([])
        elif between is not None and len(between) <= 6 and re.fullmatch(r"[\s,.«»\"()№-]*", between) and "\n" not in between:
            runs[-1].append(t)
        else:
            runs.append([t])
    out = []
    for run in runs:
        first = next((i for i, t in enumerate(run) if t[2] in ("index", "locality", "place", "street")), None)
        if first is None:
            continue
        run = run[first:]
        while run and run[-1][2] == "name" and len(run) > 1 and run[-2][2] in ("number", "premise"):
            run = run[:-1]
        if strong([t[2] for t in run]):
            out.append((run[0][0], run[-1][1]))
    return out


def _frames(frames, lex: Lexicon):  # noqa: ANN001, ANN202
    for frame in frames:
        rows = []
        for doc, seg, text, norm, omap in zip(frame["doc_id"], frame["seg_ord"], frame["text"], frame["norm"], frame["omap"], strict=True):
            for k, (a, b) in enumerate(find_addresses(norm, lex)):
                s, e = (a, b) if omap is None else (int(omap[a]), int(omap[b - 1]) + 1)
                rows.append((doc, seg, 150_000_000 + k, s, e, text[s:e], "ADDRESS", "ner", 1.0, None, None))
        yield pd.DataFrame(rows, columns=COLUMNS)


def detect_addresses(views: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """ADDRESS entities; only segments with a seed go to Python."""
    seeded = views.where(F.col("norm").rlike(SEED)).select("doc_id", "seg_ord", "text", "norm", "omap")
    return seeded.mapInPandas(partial(_frames, lex=lexicon or Lexicon()), SCHEMA)


def clip_to_barriers(addresses: DataFrame, barriers: DataFrame) -> DataFrame:
    """addresses cut back where barriers (doc_id, seg_ord, start, end) overlap their ends; those wholly inside one go."""
    b = barriers.select("doc_id", "seg_ord", F.col("start").alias("bs"), F.col("end").alias("be"))
    hit = addresses.join(b, ["doc_id", "seg_ord"], "left")
    left = F.max(F.when((F.col("bs") <= F.col("start")) & (F.col("be") > F.col("start")), F.col("be")))
    right = F.min(F.when((F.col("bs") > F.col("start")) & (F.col("bs") < F.col("end")), F.col("bs")))
    cut = hit.groupBy(*addresses.columns).agg(left.alias("_l"), right.alias("_r"))
    ends = cut.withColumn("_s", F.coalesce("_l", "start")).withColumn("_e", F.coalesce("_r", "end")).where("_s < _e")
    text = F.substring(F.col("original_text"), F.col("_s") - F.col("start") + 1, F.col("_e") - F.col("_s"))
    trimmed = ends.withColumn("_t", F.rtrim(F.regexp_replace(text, r"[\s,;]+$", ""))).where("_t <> ''")
    return trimmed.select(*[{"start": F.col("_s").alias("start"), "end": (F.col("_s") + F.length("_t")).alias("end"), "original_text": F.col("_t").alias("original_text")}.get(c, F.col(c)) for c in addresses.columns])
