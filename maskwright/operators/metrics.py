"""Quality of a run: gold values against masks, as joins and aggregates on intervals.

gold: doc_id, start, end, type, text. masks: doc_id, start, end, type. Coordinates are those of the
document. Every join is on doc_id with a test on the intervals, and every union of intervals is an
island found by a running maximum of ends, so nothing is compared pair by pair outside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.binding import once
from maskwright.functions.folds import NUMERIC, digit_core, digit_runs, plain_letters, value_key, words

#: Lengths from which open digits count, and the share of a number that a window must make up.
STRICT, SOFT, RUN_SHARE = 8, 6, 0.8
SEAM_CHARACTERS = "\n |\t\r"


def islands(spans: DataFrame, by: tuple[str, ...] = ("doc_id",), most_gap: int = 0) -> DataFrame:
    """by, start, end of the unions of spans; spans at most ``most_gap`` apart belong together."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") - reach <= most_gap, 0).otherwise(1)
    numbered = spans.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def shared(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def covered_chars(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """gold with covered, the characters that the union of spans covers."""
    key = ["doc_id", "start", "end", "type"]
    union = islands(spans.select("doc_id", "start", "end")).select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = gold.select(*key).distinct().join(union, "doc_id").where(F.greatest("start", "_s") < F.least("end", "_e"))
    sums = hit.groupBy(*key).agg(F.sum(shared(F.col("start"), F.col("end"), F.col("_s"), F.col("_e"))).alias("covered"))
    return gold.join(sums, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def uncovered_chars(gold: DataFrame, spans: DataFrame) -> DataFrame:
    return covered_chars(gold, spans).withColumn("uncovered", F.col("end") - F.col("start") - F.col("covered"))


def seam_gaps(segments: DataFrame) -> DataFrame:
    """(doc_id, start, end): what no segment covers between the first and the last (segments: doc_id, start, end)."""
    union = islands(segments)
    order = Window.partitionBy("doc_id").orderBy("start")
    return union.select("doc_id", F.col("end").alias("start"), F.lead("start").over(order).alias("end")).where("end is not null")


def best_gold(masks: DataFrame, gold: DataFrame, same_type: bool = False) -> DataFrame:
    """masks with the gold value they share most with (g_start, g_end, g_type; null: none). Of equals the first, then the last by type."""
    g = gold.select("doc_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("type").alias("g_type"))
    key = ["doc_id", "start", "end", "type"]
    met = masks.select(*key).distinct().join(g, "doc_id").where(F.greatest("start", "g_start") < F.least("end", "g_end"))
    if same_type:
        met = met.where(F.col("type") == F.col("g_type"))
    rank = F.struct(shared(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end")), -F.col("g_start"), -F.col("g_end"), "g_type")
    best = met.groupBy(*key).agg(F.max_by(F.struct("g_start", "g_end", "g_type"), rank).alias("g"))
    return masks.join(best, key, "left").select(*masks.columns, "g.*")


def masking_abc(masks: DataFrame, gold: DataFrame) -> DataFrame:
    """masks (with a_ok, a_channel_ok) with scored, b_ok (the gold value is covered by all masks together) and c_ok (types agree)."""
    paired = best_gold(masks, gold)
    closed = covered_chars(gold, masks).select("doc_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("type").alias("g_type"), (F.col("covered") == F.col("end") - F.col("start")).alias("b_ok")).distinct()
    joined = paired.join(closed, ["doc_id", "g_start", "g_end", "g_type"], "left")
    return joined.withColumn("scored", F.col("g_type").isNotNull()).withColumn("c_ok", F.col("type") == F.col("g_type"))


def _percent(part: Column, whole: Column, empty: float | None = None) -> Column:
    rate = 100.0 * part / F.nullif(whole, F.lit(0))
    return rate if empty is None else F.coalesce(rate, F.lit(empty))


def masking_rates(scored: DataFrame) -> DataFrame:
    """type (null: all), n_masks, n_scored, a, b, c in percent; 100 where there is nothing."""
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    sums = scored.rollup("type").agg(F.count(F.lit(1)).alias("n_masks"), one("a_ok").alias("a_n"), one("scored").alias("n_scored"), one("b_ok").alias("b_n"), one("c_ok").alias("c_n"))
    return sums.select(
        "type", "n_masks", "n_scored", _percent(F.col("a_n"), F.col("n_masks"), 100.0).alias("a"), _percent(F.col("b_n"), F.col("n_scored"), 100.0).alias("b"), _percent(F.col("c_n"), F.col("n_scored"), 100.0).alias("c")
    )


def boundaries(gold: DataFrame, masks: DataFrame, seams: DataFrame | None = None) -> DataFrame:
    """gold with under (open characters), over (characters of its own masks outside) and direction: not_found, exact, longer, shorter or both."""
    spans = masks.select("doc_id", "start", "end")
    under = uncovered_chars(gold, spans if seams is None else spans.unionByName(seams.select("doc_id", "start", "end"))).withColumnRenamed("uncovered", "under")
    own = best_gold(masks, gold, same_type=True).where("g_type is not null")
    outside = F.greatest(F.lit(0), F.least("end", "g_start") - F.col("start")) + F.greatest(F.lit(0), F.col("end") - F.greatest("start", "g_end"))
    over = own.groupBy("doc_id", F.col("g_start").alias("start"), F.col("g_end").alias("end"), F.col("g_type").alias("type")).agg(F.sum(outside).alias("over"))
    joined = under.join(over, ["doc_id", "start", "end", "type"], "left")
    direction = (
        F.when(F.col("over").isNull(), "not_found").when((F.col("under") == 0) & (F.col("over") == 0), "exact").when(F.col("under") == 0, "longer").when(F.col("over") == 0, "shorter").otherwise("both")
    )
    return joined.withColumn("direction", direction).withColumn("over", F.coalesce("over", F.lit(0))).drop("covered")


def boundary_summary(bounds: DataFrame) -> DataFrame:
    """Per type and in all (type null): counts by direction and open or surplus characters of each class."""
    is_ = lambda *d: F.col("direction").isin(*d)
    n = lambda *d: F.sum(is_(*d).cast("long"))
    chars = lambda c, *d: F.coalesce(F.sum(F.when(is_(*d), F.col(c))), F.lit(0))
    return bounds.rollup("type").agg(
        F.count(F.lit(1)).alias("n"), n("exact").alias("exact"), n("shorter", "both").alias("shorter"), n("longer", "both").alias("longer"), n("not_found").alias("not_found"),
        chars("under", "shorter", "both").alias("under_chars"), chars("over", "longer", "both").alias("over_chars"), chars("under", "not_found").alias("not_found_chars"),
    )


def precision_by_type(masks: DataFrame, gold: DataFrame, negatives: DataFrame) -> DataFrame:
    """Per mask type: tp, fp_neg (on a declared negative), cross (on a gold value of another type), nothing, and precision (null without decisions)."""
    paired = best_gold(masks, gold)
    key = ["doc_id", "start", "end", "type"]
    neg = negatives.select("doc_id", F.col("start").alias("ns"), F.col("end").alias("ne"))
    on_negative = masks.select(*key).join(neg, "doc_id").where(F.greatest("start", "ns") < F.least("end", "ne")).select(*key).distinct().withColumn("neg", F.lit(True))
    own = paired.join(on_negative, key, "left").withColumn("tp", F.coalesce(F.col("type") == F.col("g_type"), F.lit(False)))
    kind = F.when(F.col("tp"), "tp").when(F.col("neg"), "fp_neg").when(F.col("g_type").isNotNull(), "cross").otherwise("nothing")
    n = lambda k: F.sum((kind == k).cast("long")).alias(k)
    return own.groupBy("type").agg(n("tp"), n("fp_neg"), n("cross"), n("nothing")).withColumn("precision", _percent(F.col("tp"), F.col("tp") + F.col("fp_neg")))


def longest_window(core: Column, field: Column) -> Column:
    """The longest part of core in one number of the field that is what is left of it: all of core, or RUN_SHARE of the number.

    In a number only lengths are tried that can be in it and count: no longer than the number, and no
    shorter than its share, but for all of core.
    """
    def of(both: Column) -> Column:
        core, field = both["core"], both["field"]
        windows = lambda n: F.transform(F.sequence(F.lit(1), F.length(core) - n + 1), lambda i: F.substring(core, i, n))

        def in_run(run: Column) -> Column:
            most, least = F.least(F.length(core), F.length(run)), F.greatest(F.lit(1), F.ceil(RUN_SHARE * F.length(run)).cast("int"))
            sizes = F.when(most >= least, F.sequence(most, F.least(most, least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
            part = F.aggregate(sizes, F.lit(""), lambda acc, n: F.when(acc != "", acc).otherwise(F.coalesce(F.try_element_at(F.filter(windows(n), lambda w: F.contains(run, w)), F.lit(1)), F.lit(""))))
            return F.when(F.contains(run, core), core).otherwise(part)

        found = F.transform(F.split(field, " "), in_run)
        pick = F.aggregate(found, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
        return F.when((core == "") | (field == ""), F.lit("")).otherwise(pick)

    return once(F.struct(core.alias("core"), field.alias("field")), of)


def leak_numeric(text: Column, anonymous: Column) -> Column:
    """struct<status, fragment, threshold>: how much of a number is still to be read; thresholds shrink with short numbers."""

    def of(both: Column) -> Column:
        core, window = both["core"], both["window"]
        soft, strict = F.least(F.lit(SOFT), F.length(core)), F.least(F.lit(STRICT), F.length(core))
        leaked = (core != "") & (F.length(window) >= soft)
        status = F.when(~leaked, "none").when(window == core, "full").otherwise("partial")
        return F.struct(status.alias("status"), F.when(leaked, window).alias("fragment"), F.when(leaked, F.when(F.length(window) >= strict, strict).otherwise(soft)).alias("threshold"))

    whole = lambda core: F.struct(core.alias("core"), longest_window(core, digit_runs(anonymous)).alias("window"))
    return once(once(digit_core(text), whole), of)


def leak_words(text: Column, anonymous: Column) -> Column:
    """struct<status, fragments>: a name leaks whole, or by any word of three letters."""
    open_text, whole = plain_letters(anonymous), plain_letters(text)
    left = F.array_sort(F.array_distinct(F.filter(words(text), lambda w: F.contains(open_text, w))))
    full = (whole != "") & F.contains(open_text, whole)
    status = F.when(full, "full").when(F.size(left) > 0, "partial").otherwise("none")
    return F.struct(status.alias("status"), F.when(full, F.array(whole)).otherwise(left).alias("fragments"))


def leak_email(text: Column, anonymous: Column) -> Column:
    """struct<status, fragments>: an address leaks whole, or by its name or domain."""
    open_text, whole = plain_letters(anonymous), plain_letters(text)
    parts = F.filter(F.split(whole, "@"), lambda p: (F.length(p) >= 4) & F.contains(open_text, p))
    full = (whole != "") & F.contains(open_text, whole)
    return F.struct(F.when(full, "full").when(F.size(parts) > 0, "partial").otherwise("none").alias("status"), F.when(full, F.array(whole)).otherwise(parts).alias("fragments"))


def leak_birthdate(text: Column, anonymous: Column) -> Column:
    """struct<status, fragments>: a date leaks with all its digits, separators aside."""
    core = digit_core(text)
    field = F.regexp_replace(F.translate(anonymous, "./-", ""), r"[^0-9]+", " ")
    full = (F.length(core) >= 6) & F.contains(field, core)
    return F.struct(F.when(full, "full").otherwise("none").alias("status"), F.when(full, F.array(core)).otherwise(F.array().cast("array<string>")).alias("fragments"))


def leak_status(entity_type: Column, text: Column, anonymous: Column) -> Column:
    """none, partial or full, by the type's own rule."""
    return (
        F.when(entity_type == "BIRTHDATE", leak_birthdate(text, anonymous)["status"])
        .when(entity_type == "EMAIL", leak_email(text, anonymous)["status"])
        .when(entity_type == "ADDRESS", leak_address(text, anonymous)["status"])
        .when(entity_type.isin(*NUMERIC), leak_numeric(text, anonymous)["status"])
        .otherwise(leak_words(text, anonymous)["status"])
    )


def leak_by_position(value: Column, open_pieces: Column) -> Column:
    """none, partial or full: how many of a value's digits stand in the pieces (array<string>) that no mask covers.

    A value without digits leaks in full with any open piece.
    """
    digits = lambda t: F.length(F.regexp_replace(t, r"\D", ""))
    core, seen = digits(value), digits(F.array_join(open_pieces, ""))
    return F.when(core == 0, F.when(F.size(open_pieces) > 0, "full").otherwise("none")).when(seen == 0, "none").when(seen >= core, "full").otherwise("partial")


def uncovered_pieces(gold: DataFrame, masks: DataFrame) -> DataFrame:
    """gold (doc_id, start, end, type) with piece_start and piece_end: the parts that no mask covers, one row each.

    They are what lies between the islands of the masks: a value's start, then the end of each island
    it meets, up to the next island's start or the value's end.
    """
    key = ["doc_id", "start", "end", "type"]
    union = islands(masks.select("doc_id", "start", "end")).select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    mine = (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start"))
    cuts = gold.select(*key).distinct().join(union, "doc_id", "left").where(mine | F.col("_s").isNull())
    bare = gold.select(*key).distinct().join(cuts.select(*key).distinct(), key, "left_anti").select(*key, F.array().cast("array<struct<_s:int,_e:int>>").alias("met"))
    met = cuts.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").cast("int").alias("_s"), F.col("_e").cast("int").alias("_e"))))).alias("met"))
    both = met.unionByName(bare)
    from_ = F.concat(F.array("start"), F.transform("met", lambda m: m["_e"]))
    to = F.concat(F.transform("met", lambda m: m["_s"]), F.array("end"))
    pieces = F.filter(F.zip_with(from_, to, lambda a, b: F.struct(a.alias("piece_start"), b.alias("piece_end"))), lambda p: p["piece_start"] < p["piece_end"])
    return both.select(*key, F.inline(pieces))


def adjacent_open(core: Column, runs: Column) -> Column:
    """Length of the longest part of a number that neighbouring open runs of digits (array<string>, two digits or more each) spell together."""
    joined = F.flatten(F.transform(runs, lambda r, i: F.transform(F.sequence(F.lit(1), F.size(runs) - i), lambda n: F.array_join(F.slice(runs, i + 1, n), ""))))
    return F.coalesce(F.array_max(F.transform(F.filter(joined, lambda j: (j != "") & F.contains(core, j)), F.length)), F.lit(0))


def round_trip_kept(original: Column, restored: Column) -> Column:
    """Whether a mask gave its value back: equal, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.coalesce(bare(original) == bare(restored), F.lit(False))


def leak_address(text: Column, anonymous: Column) -> Column:
    """struct<status, fragments>: an address leaks by its postal index, or by a place's name of four letters or the better part of it."""
    open_text = plain_letters(anonymous)
    names = F.filter(words(text), lambda w: F.length(w) >= 4)
    head = lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(6), F.ceil(F.length(w) * 0.75).cast("int")))
    hit = F.filter(names, lambda w: F.contains(open_text, w) | ((F.length(w) > 6) & F.contains(open_text, head(w))))
    index = F.filter(F.split(digit_runs(text), " "), lambda d: (F.length(d) == 6) & F.array_contains(F.split(digit_runs(anonymous), " "), d))
    left = F.array_sort(F.array_distinct(F.concat(hit, index)))
    full = (F.size(names) > 0) & (F.size(hit) == F.size(names))
    return F.struct(F.when(full, "full").when(F.size(left) > 0, "partial").otherwise("none").alias("status"), left.alias("fragments"))


def totals_by_type(results: DataFrame) -> DataFrame:
    """results (type, found, leak6, leak8): n, found and leaks per type, in all (type null), with the sum that leaves BIK out beside it."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    without = lambda c: F.sum(F.when(F.col("type") != "BIK", F.col(c).cast("long")))
    counted = results.withColumn("one", F.lit(True))
    return counted.rollup("type").agg(
        n("one").alias("n"), n("found").alias("found"), n("leak6").alias("leak6"), n("leak8").alias("leak8"), F.coalesce(without("one"), F.lit(0)).alias("n_without_bik"), F.coalesce(without("found"), F.lit(0)).alias("found_without_bik")
    )


def by_entity(occurrences: DataFrame) -> DataFrame:
    """occurrences (doc_id, type, text, found, leaked) -> one row per value of a document: n_occ, masked_all, leak_any, protected."""
    keyed = occurrences.withColumn("key", value_key(F.col("type"), F.col("text")))
    grouped = keyed.groupBy("doc_id", "type", "key").agg(F.count(F.lit(1)).alias("n_occ"), F.bool_and("found").alias("masked_all"), F.bool_or("leaked").alias("leak_any"))
    return grouped.withColumn("protected", F.col("masked_all") & ~F.col("leak_any"))


def protection(entities: DataFrame) -> DataFrame:
    """Per type: values, those masked everywhere, those without a leak, those protected, those met more than once, in counts and percent."""
    n = lambda c: F.sum(c.cast("long"))
    sums = entities.groupBy("type").agg(
        F.count(F.lit(1)).alias("ent"), n(F.col("masked_all")).alias("ent_masked"), n(~F.col("leak_any")).alias("ent_clean"), n(F.col("protected")).alias("ent_protected"), n(F.col("n_occ") > 1).alias("multi")
    )
    return sums.withColumn("ent_recall", _percent(F.col("ent_masked"), F.col("ent"))).withColumn("ent_protected_pct", _percent(F.col("ent_protected"), F.col("ent")))


def crosstype_pairs(scored: DataFrame, default_types: tuple[str, ...]) -> DataFrame:
    """(gold_type, mask_type) of masks on values of another type, where the value is masked by default and the mask's type isn't: n and documents."""
    odd = scored.where(F.col("g_type").isNotNull() & (F.col("g_type") != F.col("type")) & F.col("g_type").isin(*default_types) & ~F.col("type").isin(*default_types))
    return odd.groupBy(F.col("g_type").alias("gold_type"), F.col("type").alias("mask_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def open_by_default(gold: DataFrame, maximum: DataFrame, default: DataFrame) -> DataFrame:
    """Gold values that all masks close but the default profile's masks leave open: doc_id, type, start, end."""
    closed = uncovered_chars(gold, maximum).where("uncovered = 0").select("doc_id", "type", "start", "end")
    open_ = uncovered_chars(gold, default).where("uncovered > 0").select("doc_id", "type", "start", "end")
    return closed.join(open_, ["doc_id", "type", "start", "end"], "left_semi")


def single_guard(gold: DataFrame, masks: DataFrame) -> DataFrame:
    """Values that are closed, but by masks of other types only: doc_id, type, start, end, mask_types."""
    closed = uncovered_chars(gold, masks).where("uncovered = 0").select("doc_id", "type", "start", "end")
    m = masks.select("doc_id", F.col("start").alias("ms"), F.col("end").alias("me"), F.col("type").alias("mask_type"))
    met = closed.join(m, "doc_id").where(F.greatest("start", "ms") < F.least("end", "me"))
    grouped = met.groupBy("doc_id", "type", "start", "end").agg(F.array_sort(F.collect_set("mask_type")).alias("mask_types"))
    return grouped.where(~F.array_contains("mask_types", F.col("type")))


def violations(results: DataFrame) -> DataFrame:
    """Rows that contradict themselves, with the rules they break: a leak of 8 without one of 6, exact without found, an end before the start."""
    rules = {"leak8_without_leak6": "leak8 and not leak6", "exact_not_found": "exact and not found", "negative_length": "end < start"}
    found = F.filter(F.array(*[F.when(F.expr(sql), name) for name, sql in rules.items()]), lambda x: x.isNotNull())
    return results.withColumn("rules", found).where(F.size("rules") > 0)
