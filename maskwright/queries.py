"""The library's queries over the relational tables, with the SQL that states the same results.

Texts in Russian are built from keys inside each query, so that the SQL can say in closed form which
values must be found and where.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import checks, folds, shapes
from maskwright.operators import address, boundary, casing, gate, metrics, multispan, normalize, patterns, perturb, repair, report, resolve, restore, review, sessions, structural, tokens
from maskwright.plans import detection
from maskwright.plans.groups import dealt
from maskwright.plans.rules import PROFILES, RULES, resolve_profile
from maskwright.plans.tables import keep
from maskwright.sources import texts
from maskwright.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules_of(*types: str) -> tuple:
    return tuple(r for r in RULES if r.type in types)


def built(df: DataFrame, doc_id: Column, *lines: Column) -> DataFrame:
    """Segments of built lines, one per expression; the rows are dealt over tasks before any work on them."""
    df = dealt(df, doc_id)
    rows = F.posexplode(F.array(*lines)).alias("seg_ord", "text")
    return df.select(doc_id.cast("bigint").alias("doc_id"), rows)


def found(segments: DataFrame, *types: str) -> DataFrame:
    hits = patterns.detect_patterns(normalize.with_view(segments), rules_of(*types))
    return hits.select("doc_id", "seg_ord", "start", "end", "original_text", "entity_type")


# --- e-mail addresses in documents: scan, find, number, mask, restore ------------------------------

EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
_LINES = """lines as (select doc_id, unnest(generate_series(0, len(ls) - 1))::int as seg_ord, unnest(ls) as text
  from (select doc_id, case when ls[-1] = '' then ls[:-2] else ls end as ls from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)))"""
_MAILS = (
    _LINES
    + f""", parts as (select doc_id, seg_ord, text, regexp_extract_all(text, '{EMAIL}') as ms, string_split_regex(text, '{EMAIL}') as gaps from lines),
 mails as (select doc_id, seg_ord, text, unnest(generate_series(1, len(ms))) as i, ms, gaps from parts where len(ms) > 0),
 ents as (select doc_id, seg_ord, text, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int as start, ms[i] as value from mails),
 firsts as (select doc_id, value, min(seg_ord * 1000000 + start) as f from ents group by all),
 named as (select doc_id, value, '[EMAIL_' || row_number() over (partition by doc_id order by f, value) || ']' as token from firsts)"""
)


def _emails(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segments = texts.lines(table(spark, sf_dir, "documents"))
    hits = resolve.as_entities(patterns.detect_patterns(segments.withColumn("norm", F.col("text")).withColumn("omap", F.lit(None).cast("array<int>")), rules_of("EMAIL")))
    return segments, tokens.assign_tokens(hits)


@query(f"with {_LINES} select doc_id, seg_ord, 'l' || seg_ord as seg_id, text, 'txt_line' as source_type from lines")
def scan_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.lines(table(spark, sf_dir, "documents"))


@query(f'with {_MAILS} select doc_id, seg_ord, start, (start + length(value))::int as "end", value from ents')
def email_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir)[1].select("doc_id", "seg_ord", "start", "end", F.col("original_text").alias("value"))


@query(f"with {_MAILS} select doc_id, seg_ord, start, value, token from ents join named using (doc_id, value)")
def email_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir)[1].select("doc_id", "seg_ord", "start", F.col("original_text").alias("value"), "token")


_MASKED = (
    _MAILS
    + """, marked as (select doc_id, seg_ord, string_agg(gap || coalesce(token, ''), '' order by k) as rendered
     from (select p.doc_id, p.seg_ord, k, p.gaps[k] as gap, n.token from (select *, unnest(generate_series(1, len(gaps))) as k from parts) p left join named n on n.doc_id = p.doc_id and n.value = p.ms[k]) group by all),
 whole as (select doc_id, string_agg(rendered, chr(10) order by seg_ord) as rendered from marked group by doc_id)"""
)


@query(f"with {_MASKED} select doc_id, rendered from whole")
def email_anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, tokened = _emails(spark, sf_dir)
    return tokens.assemble(tokens.render_segments(segments, tokened))


@query(f"with {_LINES} select doc_id, string_agg(text, chr(10) order by seg_ord) as restored, 0 as n_unresolved from lines group by doc_id")
def email_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, tokened = _emails(spark, sf_dir)
    masked = tokens.assemble(tokens.render_segments(segments, tokened)).withColumnRenamed("rendered", "text")
    return restore.restore(masked, restore.session_of(tokened), "exact").select("doc_id", "restored", F.size("unresolved").alias("n_unresolved"))


# --- control digits ------------------------------------------------------------------------------


def _weights(ws: tuple[int, ...], value: str) -> str:
    return " + ".join(f"{w} * cast(substr({value}, {i + 1}, 1) as int)" for i, w in enumerate(ws))


_NINE = "lpad(cast(770000000 + c_custkey as varchar), 9, '0')"
_INN10 = f"({_NINE} || cast(({_weights(checks.INN10, _NINE)}) % 11 % 10 as varchar))"
_SPOILED = f"({_NINE} || cast((({_weights(checks.INN10, _NINE)}) % 11 % 10 + 1) % 10 as varchar))"


def _nine(key: str) -> Column:
    return F.lpad((F.lit(770000000) + F.col(key)).cast("string"), 9, "0")


@query(f"select c_custkey, {_INN10} as inn, true as good, false as spoiled from customer")
def inn10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    inn = checks.make_inn10(_nine("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", inn.alias("inn"), checks.inn10(inn).alias("good"), checks.inn10(checks.spoil(inn)).alias("spoiled"))


_TEN = "lpad(cast(5000000000 + o_orderkey as varchar), 10, '0')"
_ELEVEN = f"({_TEN} || cast(({_weights(checks.INN12_FIRST, _TEN)}) % 11 % 10 as varchar))"


@query(f"select o_orderkey, v11 || cast(({_weights(checks.INN12_SECOND, 'v11')}) % 11 % 10 as varchar) as inn, true as good, false as spoiled from (select o_orderkey, {_ELEVEN} as v11 from orders)")
def inn12_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    inn = checks.make_inn12(F.lpad((F.lit(5000000000) + F.col("o_orderkey")).cast("string"), 10, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", inn.alias("inn"), checks.inn12(inn).alias("good"), checks.inn12(checks.spoil(inn)).alias("spoiled"))


@query("select s_suppkey, cast(102770000000 + s_suppkey as varchar) || cast((102770000000 + s_suppkey) % 11 % 10 as varchar) as ogrn, true as good, false as spoiled from supplier")
def ogrn13_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = checks.make_ogrn13((F.lit(102770000000) + F.col("s_suppkey")).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("ogrn"), checks.ogrn(value).alias("good"), checks.ogrn(checks.spoil(value)).alias("spoiled"))


@query("select s_suppkey, cast(30477000000000 + s_suppkey as varchar) || cast((30477000000000 + s_suppkey) % 13 % 10 as varchar) as ogrn, true as good, false as spoiled from supplier")
def ogrn15_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = checks.make_ogrn15((F.lit(30477000000000) + F.col("s_suppkey")).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("ogrn"), checks.ogrn(value).alias("good"), checks.ogrn(checks.spoil(value)).alias("spoiled"))


# --- the pattern layer on built lines ------------------------------------------------------------


def _expect(rows: list[tuple[int, str, str, str]], source: str, key: str) -> str:
    """SQL of expected entities: (segment, text before the value, value SQL, type)."""
    return " union all ".join(
        f"select {key}::bigint as doc_id, {seg} as seg_ord, {len(before)} as start, ({len(before)} + length({value}))::int as \"end\", {value} as original_text, '{kind}' as entity_type from {source}" for seg, before, value, kind in rows
    )


@query(_expect([(0, "ИНН ", _INN10, "INN"), (1, "ИНН ", _SPOILED, "INN"), (2, "", _INN10, "INN")], "customer", "c_custkey"))
def anchors_and_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor saves a value with a wrong control digit; without one it must be right, alone, and not vetoed."""
    inn = checks.make_inn10(_nine("c_custkey"))
    lines = (F.concat(F.lit("ИНН "), inn), F.concat(F.lit("ИНН "), checks.spoil(inn)), inn, checks.spoil(inn), F.concat(inn, F.lit(" 5")), F.concat(F.lit("артикул "), inn))
    return found(built(table(spark, sf_dir, "customer"), F.col("c_custkey"), *lines), "INN")


_KPP, _BIK = "cast(770000000 + s_suppkey as varchar)", "('04' || lpad(cast(s_suppkey as varchar), 7, '0'))"
_ACC = "('40702810' || lpad(cast(s_suppkey as varchar), 12, '0'))"


@query(_expect([(0, "КПП ", _KPP, "KPP"), (2, "р/с ", _ACC, "BANK_ACCOUNT"), (4, "БИК ", _BIK, "BIK"), (5, "реестровый номер ", _KPP, "REG_ID")], "supplier", "s_suppkey"))
def anchored_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types without control digits count behind their anchor only."""
    kpp, bik, acc = (F.lit(770000000) + F.col("s_suppkey")).cast("string"), F.concat(F.lit("04"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")), F.concat(F.lit("40702810"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"))
    lines = (F.concat(F.lit("КПП "), kpp), kpp, F.concat(F.lit("р/с "), acc), acc, F.concat(F.lit("БИК "), bik), F.concat(F.lit("реестровый номер "), kpp))
    return found(built(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), *lines), "KPP", "BANK_ACCOUNT", "BIK", "REG_ID")


_PRICE = "(cast(cast(floor(o_totalprice) as bigint) as varchar) || ' руб.')"
_DAY = "strftime(o_orderdate, '%d.%m.%Y')"


@query(_expect([(0, "сумма ", _PRICE, "SUM"), (1, "от ", _DAY, "DATE"), (2, "Дата рождения: ", _DAY, "BIRTHDATE"), (2, "Дата рождения: ", _DAY, "DATE")], "orders", "o_orderkey"))
def sums_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    lines = (F.concat(F.lit("сумма "), F.floor("o_totalprice").cast("string"), F.lit(" руб.")), F.concat(F.lit("от "), day), F.concat(F.lit("Дата рождения: "), day))
    return found(built(table(spark, sf_dir, "orders"), F.col("o_orderkey"), *lines), "SUM", "DATE", "BIRTHDATE")


_KEY = "l_orderkey * 10 + l_linenumber"
_PCT = "(cast(cast(l_quantity as int) as varchar) || ' %')"


@query(_expect([(0, "ставка ", _PCT, "PERCENT"), (2, "", "(" + _PCT + " || ' голосов')", "SHARE_PCT"), (3, "п. ", "(cast(l_linenumber as varchar) || '.' || cast(cast(l_quantity as int) as varchar))", "CLAUSE_REF")], "lineitem", _KEY) + f" union all select ({_KEY})::bigint, 2, 0, length({_PCT})::int, {_PCT}, 'PERCENT' from lineitem")
def percents_and_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentage, one that humidity vetoes, a share, and a clause number."""
    pct = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" %"))
    lines = (F.concat(F.lit("ставка "), pct), F.concat(F.lit("влажность "), pct), F.concat(pct, F.lit(" голосов")), F.concat(F.lit("п. "), F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string")))
    return found(built(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), *lines), "PERCENT", "SHARE_PCT", "CLAUSE_REF")


@query(
    "select c_custkey::bigint as doc_id, 0 as seg_ord, 0 as start, 17 as \"end\", t as original_text, 'PHONE' as entity_type from (select c_custkey, '8 (' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || ' ' || substr(p, 7, 2) || ' ' || substr(p, 9, 2) as t from (select c_custkey, cast(9000000000 + c_custkey as varchar) as p from customer))"
    " union all select c_custkey, 1, 4, 25, '4070281090' || chr(10) || lpad(cast(c_custkey as varchar), 10, '0'), 'BANK_ACCOUNT' from customer"
    " union all select c_custkey, 2, 15, 26, '01.0' || chr(10) || '2.1980', 'BIRTHDATE' from customer where false"
)
def values_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phone in groups, an account broken by a line end behind its anchor; without the anchor, nothing."""
    p = (F.lit(9000000000) + F.col("c_custkey")).cast("string")
    phone = F.concat(F.lit("8 ("), F.substring(p, 1, 3), F.lit(") "), F.substring(p, 4, 3), F.lit(" "), F.substring(p, 7, 2), F.lit(" "), F.substring(p, 9, 2))
    torn = F.concat(F.lit("4070281090\n"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    views = normalize.with_view(built(table(spark, sf_dir, "customer"), F.col("c_custkey"), phone, F.concat(F.lit("р/с "), torn), torn))
    return multispan.detect_multispan(views).select("doc_id", "seg_ord", "start", "end", "original_text", "entity_type")


_TEL = "cast(79000000000 + c_custkey as varchar)"


@query(f"select c_custkey, seg_ord::int as seg_ord, norm, last_at::int as last_at from (select c_custkey, 0 as seg_ord, {_TEL} as norm, 13 as last_at from customer union all select c_custkey, 1, {_TEL}, 11 from customer union all select c_custkey, 2, 'Москва', 5 from customer)")
def detection_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphens and invisible characters in numbers, and a word of two alphabets: the norm and the map's last place."""
    p = (F.lit(79000000000) + F.col("c_custkey")).cast("string")
    hyphens = F.concat(F.substring(p, 1, 4), F.lit("-"), F.substring(p, 5, 3), F.lit("-"), F.substring(p, 8, 2), F.lit("-"), F.substring(p, 10, 2))
    hidden = F.concat(F.substring(p, 1, 5), F.lit("​"), F.substring(p, 6, 6))
    views = normalize.with_view(built(table(spark, sf_dir, "customer"), F.col("c_custkey"), hyphens, hidden, F.lit("Mосква")))
    return views.select(F.col("doc_id").alias("c_custkey"), "seg_ord", "norm", F.element_at("omap", -1).alias("last_at"))


# --- intervals -----------------------------------------------------------------------------------

_GOLD = """gold as (select l_orderkey as doc_id, (l_linenumber * 20 + l_partkey % 7)::int as s, (l_linenumber * 20 + l_partkey % 7 + 5 + l_suppkey % 9)::int as e,
  case l_partkey % 3 when 0 then 'INN' when 1 then 'PHONE' else 'PERSON' end as t from lineitem)"""
_MASKS = """masks as (select l_orderkey as doc_id, (l_linenumber * 20 + l_partkey % 7 + l_suppkey % 3 - 1)::int as s, (l_linenumber * 20 + l_partkey % 7 + 5 + l_suppkey % 9 + l_partkey % 4 - 2)::int as e,
  case (l_partkey + l_suppkey % 2) % 3 when 0 then 'INN' when 1 then 'PHONE' else 'PERSON' end as t from lineitem where l_quantity > 10)"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(table(spark, sf_dir, "lineitem"), "l_linenumber * 20 + l_partkey % 7", "l_linenumber * 20 + l_partkey % 7 + 5 + l_suppkey % 9", "l_partkey % 3")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(
        table(spark, sf_dir, "lineitem").where("l_quantity > 10"), "l_linenumber * 20 + l_partkey % 7 + l_suppkey % 3 - 1", "l_linenumber * 20 + l_partkey % 7 + 5 + l_suppkey % 9 + l_partkey % 4 - 2", "(l_partkey + l_suppkey % 2) % 3"
    )


def _intervals(rows: DataFrame, start: str, end: str, kind: str) -> DataFrame:
    return rows.selectExpr("l_orderkey as doc_id", f"cast({start} as int) as start", f"cast({end} as int) as end", f"case {kind} when 0 then 'INN' when 1 then 'PHONE' else 'PERSON' end as type")


@query(f'with {_GOLD}, {_MASKS} select g.doc_id, g.s as gs, g.e as ge, m.s as ms, m.e as me from gold g join masks m on g.doc_id = m.doc_id and greatest(g.s, m.s) < least(g.e, m.e)')
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(spark, sf_dir).select("doc_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    m = _masks(spark, sf_dir).select("doc_id", F.col("start").alias("ms"), F.col("end").alias("me"))
    return g.join(m, "doc_id").where(resolve.overlaps(F.col("gs"), F.col("ge"), F.col("ms"), F.col("me")))


@query(f"with {_GOLD}, {_MASKS} select g.doc_id, g.s as gs, m.s as ms, greatest(0, greatest(g.s, m.s) - least(g.e, m.e))::int as gap from gold g join masks m on g.doc_id = m.doc_id where greatest(0, greatest(g.s, m.s) - least(g.e, m.e)) <= 3")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(spark, sf_dir).select("doc_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    m = _masks(spark, sf_dir).select("doc_id", F.col("start").alias("ms"), F.col("end").alias("me"))
    near = resolve.gap(F.col("gs"), F.col("ge"), F.col("ms"), F.col("me"))
    return g.join(m, "doc_id").where(near <= 3).select("doc_id", "gs", "ms", near.alias("gap"))


@query(f'with {_GOLD}, {_MASKS} select doc_id, s as start, e as "end" from gold g where not exists (select 1 from masks m where m.doc_id = g.doc_id and m.s <= g.s and g.e <= m.e)')
def containment_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(spark, sf_dir)
    m = _masks(spark, sf_dir).select(F.col("doc_id").alias("d"), F.col("start").alias("ms"), F.col("end").alias("me"))
    return g.join(m, (g.doc_id == m.d) & (m.ms <= g.start) & (g.end <= m.me), "left_anti").select("doc_id", "start", "end")


_UNION = """marks as (select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from masks),
 numbered as (select *, sum(f) over (partition by doc_id order by s, e rows unbounded preceding) as i from marks),
 islands as (select doc_id, i, min(s) as s, max(e) as e from numbered group by doc_id, i)"""


@query(f'with {_MASKS}, {_UNION} select doc_id, s as start, e as "end" from islands')
def union_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.islands(_masks(spark, sf_dir).select("doc_id", "start", "end"))


@query("with e as (select user_id as doc_id, floor(epoch(ts))::bigint as s from events), m as (select *, case when s - lag(s) over (partition by doc_id order by s) <= 1800 then 0 else 1 end as f from e), n as (select *, sum(f) over (partition by doc_id order by s rows unbounded preceding) as i from m) select doc_id, min(s) as start, max(s) as \"end\" from n group by doc_id, i")
def cluster_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at most half an hour apart."""
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.unix_timestamp("ts").alias("start"), F.unix_timestamp("ts").alias("end"))
    return metrics.islands(points, most_gap=1800)


_COVER = f"""{_GOLD}, {_MASKS}, {_UNION}, cover as (select g.doc_id, g.s, g.e, g.t, coalesce(sum(case when i.s is not null then least(g.e, i.e) - greatest(g.s, i.s) end), 0)::int as covered
 from (select distinct * from gold) g left join islands i on i.doc_id = g.doc_id and greatest(g.s, i.s) < least(g.e, i.e) group by all)"""


@query(f'with {_COVER} select doc_id, g.s as start, g.e as "end", g.t as type, (g.e - g.s - covered)::int as uncovered from gold g join cover c using (doc_id, s, e, t)')
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.uncovered_chars(_gold(spark, sf_dir), _masks(spark, sf_dir)).select("doc_id", "start", "end", "type", F.col("uncovered").cast("int").alias("uncovered"))


@query(f'with {_MASKS}, {_UNION} select * from (select doc_id, e as start, lead(s) over (partition by doc_id order by s) as "end" from islands) where "end" is not null')
def seam_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.seam_gaps(_masks(spark, sf_dir).select("doc_id", "start", "end"))


# --- metrics -------------------------------------------------------------------------------------

_BEST = """met as (select m.*, g.s as gs, g.e as ge, g.t as gt, least(m.e, g.e) - greatest(m.s, g.s) as o from masks m join gold g on g.doc_id = m.doc_id and greatest(m.s, g.s) < least(m.e, g.e)),
 best as (select * from (select *, row_number() over (partition by doc_id, s, e, t order by o desc, gs, ge, gt desc) as r from (select distinct * from met)) where r = 1),
 paired as (select m.*, b.gs, b.ge, b.gt from masks m left join best b using (doc_id, s, e, t))"""


@query(f"""with {_COVER}, {_BEST}, scored as (select p.t as type, p.gt is not null as scored, c.covered = c.e - c.s as b_ok, p.t = p.gt as c_ok from paired p left join cover c on c.doc_id = p.doc_id and c.s = p.gs and c.e = p.ge and c.t = p.gt)
 select type, count(*) as n_masks, count(*) filter (scored) as n_scored, 100.0 as a, coalesce(100.0 * count(*) filter (b_ok) / nullif(count(*) filter (scored), 0), 100.0)::double as b, coalesce(100.0 * count(*) filter (c_ok) / nullif(count(*) filter (scored), 0), 100.0)::double as c from scored group by rollup (type)""".replace("100.0 as a", "100.0::double as a"))
def masking_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = _masks(spark, sf_dir).withColumn("a_ok", F.lit(True))
    return metrics.masking_rates(metrics.masking_abc(masks, _gold(spark, sf_dir)))


@query(f"""with {_GOLD}, {_MASKS}, {_BEST}, neg as (select doc_id, s, e from gold where t = 'PERSON'), hit as (select distinct m.doc_id, m.s, m.e, m.t from masks m join neg n on n.doc_id = m.doc_id and greatest(m.s, n.s) < least(m.e, n.e)),
 k as (select p.t as type, case when p.t = p.gt then 'tp' when h.doc_id is not null then 'fp_neg' when p.gt is not null then 'cross' else 'nothing' end as k from paired p left join hit h using (doc_id, s, e, t))
 select type, count(*) filter (k = 'tp') as tp, count(*) filter (k = 'fp_neg') as fp_neg, count(*) filter (k = 'cross') as "cross", count(*) filter (k = 'nothing') as nothing, 100.0 * count(*) filter (k = 'tp') / nullif(count(*) filter (k in ('tp', 'fp_neg')), 0) as precision from k group by type""")
def precision_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    return metrics.precision_by_type(_masks(spark, sf_dir), gold, gold.where("type = 'PERSON'"))


_BOUNDS = f"""{_COVER}, own as (select m.doc_id, m.s, m.e, g.s as gs, g.e as ge, g.t as gt, least(m.e, g.e) - greatest(m.s, g.s) as o from masks m join gold g on g.doc_id = m.doc_id and g.t = m.t and greatest(m.s, g.s) < least(m.e, g.e)),
 pick as (select * from (select *, row_number() over (partition by doc_id, s, e, gt order by o desc, gs, ge) as r from (select distinct * from own)) where r = 1),
 over_ as (select m.doc_id, p.gs, p.ge, p.gt, sum(greatest(0, least(m.e, p.gs) - m.s) + greatest(0, m.e - greatest(m.s, p.ge))) as over_ from masks m join pick p on p.doc_id = m.doc_id and p.s = m.s and p.e = m.e and p.gt = m.t group by all),
 b as (select g.doc_id, g.t as type, g.s as start, g.e as stop, (g.e - g.s - c.covered)::int as under, o.over_ from gold g join cover c using (doc_id, s, e, t) left join over_ o on o.doc_id = g.doc_id and o.gs = g.s and o.ge = g.e and o.gt = g.t),
 d as (select *, case when over_ is null then 'not_found' when under = 0 and over_ = 0 then 'exact' when under = 0 then 'longer' when over_ = 0 then 'shorter' else 'both' end as direction from b)"""


@query(f"""with {_BOUNDS} select type, count(*) as n, count(*) filter (direction = 'exact') as exact, count(*) filter (direction in ('shorter', 'both')) as shorter, count(*) filter (direction in ('longer', 'both')) as longer, count(*) filter (direction = 'not_found') as not_found,
 coalesce(sum(under) filter (direction in ('shorter', 'both')), 0)::bigint as under_chars, coalesce(sum(over_) filter (direction in ('longer', 'both')), 0)::bigint as over_chars, coalesce(sum(under) filter (direction = 'not_found'), 0)::bigint as not_found_chars from d group by rollup (type)""")
def boundary_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.boundary_summary(metrics.boundaries(_gold(spark, sf_dir), _masks(spark, sf_dir)))


@query(f"with {_GOLD}, {_MASKS}, {_BEST} select gt as gold_type, t as mask_type, count(*) as n, count(distinct doc_id) as docs from paired where gt <> t and gt in ('PERSON', 'PHONE') and t not in ('PERSON', 'PHONE') group by all")
def crosstype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.crosstype_pairs(metrics.best_gold(_masks(spark, sf_dir), _gold(spark, sf_dir)), ("PERSON", "PHONE"))


@query(f'with {_COVER} select c.doc_id, c.t as type, c.s as start, c.e as "end", list_sort(list(distinct m.t)) as mask_types from cover c join masks m on m.doc_id = c.doc_id and greatest(m.s, c.s) < least(m.e, c.e) where c.covered = c.e - c.s group by all having not list_contains(list(distinct m.t), c.t)')
def single_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.single_guard(_gold(spark, sf_dir), _masks(spark, sf_dir))


_FEW = _MASKS.replace("masks as", "few as").replace("l_quantity > 10", "l_quantity > 10 and l_partkey % 3 <> 0")
_FEW_UNION = _UNION.replace("marks", "fmarks").replace("numbered", "fnumbered").replace("islands", "fislands").replace("from masks", "from few")


@query(f'with {_COVER}, {_FEW}, {_FEW_UNION} select c.doc_id, c.t as type, c.s as start, c.e as "end" from cover c where c.covered = c.e - c.s and coalesce((select sum(greatest(0, least(c.e, i.e) - greatest(c.s, i.s))) from fislands i where i.doc_id = c.doc_id), 0) < c.e - c.s')
def open_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = _intervals(
        table(spark, sf_dir, "lineitem").where("l_quantity > 10 and l_partkey % 3 <> 0"), "l_linenumber * 20 + l_partkey % 7 + l_suppkey % 3 - 1", "l_linenumber * 20 + l_partkey % 7 + 5 + l_suppkey % 9 + l_partkey % 4 - 2", "(l_partkey + l_suppkey % 2) % 3"
    )
    return metrics.open_by_default(_gold(spark, sf_dir).distinct(), _masks(spark, sf_dir), few)


@query("select case l_linenumber % 3 when 0 then 'BIK' when 1 then 'INN' else 'KPP' end as type, count(*) as n, count(*) filter (l_returnflag <> 'R') as found, count(*) filter (l_quantity < 6) as leak6, count(*) filter (l_quantity < 4) as leak8, count(*) filter (l_linenumber % 3 <> 0) as n_without_bik, count(*) filter (l_linenumber % 3 <> 0 and l_returnflag <> 'R') as found_without_bik from lineitem group by rollup (1)")
def leak_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("case l_linenumber % 3 when 0 then 'BIK' when 1 then 'INN' else 'KPP' end as type", "l_returnflag <> 'R' as found", "l_quantity < 6 as leak6", "l_quantity < 4 as leak8")
    return metrics.totals_by_type(rows)


@query("with e as (select o_custkey, 'PHONE' as type, bool_and(o_orderstatus <> 'P') as m, bool_or(o_orderpriority like '1%') as l, count(*) as n from orders group by o_custkey) select type, count(*) as ent, count(*) filter (m) as ent_masked, count(*) filter (not l) as ent_clean, count(*) filter (m and not l) as ent_protected, count(*) filter (n > 1) as multi, 100.0 * count(*) filter (m) / count(*) as ent_recall, 100.0 * count(*) filter (m and not l) / count(*) as ent_protected_pct from e group by type")
def by_entity_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as occurrences of their customer's phone."""
    rows = table(spark, sf_dir, "orders").select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("PHONE").alias("type"), F.concat(F.lit("8 900 "), F.col("o_custkey").cast("string")).alias("text"), (F.col("o_orderstatus") != "P").alias("found"), F.col("o_orderpriority").startswith("1").alias("leaked"))
    return metrics.protection(metrics.by_entity(rows))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'none' when o_orderkey % 3 = 1 then 'full' else 'partial' end as status from orders")
def leak_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ten-digit number that is masked, left whole, or left but for its last three digits."""
    number = F.lpad((F.lit(5000000000) + F.col("o_orderkey")).cast("string"), 10, "0")
    left = F.when(F.col("o_orderkey") % 3 == 0, "ИНН [INN_1], сумма 12").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("ИНН "), number)).otherwise(F.concat(F.lit("ИНН "), F.substring(number, 1, 7), F.lit("[INN_1]")))
    return dealt(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", metrics.leak_status(F.lit("INN"), number, left).alias("status"))


_SIDE = "select n_name as type, count(*) as found, count(*) filter (c_acctbal < {0}) as leak from customer join nation on c_nationkey = n_nationkey {1} group by n_name"


@query(f"with b as ({_SIDE.format(0, '')}), c as ({_SIDE.format(500, 'where c_custkey % 7 <> 0')}), j as (select coalesce(b.type, c.type) as key, coalesce(b.found, 0)::double as bf, coalesce(c.found, 0)::double as cf, coalesce(b.leak, 0)::double as bl, coalesce(c.leak, 0)::double as cl from b full join c on b.type = c.type) select 'b' as line, key, 'found' as metric, bf as baseline, cf as current from j where bf - cf > 0 union all select 'b', key, 'leak', bl, cl from j where cl - bl > 0")
def gate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    side = lambda df, below: df.groupBy(F.col("n_name").alias("type")).agg(F.count(F.lit(1)).alias("found"), F.sum((F.col("c_acctbal") < below).cast("long")).alias("leak"))
    return gate.compare(side(rows, 0), side(rows.where("c_custkey % 7 <> 0"), 500), "type", {"found": ("up", 0), "leak": ("down", 0)}, "b")


@query("with b as (select c_custkey as id from customer where c_custkey % 3 = 0), c as (select c_custkey as id from customer where c_custkey % 2 = 0), k as (select c_custkey as id from customer where c_custkey % 5 = 0) select 'new' as change, id from (select id from c except select id from b except select id from k) union all select 'closed', id from (select id from k except select id from c)")
def debt_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda n: table(spark, sf_dir, "customer").where(f"c_custkey % {n} = 0").select(F.col("c_custkey").alias("id"))
    return gate.debt(ids(3), ids(2), ids(5))


@query("select count(*) as n_strata, count(*) filter (hit) as covered, count(*) filter (hit) / count(*) as share from (select n_name, bool_or(c_custkey % 11 = 0) as hit from customer join nation on c_nationkey = n_nationkey group by n_name)")
def stratum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("stratum"))
    return gate.coverage(strata.where("id % 11 = 0"), strata)


# --- conflicts, numbers, assembly ----------------------------------------------------------------


@query("select c_custkey::bigint as doc_id, s::int as start, e::int as \"end\", t as entity_type from customer, (values (0, 4, 'PERSON'), (4, 12, 'INN'), (12, 16, 'ORG'), (20, 29, 'BIK'), (40, 44, 'ADDRESS')) v(s, e, t)")
def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of three, two of equal length, and one alone, in every document."""
    text = "abcdefghijklmnop    123456789           adr1"
    spans = [(0, 6, "PERSON", "ner"), (4, 12, "INN", "regex"), (10, 16, "ORG", "ner"), (20, 29, "KPP", "regex"), (20, 29, "BIK", "regex"), (40, 44, "ADDRESS", "ner")]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("ent_seq"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(text[s:e]).alias("original_text"), F.lit(t).alias("entity_type"), F.lit(d).alias("detector"), F.lit(1.0).alias("confidence")) for i, (s, e, t, d) in enumerate(spans)])
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("doc_id"), F.lit(0).alias("seg_ord"), F.inline(rows))
    return resolve.resolve_overlaps(entities).select("doc_id", "start", "end", "entity_type")


@query("select s_suppkey::bigint as doc_id, 'PERSON' as entity_type, 3 as start, 9 as \"end\" from supplier union all select s_suppkey, 'INN', 20, 30 from supplier")
def shadow_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With organisations switched off, the person that one had displaced is masked."""
    spans = [(0, 9, "ORG", "ner", "ИП Иванов"), (3, 9, "PERSON", "ner", "Иванов"), (20, 30, "INN", "regex", "7707083893"), (25, 32, "ORG", "ner", "83893 x")]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("ent_seq"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(v).alias("original_text"), F.lit(t).alias("entity_type"), F.lit(d).alias("detector"), F.lit(1.0).alias("confidence")) for i, (s, e, t, d, v) in enumerate(spans)])
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("doc_id"), F.lit(0).alias("seg_ord"), F.inline(rows))
    return resolve.recover_shadowed(keep(resolve.resolve_overlaps(entities), "resolved"), frozenset({"PERSON", "INN"})).select("doc_id", "entity_type", "start", "end")


@query("select s_suppkey::bigint as doc_id, 'INN' as suppressed_type, 'CLAUSE_REF' as suppressor_type, 4 as start, 10 as \"end\" from supplier")
def barrier_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = [(0, 12, "CLAUSE_REF", "123456789012"), (4, 10, "INN", "567890")]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("ent_seq"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(v).alias("original_text"), F.lit(t).alias("entity_type"), F.lit("regex").alias("detector"), F.lit(1.0).alias("confidence")) for i, (s, e, t, v) in enumerate(spans)])
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("doc_id"), F.lit(0).alias("seg_ord"), F.inline(rows))
    return resolve.suppressions(resolve.resolve_overlaps(entities)).drop("seg_ord")


_ORDERS = "select o_custkey as doc_id, (o_orderkey % 100000)::int as seg_ord, 0 as start, case when o_orderkey % 4 = 0 then 'INN' else 'PHONE' end as t, 'v' || (o_orderkey % 5) as v from orders"


@query(f"with o as ({_ORDERS}), f as (select doc_id, t, v, min(seg_ord) as f from o group by all), n as (select doc_id, t, v, '[' || t || '_' || row_number() over (partition by doc_id, t order by f, v) || ']' as token from f) select doc_id, seg_ord, t as entity_type, v as original_text, token from o join n using (doc_id, t, v)")
def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as segments: numbers per prefix in order of first appearance, one per value."""
    return tokens.assign_tokens(_order_entities(spark, sf_dir)).select("doc_id", "seg_ord", "entity_type", "original_text", "token")


def _order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "cast(o_orderkey % 100000 as int) as seg_ord", "o_orderkey as ent_seq", "0 as start", "2 as end", "concat('v', o_orderkey % 5) as original_text", "case when o_orderkey % 4 = 0 then 'INN' else 'PHONE' end as entity_type", "'regex' as detector", "1.0D as confidence")
    return resolve.as_entities(rows)


@query("select o_custkey as doc_id, string_agg('x v' || (o_orderkey % 5), chr(10) order by (o_orderkey % 100000)::int) as restored from orders group by o_custkey")
def exact_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th appearance of a token gets the n-th surface."""
    tokened = tokens.assign_tokens(_order_entities(spark, sf_dir))
    texts_ = tokened.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "token"))), lambda s: F.concat(F.lit("x "), s["token"])), "\n").alias("text"))
    return restore.restore(texts_, restore.session_of(tokened), "exact").select("doc_id", "restored")


@query("select r_regionkey::bigint as doc_id, string_agg(line, chr(10) order by n_nationkey) as text from (select r_regionkey, n_nationkey, n_name || ' | ' || r_name as line from nation join region on n_regionkey = r_regionkey) group by r_regionkey")
def table_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tokens.assemble(texts.table_cells(rows, F.col("r_regionkey"), F.lit(0), F.col("n_nationkey"), ["n_name", "r_name"]), "text")


@query("select conv_id as doc_id, turn::int as seg_ord, right(text, 60) as tail, left(nxt, 60) as head, right(text, 60) || chr(10) || left(nxt, 60) as text from (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as nxt from conversations) where nxt <> '' and text <> ''")
def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "cast(turn as int) as seg_ord", "text")
    return boundary.windows(segments).select("doc_id", "seg_ord", "tail", "head", "text")


@query("select c_custkey::bigint as doc_id, 0 as seg_ord, 8 as start, 18 as \"end\", '4070281090' as original_text, 'BANK_ACCOUNT' as entity_type from customer union all select c_custkey, 1, 0, 10, lpad(cast(c_custkey as varchar), 10, '0'), 'BANK_ACCOUNT' from customer")
def boundary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account torn by the end of a segment, and both of its halves."""
    segments = built(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit("Тут р/с 4070281090"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    return boundary.boundary_entities(segments).select("doc_id", "seg_ord", "start", "end", "original_text", "entity_type")


@query(f"select s_suppkey::bigint as doc_id, (s_suppkey * 3 + 1)::int as seg_ord, {_BIK} as original_text, 'BIK' as entity_type from supplier")
def anchor_in_the_left_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    bik = F.concat(F.lit("04"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("БИК").alias("label"), bik.alias("bik"), F.lit("x").alias("rest"))
    cells = texts.table_cells(rows, F.col("s_suppkey"), F.lit(0), F.col("s_suppkey"), ["label", "bik", "rest"])
    return boundary.anchors_from_the_left_cell(cells).select("doc_id", "seg_ord", "original_text", "entity_type")


# --- policy, review, sessions --------------------------------------------------------------------


@query("with t as (select l_orderkey, case l_partkey % 4 when 0 then 'INN' when 1 then 'PHONE' when 2 then 'SUM' else 'PERSON' end as t from lineitem) select p as profile, count(*) as n from t, (values ('personal'), ('personal_requisites'), ('with_money'), ('maximum')) v(p) where p in ('maximum', 'with_money') or t in ('PHONE', 'PERSON') or (t = 'INN' and p = 'personal_requisites') group by p")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case l_partkey % 4 when 0 then 'INN' when 1 then 'PHONE' when 2 then 'SUM' else 'PERSON' end")
    counts = table(spark, sf_dir, "lineitem").groupBy(kind.alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    profiles = [(p, t) for p in PROFILES for t in (resolve_profile(p) or ("INN", "PHONE", "SUM", "PERSON"))]
    return counts.join(F.broadcast(spark.createDataFrame(profiles, "profile string, entity_type string")), "entity_type").groupBy("profile").agg(F.sum("n").alias("n"))


@query("select case l_partkey % 3 when 0 then 'INN' when 1 then 'PHONE' else 'SUM' end as entity_type, case when l_suppkey % 2 = 0 then 'regex' else 'ner' end as detector, count(*) as n, count(distinct l_orderkey) as docs from lineitem group by cube (1, 2)")
def census_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "case l_partkey % 3 when 0 then 'INN' when 1 then 'PHONE' else 'SUM' end as entity_type", "case when l_suppkey % 2 = 0 then 'regex' else 'ner' end as detector")
    return report.census(rows)


_RECORDS = "select case l_partkey % 3 when 0 then 'INN' when 1 then 'PHONE' else 'SUM' end as entity_type, case when l_suppkey % 2 = 0 then 'regex' else 'ner' end as detector, {0} as kind from lineitem{1}"
_KIND = "case l_linenumber % 4 when 0 then 'missed' when 1 then 'false_mask' when 2 then 'boundary' else 'type' end"


@query("with r as (" + _RECORDS.format("'mask'", "") + " union all " + _RECORDS.format(_KIND, " where l_quantity < 5") + """), g as (select case when grouping(entity_type) = 0 then 'type' when grouping(detector) = 0 then 'detector' else 'total' end as section, coalesce(entity_type, detector) as key, count(*) filter (kind = 'mask') as masks, count(*) filter (kind = 'missed') as missed,
 count(*) filter (kind = 'false_mask') as false_mask, count(*) filter (kind = 'boundary') as boundary, count(*) filter (kind = 'type') as type_error from r group by grouping sets ((entity_type), (detector), ()))
 select *, round(100.0::double * (masks - false_mask) / nullif(masks, 0), 2) as precision, round(100.0::double * (masks - false_mask) / nullif(masks - false_mask + missed, 0), 2) as recall, round(100.0::double * boundary / nullif(masks, 0), 2) as boundary_rate, round(100.0::double * type_error / nullif(masks, 0), 2) as type_error_rate from g""")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["case l_partkey % 3 when 0 then 'INN' when 1 then 'PHONE' else 'SUM' end as entity_type", "case when l_suppkey % 2 = 0 then 'regex' else 'ner' end as detector"]
    rows = table(spark, sf_dir, "lineitem")
    return report.build_report(rows.where("l_quantity < 5").selectExpr(*base, f"{_KIND} as kind"), rows.selectExpr(*base))


_LETTERS = "regexp_replace(w, '[^\\p{L}]', '', 'g')"
#: A word counts as beginning small if its first character is a letter and no capital.
_SHAPE = (
    f"case when {_LETTERS} = '' then 'no_letters' when {_LETTERS} = upper({_LETTERS}) then 'upper' when {_LETTERS} = lower({_LETTERS}) then 'lower'"
    " when len(list_filter(string_split_regex(w, '\\s+'), lambda x: regexp_matches(x, '^\\p{L}') and not regexp_matches(x, '^\\p{Lu}'))) = 0 then 'title' else 'mixed' end"
)


@query(f"select doc_id, w as word, {_SHAPE} as shape from (select doc_id, split_part(text, ' ', 1) as w from documents where text is not null)")
def case_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part("text", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", word.alias("word"), shapes.case_shape(word).alias("shape"))


@query("select doc_id, mark_id, seg_ord::int as seg_ord, start::int as start, (start + 3)::int as \"end\" from (select o_custkey as doc_id, 1 as mark_id, o_orderkey % 100000 as seg_ord, 2 as start, min(o_orderkey % 100000) over (partition by o_custkey) as m from orders where o_orderkey % 2 = 0) where seg_ord <> m")
def markup_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value marked in a customer's first even order is found in the other even ones, not inside longer words."""
    segments = table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "cast(o_orderkey % 100000 as int) as seg_ord", "case when o_orderkey % 2 = 0 then 'a abc d' else 'abcd xabc' end as text")
    marks = segments.where("text = 'a abc d'").groupBy("doc_id").agg(F.min("seg_ord").alias("seg_ord")).select("doc_id", F.lit(1).alias("mark_id"), "seg_ord", F.lit(2).alias("start"), F.lit("abc").alias("value"))
    return review.spread(marks, segments, segments.limit(0).selectExpr("doc_id", "seg_ord", "0 as start", "0 as end"))


_SESSIONS = "(select user_id, min(ts) as created_at, max(ts) as last from events group by user_id)"


@query(f"select cast(user_id as varchar) as session_id from {_SESSIONS} where created_at + interval 24 hour > (select max(ts) from events)")
def session_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    rows = events.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.min("ts").alias("created_at")).withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(24)))
    return sessions.purge_expired(rows, now).select("session_id")


@query("select event_id from events where user_id not in (select user_id from events where event_type = 'purchase')")
def orphan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id"))
    return sessions.orphans(events, events.where("event_type = 'purchase'")).select("event_id")


@query("select count(distinct user_id) as sessions, count(*) as entries, min(ts) as oldest from events where ts >= (select max(ts) from events) - interval 7 day")
def markup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    now = F.lit(events.agg(F.max("created_at")).first()[0])
    return sessions.markup_summary(sessions.purge_markup(events, now, 7))


@query("select o_custkey::varchar as session_id, '[PHONE_1]' as token, 'v' || min(o_orderkey % 5) as original_text, count(*) as n from orders group by o_custkey")
def session_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens encrypted into sessions and read back."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("v"), F.min(F.col("o_orderkey") % 5).cast("string")).alias("original_text"), F.count(F.lit(1)).alias("n"))
    entries = rows.select("doc_id", F.lit("[PHONE_1]").alias("token"), F.lit("PHONE").alias("entity_type"), "original_text", F.lit(None).cast("string").alias("canonical"), F.array("original_text").alias("occurrences"), "n")
    key, now = F.lit("0123456789abcdef").cast("binary"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    return sessions.load_sessions(sessions.save_sessions(entries, key, now), key, now).select("session_id", "token", "original_text", "n")


@query("select quality, toxic, count(*) as n, count(*) filter (regexp_matches(text, '" + EMAIL + "')) as with_email from documents join labels using (doc_id) group by all")
def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").rlike(EMAIL).cast("long")).alias("with_email"))


@query("select event_type, time_bucket(interval 1 hour, ts) as window_start, count(*) as n from events group by all")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.counts_by_window(table(spark, sf_dir, "events"))


@query("with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as f from events), n as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as i from m) select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from n group by user_id, i")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions_by_gap(table(spark, sf_dir, "events"))


# --- the layers that need a lexicon, layout repair and noise: SQL states what built lines must give ---------------------


@query(
    "select c_custkey::bigint as doc_id, '[ORG_1] в лице директора [PERSON_1], ИНН [INN_1]' || chr(10) || 'адрес: [ADDRESS_1], тел. [PHONE_1]' || chr(10) || '[ORG_1] обязуется уплатить [SUM_1] [PERSON_1] [TERM_1]' || chr(10) || 'р/с [ACCOUNT_1]' as rendered from customer"
)
def contract_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built contract per customer through the whole detection, resolution and masking."""
    customers = table(spark, sf_dir, "customer")
    inn = checks.make_inn10(_nine("c_custkey"))
    segments = built(
        customers, F.col("c_custkey"), F.concat(F.lit("ООО «Ромашка» в лице директора Иванова Ивана Ивановича, ИНН "), inn), F.lit("адрес: 125009, г. Москва, ул. Тверская, д. 5, кв. 12, тел. +7 (495) 123-45-67"),
        F.lit("Ромашка обязуется уплатить 12 500 руб. Иванову в течение 5 дней"), F.concat(F.lit("р/с 4070281090\n"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")),
    )
    return detection.mask(segments)[0]


@query(
    "with t as (select s_suppkey::bigint as doc_id, 'ООО «Вектор», генеральный директор Петров П.С.' as a, 'Вектор и Петрова согласны, Исполнитель (далее «Сторона») тоже' as b from supplier),"
    " v as (select doc_id, unnest([{'o': 0, 'x': 'ООО «Вектор»', 'k': 'ORG', 'g': 'org:вектор'}, {'o': 0, 'x': 'Петров П.С.', 'k': 'PERSON', 'g': 'per:0'}, {'o': 1, 'x': 'Вектор', 'k': 'ORG', 'g': 'org:вектор'}, {'o': 1, 'x': 'Петрова', 'k': 'PERSON', 'g': 'per:0'}, {'o': 1, 'x': 'Сторона', 'k': 'ROLE_TERM', 'g': null}], recursive := true), a, b from t)"
    " select doc_id, o as seg_ord, (instr(case o when 0 then a else b end, x) - 1)::int as start, (instr(case o when 0 then a else b end, x) - 1 + length(x))::int as \"end\", x as original_text, k as entity_type, g as group_key from v"
)
def people_and_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = built(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.lit("ООО «Вектор», генеральный директор Петров П.С."), F.lit("Вектор и Петрова согласны, Исполнитель (далее «Сторона») тоже"))
    views = normalize.with_view(segments)
    return resolve.as_entities(structural.detect_structural(views)).unionByName(resolve.as_entities(structural.detect_barriers(views))).select("doc_id", "seg_ord", "start", "end", "original_text", "entity_type", "group_key")


@query(
    "select s_suppkey::bigint as doc_id, 0 as seg_ord, 7 as start, length(t)::int as \"end\", substr(t, 8) as original_text from (select s_suppkey, 'Адрес: 125009, г. Москва, ул. Тверская, д. ' || s_suppkey || ', кв. 7' as t from supplier)"
)
def postal_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = built(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.concat(F.lit("Адрес: 125009, г. Москва, ул. Тверская, д. "), F.col("s_suppkey").cast("string"), F.lit(", кв. 7")), F.lit("улица без номера"))
    return address.detect_addresses(normalize.with_view(segments)).select("doc_id", "seg_ord", "start", "end", "original_text")


@query(
    f"select c_custkey::bigint as doc_id, 0 as seg_ord, 4 as start, 15 as \"end\", substr({_INN10}, 1, 5) || chr(9) || substr({_INN10}, 6) as original_text, 'INN' as entity_type from customer"
)
def layout_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number torn by a tab inside its digits, behind its anchor."""
    inn = checks.make_inn10(_nine("c_custkey"))
    segments = built(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.concat(F.lit("ИНН "), F.substring(inn, 1, 5), F.lit("\t"), F.substring(inn, 6, 5)))
    before = resolve.as_entities(patterns.detect_patterns(normalize.with_view(segments)))
    return repair.repair(segments, before).select("doc_id", "seg_ord", "start", "end", "original_text", "entity_type")


@query()
def noise_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of anchored numbers distorted by each kind of noise, how many are still found."""
    base = dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", checks.make_inn10(_nine("c_custkey")).alias("inn"))
    kinds = list(perturb.NOISE)
    noisy = base.select(F.col("c_custkey").cast("bigint").alias("doc_id"), F.posexplode(F.array(*[F.concat(F.lit("ИНН "), f(F.col("inn"), F.col("c_custkey"))) for f in perturb.NOISE.values()])).alias("seg_ord", "text"))
    hits = found(noisy, "INN").select("doc_id", "seg_ord").distinct().withColumn("hit", F.lit(1))
    names = F.array(*map(F.lit, kinds))
    return noisy.join(hits, ["doc_id", "seg_ord"], "left").groupBy(F.element_at(names, F.col("seg_ord") + 1).alias("noise")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"))


@query()
def structural_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records of every word of every line of documents: shapes and hidden context, no value."""
    segments = texts.lines(table(spark, sf_dir, "documents"))
    words = dealt(segments, "doc_id", "seg_ord").select("doc_id", "seg_ord", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    before = Window.partitionBy("doc_id", "seg_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = words.withColumn("end", (F.sum(F.length("word")).over(before) + F.col("pos")).cast("int")).where("word <> ''")
    marks = placed.select("doc_id", "seg_ord", (F.col("end") - F.length("word")).alias("start"), "end", F.lit("missed").alias("kind"))
    return review.build_records(marks, segments).select("doc_id", "kind", F.to_json("record").alias("record"))


@query("select doc_id, lower(regexp_extract(text, '[A-Za-z]+')) as word from documents where text is not null and regexp_matches(text, '[A-Za-z]')")
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").where(F.col("text").rlike("[A-Za-z]"))
    return docs.select("doc_id", folds.plain_letters(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("word"))


@query("select doc_id, word, shape, count(*) as n from (" + SQL["case_shapes"].replace("split_part(text, ' ', 1) as w", "unnest(string_split(text, ' ')) as w") + ") group by all")
def case_shapes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of all words of whole texts; case_shapes has the first words only, as its SQL states."""
    words = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", " ", -1)).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "word", shapes.case_shape(F.col("word")).alias("shape"), "n")


@query("select doc_id, lower(w) as word, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents) group by all")
def folded_words_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of Latin letters of whole texts, folded; folded_words has the first ones only, as its SQL states."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("doc_id", folds.plain_letters(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select o_orderkey, w as value, {_SHAPE} as shape from (select o_orderkey, case o_orderkey % 5 when 0 then 'Иванов Иван ' || o_orderkey when 1 then upper('Иванов Иван') when 2 then 'иванов иван' when 3 then '«Ромашка» Плюс' else 'Иванов иван' end as w from orders)")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of whole values: every word that begins with a letter must begin with a capital to make a title."""
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, F.concat(F.lit("Иванов Иван "), F.col("o_orderkey").cast("string"))).when(k == 1, "ИВАНОВ ИВАН").when(k == 2, "иванов иван").when(k == 3, "«Ромашка» Плюс").otherwise("Иванов иван")
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), shapes.case_shape(value).alias("shape"))


@query(
    "select s_suppkey::bigint as doc_id, k::int as seg_ord, d as detection_text from (select s_suppkey, unnest([0, 1, 2, 3, 4]) as k from supplier) join (values (0, 'Петров Пётр Петрович'), (1, 'Подписал Крылова Е. П.'), (2, 'ИП Пирогова А.С.'), (3, null), (4, 'иванов Петрова')) v(i, d) on i = k"
)
def case_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies for detection of lines in capitals, in small letters and in odd case; an abbreviation among words stays."""
    lines = ("ПЕТРОВ ПЁТР ПЕТРОВИЧ", "Подписал КРЫЛОВА Е. П.", "ип пирогова а.с.", "код ОКВЭД и ООО «Ромашка»", "иванов пЕтРоВа")
    segments = built(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), *map(F.lit, lines))
    return casing.with_detection_text(segments).select("doc_id", "seg_ord", "detection_text")


@query(
    f"with {_GOLD}, {_MASKS}, {_UNION}, edges as (select g.doc_id, g.s, g.e, g.t, i.s as a, i.e as b from (select distinct * from gold) g left join islands i on i.doc_id = g.doc_id and i.s < g.e and i.e > g.s),"
    " cuts as (select doc_id, s, e, t, s as p, coalesce(min(a), e) as q from edges group by all union all select doc_id, s, e, t, b, coalesce(lead(a) over (partition by doc_id, s, e, t order by a), e) from edges where b is not null)"
    ' select doc_id, s as start, e as "end", t as type, p::int as piece_start, q::int as piece_end from cuts where p < q'.replace("group by all union", "group by doc_id, s, e, t union")
)
def uncovered_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of gold values that no mask covers."""
    return metrics.uncovered_pieces(_gold(spark, sf_dir), _masks(spark, sf_dir))


_LIVES = "(select user_id, min(ts) as created_at, min(ts) + interval 24 hour as expires_at from events group by user_id)"


@query(f"select cast(user_id as varchar) as session_id from {_LIVES} where expires_at > (select min(ts) + (max(ts) - min(ts)) / 2 from events) or user_id = 1")
def session_purge_midway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are alive in the middle of the recorded time, and the one to keep."""
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    rows = _lives(events)
    return sessions.purge_expired(rows, F.lit(low + (high - low) / 2), keep="1").select("session_id")


def _lives(events: DataFrame) -> DataFrame:
    rows = events.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.min("ts").alias("created_at"))
    return rows.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(24)))


@query(f"select cast(l.user_id as varchar) as session_id, created_at, expires_at, coalesce(n, 0)::bigint as n_tokens from {_LIVES} l left join (select user_id, count(*) as n from events where event_type = 'purchase' and event_id % 2 = 0 group by user_id) p on p.user_id = l.user_id where l.user_id % 3 <> 0")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of sessions with their numbers of tokens, after some were deleted."""
    events = table(spark, sf_dir, "events")
    entries = events.where("event_type = 'purchase' and event_id % 2 = 0").select(F.col("user_id").cast("string").alias("session_id"))
    gone = events.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("session_id"))
    return sessions.list_sessions(sessions.delete_session(_lives(events), gone), entries)


@query("select event_id from events where user_id not in (select user_id from events where event_id % 50 = 0)")
def orphans_of_kept_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id"))
    return sessions.orphans(events, events.where("event_id % 50 = 0")).select("event_id")


@query("select c_custkey, 9 as offset_1, 17 + length(cast(c_custkey as varchar)) as offset_2 from customer")
def segment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line begins in the assembled text: line ends count."""
    segments = built(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit("Договор "), F.concat(F.lit("номер "), F.col("c_custkey").cast("string"), F.lit(".")), F.lit("конец"))
    placed = tokens.segment_offsets(segments).groupBy("doc_id").pivot("seg_ord", [1, 2]).agg(F.first("offset"))
    return placed.select(F.col("doc_id").alias("c_custkey"), F.col("1").cast("int").alias("offset_1"), F.col("2").cast("int").alias("offset_2"))


@query("select line, key, metric, baseline, current from (select 'leaks' as line, l_returnflag as key, 'n' as metric, (count(*) filter (l_linenumber = 1))::double as baseline, (count(*) filter (l_linenumber <= 2))::double as current from lineitem group by l_returnflag) where current > baseline union all select 'purchases', event_type, 'rows', 0.0::double, count(*)::double from events where value > 50 group by event_type")
def gate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of the gate together: counts that may not rise, and rows that may not be there."""
    count = lambda df: df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    items = table(spark, sf_dir, "lineitem")
    risen = gate.compare(count(items.where("l_linenumber = 1")), count(items.where("l_linenumber <= 2")), "l_returnflag", {"n": ("down", 0.0)}, "leaks")
    return gate.evaluate(risen, gate.must_be_empty(table(spark, sf_dir, "events").where("value > 50"), "purchases", "event_type"))


@query("select 'baseline' as side, p_partkey as id from part where p_size < 10 and p_partkey % 2 = 0 union all select 'ledger', p_partkey from part where p_size >= 10 and p_partkey % 7 = 0")
def gate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a baseline and its ledger don't share."""
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    both = "(p_size < 10 and p_partkey % 2 = 1)"
    return gate.same_ledger(part.where(f"{both} or (p_size < 10 and p_partkey % 2 = 0)").select("id"), part.where(f"{both} or (p_size >= 10 and p_partkey % 7 = 0)").select("id")).select("side", "id")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'SUM' else 'PHONE' end as entity_type, (case when o_orderkey % 3 = 1 then 1 else 0 end)::int as start, substr('абвгд' || o_orderkey, case when o_orderkey % 3 = 1 then 2 else 1 end, 3) as original_text from orders where o_orderkey % 3 <> 2")
def marks_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that change a type, move a boundary or take a mask away; a moved mask takes the text that it covers."""
    orders = table(spark, sf_dir, "orders")
    segments = orders.selectExpr("o_orderkey as doc_id", "0 as seg_ord", "concat('абвгд', o_orderkey) as text")
    tokened = orders.selectExpr("o_orderkey as doc_id", "0 as seg_ord", "0 as start", "3 as end", "'абв' as original_text", "'PHONE' as entity_type", "'[PHONE_1]' as token")
    kinds = "case o_orderkey % 3 when 0 then 'type' when 1 then 'boundary' else 'false_mask' end"
    marks = orders.selectExpr("o_orderkey as doc_id", "0 as seg_ord", "0 as start", "3 as end", f"{kinds} as kind", "1 as created_at", "'SUM' as new_type", "1 as new_start", "4 as new_end")
    return review.apply_marks(tokened, marks, segments).select(F.col("doc_id").alias("o_orderkey"), "entity_type", "start", "original_text")


@query("select c_custkey, t as type, s as status from customer, (values ('INN', 'full'), ('ADDRESS', 'partial'), ('EMAIL', 'none'), ('BIRTHDATE', 'full'), ('PERSON', 'partial')) v(t, s)")
def leak_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each type's own rule says of a value against a text in which parts of it are left open."""
    inn = checks.make_inn10(_nine("c_custkey"))
    cases = [("INN", inn, F.concat(F.lit("№ "), inn)), ("ADDRESS", F.lit("г. Москва, ул. Тверская"), F.lit("на Тверской улице в тверская")), ("EMAIL", F.lit("abcdef@mail.ru"), F.lit("[EMAIL_1]")), ("BIRTHDATE", F.lit("01.02.1980"), F.lit("01/02/1980")), ("PERSON", F.lit("Иванов Пётр"), F.lit("пётр пришёл"))]
    rows = F.array(*[F.struct(F.lit(t).alias("type"), v.alias("value"), a.alias("open_text")) for t, v, a in cases])
    each = dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.inline(rows))
    return each.select("c_custkey", "type", metrics.leak_status(F.col("type"), F.col("value"), F.col("open_text")).alias("status"))


@query("select c_custkey::bigint as doc_id, 0 as seg_ord, 12 as start, 26 as \"end\", 'ИП Петров П.П.' as original_text from customer")
def sole_traders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sole trader's form and the name behind it make one organisation."""
    segments = built(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit("заключили с ИП Петров П.П. договор"))
    people = resolve.as_entities(structural.detect_structural(normalize.with_view(segments)))
    return structural.merge_compounds(people, segments).where("entity_type = 'ORG'").select("doc_id", "seg_ord", "start", "end", "original_text")
