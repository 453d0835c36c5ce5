"""Detection, conflicts, restoration and files on small examples."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import checks, shapes
from maskwright.functions.lexicon import Lexicon
from maskwright.operators import address, boundary, metrics, multispan, normalize, patterns, resolve, restore, review, structural, tokens
from maskwright.operators.repair import heal
from maskwright.plans import detection, rules
from maskwright.sources import ooxml, texts


def segments(spark, *rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id bigint, seg_ord int, text string")


def values(spark, text, *types):
    found = patterns.detect_patterns(normalize.with_view(segments(spark, text)), tuple(r for r in rules.RULES if not types or r.type in types))
    return sorted((r.entity_type, r.original_text) for r in found.collect())


@pytest.mark.parametrize(
    ("text", "norm"),
    [
        ("770708З893", "7707083893"), ("7707-083-893", "7707083893"), ("12 34 56 78", "12345678"), ("12 000 000", "12 000 000"), ("5()", "50"), ("п()", "п()"), ("Mосква", "Москва"),
        ("12.03.2О23", "12.03.2023"), ("ООО Ромашка", "ООО Ромашка"), ("7​707", "7707"), ("8\u00a0495", "8495"), ("", ""),
    ],
)
def test_normalize(text, norm):
    got, at = normalize.normalize(text)
    assert got == norm
    assert at == sorted(set(at)) and len(at) == len(got)


def test_view_is_the_text_itself_where_nothing_changes(spark):
    rows = normalize.with_view(segments(spark, "обычный текст", "plain text 12", None)).orderBy("seg_ord").collect()
    assert [(r.norm, r.omap) for r in rows] == [("обычный текст", None), ("plain text 12", None), ("", None)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("ИНН 7707083893", [("INN", "7707083893")]), ("ИНН 7707083894", [("INN", "7707083894")]), ("7707083893", [("INN", "7707083893")]), ("7707083894", []),
        ("артикул 7707083893", []), ("7707083893 5", []), ("КПП 770701001", [("KPP", "770701001")]), ("770701001", []), ("почта a.b@c.ru", [("EMAIL", "a.b@c.ru")]),
        ("СНИЛС 112-233-445 95", [("SNILS", "112-233-445 95")]), ("влажность 14 %", []), ("под 14 % годовых", [("PERCENT", "14 % годовых")]),
        ("паспорт качества 45 08 123456", []), ("паспорт 45 08 123456", [("PASSPORT", "45 08 123456")]), ("транш «Первый»", [("TRANCHE", "транш «Первый»")]),
    ],
)
def test_patterns(spark, text, found):
    assert [v for v in values(spark, text) if v[0] != "CLAUSE_REF"] == found


def test_offsets_count_code_points(spark):
    found = patterns.detect_patterns(normalize.with_view(segments(spark, "😀😀 a@b.ru")))
    assert [(r.start, r.end, r.original_text) for r in found.collect()] == [(3, 9, "a@b.ru")]


def test_multispan_guards(spark):
    assert multispan.find("р/с 4070281090\n0000012345")[0][:3] == (4, 25, "BANK_ACCOUNT")
    assert multispan.find("ОГРН 1027700132195\n15") == []  # one side is whole
    assert multispan.find("ИНН 77070\n83894") == []  # wrong control digit
    assert multispan.find("8 (900) 123-45-67")[0][2] == "PHONE"
    assert multispan.find("+7 900 1234567")[0] == (0, 14, "PHONE", [(0, 2), (3, 6), (7, 14)])  # the sign belongs to it
    assert multispan.find("Дата рождения: 01.\n02.1980")[0] == (15, 26, "BIRTHDATE", [(15, 18), (19, 26)])
    assert multispan.find("ИНН 77070\n83893") == [(4, 15, "INN", [(4, 9), (10, 15)])]
    assert multispan.find("слоО 12") == [] and multispan.find("") == []


def entity(i, start, end, kind, detector, text=None):
    return (1, 0, i, start, end, text or "x" * (end - start), kind, detector, 1.0, None, None)


def settled(spark, *rows):
    df = spark.createDataFrame(list(rows), resolve.ENTITY)
    return sorted((r.start, r.end, r.entity_type) for r in resolve.resolve_overlaps(df).collect())


def test_conflicts(spark):
    assert settled(spark, entity(0, 4, 13, "KPP", "regex"), entity(1, 4, 13, "BIK", "regex")) == [(4, 13, "BIK")]
    assert settled(spark, entity(0, 0, 6, "PERSON", "ner"), entity(1, 4, 12, "INN", "regex"), entity(2, 10, 16, "ORG", "ner")) == [(0, 4, "PERSON"), (4, 12, "INN"), (12, 16, "ORG")]
    assert (12, 16, "ADDRESS") in settled(spark, entity(0, 0, 6, "PERSON", "ner"), entity(1, 4, 10, "ORG", "ner"), entity(2, 12, 16, "ADDRESS", "ner"))
    assert settled(spark, entity(0, 0, 9, "PERSON", "ner", "Московски"), entity(1, 0, 6, "ADDRESS", "ner")) == [(0, 6, "ADDRESS"), (6, 9, "PERSON")]


def test_undeclared_types_fail(spark):
    df = spark.createDataFrame([entity(0, 0, 3, "NOPE", "regex")], resolve.ENTITY)
    with pytest.raises(Exception, match="no token prefix"):
        tokens.assign_tokens(df).collect()


def test_profiles():
    assert rules.resolve_profile("maximum") is None
    assert "ORG" not in rules.resolve_profile("personal") and "ORG" in rules.resolve_profile("personal", {"ORG": True})
    assert rules.resolve_profile("nonsense") == rules.resolve_profile("personal")
    rules.check_ranks()
    with pytest.raises(ValueError, match="no rank"):
        rules.check_ranks(("INN",))
    with pytest.raises(ValueError, match="form"):
        rules.compile_form("X", kind="other")
    assert rules.compile_form("X", kind="digit_run", digits=(3, 5)).pattern


CONTRACT = (
    "ООО «Ромашка» в лице директора Иванова Ивана Ивановича, ИНН 7707083893", "адрес: 125009, г. Москва, ул. Тверская, д. 5, кв. 12", "Ромашка уплатит 12 500 руб. Иванову", "р/с 4070281090\n0000012345",
)


def test_whole_way_and_back(spark):
    source = segments(spark, *CONTRACT)
    masked, tokened = detection.mask(source)
    text = masked.first().rendered
    for open_value in ("Ромашка", "Иванов", "7707083893", "Тверская", "12 500", "4070281090"):
        assert open_value not in text
    assert text.count("[ORG_1]") == 2 and text.count("[PERSON_1]") == 2
    back = restore.restore(masked.withColumnRenamed("rendered", "text"), restore.session_of(tokened), "exact").first()
    assert back.restored == "\n".join(CONTRACT) and back.unresolved == []


def test_profile_moves_no_other_mask(spark):
    source = segments(spark, *CONTRACT)
    every = {(r.seg_ord, r.start, r.end, r.entity_type) for r in detection.mask(source)[1].collect()}
    some = {(r.seg_ord, r.start, r.end, r.entity_type) for r in detection.mask(source, rules.resolve_profile("personal"))[1].collect()}
    assert some < every and not any(t == "SUM" for *_, t in some)


def test_unknown_tokens_are_listed_once(spark):
    session = spark.createDataFrame([(1, "[INN_1]", "77", None, ["77", "7 7"])], "doc_id int, token string, original_text string, canonical string, occurrences array<string>")
    text = spark.createDataFrame([(1, "[INN_1] [X_2] [INN_1] [X_2] [INN_1]")], "doc_id int, text string")
    row = restore.restore(text, session, "exact").first()
    assert row.restored == "77 [X_2] 7 7 [X_2] 7 7" and row.unresolved == ["[X_2]"]


def test_people_and_organisations():
    lex = Lexicon()
    assert [p[3] for p in structural.find_people("директор Петров П.С. и Иванова Анна Сергеевна", lex)] == ["Петров П.С.", "Иванова Анна Сергеевна"]
    assert structural.find_organisations("«Сторона» и ПАО «Вектор Север»", lex)[0][3] == "Вектор Север"
    book = structural.Book()
    assert book.number(("петров", "П", "С")) == book.number(("петров", "павл", "сергеевич")) != book.number(("петров", "иван"))


def test_addresses():
    lex = Lexicon()
    text = "по адресу: 125009, г. Москва, ул. Тверская, д. 5, кв. 12, далее"
    assert [text[a:b] for a, b in address.find_addresses(text, lex)] == ["125009, г. Москва, ул. Тверская, д. 5, кв. 12"]
    assert address.find_addresses("в г. Москва состоялось", lex) == []


def test_heal():
    assert heal("77070\n83893")[0] == "7707083893"
    assert heal("слово\nСлово")[0] == "слово\nСлово"
    assert heal("а\n\nб")[0] == "а\n\nб"
    assert heal("И в а н о в")[0] == "Иванов"


def test_boundary_halves(spark):
    rows = boundary.boundary_entities(segments(spark, "р/с 4070281090", "0000012345 далее")).orderBy("seg_ord").collect()
    assert [(r.seg_ord, r.start, r.end, r.original_text) for r in rows] == [(0, 4, 14, "4070281090"), (1, 0, 10, "0000012345")]


def test_empty_segment_breaks_adjacency(spark):
    assert boundary.windows(segments(spark, "а", "", "б")).count() == 0


def test_shapes(spark):
    row = spark.range(1).select(*[shapes.case_shape(F.lit(v)).alias(k) for k, v in {"a": "ИНН", "b": "Иванов", "c": "дом", "d": "мОсква", "e": "123"}.items()], shapes.place_of(F.lit("header1:t0_r2_c1")).alias("p")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("upper", "title", "lower", "mixed", "no_letters")
    assert (row.p.container, row.p.row, row.p.col) == ("cell", 2, 1)


def test_records_hold_no_value(spark):
    source = segments(spark, "Договор с Ивановым от мая")
    mark = spark.createDataFrame([(1, 0, 10, 18, "missed")], "doc_id bigint, seg_ord int, start int, end int, kind string")
    record = str(review.build_records(mark, source).select("record").first())
    assert "Иванов" not in record and "Договор" not in record and "от" in record


def test_leaks(spark):
    status = lambda kind, text, left: spark.range(1).select(metrics.leak_status(F.lit(kind), F.lit(text), F.lit(left))).first()[0]
    assert status("INN", "7707083893", "[INN_1]") == "none"
    assert status("INN", "7707083893", "7707 083 893") == "full"
    assert status("INN", "7707083893", "77070838[INN_1]") == "partial"
    assert status("KPP", "341821013", "18210101011011000110") == "none"  # part of a longer other number
    assert status("PERSON", "Иванов Иван", "и Иванов тут") == "partial"
    assert status("EMAIL", "ivan@mail.ru", "x ivan@mail.ru") == "full"
    assert status("BIRTHDATE", "01.02.1980", "01/02/1980") == "full"


def docx(body, **parts):
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml.format(w=w))
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_docx_segments_and_zones():
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    data = docx(p("раз", " два") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>", header1="<w:hdr {w}>" + p("верх") + "</w:hdr>", footnotes="<w:footnotes {w}><w:footnote>" + p("сноска") + "</w:footnote></w:footnotes>")
    assert [(s["seg_id"], s["text"]) for s in ooxml.segments_of(data)] == [("p0", "раз два"), ("t0_r0_c0", "a"), ("t0_r0_c1", "b"), ("header1:p0", "верх")]
    assert [(z["kind"], z["text"]) for z in ooxml.zones_of(data)] == [("footnote", "сноска")]
    with pytest.raises(ValueError, match="archive"):
        ooxml.segments_of(b"no zip")


def test_docx_restore_over_split_runs():
    data, n, unknown = ooxml.restore_file(docx(p("ИНН [IN", "N_1", "] и [X_9]")), ".docx", {"[INN_1]": "77\n07"})
    assert ooxml.segments_of(data)[0]["text"] == "ИНН 77 07 и [X_9]" and n == 1 and unknown == ["[X_9]"]


def test_docx_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(p("раз")))
    (tmp_path / "b.docx").write_bytes(b"broken")
    found, zones, refused = ooxml.read_docx_files(spark, str(tmp_path))
    assert [r.text for r in found.collect()] == ["раз"] and zones.count() == 0 and refused.count() == 1


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("раз\r\nдва\n".encode("cp1251"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + "три".encode())
    (tmp_path / "c.txt").write_bytes(b"\x00\x01\x02\x03")
    (tmp_path / "d.bin").write_bytes(b"x")
    found, refused = texts.read_text_files(spark, str(tmp_path))
    assert sorted(r.text for r in found.collect()) == ["два", "раз", "три"]
    assert sorted(r.reason for r in refused.collect()) == ["unreadable", "unsupported"]


def test_control_digits(spark):
    row = spark.range(1).select(checks.make_inn10(F.lit("770708389")).alias("a"), checks.make_ogrn13(F.lit("102770013219")).alias("b"), checks.make_snils(F.lit("112233445")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("7707083893", "1027700132195", "11223344595")


def test_case_repair(spark):
    from maskwright.operators import casing

    cases = {
        "иванов иван иванович": "Иванов Иван Иванович",
        "(1) иванов иван": "(1) Иванов Иван",
        "ип пирогова а.с.": "ИП Пирогова А.С.",
        "МОСКВА ЛЕНИНА 47/3 КВ 67": "Москва Ленина 47/3 КВ 67",
        "Подписал КРЫЛОВА Е. П.": "Подписал Крылова Е. П.",
        "иванов пЕтРоВа": "иванов Петрова",
        "код ОКВЭД и ООО «Ромашка»": None,
        "ПЕТРОВА АННА 04Ч525ЗбО": "Петрова Анна 04Ч525ЗбО",
        "«25» мая 2023 г.": None,
        "Обычный текст": None,
        "слово " * 40: None,
        "": None,
    }
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(cases)] + [(99, 0, "иBан"), (99, 1, "петров пётр"), (99, 2, "1. петров пётр"), (100, 0, None)], "doc_id bigint, seg_ord int, text string")
    got = {(r.doc_id, r.seg_ord): r.detection_text for r in casing.with_detection_text(rows).collect()}
    assert [got[i, 0] for i in range(len(cases))] == list(cases.values())
    assert got[99, 1] is None and got[99, 2] == "1. Петров Пётр" and got[100, 0] is None


def test_shapes_of_whole_values(spark):
    values = {"Иванов Иван": "title", "ИВАНОВ ИВАН": "upper", "иванов": "lower", "Иванов иван": "mixed", "«Ромашка» Плюс": "title", "И.": "upper", "12": "no_letters", "Мак-Дональд": "title"}
    row = spark.range(1).select(*[shapes.case_shape(F.lit(v)).alias(f"c{i}") for i, v in enumerate(values)], shapes.token_shapes(F.lit("Иванов И.И. ООО")).alias("t")).first()
    assert list(row)[:-1] == list(values.values())
    assert [t.initial for t in row.t] == [False, True, False]


def test_leaks_and_open_pieces(spark):
    from maskwright.operators import metrics

    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    row = spark.range(1).select(
        metrics.leak_by_position(F.lit("12 34"), a("12")), metrics.leak_by_position(F.lit("12 34"), a("12 3", "4")), metrics.leak_by_position(F.lit("12"), a()), metrics.leak_by_position(F.lit("аб"), a("б")),
        metrics.adjacent_open(F.lit("7707083893"), a("7707", "08", "99")), metrics.leak_address(F.lit("125009, г. Москва, ул. Тверская"), F.lit("улица Тверской и 125009"))["status"],
        metrics.round_trip_kept(F.lit("a b"), F.lit("a\nb")), metrics.round_trip_kept(F.lit("a"), F.lit(None)),
    ).first()
    assert list(row) == ["partial", "full", "none", "full", 6, "partial", True, False]
    gold = spark.createDataFrame([(1, 0, 10, "INN"), (1, 20, 25, "INN"), (2, 0, 4, "INN")], "doc_id bigint, start int, end int, type string")
    masks = spark.createDataFrame([(1, 2, 4, "INN"), (1, 3, 6, "KPP"), (1, 8, 12, "INN"), (1, 19, 30, "INN")], "doc_id bigint, start int, end int, type string")
    assert sorted((r.doc_id, r.piece_start, r.piece_end) for r in metrics.uncovered_pieces(gold, masks).collect()) == [(1, 0, 2), (1, 6, 8), (2, 0, 4)]


def test_sole_traders_and_profiles(spark):
    from maskwright.plans import detection

    rows = spark.createDataFrame([(1, 0, "Договор заключён с ИП Петров Пётр Петрович и ИП Сидоров С.С."), (2, 0, "ПЕТРОВ ПЁТР ПЕТРОВИЧ подписал")], "doc_id bigint, seg_ord int, text string")
    found = detection.run_detection(rows, seams=False)
    orgs = sorted(r.original_text for r in found.where("entity_type = 'ORG'").collect())
    assert orgs == ["ИП Петров Пётр Петрович", "ИП Сидоров С.С."]
    assert [r.original_text for r in found.where("doc_id = 2 and entity_type = 'PERSON'").collect()] == ["ПЕТРОВ ПЁТР ПЕТРОВИЧ"]
    people_only = detection.mask(rows, enabled=frozenset({"PERSON"}), seams=False)[0].collect()
    assert {r.doc_id: r.rendered for r in people_only} == {1: "Договор заключён с ИП [PERSON_1] и ИП [PERSON_2]", 2: "[PERSON_1] подписал"}


def test_moved_marks_take_the_text_they_cover(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, "абв", "ORG", "[ORG_1]")], "doc_id bigint, seg_ord int, start int, end int, original_text string, entity_type string, token string")
    marks = spark.createDataFrame([(1, 0, 0, 3, "boundary", 1, None, 0, 5)], "doc_id bigint, seg_ord int, start int, end int, kind string, created_at int, new_type string, new_start int, new_end int")
    segs = spark.createDataFrame([(1, 0, "абвгд е")], "doc_id bigint, seg_ord int, text string")
    r = review.apply_marks(rows, marks, segs).first()
    assert (r.start, r.end, r.original_text, r.token) == (0, 5, "абвгд", "[ORG_1]")


def test_pieces_pass_the_resolver(spark):
    views = normalize.with_view(spark.createDataFrame([(1, 0, "тел. 8 (900) 123-45-67")], "doc_id bigint, seg_ord int, text string"))
    phones = resolve.as_entities(multispan.detect_multispan(views))
    rival = resolve.as_entities(spark.createDataFrame([(1, 0, 7, 0, 6, "тел. 8", "ORG", "ner", 0.5)], "doc_id bigint, seg_ord int, ent_seq bigint, start int, end int, original_text string, entity_type string, detector string, confidence double"))
    for found in (phones, phones.unionByName(rival)):
        settled = resolve.entity_spans(resolve.resolve_overlaps(found)).where("entity_type = 'PHONE'").first()
        assert [(p.s, p.e) for p in settled.pieces] == [(5, 6), (8, 11), (13, 22)]  # the view has no hyphens in numbers
