"""The rule table of the pattern layer, type policy, and the ranks of types.

A rule's value is found by one pattern of three parts, ``before``, ``value`` and ``after``; only the
value is masked. ``anchor`` confirms a value from the 40 characters to its left, ``veto`` and
``veto_right`` cancel values that no anchor confirms.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ----- fixed values: forms, anchors and disqualifiers that results depend on ---------------------

_GAP = r"[ \u00A0]?"
_CODES = (
    r"(?i)\bштрих\s*-?\s*код\w*|\bean\b|\bокпо\b|\bоктмо\b|\bокато\b|\bоквэд\b|\bокуд\b|\bкбк\b|код\w*\s+бюджетн\w*|\bинвентарн\w*|\bартикул\w*|\bуин\b"
)
_NOT_A_PASSPORT = (
    r"(?i)качеств\w*|издели\w*|объект\w*|сделк\w*|трансп\w*\s*средств\w*|самоходн\w*|техническ\w*|груз\w*|товар\w*|оборудован\w*|безопасност\w*|помещени\w*|проект\w*|здани\w*|сооружени\w*"
)
_NOT_A_PHONE = (
    r"(?i)лицев\w*\s+сч[её]т\w*|сч[её]т\w*\s+абонент\w*|заводск\w*\s+(?:номер\w*|№)|серийн\w*\s+(?:номер\w*|№)|исходящ\w*|инвентарн\w*|артикул\w*|накладн\w*|реестр\w*|зарегистрирован\w*|регистрационн\w*\s+номер\w*"
)
_NOT_A_SHARE = (
    r"(?i)влажност\w*|примес\w*|погрешност\w*|прибор\w*|уклон\w*|\bбрак\w*|жирност\w*|износ\w*|содержани\w*|концентрац\w*|иностранн\w*\s+участ\w*|предельн\w*\s+дол\w*\s+иностранн\w*"
)
_NOT_A_TERM = (
    r"(?i)годност\w*|хранени\w*|хранению|хранит\w*|выдержива\w*|выдержк\w*|исков\w*\s+давност\w*|осуществля\w*\s+деятельност\w*|работает\s+на\s+рынке|присутству\w*\s+на\s+рынке|отч[её]тн\w*\s+период\w*"
)
_NORM_TO_THE_RIGHT = r"(?i)(?:как\s+установлен\w*|в\s+силу|по\s+правилам|соглас\w*|предусмотрен\w*|в\s+соответствии\s+с[а-я]*)\s+(?:стать|п\.\s*\d+\s*стать|нормам?и?\s+стать)"
_ACCOUNT = r"(?i)(?:р\s*/\s*с|к\s*/\s*с|расч[её]тн\w*\s+сч[её]т\w*|лицев\w*\s+сч[её]т\w*|корреспондентск\w*\s+сч[её]т\w*|банковск\w*\s+сч[её]т\w*|сч[её]т\w*)"
_LOOKALIKE = "0-9ОоOoЗзЧчІіб"
_BORN = r"(?:дат[аыу]\s*рожд[а-я]*|года?\s*рождения|рожд(?:ени[а-я]*|\.))"
_BORN_YEAR = rf"[{_LOOKALIKE}](?:[ ]?[{_LOOKALIKE}]){{3}}"
_NUMERAL = (
    r"(?:ноль|один\w*|одна|одну|полтор\w+|дв[ае]|двух|тр[иеё]х?|четыр\w+|пят\w+|шест\w+|сем\w+|восем\w+|восьм\w+|девят\w+|десят\w+|одиннадцат\w*|двенадцат\w*|тринадцат\w*|четырнадцат\w*|пятнадцат\w*|шестнадцат\w*|семнадцат\w*|восемнадцат\w*|девятнадцат\w*|двадцат\w*|тридцат\w*|сорок\w*|девяност\w*|ст[оа]|двест[иа]|трист\w*|четырест\w*|тысяч\w*|миллион\w*|миллиард\w*)"
)
_MONTH = r"(?:январ\w*|феврал\w*|март\w*|апрел\w*|ма[йя]|июн\w*|июл\w*|август\w*|сентябр\w*|октябр\w*|ноябр\w*|декабр\w*)"
_ORDINAL = r"(?:перв|втор|треть|четв[ёе]рт|пят|шест|седьм|восьм|девят|десят|одиннадцат|двенадцат|тринадцат|четырнадцат|пятнадцат|шестнадцат|семнадцат|восемнадцат|девятнадцат|двадцат|тридцат)(?:ого|его)"
_YEAR = r"\d(?:[ ]?\d){3}"
_FEW = r"\d(?:[ ]?\d){0,3}"
_CONTRACT = r"(?:договор\w*|соглашени\w*|контракт\w*)"
_KINDS = r"(?:возмездного\s+оказания\s+услуг|оказания\s+услуг|поставки|подряда|субподряда|аренды|субаренды|займа|цессии|купли-продажи|мены|дарения|уступки\s+прав\w*(?:\s+требования)?|комиссии|поручения|хранения|перевозки|лизинга|страхования|коммерческой\s+концессии)"
_ISSUER = r"(?:УФМС|ФМС|МВД|УВД|ОВД|ПВС|ГУВД|отделом?\s+внутренних\s+дел|отделени\w*\s+по\s+вопросам\s+миграции|паспортн\w*\s+стол\w*)"
_TAX_OFFICE = r"(?:межрайонн\w+\s+)?(?:инспекци\w+\s+|управлени\w+\s+)?(?:ми?фнс|уфнс|ифнс|фнс)"
_REGION = r"по\s+(?:[^\n,;.]|(?<=\bг)\.|(?<=\bобл)\.|(?<=\bгор)\.|(?<=\bокр)\.|(?<=\bресп)\.){1,45}"


def _digits(n: int) -> str:
    return rf"\b\d(?:{_GAP}\d){{{n - 1}}}\b"


@dataclass(frozen=True)
class Rule:
    type: str
    value: str
    before: str = ""
    after: str = ""
    flags: str = "(?U)"
    check: str | None = None
    anchor: str | None = None
    veto: str | None = None
    veto_window: int = 20
    veto_right: str | None = None
    needs_digit: bool = True

    @property
    def pattern(self) -> str:
        """Groups: what stands before the value, the value, what follows."""
        return f"{self.flags}({self.before})({self.value})({self.after})"


_I = "(?iU)"
RULES: tuple[Rule, ...] = (
    Rule("INN", _digits(10), check="inn10", anchor="(?i)инн", veto=_CODES),
    Rule("INN_PERSON", _digits(12), check="inn12", anchor="(?i)инн", veto=_CODES),
    Rule("OGRN", rf"\b\d(?:{_GAP}\d){{12}}(?:(?:{_GAP}\d){{2}})?\b", check="ogrn", anchor="(?i)огрн", veto=_CODES),
    Rule("KPP", _digits(9), anchor="(?i)кпп"),
    Rule("KPP", rf"\d(?:{_GAP}\d){{8}}", before=rf"инн\s*/\s*кпп[^\n\d]{{0,15}}\d(?:{_GAP}\d){{9}}\s*/\s*", after=r"\b", flags=_I),
    Rule("BANK_ACCOUNT", _digits(20), anchor=_ACCOUNT),
    Rule("BIK", rf"\b0{_GAP}4(?:{_GAP}\d){{7}}\b", anchor=r"(?i)\bбик\b"),
    Rule("PASSPORT", r"\d{2}\s?\d{2}" + "[ \u00a0,]{0,2}№?\\.?[ \u00a0]{0,2}" + r"\d{6}", before=r"(?:паспорт|серия)[^\n\d]{0,40}", after=r"\b", flags=_I, veto=_NOT_A_PASSPORT),
    Rule("PASSPORT", r"\d{3}[- ]?\d{3}", before=r"код\s*(?:подраздел[а-я]*|подр)\.?[^\n\d]{0,25}", after=r"(?!\d)", flags=_I),
    Rule(
        "SNILS", r"\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}", after=r"(?!\d)", flags=_I,
        before=r"(?:снилс|страхов\w*\s+свидетельств\w*(?:\s+(?:государственного|обязательного)\s+пенсионного\s+страхования)?)[^\n\d]{0,30}",
    ),
    Rule("BIRTHDATE", rf"[{_LOOKALIKE}]{{1,2}}[.\/-][{_LOOKALIKE}]{{1,2}}[.\/-]{_BORN_YEAR}", before=rf"{_BORN}[^\n\d]{{0,35}}(?<![{_LOOKALIKE}])", after=r"(?!\d)", flags=_I),
    Rule("BIRTHDATE", rf"[{_LOOKALIKE}]{{1,2}}[.\/][{_LOOKALIKE}]{{1,2}}[.\/]{_BORN_YEAR}", before=rf"(?<![{_LOOKALIKE}])", after=r"\s*(?:г\.\s?р\.|г\.\s?рожд)", flags=_I),
    Rule("PHONE", r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", before=r"(?<!\d)", veto=_NOT_A_PHONE, veto_window=60),
    Rule("EMAIL", r"[\w\.-]+@[\w\.-]+\.\w+", needs_digit=False),
    Rule(
        "SUM", flags=_I,
        value="\\d[\\d\u00a0 ]*+(?:[.,]\\d+)?" + r"(?:\s?\([^)\n\d]{1,120}\))?(?:\s?(?:тысяч\w*|миллион\w*|миллиард\w*))?\s?(?:руб(?:лей|ля|\.)?|₽|USD|\$|долл(?:аров|\.)?)" + "(?:[ \u00a0]\\d{2}[ \u00a0]коп(?:еек|ейки|\\.)?)?(?![а-яА-ЯёЁ])",
    ),
    Rule(
        "SUM", flags=_I, before=r"(?<![-а-яё])", needs_digit=False,
        value=_NUMERAL + "(?:[ \u00a0-]+" + _NUMERAL + "){0,6}[ \u00a0]+(?:рубл\\w+|копе\\w+|долл\\w+)(?:[ \u00a0]+\\d{1,2}[ \u00a0]+копе\\w+)?(?![а-яё])",
    ),
    Rule(
        "PERCENT", flags=_I, before=r"(?<![\d.,])", veto=_NOT_A_SHARE, veto_window=60,
        value=rf"(?:{_FEW}\s*/\s*{_FEW}\s+ключевой\s+ставки(?:\s+ЦБ\s+РФ)?|{_FEW}(?:[.,]\d{{1,3}})?(?:\s*\([^)\n\d]{{1,60}}\))?\s*(?:%|процент\w*))(?:\s+годовых|\s+за\s+кажд\w+\s+день\s+просрочки|\s+от\s+[а-яёa-z]+(?:\s+[а-яёa-z]+){{0,2}}(?=[,.;:!?)\n]|\s*$))?",
    ),
    Rule(
        "TERM", flags=_I, veto=_NOT_A_TERM, veto_window=60, veto_right=_NORM_TO_THE_RIGHT, needs_digit=False,
        value=rf"(?:в\s+течение\s+(?:{_FEW}(?:\s*\([^)\n\d]{{1,40}}\))?|[а-яё]{{3,}}(?:\s+[а-яё]{{3,}})?)(?:\s+[а-яё]{{3,}})?\s+(?:дн\w*|месяц\w*|недел\w*|год\w*|лет|кварта\w*|час\w*)|не\s+позднее\s+{_FEW}\s?[./]\s?{_FEW}\s?[./]\s?\d(?:[ ]?\d){{3}})(?:\s+(?:с|со)\s+(?:дат\w+|момента|дня)\s+[^,.;:!?()\n\d]{{1,80}}?(?=[,.;:!?()\n]|$))?",
    ),
    Rule(
        "DATE", flags=_I, needs_digit=False,
        value=rf"(?:(?<!\d)(?<![\d][.\/])\d{{1,2}}[.\/]\d{{1,2}}[.\/]{_YEAR}(?!\d)|(?<![\w\d])[«\"“]?\d{{1,2}}[»\"”]?[ ]{{1,2}}{_MONTH}[ ]{{1,2}}{_YEAR}|(?<![\w\d])(?:(?:двадцать|тридцать)[ ]{{1,2}})?{_ORDINAL}[ ]{{1,2}}{_MONTH}(?:[ ]{{1,2}}(?:(?:две|двух)[ ]{{1,2}}тысяч[иа](?:[ ]{{1,2}}[а-яё]+){{1,3}}|{_YEAR}))?)(?:[ ]{{0,2}}г(?:ода|\.)(?![ ]?р\.))?",
    ),
    Rule("CLAUSE_REF", r"\d{1,3}(?:\.\d{1,3}){1,3}(?!\.?\d)", before=r"(?<!\d)"),
    Rule("CLAUSE_REF", r"\b(?:пункт\w*|раздел\w*|приложени\w*)\s*(?:№\s*)?\d{1,3}(?:\.\d{1,3}){0,3}\b", flags=_I),
    Rule("CONTRACT_KIND", rf"{_CONTRACT}\s+{_KINDS}", flags=_I, needs_digit=False),
    Rule("CONTRACT_KIND", r"(?:лицензионн|агентск|субагентск|абонентск|трудов|концессионн|учредительн|рамочн)\w*\s+договор\w*", flags=_I, needs_digit=False),
    Rule(
        "CONTRACT_NO", flags=_I, before=rf"{_CONTRACT}[^\n\d№n]{{0,25}}(?:№|номер\w*|\bn\b)\s*",
        value=r"(?!\d{11})(?=[0-9а-яёa-z/-]{0,25}\d)[0-9а-яёa-z][0-9а-яёa-z/-]{0,24}[0-9а-яёa-z]|[0-9]{1,2}(?!\d)",
    ),
    Rule("PASSPORT_ISSUER", rf"[^\n]{{0,30}}?{_ISSUER}[^\n\d]{{0,60}}?", before=r"выдан\w*\s*[:\-—]?\s*", after=r"(?=\s*(?:[,;]|\d|код\s+подразделен|\n|$)|\s*\.\s*(?:\n|$))", flags=_I, needs_digit=False),
    Rule("REGISTRY_NAME", rf"{_TAX_OFFICE}\s*(?:росси\w+\s*)?№\s?\d{{1,3}}(?:\s+{_REGION})?", flags=_I),
    Rule("REGISTRY_NAME", rf"{_TAX_OFFICE}\s+(?:росси\w+\s+)?{_REGION}", flags=_I, needs_digit=False),
    Rule("REG_ID", _digits(9), anchor=r"(?i)реестр\w*|регистрац\w*"),
    Rule("REG_NUMBER", r"\d{1,3}\s?/\s?\d{1,5}-н\s?/\s?\d(?:[ ]?\d){6,14}(?![\d/])", before=r"(?<![\d/])", flags=_I),
    Rule("SHARE_PCT", r"\d(?:[ ]?\d){0,2}(?:[.,]\d{1,2})?\s?(?:%|процент\w*)\s+(?:голос\w*(?:\s+от\s+общего\s+числа)?|(?:долей\s+)?(?:в\s+)?уставн\w+\s+капитал\w*|акци\w+)", before=r"(?<![\d.,])", flags=_I),
    Rule("TRANCHE", r"транш\w*\s*[«\"„][^»\"“\n]{1,60}[»\"“]", flags=_I, needs_digit=False),
)

#: Token prefix of every maskable type, in the order of the configuration.
PREFIXES = {
    "PERSON": "PERSON", "ORG": "ORG", "ADDRESS": "ADDRESS", "INN": "INN", "INN_PERSON": "INN_PER", "OGRN": "OGRN", "KPP": "KPP", "BANK_ACCOUNT": "ACCOUNT",
    "BIK": "BIK", "PASSPORT": "PASSPORT", "SNILS": "SNILS", "BIRTHDATE": "BIRTHDATE", "PHONE": "PHONE", "EMAIL": "EMAIL", "SUM": "SUM", "PERCENT": "PERCENT",
    "TERM": "TERM", "DATE": "DATE", "CONTRACT_KIND": "CTKIND", "CONTRACT_NO": "CONTRACT", "PASSPORT_ISSUER": "ISSUER", "REGISTRY_NAME": "REGORG",
    "REG_ID": "REGID", "REG_NUMBER": "REGNUM", "SHARE_PCT": "SHARE", "TRANCHE": "TRANCHE",
}
#: Types that win conflicts but are never masked.
BARRIERS = ("CLAUSE_REF", "ROLE_TERM", "COLLECTIVE")
#: Strongest first.
PATTERN_RANK = (
    "BANK_ACCOUNT", "OGRN", "INN", "INN_PERSON", "BIK", "SNILS", "REG_ID", "KPP", "PASSPORT", "PASSPORT_ISSUER", "PHONE", "REG_NUMBER", "CONTRACT_NO",
    "CONTRACT_KIND", "REGISTRY_NAME", "SUM", "EMAIL", "BIRTHDATE", "DATE", "SHARE_PCT", "PERCENT", "TRANCHE", "TERM",
)
NAME_RANK = ("ADDRESS", "ORG", "PERSON")
#: Profiles: which types each masks; None masks all.
_PERSONAL = ("PERSON", "ADDRESS", "INN_PERSON", "PASSPORT", "SNILS", "BIRTHDATE", "PHONE", "EMAIL", "DATE", "PASSPORT_ISSUER")
_REQUISITES = (*_PERSONAL, "INN", "OGRN", "KPP", "BIK", "BANK_ACCOUNT", "ORG", "REGISTRY_NAME", "REG_ID", "REG_NUMBER")
_MONEY = (*_REQUISITES, "SUM", "PERCENT", "TERM", "CONTRACT_KIND", "CONTRACT_NO", "SHARE_PCT", "TRANCHE")
PROFILES: dict[str, tuple[str, ...] | None] = {"personal": _PERSONAL, "personal_requisites": _REQUISITES, "with_money": _MONEY, "maximum": None}

# ----- end of the fixed values -------------------------------------------------------------------


def known_types() -> tuple[str, ...]:
    """Maskable types, in the order of the configuration."""
    return tuple(PREFIXES)


def resolve_profile(profile: str = "personal", overrides: dict[str, bool] | None = None) -> frozenset[str] | None:
    """The types to mask; None stands for all of them. An unknown profile counts as personal."""
    chosen = PROFILES.get(profile, PROFILES["personal"]) if profile in PROFILES else PROFILES["personal"]
    if not overrides:
        return None if chosen is None else frozenset(chosen)
    types = set(PREFIXES if chosen is None else chosen)
    for name, on in overrides.items():
        if name in PREFIXES:
            (types.add if on else types.discard)(name)
    return None if types == set(PREFIXES) else frozenset(types)


def check_ranks(ranks: tuple[str, ...] = (*PATTERN_RANK, *NAME_RANK)) -> None:
    """Every maskable type must have a rank."""
    missing = [t for t in PREFIXES if t not in ranks]
    if missing:
        raise ValueError(f"no rank for {', '.join(missing)}")


def compile_form(name: str, words: tuple[str, ...] = (), kind: str = "raw", pattern: str = "", digits: tuple[int, int] = (1, 1), units: tuple[str, ...] = ()) -> Rule:
    """A rule from a form: raw (a pattern), digit_run (so many digits, gaps allowed), number_with_unit, or compound (words, then a run)."""
    low, high = digits
    run = rf"\d(?:{_GAP}\d){{{low - 1},{high - 1}}}"
    shapes = {
        "raw": pattern,
        "digit_run": rf"\b{run}\b",
        "number_with_unit": rf"{run}(?:[.,]\d+)?\s?(?:{'|'.join(units)})",
        "compound": rf"(?:{'|'.join(words)})\s+{run}",
    }
    if kind not in shapes or not shapes[kind]:
        raise ValueError(f"{name}: unknown or empty form {kind}")
    return Rule(name, shapes[kind], flags=_I, needs_digit=kind != "raw")


def without(rules: tuple[Rule, ...], *types: str) -> tuple[Rule, ...]:
    return tuple(r for r in rules if r.type not in types)


def anchored(rule: Rule, anchor: str) -> Rule:
    return replace(rule, anchor=anchor)
