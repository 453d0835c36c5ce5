"""Shapes of values: what a value looks like without saying what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.binding import once

#: Words that may stand in a record's context as they are.
FUNCTION_WORDS = tuple(
    """
    в во на за по из от до у к с со о об обо при над под перед про через для без
    между около возле вдоль мимо после кроме сверх ввиду вследствие
    и а но да или либо ни то же ли бы не нет что чтобы как когда если хотя так тоже
    также затем потом далее выше ниже именно только лишь даже уже ещё был была было
    были быть есть является являются
    г гор с д дом кв корп стр ул пер пр просп пл наб ш обл р-н респ край окр
    инн кпп огрн огрнип бик кс рс окпо окато оквэд снилс
    паспорт серия номер выдан выдано код подразделения
    тел телефон факс почта email e-mail сайт
    договор приложение пункт п пп статья ст лицо лицом стороны сторона
    адрес зарегистрирован проживает место рождения дата рожд рождения
    руб рублей коп копеек ндс годовых дней месяцев лет процентов
    ооо оао зао ао пао ип нко ано фгуп мбу гбу
    """.split()
)
HIDDEN = "·"
#: Characters beside a value that are read first for its context.
NEAR = 100


def case_shape(value: Column) -> Column:
    """upper, lower, title (every word that begins with a letter begins with a capital), mixed or no_letters."""
    letters = F.regexp_replace(value, r"[^\p{L}]", "")
    small_first = value.rlike(r"(?:^|\s)(?!\p{Lu})\p{L}")
    return F.when(letters == "", "no_letters").when(letters == F.upper(letters), "upper").when(letters == F.lower(letters), "lower").when(~small_first, "title").otherwise("mixed")


def token_shapes(value: Column) -> Column:
    """For each word: length, case, and whether it has digits, Latin, Cyrillic, punctuation, or is an initial."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return F.transform(
        words,
        lambda w: F.struct(
            F.length(w).alias("length"), case_shape(w).alias("shape"), w.rlike(r"\d").alias("digit"), w.rlike(r"[A-Za-z]").alias("latin"), w.rlike("[Ѐ-ӿ]").alias("cyrillic"),
            w.rlike(r"[^\p{L}\d]").alias("punct"), w.rlike(r"^[А-ЯЁA-Z]\.(?:[А-ЯЁA-Z]\.?)*$").alias("initial"),
        ),
    )


def whitelisted_context(text: Column, start: Column, end: Column, words: int = 4) -> Column:
    """Up to four words on each side; those that aren't function words are hidden.

    NEAR characters on each side are read; the rest of a text only where they hold no word more than
    is asked for, as the outermost may be cut.
    """
    split = lambda t: F.regexp_extract_all(t, F.lit(r"(?U)[\w-]+"), F.lit(0))
    hide = lambda ws: F.transform(ws, lambda w: once(F.lower(w), lambda low: F.when(low.isin(*FUNCTION_WORDS), low).otherwise(HIDDEN)))
    from_ = F.greatest(start - NEAR, F.lit(0))
    left = once(split(F.substring(text, from_ + 1, start - from_)), lambda ws: F.when((from_ == 0) | (F.size(ws) > words), ws).otherwise(split(F.substring(text, F.lit(1), start))))
    behind = F.substring(text, end + 1, F.lit(NEAR))
    right = once(split(behind), lambda ws: F.when((F.size(ws) > words) | (F.length(behind) < NEAR), ws).otherwise(split(F.substring(text, end + 1, F.length(text)))))
    return F.struct(hide(F.slice(F.reverse(left), 1, words)).alias("left_nearest_first"), hide(F.slice(right, 1, words)).alias("right"))


def direction(old_length: Column, new_length: Column) -> Column:
    """shorter, longer or null: how a corrected mask differs from the first."""
    return F.when(new_length < old_length, "shorter").when(new_length > old_length, "longer")


def place_of(seg_id: Column) -> Column:
    """container, table, row, column and number of a segment id such as header1:t0_r2_c1, p3, l7, pg0."""
    number = lambda p: F.regexp_extract(seg_id, p, 1).try_cast("int")
    body = F.regexp_extract(seg_id, r"(?:^|:)(t\d+_r\d+_c\d+|pg\d+|p\d+|l\d+)$", 1)
    kind = F.when(body.startswith("t"), "cell").when(body.startswith("pg"), "page").when(body.startswith("p"), "paragraph").when(body.startswith("l"), "line").otherwise("unknown")
    return F.struct(kind.alias("container"), number(r"t(\d+)_r").alias("table"), number(r"_r(\d+)_").alias("row"), number(r"_c(\d+)$").alias("col"), number(r"(?:pg|p|l)(\d+)$").alias("number"))
