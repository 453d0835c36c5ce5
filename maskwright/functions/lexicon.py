"""Word knowledge behind a narrow interface, with a small built-in table.

Recognising people, organisations and addresses needs lemmas and name roles. ``Lexicon`` gives them
from ending rules and short lists; pass another one with the same methods for better recall.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ----- fixed values ------------------------------------------------------------------------------
FIRST_NAMES = (
    "александр", "алексей", "анатолий", "андрей", "анна", "антон", "борис", "вадим", "валентина", "василий", "вера", "виктор", "владимир", "галина", "георгий", "дмитрий",
    "евгений", "екатерина", "елена", "иван", "игорь", "илья", "ирина", "константин", "людмила", "мария", "михаил", "наталья", "николай", "олег", "ольга", "павел", "пётр",
    "роман", "светлана", "сергей", "степан", "татьяна", "юлия", "юрий",
)
ORG_FORMS = (
    "общество с ограниченной ответственностью", "публичное акционерное общество", "непубличное акционерное общество", "акционерное общество", "закрытое акционерное общество",
    "открытое акционерное общество", "индивидуальный предприниматель", "автономная некоммерческая организация", "государственное унитарное предприятие", "ооо", "оао", "зао", "пао", "ао", "ип", "ано", "гуп", "муп", "фгуп",
)
ROLE_WORDS = (
    "заказчик", "исполнитель", "подрядчик", "субподрядчик", "поставщик", "покупатель", "продавец", "арендатор", "арендодатель", "займодавец", "заёмщик", "агент", "принципал", "сторона", "стороны",
    "лицензиар", "лицензиат", "цедент", "цессионарий", "договор", "банк", "кредитор", "должник",
)
COLLECTIVE_WORDS = ("контрагенты", "поставщики", "покупатели", "организации", "общества", "компании", "предприятия", "дочерние", "арендаторы", "участники")
STREET = ("ул", "улица", "улице", "пр-т", "просп", "проспект", "пр", "пер", "переулок", "ш", "шоссе", "наб", "набережная", "пл", "площадь", "бул", "бульвар", "проезд", "туп", "тупик", "аллея", "мкр", "микрорайон")
PREMISE = ("д", "дом", "корп", "корпус", "к", "стр", "строение", "вл", "владение", "кв", "квартира", "оф", "офис", "пом", "помещение", "комн", "комната", "эт", "этаж", "лит", "литера", "подъезд")
LOCALITY = ("г", "город", "обл", "область", "край", "респ", "республика", "р-н", "район", "п", "пос", "посёлок", "поселок", "с", "село", "дер", "деревня", "пгт", "ст-ца", "станица", "округ")
PLACES = ("москва", "санкт-петербург", "новосибирск", "екатеринбург", "казань", "самара", "омск", "челябинск", "уфа", "пермь", "воронеж", "волгоград", "краснодар", "саратов", "тюмень", "тула", "россия", "рф")
#: Endings, longest first, that lemmas lose.
NAME_ENDINGS = ("овичем", "евичем", "овича", "евича", "овичу", "евичу", "ович", "евич", "овной", "евной", "овны", "евны", "овну", "евну", "овна", "евна", "ичем", "ича", "ич")
CASE_ENDINGS = ("ого", "ому", "ыми", "ими", "ами", "ями", "ой", "ый", "ий", "ая", "ую", "ым", "им", "ом", "ем", "ей", "ою", "ах", "ях", "ов", "ев", "а", "я", "у", "ю", "ы", "и", "е", "о", "ь")
# ----- end of the fixed values -------------------------------------------------------------------

_PATRONYMIC = re.compile(r"(?:ович|евич|ьич|инич|овн|евн|иничн)(?:а|у|ем|ой|ы|е|ю)?$")
_SURNAME = re.compile(r"(?:ов|ев|ёв|ин|ын|ск|цк)(?:а|у|ым|ой|ого|ому|ий|ая|ую|ом|е|ых)?$|(?:ко|ук|юк|ян|дзе|швили|их|ых)$")

#: A surname keeps its own ending ("ов" is no case ending in it); what follows is the case.
_SURNAME_FORM = re.compile(r"(.{2,}(?:ов|ев|ин|ын))(?:а|у|ым|ой|е|ых|ы|ыми)?$")


@dataclass
class Lexicon:
    first_names: tuple[str, ...] = FIRST_NAMES
    lemmas: dict[str, str] = field(default_factory=dict)
    places: tuple[str, ...] = PLACES

    def __post_init__(self) -> None:
        self._first = {self._cut(n) for n in self.first_names}

    @staticmethod
    def _cut(word: str) -> str:
        for e in CASE_ENDINGS:
            if word.endswith(e) and len(word) - len(e) >= 3:
                return word[: -len(e)]
        return word

    def lemma(self, word: str) -> str:
        """A key that a word's case forms share."""
        low = word.lower().replace("ё", "е")
        surname = _SURNAME_FORM.match(low) if word[:1].isupper() else None
        return self.lemmas.get(low) or (surname[1] if surname else self._cut(low))

    def roles(self, word: str) -> frozenset[str]:
        """Which of name, patr, surn a word can be."""
        low = word.lower()
        out = set()
        if self._cut(low) in self._first:
            out.add("name")
        if _PATRONYMIC.search(low):
            out.add("patr")
        elif _SURNAME.search(low) and len(low) >= 4:
            out.add("surn")
        return frozenset(out)

    def is_place(self, word: str) -> bool:
        return word.lower() in self.places
