"""Dates as people type them, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names and short forms (the ones results must agree on).
ENGLISH_MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
# Words for the present.
ENGLISH_PRESENT = ("present", "current", "now", "till date", "today", "ongoing")

# Month names of other languages, January to December.
_OTHER_MONTHS = (
    "januar februar märz april mai juni juli august september oktober november dezember",
    "jänner feber mrz apr mai jun jul aug sept okt nov dez",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "ene feb mar abr may jun jul ago set oct nov dic",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "janv fevrier mars avr mai juin juil aout sept oct nov dec",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "januari februari maart april mei juni juli augustus september oktober november december",
)
MONTHS = ENGLISH_MONTHS | {"maerz": 3, "marz": 3, "fév": 2, "févr": 2, "déc": 12, "setiembre": 9} | {
    name: i for names in reversed(_OTHER_MONTHS) for i, name in enumerate(names.split(), 1)
}
PRESENT = (
    *ENGLISH_PRESENT, "to date", "to present", "to now", "till now", "until now", "until today", "currently",
    "heute", "bis heute", "jetzt", "aktuell", "derzeit", "actualidad", "actual", "presente", "hoy", "hasta hoy",
    "hasta la fecha", "actualmente", "aujourd'hui", "aujourd’hui", "présent", "actuel", "ce jour", "à ce jour",
    "oggi", "attuale", "hoje", "atual", "heden", "nu",
)

_SPACE = r"[\s  -​ 　]+"


def month_map(months: dict[str, int]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in months.items()))


def full_year(year: Column) -> Column:
    """A two-digit year below 50 is 20xx, one from 50 is 19xx."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def squeeze(text: Column) -> Column:
    """Lower case, blanks of any kind collapsed, outer blanks and brackets gone."""
    flat = F.regexp_replace(F.lower(text), _SPACE, " ")
    return F.regexp_replace(F.regexp_replace(flat, r"^[ ()\[\]{}]+", ""), r"[ ()\[\]{}]+$", "")


def _month_days(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def typed_month(text: Column, now_yyyymm: int) -> Column:
    """The month index (year * 12 + month - 1) of a typed date, NULL where it can't be read.

    Reads ISO dates and months, ``MM/YYYY``, ``MM-YYYY``, ``DD.MM.YYYY``, a bare year (its January), month names
    of nine languages with or without day, dot, comma or ``de``, two-digit years, and words for the present (the
    month ``now_yyyymm``). Impossible months and days give NULL, as do NULL and blank texts.
    """
    # A one-element array: the lambda's variable is evaluated once, where plain nesting would repeat it in every branch.
    return F.transform(F.array(squeeze(text)), lambda t: _read(t, now_yyyymm))[0]


def _read(t: Column, now_yyyymm: int) -> Column:
    names = month_map(MONTHS)

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    def index(year: Column, month: Column, day: Column | None = None) -> Column:
        good = month.between(1, 12) & (year > 0)
        if day is not None:
            good = good & day.between(1, _month_days(year, month))
        return F.when(good, year * 12 + month - 1)

    iso_day, iso_month = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{4})[-/.](\d{1,2})$"
    short, dotted = r"^(\d{1,2}) ?[-/.] ?(\d{4})$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    word = r"^(?:(\d{1,2})(?:st|nd|rd|th|er)?[. ] ?(?:de |of )?)?([\p{L}]+)[.,]?(?: de[l]?)? ?'?(\d{4}|\d{2})$"
    first = r"^(\d{4}),? ([\p{L}]+)[.]?$"
    day, year = number(word, 1), full_year(number(word, 3))
    named = names[F.regexp_extract(t, word, 2)]
    return (
        F.when(t.isin(*PRESENT), F.lit(now_yyyymm // 100 * 12 + now_yyyymm % 100 - 1))
        .when(t.rlike(r"^\d{4}$"), F.when(t.try_cast("int") > 0, t.try_cast("int") * 12))
        .when(t.rlike(iso_day), index(number(iso_day, 1), number(iso_day, 2), number(iso_day, 3)))
        .when(t.rlike(iso_month), index(number(iso_month, 1), number(iso_month, 2)))
        .when(t.rlike(short), index(number(short, 2), number(short, 1)))
        .when(t.rlike(dotted), index(number(dotted, 3), number(dotted, 2), number(dotted, 1)))
        .when(t.rlike(word), F.when(day.isNull(), index(year, named)).otherwise(index(year, named, day)))
        .when(t.rlike(first), index(number(first, 1), names[F.regexp_extract(t, first, 2)]))
    )


def yyyymm(month_index: Column) -> Column:
    return (F.floor(month_index / 12) * 100 + month_index % 12 + 1).cast("int")
