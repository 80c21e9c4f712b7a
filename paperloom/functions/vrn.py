"""Vehicle registration numbers: recognition, normal form, extraction from text and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bordered

#: Forms of a registration number, in order of preference.
FIRST_FORMS = (r"(?i)\b(\d{2,3})-([A-Z]{1,2})-(\d{1,6})\b", r"(?i)\b(\d{2})-([A-Z]{1,2})-(\d{1,5})\b", r"(?i)\b([A-Z]{1,2})-(\d{1,6})\b", r"(?i)\b(\d{2,3})([A-Z]{1,2})(\d{1,6})\b")
#: The forms searched when every candidate is scored, and whether each is of the new kind.
SCORED_FORMS = (
    (r"(?i)\b\d{3}-[A-Z]{2}-\d{1,6}\b", True),
    (r"(?i)\b\d{3}-[A-Z]-\d{1,6}\b", True),
    (r"(?i)\b\d{2}-[A-Z]{2}-\d{1,6}\b", False),
    (r"(?i)\b\d{2}-[A-Z]-\d{1,6}\b", False),
    (r"(?i)\b\d{3}[A-Z]{1,2}\d{1,6}\b", False),
    (r"(?i)\b\d{2}[A-Z]{1,2}\d{1,6}\b", False),
)
#: County codes.
COUNTIES = ("C", "CE", "CN", "CW", "D", "DL", "G", "KE", "KK", "KY", "L", "LD", "LH", "LK", "LM", "LS", "MH", "MN", "MO", "OY", "RN", "SO", "T", "TS", "W", "WH", "WW", "WX")
#: Dates, telephone numbers and mixed codes that look like one.
FALSE_FORMS = r"(?i)^(\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}|\d{3}-\d{3}-\d{4}|\d+-[A-Z]+-\d+[A-Z])"


def is_vrn(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?i)\d{2,3}-[A-Z]{1,2}-\d{4,5}"))


def is_partial_vrn(text: Column) -> Column:
    return F.regexp_like(F.trim(text), F.lit(r"(?i)^\d{2,3}-[A-Z]{1,2}$"))


def normalize(vrn: Column) -> Column:
    """Upper case, no spaces, hyphens between year, county and number; anything else stays."""
    raw = F.replace(F.upper(F.trim(vrn)), F.lit(" "), F.lit(""))
    whole = F.regexp_replace(raw, r"^(\d{2,3})([A-Z]{1,2})(\d{1,6})$", "$1-$2-$3")
    return F.regexp_replace(whole, r"^([A-Z]{1,2})(\d{1,6})$", "$1-$2")


def first_in_text(text: Column) -> Column:
    """The first match of the first form that matches, groups joined and normalised; null if none does."""
    out = []
    for form in FIRST_FORMS:
        groups = form.count("(") - form.count("(?")
        joined = F.concat(*(F.regexp_extract(text, bordered(form), i + 1) for i in range(groups)))
        out.append(F.when(F.regexp_like(text, F.lit(bordered(form))), normalize(joined)))
    return F.coalesce(*out)


def first_in_filename(name: Column) -> Column:
    """As ``first_in_text`` on the whole match; an underscore after a number is no word border."""
    return F.coalesce(*(F.when(F.regexp_like(name, F.lit(bordered(f))), normalize(F.regexp_extract(name, bordered(f), 0))) for f in FIRST_FORMS))


def county(vrn: Column) -> Column:
    """County letters of a registration number, or null."""
    hyphened = F.when(F.regexp_like(vrn, F.lit(r"(?i)^[^-]*-[A-Z]{1,2}(-|$)")), F.upper(F.split(vrn, "-")[1]))
    joined = F.upper(F.nullif(F.regexp_extract(vrn, r"(?i)^\d{2,3}([A-Z]{1,2})\d+$", 1), F.lit("")))
    return F.coalesce(hyphened, joined)


def is_valid(vrn: Column) -> Column:
    return (F.length(vrn) >= 5) & ~F.regexp_like(vrn, F.lit(FALSE_FORMS)) & county(vrn).isNotNull()


def all_in_text(text: Column) -> Column:
    """All distinct valid numbers, upper case, in the order of forms, then of the text."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(bordered(form)), F.lit(0)) for form, _ in SCORED_FORMS))
    return F.array_distinct(F.transform(F.filter(found, is_valid), F.upper))


def best_in_text(text: Column) -> Column:
    """The valid number of the highest score: hyphens 10, new form 5, known county 20, and up to 100 for an early place; ties to the earlier form."""
    upper = F.upper(text)

    def scored(form: str, new: bool, rank: int) -> Column:
        def one(m: Column, i: Column) -> Column:
            early = F.greatest(F.lit(0), F.lit(100) - (F.instr(upper, F.upper(m)) - 1))
            score = F.when(m.contains("-"), 10).otherwise(0) + F.lit(5 if new else 0) + early + F.when(county(F.upper(m)).isin(*COUNTIES), 20).otherwise(0)
            return F.struct(score.alias("score"), (-F.lit(rank) * 100_000 - i).alias("order"), F.upper(m).alias("vrn"))

        return F.transform(F.filter(F.regexp_extract_all(text, F.lit(bordered(form)), F.lit(0)), is_valid), one)

    every = F.concat(*(scored(form, new, i) for i, (form, new) in enumerate(SCORED_FORMS)))
    return F.array_max(every)["vrn"]


def loose_in_text(text: Column) -> Column:
    """Numbers in the loose form (space or hyphen optional) and runs of 6 to 9 digits, distinct and sorted."""
    loose = F.regexp_extract_all(text, F.lit(bordered(r"(?i)\b\d{2,3}[- ]?[A-Z]{1,2}[- ]?\d{1,6}\b")), F.lit(0))
    digits = F.regexp_extract_all(text, F.lit(bordered(r"\b\d{6,9}\b")), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.transform(loose, lambda v: F.upper(F.replace(v, F.lit(" "), F.lit("-")))), digits)))


def is_valid_vin(vin: Column) -> Column:
    return F.length(F.trim(vin)) == 17


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
