"""Canonical values: numbers, dates, names and the key on which two values match.

All functions map columns to columns with SQL functions alone, in the JVM. NFKC
and case folding have no function of their own; the Unicode library that Spark
itself brings for collations is called by java_method(), for texts with
characters outside ASCII only. Numbers are exact: they are compared as decimal
texts of any length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation, patterns and words of the value formats.
EDGE = ".,;:!?()[]{}<>\"'`*_~/\\|"
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "‒": "-", "―": "-", "−": "-", " ": " ", "…": "..."}
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+"
WHOLE_NUMBER = r"(?i)^\s*(?:(?:\$|us\$|usd|eur|€)\s*)?(-)?(" + NUMBER + r")\s*(k|mm|m|bn|b)?\s*(?:%|usd|dollars?|impressions?)?\s*$"
MONTHS = "january february march april may june july august september october november december".split()
MONTH = "(?:" + "|".join(sorted({*MONTHS, *(m[:3] for m in MONTHS), "sept"}, key=lambda m: (-len(m), m))) + ")"
ISO = r"(\d{4})-(\d{2})-(\d{2})"
MDY = r"(?i)(" + MONTH + r")\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,)?\s+(\d{4})"
DMY = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+(" + MONTH + r")\.?,?\s+(\d{4})"
SLASH = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"
MONTH_YEAR = r"(?i)(" + MONTH + r")\.?\s+(\d{4})"

#: For amounts in prose; matching doesn't use it.
DECIMAL = "decimal(38,10)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def once(build: Callable) -> Callable:
    """build, whose expressions are of columns by name only, called once for equal arguments and JVM: large ones take thousands of calls to the JVM to put together, and hold for any table."""
    made: dict = {}

    @functools.wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return get


def _beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def unify(text: Column) -> Column:
    """NFKC, then plain quotes, dashes, spaces and dots."""
    plain = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    one = {a: b for a, b in QUOTES.items() if len(b) == 1}
    plain = F.translate(plain, "".join(one), "".join(one.values()))
    for a in QUOTES.keys() - one.keys():
        plain = F.replace(plain, F.lit(a), F.lit(QUOTES[a]))
    return F.when(_beyond_ascii(text), plain).otherwise(text)


def fold(text: Column) -> Column:
    """Full case folding."""
    return F.when(_beyond_ascii(text), F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))).otherwise(F.lower(text))


def strip_edges(text: Column) -> Column:
    """Without white space and punctuation at both ends (of unified text)."""
    return F.trim(F.btrim(F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", ""), F.lit(EDGE)))


def bare(token: Column) -> Column:
    """A token without edge punctuation and possessive ending."""
    return F.regexp_replace(strip_edges(token), r"'s?$", "")


def words(folded: Column) -> Column:
    """Folded text as words of 0-9 and a-z with one space between; other characters separate."""
    return F.trim(F.regexp_replace(folded, "[^0-9a-z]+", " "))


def normal_name(value: Column) -> Column:
    return words(fold(unify(value)))


def name_tokens(value: Column) -> Column:
    return let(normal_name(value), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " ")))


def number(text: Column) -> Column:
    """The number that a whole (unified) text writes, as the decimal text that equal numbers share, else null."""
    unit = F.lower(F.regexp_extract(text, WHOLE_NUMBER, 3))
    shift = F.when(unit == "", 0).when(unit == "k", 3).when(unit.isin("m", "mm"), 6).otherwise(9)
    body = F.replace(F.regexp_extract(text, WHOLE_NUMBER, 2), F.lit(","), F.lit(""))
    parts = F.struct(F.regexp_extract(text, WHOLE_NUMBER, 1).alias("sign"), F.split_part(body, F.lit("."), F.lit(1)).alias("whole"), F.split_part(body, F.lit("."), F.lit(2)).alias("part"), shift.alias("by"))

    def shifted(p: Column) -> Column:
        whole = F.concat(p["whole"], F.rpad(F.substr(p["part"], F.lit(1), p["by"]), p["by"], F.lit("0")))
        return F.struct(p["sign"].alias("sign"), F.ltrim(whole, F.lit("0")).alias("whole"), F.rtrim(F.substr(p["part"], p["by"] + 1), F.lit("0")).alias("part"))

    def joined(p: Column) -> Column:
        size = F.concat(F.when(p["whole"] == "", "0").otherwise(p["whole"]), F.when(p["part"] == "", "").otherwise(F.concat(F.lit("."), p["part"])))
        return F.when((p["sign"] == "-") & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)

    return F.when(text.rlike(WHOLE_NUMBER), let(let(parts, shifted), joined))


def month_number(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def iso_day(text: Column) -> Column:
    return F.regexp_extract(text, ISO, 0).try_cast("date")


def mdy_day(text: Column) -> Column:
    return _day(F.regexp_extract(text, MDY, 3), month_number(F.regexp_extract(text, MDY, 1)), F.regexp_extract(text, MDY, 2))


def dmy_day(text: Column) -> Column:
    return _day(F.regexp_extract(text, DMY, 3), month_number(F.regexp_extract(text, DMY, 2)), F.regexp_extract(text, DMY, 1))


def slash_day(text: Column) -> Column:
    year = F.regexp_extract(text, SLASH, 3)
    return _day(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.regexp_extract(text, SLASH, 1), F.regexp_extract(text, SLASH, 2))


def _whole(pattern: str) -> str:
    return ("(?i)" if pattern.startswith("(?i)") else "") + "^(?:" + pattern.removeprefix("(?i)") + ")$"


def date(text: Column) -> Column:
    """The date that a whole (unified) text writes in one of four formats, else null."""
    return let(strip_edges(text), lambda t: F.coalesce(
        F.when(t.rlike(_whole(ISO)), iso_day(t)), F.when(t.rlike(_whole(MDY)), mdy_day(t)),
        F.when(t.rlike(_whole(DMY)), dmy_day(t)), F.when(t.rlike(_whole(SLASH)), slash_day(t))))


def month_of(text: Column) -> Column:
    """year * 100 + month of a whole "Month YYYY", else null."""
    return let(strip_edges(text), lambda t: F.when(t.rlike(_whole(MONTH_YEAR)), F.regexp_extract(t, MONTH_YEAR, 2).cast("int") * 100 + month_number(F.regexp_extract(t, MONTH_YEAR, 1))))


def kind(text: Column) -> Column:
    """date, number or name, the first that a (unified) value is."""
    return F.when(date(text).isNotNull(), "date").when(number(text).isNotNull(), "number").otherwise("name")


def key(value: Column) -> Column:
    """The canonical key: two values match exactly if their keys are equal, so matching is an equi-join."""
    plain = unify(value)
    return F.coalesce(F.concat(F.lit("d:"), date(plain).cast("string")), F.concat(F.lit("n:"), number(plain)), F.concat(F.lit("s:"), words(fold(plain))))


@once
def key_of(column: str) -> Column:
    """key() of a named column."""
    return key(F.col(column))


def values_match(left: Column, right: Column) -> Column:
    return key(left) == key(right)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), grouped(value))


def grouped(value: Column) -> Column:
    return F.format_number(value.cast(DECIMAL), 0)


def long_date(value: Column) -> Column:
    return F.date_format(value, "MMMM d, yyyy")


def natural(value: Column) -> Column:
    """An exact ISO date as a long date, other values as they are."""
    return F.when(value.rlike(_whole(ISO)) & value.try_cast("date").isNotNull(), long_date(value.try_cast("date"))).otherwise(value)


def title(value: Column) -> Column:
    """Title case that also starts anew behind a hyphen."""
    return F.array_join(F.transform(F.split(F.initcap(value), "-"), capital), "-")


def capital(text: Column) -> Column:
    """With its first letter in upper case."""
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def mail_address(name: Column, root: Column) -> Column:
    return F.lower(F.concat(F.replace(name, F.lit(" "), F.lit(".")), F.lit("@"), root, F.lit(".example")))
