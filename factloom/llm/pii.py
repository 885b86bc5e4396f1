"""PII: format-preserving Feistel pseudonyms.

Validated numbers and dates are replaced by others of the same format under a
keyed permutation, so equal values stay equal, and linked, in all documents,
while different values stay different:

    card       13 to 19 digits that pass the Luhn test; the digits before the
               last are permuted, the last is the new check digit. In a run of
               digit groups each reading that starts and ends at a group's
               boundary counts: unbroken numbers and the usual groupings first,
               then from left to right the longest
    phone      +1 (ddd) ddd-dddd and the like; all digits behind the country code. A
               number that could be dialled (area and exchange from 2 on) becomes
               another such number, any other one becomes none such
    ssn        ddd-dd-dddd in an area that is issued; it becomes another such number
    ipv4       four octets; permuted as a 32-bit number
    date       yyyy-mm-dd (a time may follow behind a T), mm/dd/yyyy and dd.mm.yyyy
               that the calendar has, and dd/mm/yyyy where mm/dd/yyyy has no such
               day; the day is permuted within the 400 years from 1800 (146,097
               days), for dd/mm/yyyy until it can't be read as mm/dd/yyyy either
    email      letters and digits of the part before the @

A Feistel network of ROUNDS rounds works on the two halves of a value: in turn,
each half has the keyed hash of the other added, modulo its size. Numbers use
halves of their digits, dates 146,097 = 189 x 773, addresses 2^16 x 2^16, and
e-mail names their characters, each within its class (a-z, A-Z, 0-9).

Only SQL functions are used: a text is split at all matches of one pattern, the
matches are replaced, and the pieces joined again.

Defined results: null text stays null; a text without a match is unchanged;
numbers that fail their test and days that no calendar has are left alone;
repeated rows are changed alike. Runs of any length are worked through in
blocks, and no pattern recurses on them. Who has the key can undo a permutation,
so the key is an argument without default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The key of the query; pseudonyms of real data need a key of their own.
DEMO_KEY = "factloom-demo-key"
ROUNDS = 4

#: The formats. Each stands clear of letters and digits around it.
#: The domain is one run of characters, not a repeated group, on which Java's matcher would recurse.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-][A-Za-z0-9.-]*(?<!\.)\.[A-Za-z]{2,}"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
ISO_DATE = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?![\w-])|(?=[Tt]\d{2}:?\d{2}))"
US_DATE = r"(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])"
DOT_DATE = r"(?<![\w.])\d{2}\.\d{2}\.\d{4}(?![\w]|\.\d)"
PHONE = r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
PLAIN_PHONE = r"(?<![\w(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
OTHERS = "|".join([EMAIL, IPV4, ISO_DATE, US_DATE, DOT_DATE, PHONE, PLAIN_PHONE, SSN])
#: Digit groups parted by single spaces or hyphens, 13 digits or more, up to a group at which another format starts.
#: All repeats are possessive: Java's matcher then loops over them, where it would else recurse and overflow on long runs.
_HYPHENED = rf"\d++(?:-(?!{OTHERS})\d++)*+(?:(?![\w-])|(?=-(?:{OTHERS})))"
RUN = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){_HYPHENED}(?: (?!{OTHERS}){_HYPHENED})*+"
CARD_DIGITS = (13, 19)
#: Groupings that cards are printed in; the number on the back may follow, so the longest comes last.
GROUPINGS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))

ANY = f"{OTHERS}|{RUN}"
#: A text without any of these can't have a match.
HINT = r"[0-9][ .-]?[0-9]|@"

DAYS = 146_097
LEFT, RIGHT = 189, 773
FIRST_DAY = -62_091  # 1800-01-01 as days from 1970-01-01
#: Steps of a walk to the next result of the same class. The rarest class, phone numbers that can't be dialled, has 36 % of all:
#: the odds that a walk ends outside are under 1e-18.
WALK = 96
#: Digit groups of a run that are worked through at once.
CELLS = 512


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _key(key: str, kind: str, round_: int) -> Column:
    return F.lit(f"{key}|{kind}|{round_}|")


def _round(key: str, kind: str, round_: int, half: Column) -> Column:
    """A keyed hash of a half: 60 bits of SHA-256, as a long that isn't negative."""
    return F.conv(F.substring(F.sha2(F.concat(_key(key, kind, round_), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _numeric(left: Column, right: Column, n_left, n_right, key: str, kind: str) -> tuple[Column, Column]:
    """The network on two numbers below n_left and n_right."""
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(_round(key, kind, r, right), n_left), n_left)
        else:
            right = F.pmod(right + F.pmod(_round(key, kind, r, left), n_right), n_right)
    return left, right


def _in_steps(first: Column, steps) -> Column:
    """Applies functions one after the other, each to the result of the one before, computed once."""
    out = F.transform(F.array(first), steps[0])
    for step in steps[1:]:
        out = F.transform(out, step)
    return out[0]


def _rounds(state: Column, key: str, kind: str, n_left, n_right) -> Column:
    """The network on a struct (l, r, ...) of numbers, a step a round; n_left, n_right: functions of the struct."""

    def step(r: int):
        def run(s: Column) -> Column:
            if r % 2 == 0:
                n = n_left(s)
                return s.withField("l", F.pmod(s["l"] + F.pmod(_round(key, kind, r, s["r"]), n), n))
            n = n_right(s)
            return s.withField("r", F.pmod(s["r"] + F.pmod(_round(key, kind, r, s["l"]), n), n))

        return run

    return _in_steps(state, [step(r) for r in range(ROUNDS)])


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits permuted among those of the same length (2 to 36)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    state = F.struct(
        F.substr(digits, F.lit(1), half).cast("long").alias("l"), F.substr(digits, half + 1, rest).cast("long").alias("r"),
        half.alias("h"), rest.alias("t"), F.length(digits).alias("n"),
    )
    done = _rounds(state, key, kind, lambda s: F.pow(F.lit(10.0), s["h"]).cast("long"), lambda s: F.pow(F.lit(10.0), s["t"]).cast("long"))
    return _in_steps(done, [lambda s: F.concat(F.lpad(s["l"].cast("string"), s["h"], F.lit("0")), F.lpad(s["r"].cast("string"), s["t"], F.lit("0")))])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def fill_digits(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of digits."""
    cells = F.split(shape, "")
    done = F.aggregate(
        cells,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
        lambda s: s["out"],
    )
    return done


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """The Luhn sum; doubled_from 1: of every second digit from the right, leaving out the last; 0: from the last on."""
    cells = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    each = F.transform(cells, lambda c, i: F.when(i % 2 == doubled_from, F.when(c > 4, 2 * c - 9).otherwise(2 * c)).otherwise(c))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def is_run(value: Column) -> Column:
    """For matches of ANY: no other format has 13 digits, spaces and hyphens only."""
    return value.rlike("^[0-9][0-9 -]*[0-9]$") & (F.length(digits_of(value)) >= CARD_DIGITS[0])


def _passes(digits: Column) -> Column:
    return F.length(digits).between(*CARD_DIGITS) & (luhn_sum(digits, 1) % 10 == 0)


def _readings(groups: Column, sizes: Column) -> Column:
    """For each digit group (strong, weak): how many groups from it on are a card, as one number or in a usual
    grouping (0: none), and how many in any other way, an array, longest first."""

    def joined(i: Column, n) -> Column:
        return F.array_join(F.slice(groups, i + 1, n), "")

    def one(g: Column, i: Column) -> Column:
        strong = F.when(_passes(g), 1)
        for shape in GROUPINGS:
            strong = strong.when((F.slice(sizes, i + 1, len(shape)) == F.array(*map(F.lit, shape))) & _passes(joined(i, len(shape))), len(shape))
        most = F.least(F.lit(CARD_DIGITS[1]), F.size(groups) - i)
        weak = F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: _passes(joined(i, n)))
        return F.struct(strong.otherwise(0).alias("strong"), weak.alias("weak"))

    return F.transform(groups, one)


def _cuts(readings: Column) -> Column:
    """For each group: how many groups the card that starts there has; -1 inside of a card, 0 elsewhere.

    Blocks of CELLS groups are worked through one after the other, so that no list grows group by group.
    """
    none = F.array().cast("array<int>")

    def block(state: Column, number: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            at = number * CELLS + F.size(s["out"])
            clear = F.filter(r["weak"], lambda n: ~F.exists(F.slice(readings, at + 2, n - 1), lambda x: x["strong"] > 0))
            n = F.when(s["skip"] > 0, -1).when(r["strong"] > 0, r["strong"]).otherwise(F.coalesce(F.get(clear, F.lit(0)), F.lit(0)))
            return F.transform(F.array(n), lambda n: F.struct(F.concat(s["out"], F.array(n)).alias("out"), F.when(n < 0, s["skip"] - 1).otherwise(F.greatest(n - 1, F.lit(0))).alias("skip")))[0]

        done = F.aggregate(F.slice(readings, number * CELLS + 1, CELLS), F.struct(none.alias("out"), state["skip"].alias("skip")), step)
        return F.transform(F.array(done), lambda d: F.struct(F.concat(state["out"], F.array(d["out"])).alias("out"), d["skip"].alias("skip")))[0]

    start = F.struct(F.array().cast("array<array<int>>").alias("out"), F.lit(0).alias("skip"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(readings) - 1) / CELLS).cast("int")), start, block, lambda s: F.flatten(s["out"]))


def cards_of_run(run: Column) -> Column:
    """The pieces (v, kind) of a run: its cards, and what stands before, between and behind them, kind null."""
    cells = F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0))
    start = _in_steps(cells, [lambda c: F.struct(c.alias("cells"), F.transform(c, digits_of).alias("groups"), F.transform(c, lambda x: F.length(digits_of(x))).alias("sizes"))])
    read = _in_steps(start, [lambda s: F.struct(s["cells"].alias("cells"), _readings(s["groups"], s["sizes"]).alias("readings"))])
    cut = _in_steps(read, [lambda s: F.struct(s["cells"].alias("cells"), _cuts(s["readings"]).alias("cuts"))])
    none = F.lit(None).cast("string")

    def pieces(cell: Column, n: Column, i: Column, cells: Column) -> Column:
        # the separator before a card's first group isn't the card's
        gap = F.regexp_extract(cell, "^[ -]?", 0)
        whole = F.array_join(F.slice(cells, i + 1, n), "")
        return F.when(n == 0, F.array(F.struct(cell.alias("v"), none.alias("kind")))).when(
            n > 0, F.array(F.struct(gap.alias("v"), none.alias("kind")), F.struct(F.substr(whole, F.length(gap) + 1).alias("v"), F.lit("card").alias("kind")))
        ).otherwise(F.array().cast("array<struct<v:string,kind:string>>"))

    return _in_steps(cut, [lambda s: F.flatten(F.transform(F.arrays_zip(s["cells"], s["cuts"]), lambda z, i: pieces(z["cells"], z["cuts"], i, s["cells"])))])


def card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    full = _in_steps(body, [lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string"))])
    return fill_digits(value, full)


def _walked(digits: Column, key: str, kind: str, same_class) -> Column:
    """digits under the permutation, as often as it takes to come to digits of the same class again: a permutation of the class."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permute_digits(digits, key, kind), lambda d, _: F.when(same_class(d), d).otherwise(permute_digits(d, key, kind)))


def phone(value: Column, key: str) -> Column:
    country = F.when(value.startswith("+1"), F.lit(2)).otherwise(0)
    rest = F.substr(value, country + 1)
    dialled = lambda d: d.rlike("^[2-9][0-9]{2}[2-9]")
    new = _in_steps(digits_of(rest), [lambda d: _walked(d, key, "phone", lambda x: dialled(x) == dialled(d))])
    return F.concat(F.substr(value, F.lit(1), country), fill_digits(rest, new))


def is_ssn(value: Column) -> Column:
    return value.rlike(_whole(SSN)) & ~value.rlike(r"^(?:000|666|9\d\d)-|-00-|-0000$")


def ssn(value: Column, key: str) -> Column:
    return fill_digits(value, _walked(digits_of(value), key, "ssn", lambda d: ~d.rlike(r"^(?:000|666|9)|^\d{3}00|0000$")))


def is_ipv4(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")


def ipv4(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    start = _in_steps(parts, [lambda p: F.struct((p[0] * 256 + p[1]).alias("l"), (p[2] * 256 + p[3]).alias("r"))])
    done = _rounds(start, key, "ipv4", lambda s: F.lit(65536), lambda s: F.lit(65536))
    return _in_steps(done, [lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(s["l"], 8), s["l"].bitwiseAND(F.lit(255)), F.shiftright(s["r"], 8), s["r"].bitwiseAND(F.lit(255)))))])


def _day_first(value: Column) -> Column:
    """A slashed date with no month before its slash: no other dd/mm is missing from the mm/dd calendar and in the dd/mm one."""
    return value.rlike("^(?:1[3-9]|[23][0-9])/")


def as_day(value: Column) -> Column:
    """The date of a value in one of the formats; null if the calendar has no such day in 1800 to 2199."""
    iso = F.when(value.rlike(r"^\d{4}-"), value)
    iso = iso.when(value.rlike("/") & ~_day_first(value), F.concat_ws("-", F.substr(value, F.lit(7), F.lit(4)), F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(4), F.lit(2))))
    iso = iso.otherwise(F.concat_ws("-", F.substr(value, F.lit(7), F.lit(4)), F.substr(value, F.lit(4), F.lit(2)), F.substr(value, F.lit(1), F.lit(2))))
    day = iso.try_cast("date")
    return F.when(F.year(day).between(1800, 2199), day)


def date(value: Column, key: str) -> Column:
    since = F.unix_date(as_day(value)).cast("long") - FIRST_DAY
    day = _in_steps(_permuted_day(since, key), [lambda d: F.date_from_unix_date((d + FIRST_DAY).cast("int"))])
    # a dd/mm/yyyy goes on to the next day of the permutation until the day of the month is no month,
    # so that it never becomes what some mm/dd/yyyy becomes
    walk = lambda d, _: F.when(F.dayofmonth(d) > 12, d).otherwise(F.date_from_unix_date((_permuted_day(F.unix_date(d).cast("long") - FIRST_DAY, key) + FIRST_DAY).cast("int")))
    day = F.when(_day_first(value), F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), day, walk)).otherwise(day)
    return _in_steps(day, [lambda d: F.when(value.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd")).when(_day_first(value), F.date_format(d, "dd/MM/yyyy")).when(value.rlike("/"), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))])


def _permuted_day(since: Column, key: str) -> Column:
    """Days since FIRST_DAY under the permutation."""
    start = _in_steps(since, [lambda d: F.struct(F.floor(d / RIGHT).cast("long").alias("l"), F.pmod(d, F.lit(RIGHT)).cast("long").alias("r"))])
    done = _rounds(start, key, "date", lambda s: F.lit(LEFT), lambda s: F.lit(RIGHT))
    return _in_steps(done, [lambda s: s["l"] * RIGHT + s["r"]])


def email(value: Column, key: str) -> Column:
    """The name's letters and digits are moved within their classes, half by half, by the hash of the other half."""
    name = F.substring_index(value, "@", 1)
    half = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substr(name, F.lit(1), half).alias("l"), F.substr(name, half + 1).alias("r"))

    def step(r: int):
        def run(s: Column) -> Column:
            mine, other = ("l", "r") if r % 2 == 0 else ("r", "l")
            return s.withField(mine, _shifted(s[mine], F.sha2(F.concat(_key(key, "email", r), s[other]), 512)))

        return run

    done = _in_steps(start, [step(r) for r in range(ROUNDS)])
    return _in_steps(done, [lambda s: F.concat(s["l"], s["r"], F.lit("@"), F.substring_index(value, "@", -1))])


def _shifted(text: Column, digest: Column) -> Column:
    """Each character of a-z, A-Z, 0-9 moved on within its class by its own byte of digest."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        at = F.ascii(c)
        moved = F.when(c.rlike("^[a-z]$"), 97 + (at - 97 + by) % 26).when(c.rlike("^[A-Z]$"), 65 + (at - 65 + by) % 26).when(c.rlike("^[0-9]$"), 48 + (at - 48 + by) % 10).otherwise(at)
        return F.when(c == "", c).otherwise(F.char(moved))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def kind_of(value: Column) -> Column:
    """The kind of a match that passes its test, else null; runs of digit groups aside."""
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(is_ipv4(value), F.lit("ipv4"))
        .when(value.rlike(_whole("|".join([ISO_DATE, US_DATE, DOT_DATE]))), F.when(as_day(value).isNotNull(), F.lit("date")))
        .when(value.rlike(_whole(f"{PHONE}|{PLAIN_PHONE}")), F.lit("phone"))
        .when(is_ssn(value), F.lit("ssn"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", email(value, key))
        .when(kind == "ipv4", ipv4(value, key))
        .when(kind == "date", date(value, key))
        .when(kind == "phone", phone(value, key))
        .when(kind == "ssn", ssn(value, key))
        .when(kind == "card", card(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, n_values, kinds), one for each row of docs: the changed text, how many values it had, and their kinds in order."""
    none = F.array().cast("array<string>")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = found.withColumn("hits", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(none))
    found = found.withColumn("tested", F.transform("hits", lambda v: F.when(is_run(v), cards_of_run(v)).otherwise(F.array(F.struct(v.alias("v"), kind_of(v).alias("kind"))))))
    found = found.withColumn("new", F.transform("tested", lambda parts: F.array_join(F.transform(parts, lambda s: pseudonym(s["v"], s["kind"], key)), "")))
    gaps = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat("new", F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")
    kinds = F.transform(F.filter(F.flatten("tested"), lambda s: s["kind"].isNotNull()), lambda s: s["kind"])
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.size("hits") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.size(kinds).cast("long").alias("n_values"),
        kinds.alias("kinds"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
