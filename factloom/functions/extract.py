"""Segments, and the dates, numbers and names that a text holds.

A text is indexed once (text_index); containment and support are then tests on
its arrays. All of it is SQL functions on arrays, so a document's index is made in
the task that reads it, without a shuffle. Values are taken out of a segment by
their place (a match that starts inside an earlier one doesn't count), not by what
they look like, so an equal text elsewhere stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import canon
from .canon import let

# Words before a point that ends no sentence, words that link parts of a name, and token patterns.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st inc corp co ltd llc lp dept est approx no vs etc eg ie jan feb mar apr jun jul aug sep sept oct nov dec am pm ext attn fig cf al".split()
CONNECTORS = ["of", "and", "&", "the", "for", "de", "la"]
# Repeated groups are possessive, since Java's matcher recurses on others; what follows them makes that no difference.
CODE = r"(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*\d)[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+"
MAGNITUDE = r"(?i)^\d+(?:\.\d+)?(?:k|mm|m|bn|b)$"
NUMBER_IN_TEXT = r"(?i)(?<![0-9A-Za-z.])(?:(?:\$|us\$)\s*+)?-?(?:" + canon.NUMBER + r")(?:\s*(?:k|mm|m|bn|b)(?![A-Za-z0-9_]))?(?:\s*%)?(?![0-9])"

#: Words that never make a name alone. A setting, not semantics: pass your own list where this short one is too small.
SAFE_WORDS = tuple("""a about after all also an and any are as ask at be before best both but by call can confirm could current date day
dear did do does due each end every final first flight for from full good had has have he hello her here his how i if in is it its just
last late let line live may me month more most my new next no not note now of on once one only or order our out over per please rate
regards same see she should since so some start status still subject such team than thanks that the their them then there these they this those
to today total under until up update us value was we week were what when where which while who why will with would yes you your de la
ad agency campaign cpm io impressions someone orders something hello automatic sales operations talked team""".split())

PARTS = ("dates", "months", "names", "numbers")
#: What containment of values needs.
VALUES = ("dates", "numbers")

_BREAK = "\u0002"
_LINK = "\u0001"
_EDGE = "\u0004"


def segments(text: Column) -> Column:
    """Parts of a (unified) text that no name crosses: lines, and sentences unless an abbreviation or initial stands before the point."""
    guard = "|".join(["[a-z]", *ABBREVIATIONS])
    split = rf"(?<=[.!?;])(?<!(?<![A-Za-z])(?i:{guard})\.)\s+(?=[\"'(\[]?[A-Z0-9])|\n"
    return F.filter(F.split(text, split), lambda s: s.rlike(r"\S"))


_SPANS = "array<struct<surface:string,value:string,a:int,b:int>>"
#: Items of an array that are folded one by one; blocks of so many are folded as wholes.
BLOCK = 256


def running(numbers: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers from 0 on the merge (a sum or maximum) of all before it.

    Arrays grow by copying, so a fold over the whole would take quadratic time; here only blocks and the list of blocks grow.
    """

    def fold(items: Column, of) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda s, x: F.struct(merge(s["now"], of(x)).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")))

    def whole(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda k: fold(F.slice(all_, k, BLOCK), lambda x: x))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(bs, lambda x: x["now"])["out"], lambda b, at: F.transform(b["out"], lambda x: merge(at, x)))))

    return let(numbers, lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(F.array().cast("array<int>")))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, value) -> Column:
    """Matches as (surface, value, a, b): from byte a up to b; value maps a surface to a text, null for a match that doesn't count."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def place(both: Column) -> Column:
        before = running(F.transform(both, lambda x: F.octet_length(x["gap"]) + F.octet_length(x["hit"])), _plus)

        def hit(x: Column, at: Column) -> Column:
            a = at + F.octet_length(x["gap"])
            return F.struct(x["hit"].alias("surface"), value(x["hit"]).cast("string").alias("value"), a.alias("a"), (a + F.octet_length(x["hit"])).alias("b"))

        return F.filter(F.zip_with(both, before, hit), lambda h: h["value"].isNotNull())

    def zipped(hits: Column) -> Column:
        pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
        return F.when(F.size(hits) > 0, let(pairs, place)).otherwise(F.array().cast(_SPANS))

    return let(found, zipped)


def _masked(text: Column, spans: Column) -> Column:
    """text with as many spaces in place of its spans. Bytes are taken, since a place in them is found without walking there."""

    def cut(ordered: Column, raw: Column) -> Column:
        def piece(x: Column, at: Column) -> Column:
            return F.concat(F.substr(raw, at + 1, F.greatest(x["a"] - at, F.lit(0))).cast("string"), F.repeat(F.lit(" "), F.greatest(x["b"] - F.greatest(x["a"], at), F.lit(0))))

        pieces = F.zip_with(ordered, running(F.transform(ordered, lambda x: x["b"]), F.greatest), piece)
        return F.concat(F.array_join(pieces, ""), F.substr(raw, F.array_max(F.transform(ordered, lambda x: x["b"])) + 1).cast("string"))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    return F.when(F.size(spans) > 0, let(text.cast("binary"), lambda raw: let(ordered, lambda o: cut(o, raw)))).otherwise(text)


def _apart(spans: Column, taken: Column, inside: bool) -> Column:
    """The spans that don't start inside one of taken (inside) or don't overlap one, in one pass over both by their places."""
    own = F.transform(spans, lambda h: F.struct((h["a"] if inside else h["b"]).alias("at"), F.lit(1 if inside else 0).alias("kind"), F.lit(0).alias("end"), h.alias("hit")))
    others = F.transform(taken, lambda t: F.struct(t["a"].alias("at"), F.lit(0 if inside else 1).alias("kind"), t["b"].alias("end"), F.lit(None).cast(_SPANS[6:-1]).alias("hit")))

    def left(merged: Column) -> Column:
        ends = running(F.transform(merged, lambda x: x["end"]), F.greatest)
        both = F.zip_with(merged, ends, lambda x, end: F.struct(x["hit"].alias("hit"), end.alias("end")))
        return F.transform(F.filter(both, lambda x: x["hit"].isNotNull() & (x["end"] <= x["hit"]["a"])), lambda x: x["hit"])

    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(let(F.array_sort(F.concat(own, others)), left))


_DAY_STEPS = (
    (r"(?<![\d/-])\d{4}-\d{2}-\d{2}(?![\d-])", canon.iso_day),
    (r"(?i)(?<![A-Za-z0-9_])" + canon.MDY.removeprefix("(?i)") + r"(?![A-Za-z0-9_])", canon.mdy_day),
    (r"(?i)(?<![A-Za-z0-9_])" + canon.DMY.removeprefix("(?i)") + r"(?![A-Za-z0-9_])", canon.dmy_day),
    (r"(?<![\d/-])\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})(?![\d/])", canon.slash_day),
)
_PARTIAL = r"(?i)(?<![A-Za-z0-9_])" + canon.MONTH_YEAR.removeprefix("(?i)") + r"(?![A-Za-z0-9_])"


#: Columns to be added to a table one after the other: names, and expressions over the columns before.
Steps = list[tuple[str, Column]]


def _span_steps(out: str, text: str, pattern: str, value, taken: str | None = None, inside: bool = True) -> Steps:
    """The column out: the spans of a text column that stand apart from those in the column taken."""
    steps = [(out, _spans(F.col(text), pattern, value))]
    return [*steps, (out, _apart(F.col(out), F.col(taken), inside))] if taken else steps


def _date_steps() -> Steps:
    """_days and _months (spans of _whole, in order of format) and _rest: _whole without them. Only true days are taken out."""
    steps = [("_days", F.array().cast(_SPANS))]
    for pattern, day in _DAY_STEPS:  # a day of one format that starts inside one of a format before isn't one
        steps += [*_span_steps("_more", "_whole", pattern, day, "_days"), ("_days", F.concat("_days", "_more"))]
    steps += _span_steps("_months", "_whole", _PARTIAL, canon.month_of, "_days", inside=False)
    return [*steps, ("_rest", _masked(F.col("_whole"), F.concat("_days", "_months")))]


def names(segment: Column, safe=SAFE_WORDS) -> Column:
    """Runs of capitalised words, acronyms and codes. Connectors may stand inside; punctuation ends a run."""
    links = "|".join(CONNECTORS)
    safe_run = r"(?i)^(?:(?:" + "|".join(re.escape(w) for w in sorted({*safe, "of", "and", "de", "la"})) + r")(?: +|$))++"

    def mark(token: Column) -> Column:
        def of(b: Column) -> Column:
            is_name = b.rlike(f"^{CODE}$") | b.rlike(r"^\p{Lu}{2,}$") | b.rlike(r"^[A-Z][A-Za-z'&-]*$")
            shown = F.when(is_name, b).when(F.lower(b).isin(CONNECTORS), F.concat(F.lit(_LINK), b)).otherwise(F.lit(_BREAK))
            ends = F.regexp_replace(token, "[)\"']+$", "").rlike("[.,;:!?]$")
            return F.concat(shown, F.when(ends, F.lit(_BREAK)).otherwise(F.lit("")))

        return let(canon.bare(token), of)

    tokens = F.filter(F.split(segment, r"\s+"), lambda t: t != "")
    runs = F.split(F.array_join(F.transform(tokens, mark), " "), _BREAK)

    def trimmed(run: Column) -> Column:
        run = F.regexp_replace(F.trim(run), f"^(?:{_LINK}[^ ]+ *)++", "")
        run = F.regexp_replace(run, rf"(?i)(?:(?:^| +){_LINK}?(?:{links}))++$", "")
        run = F.replace(run, F.lit(_LINK), F.lit(""))
        return F.trim(F.regexp_replace(run, safe_run, ""))

    return F.filter(F.transform(runs, trimmed), lambda r: r != "")


@canon.once
def _index_steps(text_col: str, safe: tuple[str, ...], parts: tuple[str, ...]) -> Steps:
    """The column idx of what is asked for in parts, and the columns that it needs: dates first, then names, then codes out, then numbers."""
    steps = [("_segs", segments(canon.unify(F.coalesce(F.col(text_col), F.lit("")))))]
    out = {}
    if parts:
        # a text's segments are read in one go: no pattern reaches across what stands between them
        steps += [("_whole", F.array_join("_segs", f" {_EDGE} ")), *_date_steps()]
        out["dates"] = F.transform("_days", lambda h: F.struct(h["surface"].alias("surface"), h["value"].cast("date").alias("day")))
        out["months"] = F.transform("_months", lambda h: F.struct(h["surface"].alias("surface"), h["value"].cast("int").alias("month")))
    if "names" in parts:
        out["names"] = names(F.col("_rest"), safe)
    if "numbers" in parts:
        steps += _span_steps("_codes", "_rest", rf"(?<![\w-]){CODE}(?![\w-])", lambda c: F.when(~c.rlike(MAGNITUDE), c))
        steps.append(("_found", F.regexp_extract_all(_masked(F.col("_rest"), F.col("_codes")), F.lit(NUMBER_IN_TEXT), 0)))
        found = F.transform("_found", lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))
        out["numbers"] = F.filter(F.transform(found, lambda n: F.struct(n.alias("surface"), canon.number(n).alias("value"))), lambda n: n["value"].isNotNull())
    norm = F.transform(F.split(canon.fold(F.array_join("_segs", "\n")), "\n"), canon.words)
    return [*steps, ("idx", F.struct(norm.alias("seg_norm"), *(out[c].alias(c) for c in PARTS if c in parts)))]


def text_index(texts: DataFrame, text_col: str = "text", safe=SAFE_WORDS, parts=PARTS) -> DataFrame:
    """texts with the column idx: seg_norm, and of dates, months, names and numbers those in parts (null text: empty). Dates stand in order of format and place, others by place."""
    df = texts
    for name, column in _index_steps(text_col, tuple(safe), tuple(parts)):
        df = df.withColumn(name, column)
    return df.select(*(c for c in texts.columns if c != "idx"), "idx")


def contains(idx: Column, v: Column) -> Column:
    """Whether an indexed text holds a value(): its date or number in any form, its name as a run of words in one segment."""
    in_names = (v["norm"] != "") & F.exists(idx["seg_norm"], lambda s: F.contains(padded(s), padded(v["norm"])))
    test = F.when(v["kind"] == "date", F.exists(idx["dates"], lambda d: d["day"] == v["day"])).when(v["kind"] == "number", F.exists(idx["numbers"], lambda n: n["value"] == v["num"])).otherwise(in_names)
    return F.coalesce(test, F.lit(False))


def padded(words: Column) -> Column:
    """Words between spaces, so that a run of words is a substring."""
    return F.concat(F.lit(" "), words, F.lit(" "))


def value(text: Column) -> Column:
    """The canonical struct (kind, day, num, norm, key) of a value; all null for null."""

    def whole(v: Column) -> Column:
        kind = F.when(v["day"].isNotNull(), "date").when(v["num"].isNotNull(), "number").when(v["norm"].isNotNull(), "name")
        key = F.coalesce(F.concat(F.lit("d:"), v["day"].cast("string")), F.concat(F.lit("n:"), v["num"]), F.concat(F.lit("s:"), v["norm"]))
        return F.struct(kind.alias("kind"), v["day"].alias("day"), v["num"].alias("num"), v["norm"].alias("norm"), key.alias("key"))

    return canon.let(let(canon.unify(text), lambda p: F.struct(canon.date(p).alias("day"), canon.number(p).alias("num"), canon.words(canon.fold(p)).alias("norm"))), whole)


@canon.once
def _value_of(col: str) -> Column:
    return value(F.col(col))


def with_value(df: DataFrame, col: str, prefix: str = "v") -> DataFrame:
    """df with the canonical columns of a value column: {prefix}_kind, _day, _num, _norm, _key."""
    own = f"_{prefix}"
    return df.withColumn(own, _value_of(col)).withColumns({f"{prefix}_{c}": F.col(f"{own}.{c}") for c in ("kind", "day", "num", "norm", "key")}).drop(own)


def holds(idx: Column, prefix: str = "v") -> Column:
    return contains(idx, F.struct(*(F.col(f"{prefix}_{c}").alias(c) for c in ("kind", "day", "num", "norm"))))


def value_in_text(value_: Column, idx: Column) -> Column:
    """Whether an indexed text holds a value given as text; null isn't held."""
    return let(value(value_), lambda v: contains(idx, v))


def supports_name(tokens: Column, phrases: Column, safe=SAFE_WORDS) -> Column:
    """Whether a name's words are all safe, stand in one of phrases (normalised), or do so piece by piece between safe words."""
    safe_set = F.array(*map(F.lit, sorted({*safe, "of", "and", "de", "la"})))

    def inside(piece: Column) -> Column:
        return F.exists(phrases, lambda p: F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), piece, F.lit(" "))))

    marked = F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(safe_set, t), F.lit(_BREAK)).otherwise(t)), " ")
    parts = F.filter(F.transform(F.split(marked, _BREAK), lambda p: F.trim(p)), lambda p: p != "")
    whole = F.array_join(tokens, " ")
    return (whole == "") | inside(whole) | (F.forall(parts, inside) & ((F.size(parts) == 0) | (parts[0] != whole)))
