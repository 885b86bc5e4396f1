"""Operators along time as table functions, for callers that write SQL.

register(spark) brings asof and periods into a session:

    SELECT * FROM asof(TABLE(facts), DATE'2024-06-30')
    SELECT * FROM periods(TABLE(stays), 'room', 'arrived', 'left_on')

Both look at the table that they are called with: the result has its columns (asof) or its keys' types (periods), and
they ask Spark for the partitioning and the order that they need, so a caller names neither. A key streams
through one task in order and is never held whole: asof keeps the facts of one day and the pointers to facts that
have not come yet, periods one count a day on which something that has begun will end. The forms over DataFrames
(operators.temporal, operators.timeline) combine before they shuffle and stay the choice for keys with very many rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf

from factloom.operators.temporal import KEY
from factloom.sources.scratch import workers_import_us

_EPOCH, _LAST = date(1970, 1, 1).toordinal(), date.max.toordinal() - date(1970, 1, 1).toordinal()
_ASOF_NEEDS = [*KEY, "fact_id", "supersedes", "validity_interval"]


def _table(name: str, arg: AnalyzeArgument, needs: list[str]) -> T.StructType:
    if not arg.isTable:
        raise ValueError(f"{name} takes a table first: {name}(TABLE(t), ...)")
    lacks = [c for c in needs if c not in arg.dataType.fieldNames()]
    if lacks:
        raise ValueError(f"{name}: the table has no column {', '.join(lacks)}")
    return arg.dataType


class AsOf:
    """The facts of a table that are active on a day, with all columns that the table has.

    As operators.temporal.status has it: a fact is known from its start on, superseded once a fact that names it has started,
    expired behind its end. Facts come latest first, so a fact's successor has been seen before it or starts
    on the same day. Pointers to facts of other keys (a violation of its own) are not followed. A null day gives no rows.
    """

    @staticmethod
    def analyze(facts: AnalyzeArgument, day: AnalyzeArgument) -> AnalyzeResult:
        schema = _table("asof", facts, _ASOF_NEEDS)
        if facts.isTable and not isinstance(day.dataType, (T.DateType, T.NullType)):
            raise ValueError("asof: the day must be a DATE")
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(c) for c in KEY], orderBy=[OrderingColumn("validity_interval.start", ascending=False, overrideNullsFirst=False)])

    def __init__(self):
        self.named: set[str] = set()
        self.today: list = []
        self.start: date | None = None

    def eval(self, facts, day) -> Iterator[tuple]:
        start = facts["validity_interval"]["start"] if facts["validity_interval"] is not None else None
        if day is None or start is None or start > day:
            return
        if start != self.start:
            yield from self._active()
            self.start = start
        if facts["supersedes"] is not None:
            self.named.add(facts["supersedes"])
        end = facts["validity_interval"]["end"]
        self.today.append((facts, end is None or end >= day))

    def terminate(self) -> Iterator[tuple]:
        yield from self._active()

    def _active(self) -> Iterator[tuple]:
        """The facts of one start, now that all that could supersede them has been seen."""
        for fact, lasts in self.today:
            if fact["fact_id"] not in self.named and lasts:
                yield tuple(fact)
        self.named -= {fact["fact_id"] for fact, _ in self.today}
        self.today = []


class Periods:
    """The periods of each key in which n intervals of a table hold, as operators.timeline.periods has them.

    keys names the key columns, parted by commas; start and end name date columns, or columns of arrays of dates, where a row holds
    several intervals of its key (packed). Intervals that have no start, or end before it, count as none; a null end is open.
    """

    @staticmethod
    def analyze(intervals: AnalyzeArgument, keys: AnalyzeArgument, start: AnalyzeArgument, end: AnalyzeArgument) -> AnalyzeResult:
        if not all(isinstance(a.value, str) for a in (keys, start, end)):
            raise ValueError("periods takes names of columns as constant strings")
        names = [k.strip() for k in keys.value.split(",")]
        schema = _table("periods", intervals, [*names, start.value, end.value])
        kinds = [schema[c].dataType for c in (start.value, end.value)]
        several = all(isinstance(k, T.ArrayType) and isinstance(k.elementType, T.DateType) for k in kinds)
        for c, kind in zip((start.value, end.value), kinds, strict=True):
            if not several and not isinstance(kind, T.DateType):
                raise ValueError(f"periods: {c} must be a DATE, or both columns arrays of them")
        out = T.StructType([schema[k] for k in names]).add("start", T.DateType()).add("end", T.DateType()).add("n", T.LongType())
        # days come as numbers, which cost less to bring to Python than dates; rows of equal first starts are ordered by their last ones
        days = (f"transform(`{c}`, d -> unix_date(d))" if several else f"array(unix_date(`{c}`))" for c in (start.value, end.value))
        select = [*(SelectedColumn(f"`{k}`", k) for k in names), *map(SelectedColumn, days, ("_starts", "_ends"))]
        at = f"`{start.value}`"
        order = [OrderingColumn(f"get({at}, 0)"), OrderingColumn(f"get({at}, size({at}) - 1)")] if several else [OrderingColumn(at)]
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(f"`{k}`") for k in names], orderBy=order, select=select)

    def __init__(self):
        self.key: tuple | None = None
        self.changes: dict[int, int] = {}
        self.days: list[int] = []
        self.since: date | None = None
        self.n = 0

    def eval(self, intervals, keys, start, end) -> Iterator[tuple]:
        *key, starts, ends = intervals
        first = next((s for s in starts or () if s is not None), None)
        if first is None:
            return
        if self.key is None:
            self.key = tuple(key)
        changes, days = self.changes, self.days
        yield from self._upto(first)
        for s, e in zip(starts, ends, strict=True):
            if s is None or (e is not None and e < s):
                continue
            for day, by in ((s, 1),) if e is None or e >= _LAST else ((s, 1), (e + 1, -1)):
                if day in changes:
                    changes[day] += by
                else:
                    heapq.heappush(days, day)
                    changes[day] = by

    def terminate(self) -> Iterator[tuple]:
        yield from self._upto(None)
        if self.n:
            yield *self.key, self.since, None, self.n

    def _upto(self, day: int | None) -> Iterator[tuple]:
        """Periods that end before the day, since starts come in order."""
        while self.days and (day is None or self.days[0] < day):
            at = heapq.heappop(self.days)
            by = self.changes.pop(at)
            if by:
                if self.since is not None:
                    yield *self.key, self.since, date.fromordinal(_EPOCH + at - 1), self.n
                self.since, self.n = date.fromordinal(_EPOCH + at), self.n + by


#: Intervals of a key in one row of packed().
PACK = 1000


def packed(intervals: DataFrame, keys: list[str], start: str, end: str, size: int = PACK) -> DataFrame:
    """(keys, start, end) with up to `size` intervals of a key in a row, as arrays in order of start: calls of periods() cost a row in Python, not an interval.

    Rows are numbered as they stream by, so a key with very many of them is held nowhere.
    """
    order = W.partitionBy(*keys).orderBy(start)
    part = F.floor((F.row_number().over(order) - 1) / size)
    rows = intervals.withColumn("_part", part).groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(F.struct(start, end))).alias("_held"))
    return rows.select(*keys, F.col(f"_held.{start}").alias(start), F.col(f"_held.{end}").alias(end))


def register(spark: SparkSession) -> None:
    """Brings asof and periods into the session."""
    workers_import_us(spark)
    spark.udtf.register("asof", udtf(AsOf))
    spark.udtf.register("periods", udtf(Periods))
