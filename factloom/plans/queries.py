"""The engine's operators as queries over the driver's tables, each with its SQL where SQL can express it.

Events become facts (facts_of_events): the last event of a day in a key
(user, type) is a fact of that day. Purchases, views and clicks revise each
other within their key; sign-ups lapse after five days; errors are injected, a
tenth of them snapshots that nobody may keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import canon, extract, values
from factloom.operators import audit, containment, questions, reports, table_functions, validate
from factloom.operators import temporal as t
from factloom.plans import commerce, notes, sketches, texts, timeline  # noqa: F401 (they register their queries)
from factloom.plans.registry import QUERIES, SQL, query  # noqa: F401
from factloom.sources import scratch, store, tables


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso(day: str) -> Column:
    return F.col(day).cast("string").alias(day)


def facts_of_events(events: DataFrame) -> DataFrame:
    day = F.to_date("ts")
    last = events.withColumn("d", day).groupBy("user_id", "event_type", "d").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    key = W.partitionBy("user_id", "event_type").orderBy("d")
    kind, eid = F.col("event_type"), F.col("e.event_id")
    fact = F.concat(F.lit("E"), eid.cast("string"))
    chained = kind.isin("purchase", "view", "click")
    channel = F.element_at(F.array(*map(F.lit, values.CHANNELS)), (eid % 4).cast("int") + 1)
    author = F.element_at(F.array(*map(F.lit, values.AUTHORS)), (eid % 3).cast("int") + 1)
    return last.select(
        F.lit(1).alias("seed"), fact.alias("fact_id"), F.lit("contact").alias("entity"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"), F.concat(F.lit("V"), eid.cast("string")).alias("event_id"),
        kind.alias("attribute"), F.col("e.value").cast("decimal(12,2)").cast("string").alias("value"),
        F.struct(F.col("d").alias("start"), F.when(kind == "signup", F.date_add("d", 5)).alias("end")).alias("validity_interval"),
        F.when(kind == "signup", "transient").otherwise("slow_changing").alias("volatility_class"), channel.alias("channel"), author.alias("author"), F.lit(None).cast("string").alias("trust_class"),
        F.when(chained, F.lag(fact).over(key)).alias("supersedes"), F.when(kind == "error", "low").alias("plausibility"), (kind == "error").alias("injection"), ((kind == "error") & (eid % 10 == 0)).alias("never_memorize"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, so that what reads them twice doesn't scan the events twice."""
    return scratch.written(facts_of_events(_t(spark, sf_dir, "events")), "facts")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.lit(1).alias("seed"), F.to_date("ts").alias("timestamp"))


FACTS = """
last_of_day AS (
  SELECT *, CAST(ts AS DATE) AS d FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1),
f AS (
  SELECT 'E' || event_id AS fact_id, 'U' || user_id AS entity_id, event_type AS attribute, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value,
         d AS start_day, CASE WHEN event_type = 'signup' THEN d + 5 END AS end_day, event_id,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN lag('E' || event_id) OVER (PARTITION BY user_id, event_type ORDER BY d) END AS supersedes,
         event_type = 'error' AS injection, event_type = 'error' AND event_id % 10 = 0 AS never_memorize
  FROM last_of_day),
s AS (SELECT f.*, n.start_day AS succ_start FROM f LEFT JOIN f n ON n.supersedes = f.fact_id),
span AS (SELECT min(CAST(ts AS DATE)) AS t0, max(CAST(ts AS DATE)) AS t1 FROM events),
dates AS (
  SELECT 'early' AS horizon, t0 + CAST(floor((t1 - t0) * 0.25) AS INT) AS as_of FROM span UNION ALL
  SELECT 'mid', t0 + CAST(floor((t1 - t0) * 0.55) AS INT) FROM span UNION ALL
  SELECT 'late', t1 FROM span UNION ALL
  SELECT 'current', (SELECT max(start_day) FROM f) + 365),
st AS (
  SELECT s.*, horizon, as_of, CASE WHEN succ_start <= as_of THEN 'superseded' WHEN end_day < as_of THEN 'expired' ELSE 'active' END AS status
  FROM s, dates WHERE start_day <= as_of)
"""


@query(f"WITH {FACTS} SELECT entity_id, attribute, fact_id, value, CAST(as_of AS DATE)::VARCHAR AS as_of FROM st WHERE horizon = 'current' AND status = 'active' AND NOT injection AND NOT never_memorize")
def asof_current_value(spark, sf_dir):
    return t.current_values(_facts(spark, sf_dir)).select("entity_id", "attribute", "fact_id", "value", _iso("as_of"))


@query(SQL["asof_current_value"])
def table_function_asof(spark, sf_dir):
    """The same by the table function in SQL; the day is worked out before, as an argument of it must be a constant."""
    table_functions.register(spark)
    f = _facts(spark, sf_dir)
    day = t.current_as_of(f).first()["as_of"]
    return spark.sql(f"SELECT entity_id, attribute, fact_id, value, '{day}' AS as_of FROM asof(TABLE(SELECT * FROM {{f}} WHERE NOT injection AND NOT never_memorize), DATE'{day}')", f=f)


@query(f"WITH {FACTS} SELECT horizon, CAST(as_of AS DATE)::VARCHAR AS as_of, entity_id, attribute, fact_id, value FROM st WHERE status = 'active' AND NOT injection AND NOT never_memorize")
def asof_horizons(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return t.active_at(f, t.horizons(f, _days(spark, sf_dir))).select("horizon", _iso("as_of"), "entity_id", "attribute", "fact_id", "value")


@query(f"WITH {FACTS} SELECT fact_id, horizon, status FROM st WHERE NOT injection AND NOT never_memorize")
def memory_point_status(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return t.with_status(f.where(t.memorable()), t.horizons(f, _days(spark, sf_dir))).select("fact_id", "horizon", "status")


@query(f"WITH {FACTS} SELECT horizon, status, count(*) AS n FROM st GROUP BY ALL")
def status_counts(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return t.with_status(f, t.horizons(f, _days(spark, sf_dir))).groupBy("horizon", "status").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {FACTS}, walk AS (
  SELECT fact_id AS root, fact_id, 0 AS depth FROM f WHERE supersedes IS NULL UNION ALL
  SELECT walk.root, f.fact_id, depth + 1 FROM walk JOIN f ON f.supersedes = walk.fact_id) SELECT * FROM walk""")
def supersession_chains(spark, sf_dir):
    return t.pointer_chains(_facts(spark, sf_dir)).select("root", "fact_id", "depth")


@query(SQL["supersession_chains"])
def stored_chains(spark, sf_dir):
    """The same from a bucketed store that took the facts in two batches, so that half of all predecessors came late."""
    f = _facts(spark, sf_dir)
    kept = store.FactStore(spark, scratch.place(spark, "store"))
    for k in range(2):
        kept.append(f.where(F.pmod(F.xxhash64("fact_id"), F.lit(2)) == k), f"part-{k}")
    return kept.roots().select("root", "fact_id", "depth")


@query(f"""WITH {FACTS} SELECT entity_id, attribute, count(*) AS length, arg_min(value, start_day) AS first_value, arg_max(value, start_day) AS last_value
FROM f WHERE NOT injection AND NOT never_memorize GROUP BY entity_id, attribute""")
def chain_first_last(spark, sf_dir):
    return t.history(_facts(spark, sf_dir)).where("pos = length - 1").select("entity_id", "attribute", "length", "first_value", "last_value")


@query(f"""WITH {FACTS} SELECT entity_id, attribute, count(*) AS n FROM f WHERE attribute <> 'signup' AND NOT injection GROUP BY ALL HAVING count(*) > 1""")
def duplicate_active(spark, sf_dir):
    loose = _facts(spark, sf_dir).withColumn("supersedes", F.lit(None).cast("string"))
    return t.current_values(loose).groupBy("entity_id", "attribute").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) GROUP BY ALL""")
def interval_violations(spark, sf_dir):
    both = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = both.select(
        F.lit(1).alias("seed"), F.concat(F.lit("L"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))).alias("fact_id"), F.lit("deal").alias("entity"), F.lit("D1").alias("entity_id"), F.lit("V1").alias("event_id"),
        F.lit("flight").alias("attribute"), F.lit("x").alias("value"), F.struct(F.to_date("o_orderdate").alias("start"), F.to_date("l_shipdate").alias("end")).alias("validity_interval"), F.lit("durable").alias("volatility_class"),
        F.lit("call_note").alias("channel"), F.lit("user").alias("author"), F.lit("first_party_note").alias("trust_class"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("plausibility"), F.lit(False).alias("injection"), F.lit(False).alias("never_memorize"))
    return validate.fact_violations(f, ["interval"]).groupBy("key").agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS} SELECT arg_min(fact_id, start_day) AS key, CAST(count(*) - 1 AS VARCHAR) AS detail FROM f WHERE attribute IN ('purchase', 'view', 'click') GROUP BY entity_id, attribute HAVING count(*) > 2""")
def superseded_twice(spark, sf_dir):
    f = _facts(spark, sf_dir).where(F.col("attribute").isin("purchase", "view", "click"))
    first = F.first("fact_id").over(W.partitionBy(*t.KEY).orderBy(t.start_day()))
    star = f.withColumn("supersedes", F.when(first != F.col("fact_id"), first))
    return validate.chain_violations(star).where("check = 'superseded_twice'").select("key", "detail")


@query("""WITH e AS (SELECT ['email_received', 'email_sent', 'order_system', 'call_note'][event_id % 4 + 1] AS channel, ['user', 'counterparty', 'system'][event_id % 3 + 1] AS author FROM events),
trust(channel, author, trust_class) AS (VALUES ('order_system', 'system', 'system_of_record'), ('order_system', 'user', 'first_party_sent'), ('email_sent', 'user', 'first_party_sent'),
 ('email_sent', 'system', 'automated_notification'), ('email_received', 'counterparty', 'counterparty_asserted'), ('email_received', 'system', 'automated_notification'),
 ('email_received', 'user', 'third_party_unverified'), ('call_note', 'user', 'first_party_note'), ('call_note', 'counterparty', 'counterparty_asserted'))
SELECT e.channel, e.author, coalesce(trust_class, 'unknown pair') AS trust_class, count(*) AS n FROM e LEFT JOIN trust USING (channel, author) GROUP BY ALL""")
def trust_derivation(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, values.CHANNELS)), (F.col("event_id") % 4).cast("int") + 1).alias("channel"), F.element_at(F.array(*map(F.lit, values.AUTHORS)), (F.col("event_id") % 3).cast("int") + 1).alias("author"))
    return t.with_trust(e).groupBy("channel", "author", F.coalesce("derived_trust", F.lit("unknown pair")).alias("trust_class")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS top_order FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def infer_argmax(spark, sf_dir):
    return questions.argmax(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.col("o_totalprice"), 2, "top_order").select("o_custkey", "top_order")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS live FROM orders GROUP BY o_custkey")
def infer_count_live(spark, sf_dir):
    return questions.count_where(_t(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") != "F", "live")


@query("SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY c_nationkey HAVING count(*) >= 2")
def infer_sum_budget(spark, sf_dir):
    # orders are summed by customer before they meet their nation
    own = questions.total(_t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), ["o_custkey"], F.col("o_totalprice").cast("decimal(18,2)"), 1)
    both = own.join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = questions.total(both, ["c_nationkey"], F.col("total"), 2, F.col("n"))
    return g.select("c_nationkey", F.col("total").cast("decimal(38,2)").cast("string").alias("total"))


@query("""SELECT l_orderkey, arg_max(l_linestatus, struct_pack(d := l_shipdate, n := l_linenumber, p := l_partkey, s := l_suppkey, l := l_linestatus)) AS state, count(*) AS changes
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_orderkey""")
def order_state_asof(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.latest(li, ["l_orderkey"], "l_linestatus", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"], "state", "changes")


@query("SELECT c_nationkey, arg_max(o_custkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_customer FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def mapping_last_wins(spark, sf_dir):
    own = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    events = _t(spark, sf_dir, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"))
    events = events.select(F.lit(1).alias("seed"), "c_nationkey", "o_custkey", F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("event_id"))
    return t.last_of(events, "c_nationkey", "o_custkey").select("c_nationkey", F.col("o_custkey").alias("last_customer"))


@query(f"WITH {FACTS} SELECT fact_id FROM f WHERE injection AND EXISTS (SELECT 1 FROM f g WHERE g.entity_id = f.entity_id AND g.start_day = f.start_day AND NOT g.injection AND NOT g.never_memorize)")
def injection_siblings(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("day", t.start_day())
    return t.with_sibling(f, ["seed", "entity_id", "day"], t.memorable()).where("injection").select("fact_id")


@query(f"""WITH {FACTS}, h AS (SELECT *, lead(start_day) OVER (PARTITION BY entity_id, attribute ORDER BY start_day) AS nxt FROM f)
SELECT entity_id, attribute, value FROM h WHERE start_day <= DATE '2024-01-15' AND (nxt IS NULL OR nxt > DATE '2024-01-15')""")
def asof_window_form(spark, sf_dir):
    return t.active_by_window(_facts(spark, sf_dir), F.lit("2024-01-15").cast("date")).select("entity_id", "attribute", "value")


@query(f"""WITH {FACTS}, h AS (SELECT fact_id, start_day, (SELECT max(as_of) FROM dates WHERE horizon = 'current') AS cur, (SELECT max(as_of) FROM dates WHERE horizon = 'early') AS e,
 (SELECT max(as_of) FROM dates WHERE horizon = 'mid') AS m, (SELECT max(as_of) FROM dates WHERE horizon = 'late') AS l FROM f)
SELECT fact_id, CASE WHEN start_day >= cur THEN 'current' WHEN abs(e - start_day) <= abs(m - start_day) AND abs(e - start_day) <= abs(l - start_day) THEN 'early'
 WHEN abs(m - start_day) <= abs(l - start_day) THEN 'mid' ELSE 'late' END AS horizon FROM h""")
def nearest_horizon(spark, sf_dir):
    f = _facts(spark, sf_dir)
    dates = t.horizons(f, _days(spark, sf_dir)).groupBy("seed").pivot("horizon", values.HORIZONS).agg(F.first("as_of"))
    return f.join(t.by_seed(dates), "seed").select("fact_id", t.nearest_horizon(t.start_day(), {h: F.col(h) for h in values.HORIZONS}).alias("horizon"))


@query(f"""WITH {FACTS} SELECT s.fact_id, CAST(s.start_day AS VARCHAR) AS start_day, CAST(least(s.end_day, s.succ_start - 1) AS VARCHAR) AS end_day FROM s""")
def close_intervals(spark, sf_dir):
    return t.close_intervals(_facts(spark, sf_dir)).select("fact_id", t.start_day().cast("string").alias("start_day"), t.end_day().cast("string").alias("end_day"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$' || format('{:,.2f}', p_retailprice) WHEN 1 THEN format('{:.2f}', p_retailprice) || ' USD' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || 'k' END AS surface,
 CASE WHEN p_partkey % 3 < 2 THEN CAST(p_retailprice AS DECIMAL(12,2)) ELSE CAST(floor(p_retailprice) * 1000 AS DECIMAL(18,2)) END AS v FROM part)
SELECT p_partkey, surface, 'n:' || regexp_replace(regexp_replace(CAST(v AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS key FROM p""")
def canon_numbers(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(12,2)")
    surface = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), F.format_number(price, 2))).when(F.col("p_partkey") % 3 == 1, F.concat(price.cast("string"), F.lit(" USD"))).otherwise(F.concat(F.floor("p_retailprice").cast("string"), F.lit("k")))
    return _t(spark, sf_dir, "part").select("p_partkey", surface.alias("surface")).withColumn("key", canon.key(F.col("surface")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS surface,
 'd:' || strftime(o_orderdate, '%Y-%m-%d') AS key FROM orders""")
def canon_dates(spark, sf_dir):
    forms = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy"]
    surface = F.coalesce(*(F.when(F.col("o_orderkey") % 4 == k, F.date_format("o_orderdate", f)) for k, f in enumerate(forms)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", surface.alias("surface")).withColumn("key", canon.key(F.col("surface")))


@query("""SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))) AS norm FROM documents""")
def normalize_names(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(canon.normal_name(F.coalesce("text", F.lit("")))).alias("norm"))


_ABBREVIATION = "[A-Za-z]|" + "|".join(extract.ABBREVIATIONS)
_GUARDED = "text"
for _ in range(2):
    _GUARDED = f"regexp_replace({_GUARDED}, '(^|[^A-Za-z])((?i:{_ABBREVIATION})\\.)[ \\t\\r\\f\\v]+', '\\1\\2' || chr(30), 'g')"
_SEGMENTS = f"list_filter(string_split(regexp_replace({_GUARDED}, '([.!?;])[ \\t\\r\\f\\v]+([\"''(\\[]?[A-Z0-9])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x1e]'))"


@query(f"""SELECT doc_id, len({_SEGMENTS}) AS segments, md5(array_to_string(list_transform({_SEGMENTS}, lambda x: trim(regexp_replace(x, '[\\s\\x1e]+', ' ', 'g'))), '|')) AS digest FROM documents""")
def segment_sentences(spark, sf_dir):
    segs = extract.segments(canon.unify(F.coalesce("text", F.lit(""))))
    return _t(spark, sf_dir, "documents").select("doc_id", segs.alias("s")).select("doc_id", F.size("s").cast("long").alias("segments"), F.md5(F.array_join(F.transform("s", lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), "|")).alias("digest"))


_NORM = "' ' || trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g')) || ' '"
_HELD = f"""WITH b AS (SELECT item_id, {_NORM.format('text')} AS p FROM benchmark), d AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents),
 held AS (SELECT doc_id, item_id FROM d, b WHERE contains(t, p) AND p <> '  ')"""


def _held(spark, sf_dir) -> DataFrame:
    return containment.contains_join(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"{_HELD} SELECT doc_id, item_id FROM held")
def contains_benchmark(spark, sf_dir):
    return _held(spark, sf_dir)


@query(f"{_HELD} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM held)")
def corpus_absence(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id").join(_held(spark, sf_dir).select("item_id").distinct(), "item_id", "left_anti")


@query(f"{_HELD} SELECT item_id, doc_id FROM benchmark JOIN documents ON doc_id = item_id * 3 WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.item_id = benchmark.item_id AND held.doc_id = documents.doc_id)")
def recall_missing(spark, sf_dir):
    planted = _t(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"))
    planted = planted.join(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return planted.join(_held(spark, sf_dir), ["doc_id", "item_id"], "left_anti").select("item_id", "doc_id")


@query(f"""WITH pairs AS (
  SELECT u.conv_id, u.turn, list_filter(string_split(trim(regexp_replace(replace(lower(u.text), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS every, a.text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
 n AS (SELECT conv_id, turn, list_distinct(every) AS tokens, list_transform({_SEGMENTS}, lambda x: ' ' || trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g')) || ' ') AS segs FROM pairs),
 c AS (SELECT conv_id, turn, len(tokens) AS tokens, len(list_filter(tokens, lambda w: len(list_filter(segs, lambda s: contains(s, ' ' || w || ' '))) = 0)) AS missing FROM n)
SELECT conv_id, turn, tokens > 0 AND missing = 0 AS matched, CAST(tokens - missing AS BIGINT) AS n_matched, CAST(missing AS BIGINT) AS n_missing FROM c""")
def judge_tokens(spark, sf_dir):
    """Each reply judged by all distinct words of the turn before it, digits left as names."""
    c = _t(spark, sf_dir, "conversations")
    words = F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != ""))
    ask = c.where("role = 'user'").select("conv_id", "turn", canon.normal_name(F.col("text")).alias("norm")).select("conv_id", "turn", words.alias("gold_tokens"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = ask.join(reply, ["conv_id", "turn"]).withColumns({"gold_kind": F.lit("value"), "gold_answer": F.array_join("gold_tokens", " ")})
    judged = audit.judge(both)
    return judged.select("conv_id", "turn", (F.col("matched") & (F.size("gold_tokens") > 0)).alias("matched"), F.size("matched_tokens").cast("long").alias("n_matched"), F.size("missing_tokens").cast("long").alias("n_missing"))


@query(f"""WITH {FACTS}, g AS (SELECT attribute, horizon, count(*) AS n FROM st WHERE status = 'active' GROUP BY GROUPING SETS ((attribute), (horizon), (attribute, horizon)))
SELECT coalesce(attribute, 'all') AS attribute, coalesce(horizon, 'all') AS horizon, n FROM g""")
def counts_by_grouping(spark, sf_dir):
    f = _facts(spark, sf_dir)
    active = t.with_status(f, t.horizons(f, _days(spark, sf_dir))).where("status = 'active'")
    g = reports.counts_by(active, ("attribute",), ("horizon",), ("attribute", "horizon"))
    return g.select(F.coalesce("attribute", F.lit("all")).alias("attribute"), F.coalesce("horizon", F.lit("all")).alias("horizon"), "n")


@query(f"WITH {FACTS} SELECT attribute, CAST(round(CAST(100.0 * count(*) FILTER (supersedes IS NOT NULL) / greatest(count(*), 1) AS DECIMAL(18,6)), 1) AS DECIMAL(9,1)) AS revised_pct FROM f GROUP BY attribute")
def percent_revised(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("attribute").agg(t.percentage(F.count_if(F.col("supersedes").isNotNull()), F.count("*")).alias("revised_pct"))


@query(f"WITH {FACTS} SELECT entity_id, CAST(start_day AS VARCHAR) AS day, bool_or(attribute = 'signup') AND bool_or(attribute = 'purchase') AS both FROM f GROUP BY ALL")
def co_occurrence(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("day", t.start_day().cast("string"))
    return t.co_occurrence(f, ["entity_id", "day"], F.col("attribute") == "signup", F.col("attribute") == "purchase")


@query("""WITH p AS (SELECT DISTINCT p_size % 3 AS seed, p_name FROM part)
SELECT l.seed AS left_seed, r.seed AS right_seed, count(*) AS shared FROM p l JOIN p r ON l.p_name = r.p_name AND l.seed < r.seed GROUP BY ALL""")
def cross_seed_overlap(spark, sf_dir):
    return reports.shared_names(_t(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("seed"), "p_name"), "p_name")


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def stable_digest(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.sha2(tables.json_line(n), 256).alias("digest"))


@query("""SELECT o_custkey, string_agg(o_orderpriority, '>' ORDER BY first_key) AS seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def ordered_distinct(spark, sf_dir):
    seen = reports.first_seen(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return seen.select("o_custkey", F.array_join("seen", ">").alias("seen"))


@query("SELECT 'Q-1-' || lpad(CAST(row_number() OVER (ORDER BY s_nationkey, s_name) AS VARCHAR), 4, '0') AS question_id, s_suppkey FROM supplier")
def numbered_ids(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").withColumn("seed", F.lit(1))
    return t.numbered(s, "Q", "question_id", "s_nationkey", "s_name").select("question_id", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def pending_resume(spark, sf_dir):
    events = _t(spark, sf_dir, "customer").select(F.lit(1).alias("seed"), F.col("c_custkey").alias("event_id"))
    done = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit(1).alias("seed"), F.col("o_custkey").alias("event_id"), F.lit("pass").alias("fidelity"), F.lit("template").alias("render_mode"))
    return tables.pending(events, done, "template").select(F.col("event_id").alias("c_custkey"))


@query("""SELECT sha256(string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation""")
def jsonl_digest(spark, sf_dir):
    return spark.createDataFrame([(tables.line_digest(_t(spark, sf_dir, "nation"), ["n_nationkey"]),)], "digest string")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'states', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'days', max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) FROM orders")
def completion_counts(spark, sf_dir):
    """Facts, entities and span of one seed, with orders as events."""
    o = _t(spark, sf_dir, "orders").select(F.lit(1).alias("seed"), F.col("o_custkey").alias("advertiser_id"), F.col("o_orderstatus").alias("deal_id"), F.lit("x").alias("io_id"), F.to_date("o_orderdate").alias("timestamp"))
    r = reports.completion(o, o, o)
    names = {"orders": "events", "customers": "advertisers", "states": "deals", "days": "span_days"}
    return r.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(c).cast("long").alias("n")) for k, c in names.items()))))
