"""A synthetic universe: advertisers, deals and order lines with facts that change over time.

Draws are hashes of (seed, entity, purpose), never a sequence, so seeds and
entities are independent, every run gives the same rows, and seeds are
partitions. Names come from the short lists below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import canon, values

from . import temporal as t

FIRST = "Ana Bruno Carla Davor Elin Farid Greta Hugo Ines Jonas Keiko Lior Mara Nils Olga Pavel".split()
LAST = "Abelson Birch Castell Dorn Eklund Farrow Gatti Holm Ibarra Jansen Kovar Lund Moreau Novak Ostrow Petrov".split()
ROOTS = "Quillmark Brightfen Tessaly Orrin Valdmere Kestrow Lumenor Halvick Norrway Pelmont Ravensby Sorrel Thornby Umbral Wexcombe Yarrowind".split()
KINDS = "Foods Motors Outfitters Energy Travel Health".split()
AGENCIES = "Atlasgrove Bluehatch Cindermere Driftwell Emberline Foxhollow".split()
RATES = ["18.00", "19.50", "21.00", "22.50", "24.00", "26.50", "28.00", "31.50"]
START = "2025-01-06"

#: Least of each kind of entity in a seed.
ADVERTISERS, DEALS, LINES = 10, 4, 2
#: Share of a seed's deals that are corrected. The first six by hash are corrected in two steps, at least LEAST_MORE others once.
CORRECTED, LEAST_MORE = 0.45, 6
FIRST_PLANS = ["rate twice"] * 3 + ["flight, then cancelled"] * 3
MORE_PLANS = ["rate once", "impressions", "flight", "activation"]


def draw(*parts, upto: int) -> Column:
    return F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit(upto)).cast("int")


def pick(words: list[str], *parts) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), draw(*parts, upto=len(words)) + 1)


def _fact(entity: str, entity_id: Column, attribute: str, value: Column, volatility: str, revises: bool = False, days: int | None = None, injected: str | None = None, snapshot: bool = False) -> Column:
    return F.struct(
        F.lit(entity).alias("entity"), entity_id.cast("string").alias("entity_id"), F.lit(attribute).alias("attribute"), value.cast("string").alias("value"), F.lit(volatility).alias("volatility_class"),
        F.lit(revises).alias("revises"), F.lit(days).cast("int").alias("days"), F.lit(injected).cast("string").alias("plausibility"), F.lit(injected is not None).alias("injection"), F.lit(snapshot).alias("never_memorize"))


def _event(df: DataFrame, kind: str, day: Column, channel: str, author: str, subject: Column, facts: list[Column]) -> DataFrame:
    def or_null(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    return df.select(
        "seed", F.lit(kind).alias("scenario_kind"), F.date_add(F.lit(START).cast("date"), day.cast("int")).alias("timestamp"), F.lit(channel).alias("channel"), F.lit(author).alias("author"), subject.alias("subject"),
        "advertiser_id", "advertiser_name", or_null("agency_name").alias("agency_name"), or_null("contact_name").alias("contact_name"), or_null("deal_id").alias("deal_id"), or_null("io_id").alias("io_id"),
        F.array(*facts).alias("facts"))


def plan(spark: SparkSession, seeds: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(advertisers, deals, lines): the entities of each seed with the draws that events share."""
    s = F.col("seed")
    base = spark.createDataFrame([(x,) for x in seeds], "seed int")
    adv = base.select("seed", F.explode(F.sequence(F.lit(0), F.lit(ADVERTISERS - 1) + draw(s, "advertisers", upto=2))).alias("a"))
    a = F.col("a")
    # distinct names: a seeded offset into the list, then one step an advertiser
    root = F.element_at(F.array(*map(F.lit, ROOTS)), F.pmod(a + draw(s, "roots", upto=len(ROOTS)), F.lit(len(ROOTS))) + 1)
    name = F.concat(root, F.lit(" "), pick(KINDS, s, a, "kind"))
    person = F.concat(F.element_at(F.array(*map(F.lit, FIRST)), F.pmod(a * 3 + draw(s, "first", upto=16), F.lit(16)) + 1), F.lit(" "), F.element_at(F.array(*map(F.lit, LAST)), F.pmod(a + draw(s, "last", upto=16), F.lit(16)) + 1))
    adv = adv.withColumns({
        "advertiser_id": F.format_string("ADV-%d-%02d", s, a), "advertiser_name": name, "root": F.lower(root), "contact_name": person, "contact_id": F.format_string("CON-%d-%02d", s, a),
        "agency_name": F.concat(pick(AGENCIES, s, a, "agency"), F.lit(" Media")), "day": a * 3 + draw(s, a, "day", upto=3),
    })
    deals = adv.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).withColumns({
        "deal_id": F.format_string("DEAL-%d-%02d%d", s, a, F.col("d")), "deal_day": F.col("day") + 20 + F.col("d") * 12 + draw(s, a, F.col("d"), "deal", upto=6),
        "deal_name": F.concat("root", F.lit(" "), pick(["Harvest", "Meridian", "Solstice", "Lantern", "Compass"], s, a, F.col("d"), "deal name"), F.lit(" "), F.col("d").cast("string")),
    })
    deals = deals.withColumn("deal_name", canon.title(F.col("deal_name"))).withColumn("plan", _plan_of())
    lines = deals.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(LINES - 1)))).withColumns({
        "io_id": F.format_string("IO-%d-%04d", s, (a * DEALS + F.col("d")) * LINES + F.col("l") + 1), "n": (a * DEALS + F.col("d")) * LINES + F.col("l"), "line_day": F.col("deal_day") + 4 + F.col("l"),
        "rate": draw(s, a, F.col("d"), F.col("l"), "rate", upto=len(RATES)), "goal": (draw(s, a, F.col("d"), F.col("l"), "goal", upto=40) + 10) * 10_000,
    })
    # the rungs that a line's rate, its revisions, a claim and a rate card take, each unlike those before
    for k in range(1, 5):
        lines = lines.withColumn(f"rate{k}", next_rung(F.col(f"rate{k - 1 or ''}"), F.array("rate", *(f"rate{j}" for j in range(1, k)))))
    return adv, deals, lines


def _plan_of() -> Column:
    """How a deal is corrected; null for those that never are. A seed's deals, a few dozen, are ranked by a seeded hash."""
    one = W.partitionBy("seed")
    slot = F.row_number().over(one.orderBy(F.xxhash64("seed", "a", "d", F.lit("corrected")), "a", "d")) - 1
    n = F.least(F.greatest(F.ceil(F.count("*").over(one) * CORRECTED), F.lit(len(FIRST_PLANS) + LEAST_MORE)), F.count("*").over(one))
    more = F.element_at(F.array(*map(F.lit, MORE_PLANS)), (F.pmod(slot - len(FIRST_PLANS), F.lit(len(MORE_PLANS))) + 1).cast("int"))
    return F.when(slot < len(FIRST_PLANS), F.element_at(F.array(*map(F.lit, FIRST_PLANS)), F.least(slot + 1, F.lit(len(FIRST_PLANS))).cast("int"))).when(slot < n, more)


def next_rung(now: Column, used: Column) -> Column:
    """The rung nearest to now that isn't among used, the lower of two, null if all are; rungs are places in RATES from 0."""
    steps = F.array(*(F.lit(s) for d in range(1, len(RATES)) for s in (-d, d)))
    return F.get(F.filter(F.transform(steps, lambda s: now + s), lambda r: (r >= 0) & (r < len(RATES)) & ~F.array_contains(used, r)), F.lit(0))


def _rate(rung: str) -> Column:
    return F.element_at(F.array(*map(F.lit, RATES)), F.col(rung) + 1)


def scenarios(spark: SparkSession, seeds: list[int]) -> DataFrame:
    """All events with their facts inline, before ids."""
    adv, deals, lines = plan(spark, seeds)
    A, D, L, C = (F.col(c) for c in ("advertiser_id", "deal_id", "io_id", "contact_id"))
    s, a, n = F.col("seed"), F.col("a"), F.col("n")
    turn = F.pmod(n, F.lit(10))  # what else happens to a line goes by one plan of ten
    first = F.col("l") == 0  # a deal's plan of corrections falls on its first line
    lie = (turn == 8) & F.pmod(n, F.lit(30)).isin(8, 18, 28)

    def plan_is(*names: str) -> Column:
        return F.col("plan").isin(*names)

    new_agency = F.concat(F.element_at(F.array(*map(F.lit, AGENCIES)), F.pmod(draw(s, a, "agency", upto=len(AGENCIES)) + 1, F.lit(len(AGENCIES))) + 1), F.lit(" Media"))
    new_person = F.concat(pick(FIRST, s, a, "handoff"), F.lit(" Z"), F.lower(F.substring_index("contact_name", " ", -1)))

    def io(df: DataFrame, kind: str, day: Column, channel: str, author: str, facts: list[Column]) -> DataFrame:
        return _event(df, kind, day, channel, author, F.concat(canon.title(F.lit(kind.replace("_", " "))), F.lit(" for "), L), facts)

    def ad(df: DataFrame, kind: str, day: Column, channel: str, author: str, facts: list[Column]) -> DataFrame:
        return _event(df, kind, day, channel, author, F.concat(canon.title(F.lit(kind.replace("_", " "))), F.lit(" for "), "advertiser_name"), facts)

    flight = F.date_add(F.lit(START).cast("date"), F.col("deal_day") + 30)
    all_ = [
        ad(adv, "account_setup", F.col("day"), "email_received", "counterparty", [
            _fact("advertiser", A, "legal_entity_name", F.concat("advertiser_name", F.lit(" Holdings")), "permanent"), _fact("advertiser", A, "billing_country", pick(["Norway", "Chile", "Japan", "Kenya"], s, a, "country"), "permanent"),
            _fact("advertiser", A, "industry_vertical", pick(["Retail", "Automotive", "Utilities", "Leisure"], s, a, "vertical"), "durable"), _fact("advertiser", A, "agency_of_record", F.col("agency_name"), "slow_changing"),
            _fact("advertiser", A, "primary_contact", F.col("contact_name"), "slow_changing"), _fact("advertiser", A, "advertiser_tax_id", F.format_string("TX%05d-%d", draw(s, a, "tax", upto=99_999), a), "permanent"),
            _fact("contact", C, "contact_role", pick(["Buyer", "Planner", "Director"], s, a, "role"), "slow_changing"), _fact("contact", C, "contact_email", canon.mail_address(F.col("contact_name"), F.col("root")), "durable")]),
        _event(deals, "deal_kickoff", F.col("deal_day"), "email_sent", "user", F.concat(F.lit("Kickoff of "), "deal_name"), [
            _fact("deal", D, "deal_name", F.col("deal_name"), "permanent"), _fact("deal", D, "objective", pick(["Awareness", "Consideration", "Retention"], s, a, F.col("d"), "objective"), "durable"),
            _fact("deal", D, "budget_usd", (draw(s, a, F.col("d"), "budget", upto=80) + 20) * 5_000, "durable"), _fact("deal", D, "flight_start", flight, "durable"), _fact("deal", D, "flight_end", F.date_add(flight, 90), "durable")]),
        io(lines, "order_booked", F.col("line_day"), "order_system", "system", [
            _fact("order-line", L, "cpm_rate", _rate("rate"), "slow_changing"), _fact("order-line", L, "impressions_goal", F.col("goal"), "durable"), _fact("order-line", L, "line_status", F.lit("booked"), "slow_changing"),
            _fact("order-line", L, "geo_targeting", pick(["CA-1", "NY-2", "TX-3"], s, n, "geo"), "durable"), _fact("order-line", L, "demo_targeting", pick(["A25-54", "A18-34", "P35-64"], s, n, "demo"), "durable"), _fact("order-line", L, "creative_format", pick(["V15", "V30", "D970"], s, n, "format"), "durable")]),
        io(lines.where(first & plan_is("rate twice", "rate once") | lie), "rate_revision", F.col("line_day") + 60, "order_system", "system", [_fact("order-line", L, "cpm_rate", _rate("rate1"), "slow_changing", True)]),
        io(lines.where(first & plan_is("rate twice")), "rate_revision", F.col("line_day") + 85, "order_system", "system", [_fact("order-line", L, "cpm_rate", _rate("rate2"), "slow_changing", True)]),
        io(lines.where(first & plan_is("impressions")), "impressions_adjustment", F.col("line_day") + 75, "order_system", "system", [_fact("order-line", L, "impressions_goal", F.col("goal") + 50_000, "durable", True)]),
        _event(deals.where(plan_is("flight", "flight, then cancelled")), "flight_shift", F.col("deal_day") + 24, "email_received", "counterparty", F.concat(F.lit("New dates for "), "deal_name"), [
            _fact("deal", D, "flight_start", F.date_add(flight, 14), "durable", True), _fact("deal", D, "flight_end", F.date_add(flight, 104), "durable", True)]),
        io(lines.where(first & plan_is("flight, then cancelled")), "line_hold", F.col("line_day") + 40, "order_system", "system", [_fact("order-line", L, "line_status", F.lit("on hold"), "slow_changing", True)]),
        io(lines.where(first & plan_is("flight, then cancelled")), "line_cancellation", F.col("line_day") + 90, "order_system", "system", [_fact("order-line", L, "line_status", F.lit("cancelled"), "slow_changing", True)]),
        io(lines.where(first & plan_is("activation")), "line_activation", F.col("line_day") + 35, "order_system", "system", [_fact("order-line", L, "line_status", F.lit("delivering"), "slow_changing", True)]),
        ad(adv.where(F.pmod(a, F.lit(3)) == 0).withColumn("agency_name", new_agency), "agency_change", F.lit(150) + a, "email_received", "counterparty", [_fact("advertiser", A, "agency_of_record", F.col("agency_name"), "slow_changing", True)]),
        ad(adv.where(F.pmod(a, F.lit(3)) == 1).withColumn("contact_name", new_person), "contact_handoff", F.lit(170) + a, "email_received", "counterparty", [_fact("advertiser", A, "primary_contact", F.col("contact_name"), "slow_changing", True)]),
        io(lines.where(turn.isin(5, 9)), "pacing_note", F.col("line_day") + 50, "call_note", "user", [
            _fact("order-line", L, "pacing_status", F.lit("steady"), "transient", days=14), _fact("order-line", L, "pacing_review_through", F.date_add(F.date_add(F.lit(START).cast("date"), F.col("line_day").cast("int") + 50), 14), "durable")]),
        io(lines.where(turn == 6), "rate_card_snapshot", F.col("line_day") + 45, "email_sent", "system", [_fact("order-line", L, "rate_card_cpm", _rate("rate4"), "ephemeral", days=0, snapshot=True), _fact("order-line", L, "creative_due_date", F.date_add(flight, -7), "permanent")]),
        io(lines.where(turn == 7), "client_rate_claim", F.col("line_day") + 55, "email_received", "counterparty", [_fact("order-line", L, "cpm_rate_claimed", _rate("rate3"), "slow_changing")]),
        *(io(lines.where(F.pmod(n, F.lit(30)) == k), "injection_false_rate", F.col("line_day") + 65, "email_received", "user", [
            _fact("order-line", L, "cpm_rate", F.lit(v), "slow_changing", injected=grade), _fact("order-line", L, "pacing_review_through", F.date_add(F.lit(START).cast("date"), F.col("line_day").cast("int") + 80), "durable")]) for k, grade, v in ((8, "low", "3.25"), (18, "medium", "12.75"), (28, "high", "17.25"))),
        ad(adv.where(a == 4), "injection_false_agency", F.lit(200) + a, "email_received", "user", [_fact("advertiser", A, "agency_of_record", F.lit("Grimwater Desk"), "slow_changing", injected="medium"), _fact("advertiser", A, "renewal_intent", F.lit("Undecided"), "slow_changing")]),
        ad(adv.where(a == 6), "injection_false_payment", F.lit(210) + a, "email_received", "user", [_fact("advertiser", A, "remittance_account_name", F.lit("Hollowgate Clearing"), "durable", injected="high"), _fact("advertiser", A, "renewal_intent", F.lit("Open"), "slow_changing")]),
        ad(adv.where(~a.isin(4, 6)), "renewal_conversation", F.lit(370) + a, "call_note", "user", [_fact("advertiser", A, "renewal_intent", pick(["Likely", "Unlikely"], s, a, "renewal"), "slow_changing"), _fact("advertiser", A, "renewal_budget_indication", (draw(s, a, "next", upto=50) + 40) * 10_000, "durable")]),
    ]
    out = all_[0]
    for more in all_[1:]:
        out = out.unionByName(more)
    return out


def generate(spark: SparkSession, seeds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, events) of the seeds, with ids, pointers, trust and closed intervals."""
    raw = scenarios(spark, seeds or values.DEFAULTS["seeds"])
    rn = F.row_number().over(W.partitionBy("seed").orderBy("timestamp", "scenario_kind", F.coalesce("io_id", "deal_id", "advertiser_id")))
    events = raw.withColumn("rank", rn).withColumn("event_id", F.format_string("EV-%d-%04d", "seed", "rank"))
    each = events.select("seed", "event_id", "rank", "timestamp", "channel", "author", F.posexplode("facts").alias("fact_pos", "f")).select("*", "f.*").drop("f")
    each = each.withColumn("fact_id", F.format_string("F-%d-%05d", "seed", F.row_number().over(W.partitionBy("seed").orderBy("rank", "fact_pos"))))
    # the prior of a revision is the memorable fact before it in its key; injected facts revise nothing and are revised by nothing
    plain = ~F.col("injection") & ~F.col("never_memorize")
    prior = F.lag("fact_id").over(W.partitionBy(*t.KEY, plain).orderBy("rank", "fact_pos"))
    each = each.withColumn("supersedes", F.when(F.col("revises") & plain, prior))
    interval = F.struct(F.col("timestamp").alias("start"), F.when(F.col("days").isNotNull(), F.expr("date_add(timestamp, days)")).alias("end"))
    facts = t.with_trust(each.withColumn("validity_interval", interval)).withColumnRenamed("derived_trust", "trust_class")
    names = [c.strip().split()[0] for c in "seed fact_id entity entity_id event_id attribute value validity_interval volatility_class channel author trust_class supersedes plausibility injection never_memorize".split()]
    facts = t.close_intervals(facts.select(*names)).select(*names)
    ids = each.groupBy("seed", "event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("fact_pos", "fact_id"))), lambda x: x["fact_id"]).alias("fact_ids"))
    events = events.drop("facts", "rank").join(ids, ["seed", "event_id"])
    return facts, events.select("event_id", "seed", "scenario_kind", "subject", "timestamp", "channel", "author", "advertiser_id", "advertiser_name", "agency_name", "contact_name", "deal_id", "io_id", "fact_ids")
