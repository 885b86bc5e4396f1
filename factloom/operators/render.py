"""Manifests and deterministic texts: each fact becomes a clause of a template table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import canon

from .temporal import event_facts

#: A clause for each attribute; {v} stands for the value as prose, {id} for the order line.
CLAUSES = {
    "legal_entity_name": "the legal entity is {v}",
    "billing_country": "billing goes to {v}",
    "industry_vertical": "the vertical is {v}",
    "agency_of_record": "the agency of record is {v}",
    "primary_contact": "the primary contact is {v}",
    "advertiser_tax_id": "the tax reference is {v}",
    "remittance_account_name": "the remittance account is {v}",
    "renewal_intent": "the renewal is {v}",
    "renewal_budget_indication": "the budget for the renewal is {v}",
    "deal_name": "the programme is {v}",
    "objective": "the objective is {v}",
    "budget_usd": "the working budget is {v}",
    "flight_start": "the flight starts on {v}",
    "flight_end": "the flight ends on {v}",
    "creative_due_date": "the creative is due on {v}",
    "cpm_rate": "the rate is {v}",
    "cpm_rate_claimed": "our notes say the rate is {v}",
    "impressions_goal": "the goal is {v}",
    "line_status": "the line is {v}",
    "geo_targeting": "the geo is {v}",
    "demo_targeting": "the demo is {v}",
    "creative_format": "the format is {v}",
    "pacing_status": "pacing is {v}",
    "pacing_review_through": "the review runs through {v}",
    "rate_card_cpm": "the rate card shows {v}",
    "contact_role": "the role is {v}",
    "contact_email": "the address is {v}",
}
#: Clauses of injected facts: somebody claims them, we don't say them ourselves.
CLAIMS = {
    "cpm_rate": "someone wrote to us that the rate was {v}",
    "agency_of_record": "someone wrote to us that the agency was {v}",
    "remittance_account_name": "someone asked us to pay {v} from now on",
}
ANY_CLAIM = "someone wrote to us about {v}"
#: First sentence by kind of scenario.
OPENERS = {
    "account_setup": "we have a new account to set up",
    "deal_kickoff": "we are about to start",
    "order_booked": "the line is booked",
    "rate_revision": "there is a new rate",
    "impressions_adjustment": "there is a new goal",
    "flight_shift": "the dates have moved",
    "line_hold": "the line has to wait",
    "line_cancellation": "the line is off",
    "line_activation": "the line is on",
    "agency_change": "orders come from elsewhere now",
    "contact_handoff": "someone else answers from now on",
    "pacing_note": "we talked about pacing",
    "rate_card_snapshot": "the rate card of the day is out",
    "client_rate_claim": "we have a question about the rate",
    "renewal_conversation": "we talked about next year",
}
OPENER = "there is something to tell"
MONEY = ["budget_usd", "renewal_budget_indication"]
GROUPED = ["impressions_goal"]
PRICE = ["cpm_rate", "cpm_rate_claimed", "rate_card_cpm"]


#: What a manifest has of a fact.
FACT = ["fact_pos", "fact_id", "entity", "entity_id", "attribute", "value", "volatility_class", "trust_class", "validity_interval", "supersedes", "injection", "plausibility", "never_memorize"]


def manifests(events: DataFrame, facts: DataFrame) -> DataFrame:
    """One self-contained record an event: its columns, its deal's name, trust and facts in order.

    Events that carry facts (as FACT has them, in order) and deal_name already, as a source may that has an event and its facts in one row, are taken as they are.
    """
    if {"facts", "deal_name"} <= set(events.columns):
        return events.drop("fact_ids").where("size(facts) > 0").withColumn("trust_class", F.array_min(F.transform("facts", lambda f: f["trust_class"])))
    each = event_facts(events, facts)
    facts_of = each.groupBy("seed", "event_id").agg(F.sort_array(F.collect_list(F.struct(*FACT))).alias("facts"), F.min("trust_class").alias("trust_class"))
    names = facts.where("attribute = 'deal_name'").groupBy("seed", F.col("entity_id").alias("deal_id")).agg(F.max_by("value", "fact_id").alias("deal_name"))
    return events.drop("fact_ids").join(facts_of, ["seed", "event_id"]).join(names, ["seed", "deal_id"], "left")


def _inbound() -> Column:
    """A message that the counterparty wrote to us."""
    return (F.col("channel") == "email_received") & (F.col("author") == "counterparty")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _greeting() -> Column:
    first = F.substring_index("contact_name", " ", 1)
    named = F.when(~_inbound() & F.col("contact_name").isNotNull(), F.concat(F.lit("Hello "), first, F.lit(","))).otherwise("Hello,")
    return F.when(F.col("channel") == "call_note", "From a call.").when(F.col("author") == "system", "An automatic note.").otherwise(named)


def _identity() -> Column:
    """What the message is about: the advertiser, and its deal and order line where it has them."""
    deal = F.coalesce(F.concat(F.lit(" and its programme "), "deal_name"), F.lit(""))
    line = F.coalesce(F.concat(F.lit(", order line "), "io_id"), F.lit(""))
    return F.concat(F.lit("this is about "), "advertiser_name", deal, line)


def render(manifest: DataFrame, strict: bool = False) -> DataFrame:
    """(seed, event_id, text, unknown): unknown lists attributes without a clause; strict: such an attribute is an error.

    Facts come in the order of the clauses, then by id. A deal's name that the
    identity sentence gives isn't said again. Two clauses make a sentence.
    """
    said, claimed = _table(CLAUSES), _table(CLAIMS)
    place = _table({name: f"{k:03d}" for k, name in enumerate(CLAUSES)})

    def clause(f: Column) -> Column:
        number = f["value"].try_cast(canon.DECIMAL)
        shown = F.when(f["attribute"].isin(MONEY), canon.money(number)).when(f["attribute"].isin(GROUPED), canon.grouped(number)).when(f["attribute"].isin(PRICE), F.concat(F.lit("$"), f["value"])).otherwise(canon.natural(f["value"]))
        template = F.when(f["injection"] & said[f["attribute"]].isNotNull(), F.coalesce(claimed[f["attribute"]], F.lit(ANY_CLAIM))).otherwise(said[f["attribute"]])
        return F.replace(template, F.lit("{v}"), shown)

    ordered = F.transform(F.array_sort(F.transform("facts", lambda f: F.struct(F.coalesce(place[f["attribute"]], F.lit("999")).alias("p"), f["fact_id"].alias("i"), f.alias("f")))), lambda x: x["f"])
    told = F.filter(ordered, lambda f: ~((f["attribute"] == "deal_name") & f["value"].eqNullSafe(F.col("deal_name"))))
    lines = F.filter(F.transform(told, clause), lambda c: c.isNotNull())
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size(lines)), lambda k: (k % 2 == 0) & (k < F.size(lines))), lambda k: F.array_join(F.slice(lines, k + 1, F.lit(2)), ", and "))
    sentences = F.concat(F.array(F.coalesce(_table(OPENERS)[F.col("scenario_kind")], F.lit(OPENER)), _identity()), pairs)
    body = F.array_join(F.transform(sentences, lambda p: F.concat(canon.capital(p), F.lit("."))), "\n")
    head = F.concat(F.lit("Subject: "), "subject", F.lit("\nDate: "), canon.long_date(F.col("timestamp")))
    close = F.when(_inbound(), F.concat(F.lit("Regards, the team of "), "advertiser_name")).otherwise("Regards, sales operations")
    text = F.concat(head, F.lit("\n\n"), _greeting(), F.lit("\n"), body, F.lit("\n"), close, F.lit("\n"))
    unknown = F.transform(F.filter("facts", lambda f: said[f["attribute"]].isNull()), lambda f: f["attribute"])
    if strict:
        text = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("no clause for "), F.array_join(unknown, ", ")))).otherwise(text)
    return manifest.select("seed", "event_id", text.alias("text"), unknown.alias("unknown"))


def meta(report: DataFrame, manifest: DataFrame, mode: str = "template") -> DataFrame:
    """One row an event on how it was rendered and whether its text is faithful."""
    return manifest.select("seed", "event_id", "timestamp", "scenario_kind", "channel", "author").join(report, ["seed", "event_id"]).select(
        "seed", "event_id", "timestamp", "scenario_kind", "channel", "author", F.lit(mode).alias("render_mode"), F.lit(1).alias("attempts"),
        F.col("status").alias("fidelity"), F.col("missing").alias("fidelity_missing_facts"), F.struct("numbers", "dates", "names").alias("fidelity_unsupported"))
