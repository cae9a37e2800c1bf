"""The composed flows: visits to a report, vendor requests to clean traffic, counters to a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.functions import web
from kveil.functions.anonymize import SaltBook
from kveil.operators import accounts, classify, events, kanon, limits, rollup, usage


def top_keys_report(visits: DataFrame, salts: SaltBook, qi: list[str], k: int = kanon.K) -> DataFrame:
    """Visits to the daily top keys of released events."""
    clean = kanon.with_quasi_identifiers(events.build_events(visits, salts))
    return rollup.top_keys(rollup.daily_dimensions(kanon.release_buckets(clean, qi, k)))


def arrival_report(visits: DataFrame, salts: SaltBook, qi: list[str] | None = None, k: int = kanon.K, **gate) -> DataFrame:
    """Visits to daily reports through the arrival gate, kept for the newest days."""
    clean = kanon.with_quasi_identifiers(events.build_events(visits, salts))
    labelled = kanon.release_in_order(clean, qi, k, **gate)
    return rollup.retain_days(rollup.daily_report(labelled.where(f"status = '{kanon.RELEASED}'")))


def limited_beacons(visits: DataFrame, salts: SaltBook, policy: str = "collect") -> DataFrame:
    """Clean events of the beacons that the collect limit lets through, per visitor token and window."""
    clean = events.build_events(visits, salts)
    limit, seconds = next((n, s) for name, n, s, _ in limits.POLICIES if name == policy)
    return limits.fixed_window_allowed(clean, limit, seconds, key="visitor", tie="event_id")


def admitted(requests: DataFrame, customers: DataFrame, projects: DataFrame, revocations: DataFrame) -> DataFrame:
    """Requests with a live key from a listed domain, with the customer that the key proves."""
    known = accounts.drop_revoked(accounts.authenticate(requests, customers, projects), revocations)
    referer = F.col("referer") if "referer" in requests.columns else F.lit(None).cast("string")
    return known.where(accounts.domain_allowed(F.col("origin"), referer, F.col("allowed_domains")))


def vendor_flow(
    requests: DataFrame, customers: DataFrame, projects: DataFrame, revocations: DataFrame, salts: SaltBook, **resolver
) -> tuple[DataFrame, DataFrame]:
    """Requests of admitted customers to ``(requests with their fate and clean form, first-party events)``."""
    known = admitted(requests, customers, projects, revocations)
    clean = events.clean_requests(classify.resolve_trackers(known, **resolver), salts)
    return clean, events.vendor_events(known, salts)


def united_gate(visits: DataFrame, vendor: DataFrame, salts: SaltBook, qi: list[str], k: int = kanon.K, **gate) -> DataFrame:
    """Beacon and vendor events through one gate; ``event_id`` must be unique over both."""
    columns = ["event_id", "ts", "visitor", "domain", "event", "path", "country", "device"]
    both = events.build_events(visits, salts).select(*columns).unionByName(vendor.select(*columns))
    return kanon.release_in_order(kanon.with_quasi_identifiers(both), qi, k, **gate)


def feed(requests: DataFrame, projects: DataFrame, month: str, **resolver) -> tuple[DataFrame, DataFrame]:
    """Requests to ``(monthly totals, tracker breakdown)`` per feed, counted by what became of them.

    A request without a URL has no route and is not counted. It is left out before the
    rules run: a condition on the outcome would carry the whole rule table into the filter.
    """
    resolved = classify.resolve_trackers(requests.where(F.coalesce("url", F.lit("")) != ""), **resolver)
    _, counted = events.request_disposition(web.vendor_route(F.col("url")), F.col("url"), F.col("action"))
    log = resolved.withColumn("action", counted)
    owner = projects.select(F.col("customer_id_ref").alias("customer_id"), "feed_hash")
    return (
        usage.feed_totals(projects, usage.monthly_usage(log), month),
        usage.feed_breakdown(log.drop("feed_hash").join(owner, "customer_id")),
    )
