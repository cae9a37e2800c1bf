"""Page leakage audit, enrolment and attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kveil.functions.fields import DOMAIN_FORMAT, bare_domain
from kveil.functions.web import attested, audit_match, is_relay_host, url_host, verdict
from kveil.operators.substring import contained


def page_leakage(requests: DataFrame, relay_hosts: list[str], page: str = "page_host") -> DataFrame:
    """Requests per page, trackers reached directly and relay hosts used.

    Both sets are bounded: by the audit list and by the number of relay hosts seen.
    """
    host = F.coalesce(url_host(F.col("url"), with_port=False), F.lit(""))
    low = requests.select(page, host.alias("_host"), F.lower("url").alias("_low"))
    seen = low.select(page, "_host", audit_match("_low").alias("_tracker"))
    relay = is_relay_host(F.col("_host"), relay_hosts)
    return seen.groupBy(page).agg(
        F.count("*").alias("total"),
        F.array_sort(F.collect_set(F.when(~relay, F.col("_tracker")))).alias("direct"),
        F.array_sort(F.collect_set(F.when(relay, F.col("_host")))).alias("relayed"),
    )


def leakage_verdict(leakage: DataFrame, attestations: DataFrame, page: str = "page_host") -> DataFrame:
    """Verdict per page. ``attestations`` has one row per domain."""
    known = attestations.select(F.col("domain").alias(page), "enrolled", "signature_valid")
    is_attested = attested(F.col("enrolled"), F.col("signature_valid"))
    return (
        leakage.join(known, page, "left")
        .withColumn("verdict", verdict(is_attested, F.size("direct") > 0))
        .drop("enrolled", "signature_valid")
    )


def enrolled_domains(domains: DataFrame, projects: DataFrame, customers: DataFrame, match: str = "exact") -> DataFrame:
    """Domains (column ``domain``) that an enabled customer lists.

    ``exact`` compares normalised names. ``contains`` also accepts a domain that is part
    of a listed one; the listed names are found by the rarest piece of the domain.
    """
    clean = bare_domain(F.col("domain"))
    asked = domains.withColumn("_d", F.substring(clean, 1, 255)).where(F.col("_d").rlike(DOMAIN_FORMAT))
    active = customers.where("enabled").select(F.col("id").alias("customer_id_ref"))
    listed = (
        projects.join(active, "customer_id_ref", "left_semi")
        .select(F.explode("allowed_domains").alias("_l")).select(bare_domain(F.col("_l")).alias("_l")).distinct()
    )
    if match == "contains":
        listed = contained(listed, asked.select("_d"), "_l", "_d").select(F.col("_d").alias("_l")).distinct()
    return asked.join(listed, F.col("_d") == F.col("_l"), "left_semi").drop("_d")


def fresh_attestations(
    attestations: DataFrame, now: str, expected: str | None = None, pin: str | None = None
) -> DataFrame:
    """Attestations that may be believed: not expired, right domain and key, first use of the nonce.

    ``expected`` names the column with the inspected domain, ``pin`` the accepted key.
    """
    age_ms = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    ok = age_ms <= F.col("ttl_ms")
    if expected:
        ok = ok & (F.lower(F.col("domain")) == F.lower(F.col(expected)))
    if pin:
        ok = ok & (F.col("public_key") == pin)
    # The first use is found before any other test: a replay is refused even if the
    # first use itself has expired since.
    w = Window.partitionBy("nonce").orderBy("ts", "domain")
    first = attestations.withColumn("_use", F.row_number().over(w)).where(F.col("_use") == 1).drop("_use")
    return first.where(ok)
