"""Web columns: device, path, referrer, hosts, routes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kveil.functions.anonymize import non_empty
from kveil.functions.scrub import scrub_url
from kveil.sources.rulebase import AUDIT_HOSTS, COOKIE_PREFIXES, INTERCEPT_PATTERNS, ROUTE_PATTERNS, SCRIPT_PATTERNS


def _has_any(low: Column, words: list[str]) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(low, F.lit(word))
    return out


def beacon_device(ua: Column, lowered: bool = False) -> Column:
    low = ua if lowered else F.lower(F.coalesce(ua, F.lit("")))
    return (
        F.when(_has_any(low, ["ipad", "tablet"]), "tablet")
        .when(_has_any(low, ["mobi", "iphone"]), "mobile")
        .when(_has_any(low, ["bot", "crawl", "spider", "headless"]), "bot")
        .otherwise("desktop")
    )


def vendor_device(ua: Column, lowered: bool = False) -> Column:
    low = ua if lowered else F.lower(F.coalesce(ua, F.lit("")))
    return F.when(_has_any(low, ["mobi", "android", "iphone"]), "mobile").otherwise("desktop")


def event_name(name: Column, default: str = "pageview") -> Column:
    return F.substring(F.coalesce(name, F.lit(default)), 1, 40)


def country_code(country: Column) -> Column:
    return F.when(country.rlike("^[A-Za-z]{2}$"), F.upper(country)).otherwise("??")


def local_part(url: Column) -> Column:
    """Path, query and fragment of a URL; ``/`` when there is nothing."""
    rest = F.when(url.startswith("/"), url).otherwise(F.regexp_replace(url, "(?i)^https?://[^/?#]*", ""))
    return F.coalesce(non_empty(rest), F.lit("/"))


def event_path(url: Column, order: str = "phone_first") -> Column:
    """Scrubbed path and query of an event. Give the ``local_part`` as a column of its own."""
    return scrub_url(local_part(url), order)


def url_host(url: Column, with_port: bool = True) -> Column:
    """Lower-case host, with a port that is not the default; null when there is none."""
    third = F.split_part(F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.lit("/"), F.lit(3))
    authority = F.lower(F.substring_index(third, "@", -1))
    drop = r"(?i)^(?:https://[^/?#]*:443|http://[^/?#]*:80)(?:[/?#]|$)" if with_port else r"^[^/?#]*//[^/?#]*:[0-9]*(?:[/?#]|$)"
    host = F.when(url.rlike(drop), F.regexp_replace(authority, ":[0-9]*$", "")).otherwise(authority)
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]"), host)


def referrer_key(referrer: Column) -> Column:
    """Report key: host, ``(direct)`` without referrer, ``(other)`` if unreadable."""
    return (
        F.when(F.coalesce(referrer, F.lit("")) == "", "(direct)")
        .when(referrer.rlike("(?i)^https?:"), F.coalesce(url_host(referrer), F.lit("(other)")))
        .when(referrer.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url_host(referrer))
        .otherwise("(other)")
    )


def origin_host(origin: Column, fallback: Column | None = None) -> Column:
    return F.coalesce(url_host(origin), fallback if fallback is not None else F.lit(None), F.lit(""))


def url_without_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def is_intercepted(url: Column, own_url: str = "https://relay.example") -> Column:
    """A request that the filter takes over: not for the own relay, and a known pattern."""
    return F.coalesce(~url.startswith(own_url) & url.rlike("|".join(INTERCEPT_PATTERNS)), F.lit(False))


def is_blocked_script(src: Column, own_url: str = "https://relay.example") -> Column:
    return F.coalesce(src.rlike("|".join(SCRIPT_PATTERNS)), F.lit(False)) | is_intercepted(src, own_url)


def cookie_name(cookie: Column) -> Column:
    return F.trim(F.split_part(cookie, F.lit("="), F.lit(1)))


def is_blocked_cookie(cookie: Column) -> Column:
    return F.coalesce(cookie_name(cookie).rlike("^(" + "|".join(COOKIE_PREFIXES) + ")"), F.lit(False))


def vendor_route(url: Column) -> Column:
    (first, first_re), (second, second_re) = ROUTE_PATTERNS
    return F.when(url.rlike("(?i)" + first_re), first).when(url.rlike("(?i)" + second_re), second).otherwise("generic")


def is_relay_host(host: Column, relay_hosts: list[str]) -> Column:
    out = F.lit(False)
    for own in relay_hosts:
        out = out | (host == own) | host.endswith("." + own)
    return F.coalesce(out, F.lit(False))


def audit_match(low: str) -> Column:
    """First audit pattern in the lower-cased URL of the named column, or null.

    The column is read once per pattern, so it is lower-cased in a projection before.
    """
    cases = " ".join(f"WHEN contains({low}, '{h}') THEN '{h}'" for h in AUDIT_HOSTS)
    return F.expr(f"CASE {cases} END")


def attested(enrolled: Column, signature_valid: Column) -> Column:
    """Enrolled, and the signature is not known to be false (null: it could not be checked)."""
    return F.coalesce(enrolled, F.lit(False)) & F.coalesce(signature_valid, F.lit(True))


def verdict(is_attested: Column, leaking: Column) -> Column:
    return (
        F.when(is_attested & ~leaking, "protected")
        .when(is_attested, "partial")
        .when(leaking, "unprotected")
        .otherwise("clean")
    )


def usage_column(action: Column) -> Column:
    """Usage counter that an action adds to; unknown actions count as allowed."""
    return F.when(action.isin("strip", "stripped"), "stripped").when(action == "blocked", "blocked").otherwise("allowed")


def feed_column(action: Column) -> Column:
    return (
        F.when(action.isin("block", "blocked"), "blocked")
        .when(action.isin("strip", "stripped"), "stripped")
        .otherwise("allowed")
    )


def percent(part: Column, total: Column) -> Column:
    """Whole percentage, halves rounded up; 0 when the total is 0."""
    return F.when(total > 0, F.floor(part / total * 100 + 0.5)).otherwise(0).cast("bigint")
