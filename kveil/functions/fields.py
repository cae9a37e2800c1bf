"""Normalisers and shape checks for account and request fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kveil.functions.anonymize import js_trim

# Accepted plans, templates, event types, formats and limits.
PLANS = ["starter", "pro", "business", "test"]
TEMPLATES = ["ultra-streng", "basis-analytics", "marketing-light", "custom"]
SECURITY_EVENTS = [
    "key_activated", "key_revoked", "rate_limit_hit", "domain_blocked",
    "invalid_key_attempt", "gdpr_delete", "webhook_received", "pending_cleanup",
]
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
DOMAIN_FORMAT = r"^[a-z0-9][a-z0-9\-\.]*[a-z0-9]$"
API_KEY_FORMAT = r"^wk_[a-f0-9]{48}$"
FEED_HASH_FORMAT = r"^[a-f0-9]{16}$"
MAX_EMAIL, MAX_TEXT, MAX_DOMAINS = 254, 500, 150
BODY_REJECTS = ["__proto__", "constructor", "prototype"]
URL_REJECTS = ["..", "%2e%2e", "%252e", "%00", "\0"]


def clean_email(email: Column) -> Column:
    low = F.substring(js_trim(F.lower(email)), 1, MAX_EMAIL)
    return F.when(low.rlike(EMAIL_FORMAT), low)


def bare_domain(value: Column) -> Column:
    """Host of a domain field: no scheme, path or ``www.``."""
    low = F.lower(js_trim(value))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "^https?://", ""), "/.*$", ""), r"^www\.", "")


def clean_domains(domains: Column) -> Column:
    parts = F.transform(F.split(domains, ","), bare_domain)
    good = F.filter(parts, lambda d: (F.length(d) > 0) & (F.length(d) < 255) & d.rlike(DOMAIN_FORMAT))
    return F.coalesce(F.slice(good, 1, MAX_DOMAINS), F.array().cast("array<string>"))


def clean_plan(plan: Column) -> Column:
    return F.when(plan.isin(PLANS), plan).otherwise(PLANS[0])


def clean_template(template: Column) -> Column:
    return F.when(template.isin(TEMPLATES), template).otherwise(TEMPLATES[0])


def clean_text(text: Column, limit: int = MAX_TEXT) -> Column:
    return F.coalesce(F.regexp_replace(F.substring(js_trim(text), 1, limit), "<[^>]*>", ""), F.lit(""))


def is_api_key(key: Column) -> Column:
    return F.coalesce(key.rlike(API_KEY_FORMAT), F.lit(False))


def is_feed_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(FEED_HASH_FORMAT), F.lit(False))


def reject_reason(url: Column, body: Column) -> Column:
    """Why a request is refused, or null."""

    def any_of(col: Column, words: list[str]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | F.coalesce(F.contains(col, F.lit(word)), F.lit(False))
        return out

    return F.when(any_of(body, BODY_REJECTS), "invalid_input").when(any_of(url, URL_REJECTS), "invalid_path")
