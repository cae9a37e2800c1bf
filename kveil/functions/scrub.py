"""Removal of personal data and tracking identifiers from text, URLs and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kveil.functions.anonymize import JS_SPACE

# Word boundaries are spelled out because only ASCII letters, digits and "_" count.
_B0, _B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Personal-data patterns and their tags, in the order they apply.
EMAIL = (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]")
PHONE = (rf"\+?[0-9][0-9{JS_SPACE}().-]{{7,}}[0-9]", "[phone]")
IP4 = (rf"{_B0}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_B1}", "[ip]")
# A match may end in ":", where a word must follow for the boundary to hold.
IP6 = (rf"{_B0}(?:[A-Fa-f0-9]{{1,4}}:){{2,}}(?:[A-Fa-f0-9]{{1,4}}{_B1}|(?=[A-Za-z0-9_]))", "[ip6]")
LONG_NUMBER = (rf"{_B0}[0-9]{{13,19}}{_B1}", "[num]")
ID_NUMBER = (rf"{_B0}[0-9]{{9}}{_B1}", "[id]")
PII_PATTERNS = [EMAIL, PHONE, IP4, IP6, LONG_NUMBER, ID_NUMBER]
PII_SPECIFIC_FIRST = [EMAIL, IP4, IP6, LONG_NUMBER, ID_NUMBER, PHONE]

# Where this does not match, none of the patterns above does: one look saves six passes.
PII_CANDIDATE = rf"@|[A-Fa-f0-9]:[A-Fa-f0-9]{{1,4}}:|[0-9][0-9{JS_SPACE}().-]{{5,}}[0-9]"

# Query parameters that only serve tracking.
TRACKING_PARAMS = """
gclid fbclid msclkid dclid twclid ttclid yclid utm_id _ga _gl mc_eid mc_cid igshid vero_id wickedid oly_anon_id
oly_enc_id s_kwcid ef_id cmpid external_id fbp fbc
""".split()

# Payload keys whose value is always redacted.
REDACT_KEYS = "email phone name user_id userid ssn bsn ip address fn ln em ph".split()
REDACTED = "[redacted]"
MAX_DEPTH = 6

# Stripped parameters that keep their place with the visitor token as value.
PSEUDO_PATTERN = r"(?i)^(_id|uid|cid|vid|aid|mid|duid|_pk_id|visitor|distinct_id)"

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
_HTTP = r"(?i)^https?://"
_MARK = "\u0001"  # stands for the token while the URL is scrubbed; no valid URL contains it


def _patterns(order: str) -> list[tuple[str, str]]:
    return {"phone_first": PII_PATTERNS, "specific_first": PII_SPECIFIC_FIRST}[order]


def _scrub(text: Column, order: str) -> Column:
    for pattern, tag in _patterns(order):
        text = F.regexp_replace(text, pattern, tag)
    return text


def scrub_text(text: Column, order: str = "phone_first") -> Column:
    """Replace personal data by tags.

    ``phone_first`` applies the broad phone rule before the narrower ones, which then
    rarely match; ``specific_first`` applies it last.
    """
    return F.when(text.rlike(PII_CANDIDATE), _scrub(text, order)).otherwise(text)


def _key(param: Column) -> Column:
    raw = F.split_part(param, F.lit("="), F.lit(1))
    return F.lower(F.coalesce(F.try_url_decode(raw), raw))


def _before_query(url: Column) -> Column:
    return F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


def query_params(url: Column) -> Column:
    """Raw ``key=value`` strings of the query, in order."""
    query = F.regexp_extract(F.split_part(url, F.lit("#"), F.lit(1)), r"(?s)^[^?]*\?(.*)$", 1)
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _with_query(base: Column, params: Column) -> Column:
    return F.concat(base, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


# A query that needs a look at its keys: a listed one, or one with encoded characters.
_TRACKED = rf"(?i)[?&](?:{'|'.join(TRACKING_PARAMS)})(?:[=&#]|$)|[?&][^=&#]*%"
_NO_HOST = r"(?i)^https?:/*($|[?#])"


def _without_secrets(url: Column) -> Column:
    """URL without credentials; a relative reference becomes a bare path."""
    return (
        F.when(url.startswith("//"), F.concat(F.lit("/"), F.regexp_replace(url, r"^//[^/?#]*/?", "")))
        .when(url.startswith("/"), url)
        .when(url.rlike(_HTTP) & F.contains(url, F.lit("@")), F.regexp_replace(url, r"(?i)^(https?://)[^/?#]*@", "$1"))
        .when(url.rlike(_SCHEME), url)
        .otherwise(F.concat(F.lit("/"), url))
    )


def _scrub_if_needed(url: Column, cleaned: Column, order: str) -> Column:
    # No pattern crosses "?", "&", "=" or "/", so the raw URL shows whether a scrub is due.
    return F.when(url.rlike(PII_CANDIDATE), _scrub(cleaned, order)).otherwise(cleaned)


def scrub_url(url: Column, order: str = "phone_first") -> Column:
    """Drop tracking parameters, credentials and the fragment, then scrub the rest.

    A bare path stays a bare path. Bytes that need no change are kept as written. A
    URL without a host is scrubbed as text. ``url`` is read several times: give a plain
    column rather than a long expression.
    """
    plain = _without_secrets(url)
    untracked = F.filter(query_params(url), lambda p: ~_key(p).isin(TRACKING_PARAMS))
    kept = F.when(url.rlike(_TRACKED), _with_query(_before_query(plain), untracked)).otherwise(F.substring_index(plain, "#", 1))
    return (
        F.when(url.isNull() | (url == ""), url)
        .when(url.rlike(_NO_HOST), scrub_text(url, order))
        .otherwise(_scrub_if_needed(url, kept, order))
    )


def strip_tracker_url(
    url: Column, strip_fields: Column | list[str], token: Column, order: str = "phone_first"
) -> Column:
    """Drop or pseudonymise the parameters that a tracker rule names, then scrub the URL.

    A parameter is hit when its name starts with a strip field; the fields are a list, or
    an array column where they differ by row. Stable identifiers keep
    their first occurrence, with the visitor token as value; other hits are dropped. The
    token goes in after scrubbing, so a token that looks like a number survives.
    """
    if isinstance(strip_fields, list):
        prefix = "^(?:" + "|".join(re.escape(f.lower()) for f in strip_fields) + ")"
    else:
        fields = F.transform(F.coalesce(strip_fields, F.array().cast("array<string>")), lambda f: F.lower(f))

    def is_hit(key: Column) -> Column:
        if isinstance(strip_fields, list):
            return key.rlike(prefix) if strip_fields else F.lit(False)
        return F.exists(fields, lambda f: key.startswith(f))

    def marked(p: Column) -> Column:
        """The parameter that stays, if any; the mark stands for the token."""
        key = _key(p)
        pseudonym = F.when(key.rlike(PSEUDO_PATTERN), F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("=" + _MARK)))
        return F.when(is_hit(key), pseudonym).when(~key.isin(TRACKING_PARAMS), p)

    params = F.transform(query_params(url), marked)
    # Only replaced parameters can be equal: each identifier keeps its first place.
    kept = F.filter(
        params,
        lambda p, i: p.isNotNull() & (~p.endswith("=" + _MARK) | (F.array_position(params, p) == i.cast("long") + 1)),
    )
    cleaned = _scrub_if_needed(url, _with_query(_before_query(_without_secrets(url)), kept), order)
    parsable = url.rlike(_SCHEME) & ~url.rlike(_NO_HOST)
    return F.when(parsable, F.replace(cleaned, F.lit(_MARK), token)).otherwise(url)


def scrub_flat_json(payload: Column, order: str = "phone_first") -> Column:
    """Scrub a flat JSON object inside the JVM; null when it is not a JSON object.

    Redacted keys lose their value, strings are scrubbed and numbers kept. A nested value
    is redacted as a whole, because its keys can not be inspected here:
    ``scrub_payload`` sends such payloads to ``scrub_json``.
    """
    pairs = F.map_entries(F.from_json(payload, "map<string,variant>"))

    def member(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        text = F.to_json(_scrub(F.try_variant_get(e["value"], "$", "string"), order).cast("variant"))
        value = (
            F.when(F.lower(e["key"]).isin(REDACT_KEYS) | kind.rlike("^(OBJECT|ARRAY)"), F.lit(f'"{REDACTED}"'))
            .when(e["value"].isNull(), F.lit("null"))
            .when(kind == "STRING", text)
            .otherwise(F.to_json(e["value"]))
        )
        return F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), value)

    body = F.array_join(F.transform(pairs, member), ",")
    return F.when(pairs.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))


def _scrub_value(value, depth, patterns):
    if isinstance(value, str):
        for pattern, tag in patterns:
            value = pattern.sub(tag, value)
        return value
    if isinstance(value, (list, dict)) and depth > MAX_DEPTH:
        return REDACTED  # too deep to inspect: nothing leaves unchecked
    if isinstance(value, list):
        return [_scrub_value(v, depth + 1, patterns) for v in value]
    if isinstance(value, dict):
        return {
            k: REDACTED if k.lower() in REDACT_KEYS else _scrub_value(v, depth + 1, patterns)
            for k, v in value.items()
        }
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    return value


def scrub_json(payload: Column, order: str = "phone_first") -> Column:
    """Scrub nested JSON down to six levels; anything that is not JSON is scrubbed as text.

    Recursion over unknown shapes has no built-in expression, so this is an Arrow UDF.
    """
    compiled = [(re.compile(p), tag) for p, tag in _patterns(order)]

    def one(text):
        if not text:
            return text
        try:
            value = json.loads(text)
        except ValueError:
            return _scrub_value(text, 0, compiled)
        return json.dumps(_scrub_value(value, 0, compiled), separators=(",", ":"), ensure_ascii=False)

    @F.pandas_udf("string")
    def scrub(series: pd.Series) -> pd.Series:
        return series.map(one, na_action="ignore")

    return scrub(payload)


# A flat object of plain strings, whole numbers and literals, for which both forms agree.
_FLAT = r'^\{(\s*"[^"\\]*"\s*:\s*("[^"\\\x00-\x1F]*"|(0|-?[1-9]\d{0,14})|true|false|null)\s*(,(?=\s*")|(?=\})))*\}$'


def scrub_payload(payload: Column, order: str = "phone_first") -> Column:
    """Scrub any payload: flat objects inside the JVM, only the others in the Arrow UDF."""
    keys = F.map_keys(F.from_json(payload, "map<string,variant>"))
    flat = F.coalesce(payload.rlike(_FLAT) & (F.size(keys) == F.size(F.array_distinct(keys))), F.lit(False))
    return F.when(flat, scrub_flat_json(payload, order)).otherwise(scrub_json(F.when(~flat, payload), order))
