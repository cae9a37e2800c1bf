"""Raw visits and vendor requests to clean events, and what is forwarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions import anonymize as an
from kveil.functions import scrub as sc
from kveil.functions import web
from kveil.sources.rulebase import ROUTE_TRACKER, load_rules

# Parameter and header lists of the vendor routes.
GA4_PARAMS = "v tid gtm en ep sid sct seg dl dr dt".split()
META_PARAMS = "id ev".split()
GENERIC_DROP = "client_id user_id _ga _gid _fbc _fbp uid email phone".split()
GA4_EVENT_DROP = "user_id email phone name ip_override".split()
SKIP_HEADERS = "cookie referer x-forwarded-for x-real-ip x-client-data origin x-requested-with authorization".split()
PARAM_CAP, URL_CAP = 200, 2000


def build_events(
    visits: DataFrame, salts: an.SaltBook, order: str = "phone_first"
) -> DataFrame:
    """Beacons to clean events: token, defaults, scrubbed path, referrer and props.

    Columns other than the beacon's own pass through.
    """
    c = F.col
    clean_props = sc.scrub_payload(F.coalesce(c("p"), F.lit("{}")), order)
    used = {"ip", "ua", "origin", "d", "e", "u", "r", "country", "p"}
    shared = _shared(visits, web.origin_host(c("origin"), c("d"))).withColumn("_u", web.local_part(c("u")))
    return shared.select(
        *[n for n in visits.columns if n not in used],
        an.visitor_token(c("ip"), c("_ua"), c("_host"), salts, c("ts"), lowered=True).alias("visitor"),
        c("_host").alias("domain"),
        c("_host").alias("origin"),
        web.event_name(c("e")).alias("event"),
        sc.scrub_url(c("_u"), order).alias("path"),
        F.when(F.coalesce(c("r"), F.lit("")) == "", "").otherwise(sc.scrub_url(c("r"), order)).alias("referrer"),
        web.country_code(c("country")).alias("country"),
        web.beacon_device(c("_ua"), lowered=True).alias("device"),
        clean_props.alias("props"),
    )


def _shared(df: DataFrame, host: Column) -> DataFrame:
    """Add what several columns read: computed once per row, in a projection of its own."""
    return df.withColumns({"_ua": F.lower(F.coalesce(F.col("ua"), F.lit(""))), "_host": host})


def vendor_events(requests: DataFrame, salts: an.SaltBook) -> DataFrame:
    """First-party events for requests that go to a vendor's strip route."""
    c = F.col
    route = web.vendor_route(c("url"))
    key = F.create_map(*[F.lit(x) for pair in ROUTE_TRACKER.items() for x in pair])[route]
    used = {"ip", "ua", "origin", "country", "url", "method", "headers", "body"}
    return (
        _shared(requests.where(F.coalesce(c("url"), F.lit("")) != "").where(route != "generic"), web.origin_host(c("origin")))
        .select(
            *[n for n in requests.columns if n not in used],
            an.visitor_token(c("ip"), c("_ua"), c("_host"), salts, c("ts"), lowered=True).alias("visitor"),
            c("_host").alias("domain"),
            c("_host").alias("origin"),
            F.concat(F.lit("tracker_"), key).alias("event"),
            F.concat(F.lit("/"), key).alias("path"),
            F.lit("").alias("referrer"),
            web.country_code(c("country")).alias("country"),
            web.vendor_device(c("_ua"), lowered=True).alias("device"),
            F.lit("{}").alias("props"),
        )
    )


def strip_requests(requests: DataFrame, salts: an.SaltBook, order: str = "phone_first") -> DataFrame:
    """Vendor-route requests with their URL and body anonymised."""
    c = F.col
    fields = {r.key: list(r.strip_fields) for r in load_rules()}
    clean_url = F.lit(None).cast("string")
    for name, key in ROUTE_TRACKER.items():
        stripped = sc.strip_tracker_url(c("url"), fields[key], c("visitor"), order)
        clean_url = F.when(c("route") == name, stripped).otherwise(clean_url)
    token = an.visitor_token(c("ip"), c("ua"), web.origin_host(c("origin")), salts, c("ts"))
    body = sc.scrub_payload(F.when(c("method") == "POST", c("body")), order) if "body" in requests.columns else F.lit(None)
    return (
        requests.withColumn("route", web.vendor_route(c("url"))).where("route <> 'generic'")
        .withColumn("visitor", token)
        .withColumn("clean_url", clean_url)
        .withColumn("clean_body", body)
    )


def _listed_params(url: Column, names: list[str], value) -> Column:
    """Map of the first occurrence of each listed, non-empty parameter, with ``value`` of its text."""

    def name(p: Column) -> Column:
        return F.split_part(p, F.lit("="), F.lit(1))

    def entry(p: Column) -> Column:
        raw = F.regexp_replace(p, "^[^=]*=?", "")
        return F.struct(name(p).alias("key"), value(F.coalesce(F.try_url_decode(raw), raw)).alias("value"))

    found = F.filter(sc.query_params(url), lambda p: name(p).isin(names) & p.rlike("=."))
    keys = F.transform(found, name)
    first = F.filter(found, lambda p, i: F.array_position(keys, name(p)) == i.cast("long") + 1)
    return F.map_from_entries(F.transform(first, entry))


def original_url(relay_url: Column, headers: Column | None = None, header: str = "x-original-url") -> Column:
    """Tracker URL that a relay request carries: its ``_orig`` parameter, else a header; else empty."""
    carried = F.try_element_at(_listed_params(relay_url, ["_orig"], lambda v: F.substring(v, 1, URL_CAP)), F.lit("_orig"))
    found = [carried]
    if headers is not None:
        matching = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == header))
        found.append(F.try_element_at(matching, F.lit(1)))
    return F.coalesce(*found, F.lit(""))


def allowed_params(url: Column, names: list[str]) -> Column:
    """Map of the listed, non-empty query parameters, values cut to the cap."""
    return _listed_params(url, names, lambda v: F.substring(v, 1, PARAM_CAP))


def ga4_params(url: Column, ip: Column, salts: an.SaltBook, ts: Column | None = None) -> Column:
    """Kept GA4 parameters, with pseudonyms for the client id and the address."""
    return F.map_concat(
        allowed_params(url, GA4_PARAMS),
        _listed_params(url, ["cid", "client_id"], lambda v: an.client_pseudonym(v, salts, ts)),
        F.create_map(F.lit("uip"), an.anonymize_ip(ip, salts, ts)),
    )


def meta_params(url: Column, ip: Column, salts: an.SaltBook, ts: Column | None = None) -> Column:
    return F.map_concat(allowed_params(url, META_PARAMS), F.create_map(F.lit("_anon"), an.anonymize_ip(ip, salts, ts)))


def generic_url(url: Column) -> Column:
    """URL of the generic route without its identifying parameters (case-sensitive)."""
    params = sc.query_params(url)
    kept = F.filter(params, lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).isin(GENERIC_DROP))
    base = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    changed = F.size(kept) < F.size(params)
    return F.when(changed & url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(base, query, fragment)).otherwise(url)


def drop_event_params(body: Column) -> Column:
    """GA4 body without the identifying keys of each ``events[].params``.

    Other members of the body and of the events are kept as they are.
    """
    whole = F.map_entries(F.from_json(body, "map<string,variant>"))

    def member(key: Column, text: Column) -> Column:
        return F.concat(F.to_json(key.cast("variant")), F.lit(":"), text)

    def obj(entries: Column, value) -> Column:
        parts = F.transform(entries, lambda e: member(e["key"], value(e)))
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    def text_of(e: Column) -> Column:
        return F.coalesce(F.to_json(e["value"]), F.lit("null"))

    def params_text(e: Column) -> Column:
        inner = F.map_entries(F.from_json(F.to_json(e["value"]), "map<string,variant>"))
        kept = F.filter(inner, lambda p: ~p["key"].isin(GA4_EVENT_DROP))
        return F.when(e["key"] == "params", F.coalesce(obj(kept, text_of), F.lit("{}"))).otherwise(text_of(e))

    def event_text(event: Column) -> Column:
        entries = F.map_entries(F.from_json(F.to_json(event), "map<string,variant>"))
        has_params = F.exists(entries, lambda e: e["key"] == "params")
        parts = F.transform(entries, lambda e: member(e["key"], params_text(e)))
        parts = F.when(has_params, parts).otherwise(F.array_append(parts, F.lit('"params":{}')))
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    def events_text(e: Column) -> Column:
        events = F.from_json(F.to_json(e["value"]), "array<variant>")
        listed = F.concat(F.lit("["), F.array_join(F.transform(events, event_text), ","), F.lit("]"))
        return F.when(e["key"] == "events", F.coalesce(listed, text_of(e))).otherwise(text_of(e))

    return F.when(whole.isNotNull(), obj(whole, events_text)).otherwise(body)


def filter_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(SKIP_HEADERS))


def forward_headers(headers: Column, ua: Column, has_body: Column) -> Column:
    """Headers that leave: content type, accept, coarse user agent, no address, no cookie."""
    low = F.map_from_entries(
        F.transform(
            F.map_entries(F.map_filter(headers, lambda k, v: F.lower(k).isin("content-type", "accept"))),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
        )
    )
    kind = F.when(has_body, "application/json").otherwise("text/plain")
    return F.create_map(
        F.lit("content-type"), F.coalesce(an.non_empty(F.try_element_at(low, F.lit("content-type"))), kind),
        F.lit("user-agent"), an.coarsen_ua(ua),
        F.lit("x-forwarded-for"), F.lit("0.0.0.0"),
        F.lit("accept"), F.coalesce(an.non_empty(F.try_element_at(low, F.lit("accept"))), F.lit("*/*")),
        F.lit("cookie"), F.lit(""),
    )


def vendor_lane(url: Column, tracker: Column) -> Column:
    """Lane of a request: a strip route by its URL, the GA4 or Meta relay by its tracker, else generic."""
    route = web.vendor_route(url)
    return F.when(route != "generic", route).when(tracker == "ga4", "ga4").when(tracker == "meta_pixel", "meta").otherwise("generic")


def clean_requests(requests: DataFrame, salts: an.SaltBook, order: str = "phone_first") -> DataFrame:
    """Resolved requests with ``lane, disposition, counted_as, clean_url, clean_body, clean_headers``.

    Takes the columns of ``resolve_trackers``. Strip routes lose the fields of their
    tracker, the relays keep their listed parameters only, and the generic lane loses its
    identifying parameters; only what is forwarded has a clean form.
    """
    c = F.col
    fields = {r.key: list(r.strip_fields) for r in load_rules()}
    routed = requests.withColumn("route", web.vendor_route(c("url"))).withColumn("lane", vendor_lane(c("url"), c("tracker")))
    token = an.visitor_token(c("ip"), c("ua"), web.origin_host(c("origin")), salts, c("ts"))
    disposition, counted = request_disposition(c("route"), c("url"), c("action"))
    out = routed.withColumns({"disposition": disposition, "counted_as": counted, "_token": token})
    base = F.split_part(F.split_part(c("url"), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))

    def query(params: Column) -> Column:
        pairs = F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"])))
        return F.concat_ws("?", base, F.nullif(F.array_join(pairs, "&"), F.lit("")))

    url = F.when(c("lane") == "ga4", query(ga4_params(c("url"), c("ip"), salts, c("ts")))).when(
        c("lane") == "meta", query(meta_params(c("url"), c("ip"), salts, c("ts")))
    )
    for name, key in ROUTE_TRACKER.items():
        url = url.when(c("lane") == name, sc.strip_tracker_url(c("url"), fields[key], c("_token"), order))
    body = F.when(c("method") == "POST", c("body"))
    clean_body = F.when(c("lane") == "ga4", drop_event_params(body)).otherwise(sc.scrub_payload(body, order))
    headers = c("headers") if "headers" in requests.columns else F.lit(None).cast("map<string,string>")
    forwarded = c("disposition") == "forwarded"
    return out.withColumns({
        "clean_url": F.when(forwarded, url.otherwise(generic_url(c("url")))),
        "clean_body": F.when(forwarded, clean_body),
        "clean_headers": F.when(forwarded, forward_headers(headers, c("ua"), body.isNotNull())),
    }).drop("_token", "route")


def request_disposition(route: Column, url: Column, action: Column) -> tuple[Column, Column]:
    """``(disposition, counted_as)`` of a request; an uncounted request has a null second value."""
    missing = F.coalesce(url, F.lit("")) == ""
    vendor = route != "generic"
    disposition = (
        F.when(missing, "dropped")
        .when(vendor, "forwarded")
        .when(action == "block", "blocked")
        .when(action.isin("allow", "strip"), "forwarded")
        .otherwise("processed")
    )
    counted = (
        F.when(missing & vendor, "blocked")
        .when(missing, None)
        .when(vendor, "stripped")
        .when(action == "block", "blocked")
        .when(action == "strip", "stripped")
        .otherwise("allowed")
    )
    return disposition, counted
