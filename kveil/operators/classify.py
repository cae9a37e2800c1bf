"""Tracker resolution, effective configuration and page-resource classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions import web
from kveil.operators.substring import contained
from kveil.sources.rulebase import (
    DEFAULT_TEMPLATE, TEMPLATE_ROWS, Rule, load_rules, template_overrides,
)

LIST_RULES = 256


def _text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _test(pattern: str, url_low: str, host: str, match: str) -> str:
    low = pattern.lower()
    if match == "host_suffix" and "/" not in low and not low.endswith((".php", ".js", ".")):
        domain = low.lstrip(".")
        return f"{host} = {_text(domain)} OR endswith({host}, {_text('.' + domain)})"
    return f"contains({url_low}, {_text(low)})"


def tracker_of(url_low: str, host: str = "", rules: list[Rule] | None = None, match: str = "contains") -> Column:
    """Key of the first rule with a pattern in the lower-cased URL, or null.

    Takes column names: each is read once per pattern. ``host_suffix`` compares host
    patterns with the end of the host, so a short pattern can not hit in the middle of
    another name.
    """
    cases = [
        f"WHEN {' OR '.join(_test(p, url_low, host, match) for p in rule.patterns)} THEN {_text(rule.key)}"
        for rule in rules or load_rules()
    ]
    return F.expr(f"CASE {' '.join(cases)} END")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.expr(f"map({', '.join(_text(x) for kv in pairs.items() for x in kv)})"), key)


def _lists(pairs: dict[str, tuple[str, ...]], key: Column) -> Column:
    """List of a key; empty for a known key without one, null for no key."""
    texts = {k: "|".join(v) for k, v in pairs.items()}
    return F.filter(F.split(_lookup(texts, key), r"\|"), lambda v: v != "")


def template_action(template: Column | str, tracker: Column, rules: list[Rule] | None = None) -> Column:
    """Action of a tracker under a template: its override, else the rule's default.

    An unknown template counts as the default template.
    """
    name = F.lit(template) if isinstance(template, str) else template
    known = F.when(name.isin(list(TEMPLATE_ROWS)), name).otherwise(DEFAULT_TEMPLATE)
    overrides = {f"{t}|{k}": a for t in TEMPLATE_ROWS for k, a in template_overrides(t).items()}
    defaults = {r.key: r.default_action for r in rules or load_rules()}
    return F.coalesce(_lookup(overrides, F.concat_ws("|", known, tracker)), _lookup(defaults, tracker))


def _own_rules(requests: DataFrame, custom_rules: DataFrame) -> tuple[DataFrame, Column]:
    """The requests with what is needed to name the customer's first rule that matches, and that rule."""
    rules = custom_rules.where(F.coalesce(F.col("domain"), F.lit("")) != "").select(
        "customer_id", F.struct(F.col("ord").cast("int").alias("ord"), "domain", "action").alias("_rule")
    )
    many = rules.groupBy("customer_id").agg(F.count("*").alias("_n"))
    long_ = many.where(F.col("_n") > LIST_RULES).select("customer_id")
    lists = rules.join(long_, "customer_id", "left_anti").groupBy("customer_id").agg(F.sort_array(F.collect_list("_rule")).alias("_own"))
    out = requests.join(lists, "customer_id", "left")
    listed = F.try_element_at(F.filter(F.col("_own"), lambda r: F.contains(F.col("_low"), F.lower(r["domain"]))), F.lit(1))
    if long_.isEmpty():
        return out, listed
    rest = rules.join(long_, "customer_id", "left_semi").withColumn("_part", F.lower(F.col("_rule.domain")))
    asked = requests.select("customer_id", "_low").join(long_, "customer_id", "left_semi")
    pairs = contained(asked, rest, "_low", "_part", ("customer_id",))
    first = pairs.join(rest, ["customer_id", "_part"]).groupBy("customer_id", "_low").agg(F.min("_rule").alias("_found"))
    found = out.join(first, ["customer_id", "_low"], "left").select(*requests.columns, "_own", "_found")
    return found, F.coalesce(listed, F.col("_found"))


def resolve_trackers(
    requests: DataFrame, url: str = "url", template: Column | str = DEFAULT_TEMPLATE,
    custom_rules: DataFrame | None = None, match: str = "contains", rules: list[Rule] | None = None,
) -> DataFrame:
    """Add ``tracker, name, category, action, custom, cookies, strip_fields`` to each request.

    The built-in rules are part of the projection: no join and no shuffle. Custom rules
    (``customer_id, ord, domain, action``) come first. A customer with at most
    ``LIST_RULES`` of them brings them along as one ordered array; longer lists are met by
    the rarest piece of each rule, so no row carries them.
    """
    rules = rules or load_rules()
    # Lower-casing is a step of its own, so that it runs once per row and not per pattern.
    host = F.coalesce(web.url_host(F.col(url), with_port=False), F.lit("")) if match == "host_suffix" else F.lit(None)
    out = requests.withColumns({"_low": F.lower(F.col(url)), "_host": host})
    if custom_rules is None:
        own = F.lit(None).cast("struct<ord:int,domain:string,action:string>")
    else:
        out, own = _own_rules(out, custom_rules)
    built_in = F.col("_built_in")
    mine = F.col("_mine")
    return (
        out.withColumn("_mine", own)
        .withColumn("_built_in", tracker_of("_low", "_host", rules, match))
        .withColumn("tracker", F.coalesce(mine["domain"], built_in))
        .withColumn("name", F.when(mine.isNull(), _lookup({r.key: r.name for r in rules}, built_in)))
        .withColumn("category", F.when(mine.isNull(), _lookup({r.key: r.category for r in rules}, built_in)))
        .withColumn("action", F.when(mine.isNotNull(), mine["action"]).otherwise(template_action(template, built_in, rules)))
        .withColumn("custom", mine.isNotNull())
        .withColumn("cookies", F.when(mine.isNull(), _lists({r.key: r.cookies for r in rules}, built_in)))
        .withColumn("strip_fields", F.when(mine.isNull(), _lists({r.key: r.strip_fields for r in rules}, built_in)))
        .drop("_mine", "_built_in", "_own", "_found", "_low", "_host")
    )


def effective_config(choices: DataFrame, rules: DataFrame, templates: DataFrame, manual: DataFrame) -> DataFrame:
    """Action of every tracker for every customer: manual choice, template, default.

    ``choices`` holds ``customer_id, template`` and ``manual`` holds ``customer_id,
    tracker, action``. The rule list is inlined as an array, so each customer row is
    expanded in place.
    """
    catalogue = F.array(
        *[F.struct(F.lit(r["tracker"]).alias("tracker"), F.lit(r["default_action"]).alias("default_action")) for r in rules.collect()]
    )
    wide = choices.select("customer_id", "template", F.inline(catalogue))
    return (
        wide.join(F.broadcast(templates.withColumnRenamed("action", "_override")), ["template", "tracker"], "left")
        .join(manual.select("customer_id", "tracker", F.col("action").alias("_manual")), ["customer_id", "tracker"], "left")
        .select("customer_id", "template", "tracker", F.coalesce("_manual", "_override", "default_action").alias("action"))
    )


def action_counts(config: DataFrame, custom_rules: DataFrame | None = None) -> DataFrame:
    """Trackers per action and customer, and the number of custom rules if they are given."""
    counts = config.groupBy("customer_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("action") == a).alias(n) for a, n in (("block", "blocked"), ("strip", "stripped"), ("allow", "allowed"))],
    )
    if custom_rules is None:
        return counts
    own = custom_rules.groupBy("customer_id").agg(F.count("*").alias("custom"))
    return counts.join(own, "customer_id", "left").withColumn("custom", F.coalesce("custom", F.lit(0)))


def search_catalogue(rules: DataFrame, category: str | None = None, search: str = "") -> DataFrame:
    out = rules
    if category and category != "all":
        out = out.where(F.col("category") == category)
    if search:
        word = search.lower()
        out = out.where(F.contains(F.lower("name"), F.lit(word)) | F.contains(F.lower("vendor"), F.lit(word)))
    return out


# Character references in attribute values; the ampersand comes last.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")]
# Resource kinds with the tag and attribute that carry their URL.
RESOURCE_TAGS = [("script", "script", "src"), ("pixel", "img", "src"), ("link", "link", "href")]


def page_resources(pages: DataFrame, html: str = "html", own_url: str = "https://relay.example") -> DataFrame:
    """One row per script, image and link URL of a page, with the blocking decision.

    Attribute values may stand in quotes or without them. Comments and the text of
    scripts hold no elements.
    """
    live = F.regexp_replace(F.regexp_replace(F.col(html), r"(?s)<!--.*?(-->|$)", ""), r"(?is)(<script\b[^>]*>).*?(</script\s*>|$)", "$1")

    def plain(value: Column) -> Column:
        bare = F.regexp_replace(value, r"""^["']\s*|\s*["']$""", "")
        for entity, char in ENTITIES:
            bare = F.replace(bare, F.lit(entity), F.lit(char))
        return bare

    def found(kind: str, tag: str, attr: str) -> Column:
        pattern = rf"""(?i)<{tag}\s(?:[^>]*?\s)?{attr}\s*=\s*("[^"]+"|'[^']+'|[^\s"'>]+)"""
        urls = F.regexp_extract_all(F.col("_live"), F.lit(pattern), F.lit(1))
        return F.transform(urls, lambda u: F.struct(F.lit(kind).alias("kind"), plain(u).alias("resource_url")))

    resources = F.concat(*[found(*t) for t in RESOURCE_TAGS])
    others = [c for c in pages.columns if c != html]
    rows = pages.select(*others, live.alias("_live")).select(*others, F.inline(resources))
    blocked = F.when(F.col("kind") == "script", web.is_blocked_script(F.col("resource_url"), own_url)).otherwise(
        web.is_intercepted(F.col("resource_url"), own_url)
    )
    return rows.withColumn("blocked", blocked)


def protection_counters(site: str, requests: DataFrame, cookies: DataFrame, resources: DataFrame) -> DataFrame:
    """Blocked requests, cookies, scripts and pixels per site.

    Inputs hold the site column plus ``url``, ``cookie`` or the ``page_resources``
    columns. Each input is counted before the results meet.
    """
    zero = F.lit(0).cast("bigint")
    kinds = ["blocked", "cookies", "scripts", "pixels"]

    def counts(df: DataFrame, **tests: Column) -> DataFrame:
        return df.groupBy(site).agg(*[(F.count_if(tests[k]) if k in tests else zero).alias(k) for k in kinds])

    parts = [
        counts(requests, blocked=web.is_intercepted(F.col("url"))),
        counts(cookies, cookies=web.is_blocked_cookie(F.col("cookie"))),
        counts(
            resources, scripts=F.col("blocked") & (F.col("kind") == "script"), pixels=F.col("blocked") & (F.col("kind") == "pixel")
        ),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy(site).agg(*[F.sum(k).alias(k) for k in kinds])
