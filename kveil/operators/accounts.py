"""Customer lookups, key checks and activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kveil.functions import fields
from kveil.functions.anonymize import short_hash

REVOKED_HOURS = 24


def active_customers(customers: DataFrame, projects: DataFrame) -> DataFrame:
    """Enabled customers with a well-formed key, with their oldest project."""
    age = F.struct(*[c for c in ("created_at", "id", "feed_hash") if c in projects.columns])
    project = F.struct("feed_hash", "allowed_domains")
    first = projects.groupBy(F.col("customer_id_ref").alias("customer_id")).agg(F.min_by(project, age).alias("p"))
    return (
        customers.where(F.col("enabled") & fields.is_api_key(F.col("api_key")))
        .select(F.col("id").alias("customer_id"), "api_key", "plan")
        .join(first.select("customer_id", "p.feed_hash", "p.allowed_domains"), "customer_id")
    )


def authenticate(requests: DataFrame, customers: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests of enabled customers, with customer id, plan, feed and allowed domains.

    A customer id in the log is replaced by the one that the key proves.
    """
    return requests.drop("customer_id").join(active_customers(customers, projects), "api_key")


def drop_revoked(requests: DataFrame, revocations: DataFrame, hours: int = REVOKED_HOURS) -> DataFrame:
    """Drop requests made within ``hours`` after their key was revoked."""
    r = revocations.select(F.col("key_hash").alias("_key"), "revoked_at")
    keyed = requests.withColumn("_hash", short_hash(F.col("api_key")))
    cond = (
        (F.col("_hash") == F.col("_key")) & (F.col("ts") >= F.col("revoked_at"))
        & (F.col("ts") < F.col("revoked_at") + F.expr(f"INTERVAL {hours} HOURS"))
    )
    return keyed.join(r, cond, "left_anti").drop("_hash")


def _request_domain(header: Column) -> Column:
    h = F.coalesce(header, F.lit(""))
    h = F.regexp_replace(F.regexp_replace(h, "^https?://", ""), "/.*", "")
    return F.trim(F.lower(F.regexp_replace(h, r"^www\.", "")))


def domain_allowed(origin: Column, referer: Column, allowed: Column) -> Column:
    """Origin, else Referer, equals an allowed domain or is a subdomain; an empty list is open."""
    host = F.coalesce(F.nullif(_request_domain(origin), F.lit("")), _request_domain(referer))
    listed = F.filter(F.coalesce(allowed, F.array().cast("array<string>")), lambda d: F.coalesce(d, F.lit("")) != "")

    def fits(d: Column) -> Column:
        d = F.trim(F.lower(d))
        return (host == d) | host.endswith(F.concat(F.lit("."), d))

    return (F.size(listed) == 0) | ((host != "") & F.exists(listed, fits))


def newest_per(df: DataFrame, key: str, order: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest row per key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def customer_view(users: DataFrame, customers: DataFrame, projects: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each user with the newest enabled customer that has a project, and its subscription."""
    with_project = customers.where("enabled").join(
        projects.select(F.col("customer_id_ref").alias("id"), "feed_hash"), "id"
    )
    newest = newest_per(with_project, "user_id")
    status = subscriptions.select(F.col("customer_id_ref").alias("id"), F.col("status").alias("sub_status"))
    return (
        users.select(F.col("id").alias("user_id"), "email")
        .join(newest.select("id", "user_id", "api_key", "plan", "feed_hash"), "user_id")
        .join(status, "id", "left")
        .select("user_id", "email", "api_key", "plan", "feed_hash", "sub_status")
    )


def login_candidates(users: DataFrame) -> DataFrame:
    """Newest live user per email."""
    return newest_per(users.where("deleted_at IS NULL"), "email")


def find_subjects(requests: DataFrame, users: DataFrame, customers: DataFrame) -> DataFrame:
    """User of each erasure request: by API key, else by the email of a live user."""
    by_key = newest_per(customers.where("api_key IS NOT NULL"), "api_key").select("api_key", F.col("user_id").alias("_by_key"))
    by_email = login_candidates(users).select("email", F.col("id").alias("_by_email"))
    return (
        requests.join(by_key, "api_key", "left").join(by_email, "email", "left")
        .withColumn("user_id", F.coalesce("_by_key", "_by_email")).drop("_by_key", "_by_email")
    )


def activate(events: DataFrame, users: DataFrame, customers: DataFrame, pending: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Activations that take effect: the first per email that is neither active nor processed."""
    active = customers.where("enabled").select(F.col("user_id").alias("id")).join(users.select("id", "email"), "id").select("email")
    processed = pending.where("payment_processed").select("email")
    w = Window.partitionBy("email").orderBy(ts, tie)
    first = events.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")
    return first.join(active, "email", "left_anti").join(processed, "email", "left_anti")


def close_old_accounts(activations: DataFrame, users: DataFrame, customers: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Users and customers after the activations: older live accounts of the emails are closed."""
    hit = activations.select("email", F.lit(True).alias("_hit")).distinct()
    marked = users.join(hit, "email", "left")
    closing = F.col("_hit").isNotNull() & F.col("deleted_at").isNull()
    new_users = marked.withColumn("deleted_at", F.when(closing, F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))
    closed = marked.where(closing).select(F.col("id").alias("user_id"), F.lit(True).alias("_closed"))
    new_customers = customers.join(closed, "user_id", "left").withColumn("enabled", F.col("enabled") & F.col("_closed").isNull())
    return new_users.drop("_hit").select(users.columns), new_customers.select(customers.columns)


def clean_accounts(raw: DataFrame) -> DataFrame:
    """Registration rows with every field normalised; a null email marks an invalid row."""
    c = F.col
    return raw.select(
        *[n for n in raw.columns if n not in ("email", "domain", "plan", "template", "name")],
        fields.clean_email(c("email")).alias("email"),
        fields.clean_domains(c("domain")).alias("domains"),
        fields.clean_plan(c("plan")).alias("plan"),
        fields.clean_template(c("template")).alias("template"),
        fields.clean_text(c("name")).alias("name"),
    )


def quarantine(requests: DataFrame) -> DataFrame:
    """Requests with ``reject_reason``; null means accepted."""
    return requests.withColumn("reject_reason", fields.reject_reason(F.col("url"), F.col("body")))
