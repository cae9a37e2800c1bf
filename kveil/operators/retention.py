"""Retention and erasure: what is removed, when, and what is recorded about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.functions.anonymize import short_hash


def _before(column: str, now: Column, span: str) -> Column:
    return F.coalesce(F.col(column) < now - F.expr(f"INTERVAL {span}"), F.lit(False))


def _is(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


# The retention policies; each says which rows have expired.
POLICIES: dict[str, Callable[[Column], Column]] = {
    "pending_accounts": lambda now: _before("created_at", now, "2 HOURS") & ~_is("payment_processed"),
    "view_tokens": lambda now: _before("expires_at", now, "1 HOUR"),
    "magic_links": lambda now: _is("used") | _before("expires_at", now, "1 HOUR"),
    "usage_monthly": lambda now: F.col("month") < F.date_format(F.add_months(now.cast("date"), -12), "yyyy-MM"),
    "deletions": lambda now: F.coalesce(F.col("deleted_at") < F.add_months(now.cast("date"), -60), F.lit(False)),
}
TRIAL_MINUTES = 10


def expired(policy: str, now: str) -> Column:
    return POLICIES[policy](F.lit(now).cast("timestamp"))


def purge(df: DataFrame, policy: str, now: str) -> DataFrame:
    """Rows that stay under a policy."""
    return df.where(~expired(policy, now))


def purge_counts(tables: dict[str, DataFrame], now: str) -> DataFrame:
    """Kept and purged rows per table; the key names the policy."""
    counts = [
        df.agg(
            F.lit(name).alias("policy"), F.count_if(~expired(name, now)).alias("kept"), F.count_if(expired(name, now)).alias("purged")
        )
        for name, df in tables.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def expire_trials(customers: DataFrame, now: str, minutes: int = TRIAL_MINUTES) -> DataFrame:
    """Customers with trial accounts disabled once their time is over."""
    over = (F.col("plan") == "test") & _before("created_at", F.lit(now).cast("timestamp"), f"{minutes} MINUTES")
    return customers.withColumn("enabled", F.col("enabled") & ~over)


def erase_subjects(
    subjects: DataFrame, users: DataFrame, customers: DataFrame, now: str, replacement: Column | None = None,
    reason: str = "user_confirmed",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, customers and audit rows after erasing the subjects (column ``user_id``).

    ``replacement`` is the random part of the new email, by default from ``uuid()``.
    """
    when = F.lit(now).cast("timestamp")
    ids = subjects.where("user_id IS NOT NULL").select("user_id").distinct()
    random = replacement if replacement is not None else F.substring(F.replace(F.expr("uuid()"), F.lit("-")), 1, 16)
    hit = ids.withColumn("_hit", F.lit(True))
    marked = users.join(hit.withColumnRenamed("user_id", "id"), "id", "left")
    gone = F.col("_hit").isNotNull()
    new_users = marked.withColumns({
        "email": F.when(gone, F.concat(F.lit("deleted_"), random, F.lit("@deleted"))).otherwise(F.col("email")),
        "deleted_at": F.when(gone, when).otherwise(F.col("deleted_at")),
    }).select(users.columns)
    new_customers = (
        customers.join(hit, "user_id", "left").withColumn("enabled", F.col("enabled") & F.col("_hit").isNull()).select(customers.columns)
    )
    audit = ids.select(short_hash(F.col("user_id")).alias("user_hash"), when.alias("deleted_at"), F.lit(reason).alias("reason"))
    return new_users, new_customers, audit


def cascade_delete(
    ended: DataFrame, users: DataFrame, customers: DataFrame, projects: DataFrame, feed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Customers and feed rows after subscriptions ended (column ``email``)."""
    owners = ended.select("email").distinct().join(users.select("id", "email"), "email").select(F.col("id").alias("user_id")).distinct()
    closed = customers.join(owners, "user_id", "left_semi").select(F.col("id").alias("customer_id_ref"))
    hashes = projects.join(closed, "customer_id_ref", "left_semi").select("feed_hash")
    disabled = customers.join(owners.withColumn("_hit", F.lit(True)), "user_id", "left").withColumn(
        "enabled", F.col("enabled") & F.col("_hit").isNull()
    )
    return disabled.select(customers.columns), feed.join(hashes, "feed_hash", "left_anti")
