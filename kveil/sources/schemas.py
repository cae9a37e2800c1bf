"""Schemas of the inputs (DDL strings)."""

BEACON = "event_id BIGINT, ts TIMESTAMP, ip STRING, ua STRING, origin STRING, d STRING, e STRING, u STRING, r STRING, country STRING, p STRING"
CLEAN_EVENT = (
    "event_id BIGINT, ts TIMESTAMP, visitor STRING, domain STRING, origin STRING, event STRING, path STRING, "
    "referrer STRING, country STRING, device STRING, props STRING"
)
TRACKER_REQUEST = (
    "request_id BIGINT, ts TIMESTAMP, customer_id STRING, api_key STRING, method STRING, url STRING, "
    "headers MAP<STRING,STRING>, body STRING, ip STRING, ua STRING, origin STRING, referer STRING, country STRING"
)
PAGE_REQUEST = "page_host STRING, ts TIMESTAMP, url STRING"
CUSTOM_RULE = "customer_id STRING, ord INT, domain STRING, action STRING"
USAGE = "customer_id STRING, month STRING, requests BIGINT, blocked BIGINT, stripped BIGINT, allowed BIGINT"
FEED_EVENT = "ts TIMESTAMP, tracker STRING, action STRING"
ATTESTATION = (
    "domain STRING, ts TIMESTAMP, ttl_ms BIGINT, nonce STRING, public_key STRING, enrolled BOOLEAN, "
    "signature_valid BOOLEAN"
)
USERS = "id BIGINT, email STRING, created_at TIMESTAMP, deleted_at TIMESTAMP"
CUSTOMERS = "id BIGINT, user_id BIGINT, api_key STRING, plan STRING, enabled BOOLEAN, created_at TIMESTAMP"
PROJECTS = "id BIGINT, customer_id_ref BIGINT, name STRING, feed_hash STRING, allowed_domains ARRAY<STRING>, created_at TIMESTAMP"
SUBSCRIPTIONS = "customer_id_ref BIGINT, plan STRING, status STRING"
REVOCATIONS = "key_hash STRING, revoked_at TIMESTAMP"
PENDING_ACCOUNTS = "email STRING, created_at TIMESTAMP, payment_processed BOOLEAN"
VIEW_TOKENS = "token STRING, expires_at TIMESTAMP"
MAGIC_LINKS = "token_hash STRING, used BOOLEAN, expires_at TIMESTAMP"
SYSTEM_EVENTS = "event_type STRING, meta STRING, created_at TIMESTAMP"
DELETIONS = "user_hash STRING, deleted_at TIMESTAMP, reason STRING"
