"""Visitor anonymisation: coarse IP and user agent, daily keyed tokens."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
REDACTION, SALT_LITERAL = "spark.sql.redaction.string.regex", "(0x|X')[0-9A-Fa-f]{128}"
_BLOCK = 64  # SHA-256 block size in bytes

# White space as JavaScript's trim and \s see it.
JS_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


_JS_SPACE_CHARS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(_JS_SPACE_CHARS))


def non_empty(col: Column) -> Column:
    """The text, or null when it is empty. Stays inside its branch, unlike ``nullif``."""
    return F.when(col != "", col)


def _expanded(address: Column) -> Column:
    """IPv6 text with its ``::`` written out as zero groups."""
    left, right = (non_empty(F.split_part(address, F.lit("::"), F.lit(n))) for n in (1, 2))

    def groups(part: Column) -> Column:
        return F.coalesce(F.length(part) - F.length(F.replace(part, F.lit(":"), F.lit(""))) + 1, F.lit(0))

    zeros = F.substring(F.repeat(F.lit(":0"), F.lit(8) - groups(left) - groups(right)), 2, 20)
    return F.concat_ws(":", left, non_empty(zeros), right)


def coarsen_ip(ip: Column, expand_v6: bool = True) -> Column:
    """IPv4 to its /24 and IPv6 to its /48; empty or unreadable input gives ``0``.

    ``expand_v6`` fills a ``::`` before taking the first three groups; switch it off
    to keep the groups as written.
    """

    def v4(address: Column) -> Column:
        dots = F.length(address) - F.length(F.replace(address, F.lit("."), F.lit("")))
        return F.when(dots == 3, F.concat(F.substring_index(js_trim(address), ".", 3), F.lit(".0/24"))).otherwise("0")

    def v6(address: Column) -> Column:
        inner = F.regexp_replace(address, "(?s)^.{0,7}", "")
        mapped = F.lower(F.substring(address, 1, 7)) == "::ffff:"
        full = F.when(mapped, inner).otherwise(address)
        if expand_v6:
            full = F.when(F.contains(full, F.lit("::")), _expanded(full)).otherwise(full)
        coarse = F.concat(F.substring_index(full, ":", 3), F.lit("::/48"))
        return F.when(mapped & ~F.contains(inner, F.lit(":")), v4(inner)).otherwise(coarse)

    # The array binds the trimmed text to a name, so that the long v6 rule stays small code.
    by_v6 = F.transform(F.array(js_trim(ip)), v6)[0]
    return F.when(F.coalesce(ip, F.lit("")) == "", "0").when(~F.contains(ip, F.lit(":")), v4(ip)).otherwise(by_v6)


def coarsen_ua(ua: Column, lowered: bool = False) -> Column:
    """``browser/os`` family; the order of the tests matters.

    ``lowered`` says that the column is lower case and never null, which saves work
    where several expressions read it.
    """
    low = ua if lowered else F.lower(F.coalesce(ua, F.lit("")))

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    browser = (
        F.when(has("firefox"), "ff").when(has("edg/"), "edge").when(has("chrome"), "chrome")
        .when(has("safari"), "safari").otherwise("other")
    )
    system = (
        F.when(has("windows"), "win").when(has("android"), "android").when(has("iphone") | has("ipad"), "ios")
        .when(has("mac os"), "mac").when(has("linux"), "linux").otherwise("other")
    )
    return F.concat(browser, F.lit("/"), system)


def salt_epoch(ts: Column, rotation_ms: int = DAY_MS) -> Column:
    """Number of the salt period; a new salt starts at every UTC midnight by default."""
    return F.floor(F.unix_millis(ts) / rotation_ms)


class SaltBook:
    """One random 32-byte salt per epoch, held by the driver and never written to a table.

    The salts are literals of the query, so a redaction rule keeps them out of plans in
    the UI and the event log; it is set here unless the session has a rule of its own.
    ``provider`` maps an epoch to its salt; give one when several jobs (or a restarted
    stream) must agree on the tokens of an open day. A row of an epoch without a salt has a
    null token, and fails the query if the book is ``strict``; ``uncovered`` counts such rows.
    """

    def __init__(self, provider: Callable[[int], bytes] | None = None, rotation_ms: int = DAY_MS, strict: bool = False):
        self.rotation_ms, self.strict = rotation_ms, strict
        self._provider = provider or (lambda epoch: os.urandom(32))
        self._salts: dict[int, bytes] = {}

    @classmethod
    def fixed(cls, salt: bytes) -> SaltBook:
        """The same salt for all epochs: for tests only."""
        book = cls(lambda epoch: salt)
        book._fixed = salt
        return book

    _fixed: bytes | None = None

    def cover(self, epochs: Iterable[int]) -> SaltBook:
        for epoch in epochs:
            if epoch not in self._salts:
                self._salts[epoch] = self._provider(epoch)
        return self

    def fingerprint(self, epoch: int) -> str:
        """Short hash that tells salts apart without showing them."""
        return hashlib.sha256(self._fixed or self._salts[epoch]).hexdigest()[:8]

    def forget_before(self, epoch: int) -> None:
        """Drop the salts of finished epochs: their tokens can not be rebuilt any more."""
        self._salts = {e: s for e, s in self._salts.items() if e >= epoch}

    def uncovered(self, rows: DataFrame, ts: str = "ts") -> DataFrame:
        """Rows per epoch that no salt covers: their tokens would be null, and nobody would count them."""
        epoch = salt_epoch(F.col(ts), self.rotation_ms)
        held = F.lit(self._fixed is not None) | epoch.isin(list(self._salts))
        return rows.where(~F.coalesce(held, F.lit(False))).groupBy(epoch.alias("epoch")).agg(F.count("*").alias("rows"))

    def pads(self, ts: Column | None) -> tuple[Column, Column]:
        """Inner and outer HMAC key blocks for each row; null where no salt is held, unless that is an error."""
        session = SparkSession.getActiveSession()
        if session is not None and not session.conf.get(REDACTION, None):
            session.conf.set(REDACTION, SALT_LITERAL)
        if self._fixed is not None:
            return F.lit(_pad(self._fixed, 0x36)), F.lit(_pad(self._fixed, 0x5C))
        if not self._salts:
            raise ValueError("call cover() with the epochs of the data first")
        cells = [
            cell
            for epoch, salt in sorted(self._salts.items())
            for cell in (F.lit(epoch), F.struct(F.lit(_pad(salt, 0x36)).alias("i"), F.lit(_pad(salt, 0x5C)).alias("o")))
        ]
        epoch = salt_epoch(ts, self.rotation_ms)
        pads = F.try_element_at(F.create_map(*cells), epoch)
        if not self.strict:
            return pads["i"], pads["o"]
        missing = F.raise_error(F.concat(F.lit("no salt is held for epoch "), epoch.cast("string")))
        pads = F.when(epoch.isNotNull(), F.coalesce(pads, missing))
        return pads["i"], pads["o"]


def _pad(key: bytes, byte: int) -> bytes:
    return bytes(b ^ byte for b in key.ljust(_BLOCK, b"\0"))


def keyed_token(message: Column, salts: SaltBook, ts: Column | None = None) -> Column:
    """First 16 hex digits of HMAC-SHA256, composed from ``sha2`` so it stays in the JVM."""
    inner, outer = salts.pads(ts)
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, digest), 256), 1, 16)


def visitor_token(
    ip: Column, ua: Column, origin: Column, salts: SaltBook, ts: Column | None = None, lowered: bool = False
) -> Column:
    """The daily, unlinkable visitor token."""
    site = F.coalesce(non_empty(origin), F.lit("-"))
    return keyed_token(F.concat_ws("|", coarsen_ip(ip), coarsen_ua(ua, lowered), site), salts, ts)


def anonymize_ip(ip: Column, salts: SaltBook, ts: Column | None = None) -> Column:
    return F.when(F.coalesce(ip, F.lit("")) == "", "unknown").otherwise(keyed_token(coarsen_ip(ip), salts, ts))


def client_pseudonym(client_id: Column, salts: SaltBook, ts: Column | None = None) -> Column:
    """Token of a vendor's client id; the whole id is hashed, so ids stay distinct."""
    return keyed_token(F.concat(client_id, F.lit("|cid")), salts, ts)


def short_hash(col: Column) -> Column:
    """Unkeyed 16-digit hash used for API keys and erasure audit rows."""
    return F.substring(F.sha2(F.encode(col.cast("string"), "UTF-8"), 256), 1, 16)
