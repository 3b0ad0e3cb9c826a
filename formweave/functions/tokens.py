"""Keys and tokens: PBKDF2, HMAC verification, licence tokens. Hash loops run in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.operators.matching import rules

MOST_ITERATIONS = 5_000_000
TOLERANCE = 300


def pbkdf2(password: Column, salt: Column, iterations: int) -> Column:
    """Hex of a 32-byte PBKDF2-HMAC-SHA256 key; 0 or more than five million iterations are refused."""
    if not 0 < iterations <= MOST_ITERATIONS:
        raise ValueError(f"between 1 and {MOST_ITERATIONS} iterations")

    @F.pandas_udf("string")
    def derive(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([hashlib.pbkdf2_hmac("sha256", a.encode(), b.encode(), iterations, 32).hex() for a, b in zip(p, s, strict=True)])

    return derive(password, salt)


def derived_keys(secrets: DataFrame, iterations: int) -> DataFrame:
    """`secrets` (p, s, any others) with `key`: each distinct pair of password and salt is derived once. The pairs are few bytes and
    much work, so they are dealt over all shuffle partitions."""
    n = int(secrets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = secrets.select("p", "s").distinct().repartition(n, "p", "s")
    return secrets.join(rules(pairs.withColumn("key", pbkdf2(F.col("p"), F.col("s"), iterations))), ["p", "s"])


def signed(body: Column, secret: str) -> Column:
    @F.pandas_udf("string")
    def mac(b: pd.Series) -> pd.Series:
        return b.map(lambda x: hmac.new(secret.encode(), (x or "").encode(), "sha256").hexdigest())

    return mac(body)


def webhook_ok(body: Column, signature: Column, secret: str, sent: Column, now: Column) -> Column:
    """A signature that is equal in constant time, no older or newer than the tolerance."""

    @F.pandas_udf("boolean")
    def same(b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([hmac.compare_digest(hmac.new(secret.encode(), (x or "").encode(), "sha256").hexdigest(), y or "") for x, y in zip(b, s, strict=True)])

    return same(body, signature) & (F.abs(now - sent) <= TOLERANCE)


def license_state(token: Column, device: Column, now: Column) -> Column:
    """'Malformed', 'Expired', 'WrongDevice' or 'ok' of payload.signature; the signature is checked elsewhere."""
    raw = F.try_to_binary(F.split_part(token, F.lit("."), F.lit(1)), F.lit("base64"))
    p = F.from_json(raw.cast("string"), "subject string, expires_at long, device_id string")
    bad = ~F.contains(token, F.lit(".")) | raw.isNull() | p.subject.isNull()
    return F.when(F.coalesce(bad, F.lit(True)), "Malformed").when((p.expires_at != 0) & (now > p.expires_at), "Expired").when(p.device_id.isNotNull() & (p.device_id != "") & (p.device_id != device), "WrongDevice").otherwise("ok")
