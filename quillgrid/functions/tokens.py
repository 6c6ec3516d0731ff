"""State of an access token at a given moment, as Column expressions.

``as_of`` is always passed in, so a result can be reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_expired(expires_at: Column, as_of: Column) -> Column:
    """Inclusive at the expiry moment; a token without expiry never expires."""
    return F.coalesce(expires_at <= as_of, F.lit(False))


def needs_reauth(flag: Column, expires_at: Column, as_of: Column) -> Column:
    """Flagged, or past expiry (strictly)."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(expires_at < as_of, F.lit(False))


def integration_status(has_token: Column, flag: Column, expires_at: Column, as_of: Column) -> Column:
    return (
        F.when(~has_token, F.lit("disconnected"))
        .when(needs_reauth(flag, expires_at, as_of), F.lit("needs_reauth"))
        .otherwise(F.lit("connected"))
    )


def expires_soon(expires_at: Column, as_of: Column, hours: int = 24) -> Column:
    """Less than ``hours`` left, or already expired."""
    return F.coalesce(expires_at < F.timestamp_add("HOUR", F.lit(hours), as_of), F.lit(False))


def expiry_from(seconds: Column, as_of: Column) -> Column:
    """Expiry of a token granted at ``as_of``; NULL if no duration was given."""
    return F.timestamp_add("SECOND", seconds.cast("int"), as_of)
