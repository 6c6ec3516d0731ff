"""Users, tokens and tasks: lookups, patches, upserts and latest states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import tokens as tk
from quillgrid.operators.skew import HOT_ROWS, salted_join

TOKEN_KEY = ["user_id", "provider"]
PATCHABLE = ("email", "full_name", "hashed_password")
SUPERUSER_ONLY = ("is_active", "is_superuser")
SECRET = ("hashed_password", "access_token_enc", "refresh_token_enc")


def public(df: DataFrame) -> DataFrame:
    """Without secret columns."""
    return df.drop(*SECRET)


def find_first(df: DataFrame, condition: Column, order: str = "id") -> DataFrame:
    """The first matching row by ``order``; empty if there is none."""
    return df.filter(condition).orderBy(order).limit(1)


def with_user_defaults(users: DataFrame) -> DataFrame:
    return users.withColumns(
        {
            "full_name": F.coalesce("full_name", F.lit("")),
            "is_superuser": F.coalesce("is_superuser", F.lit(False)),
        }
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key by ``order``: a fold, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def fold_to_map(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """``key, value`` rows with unique keys; the last value of a repeated key wins."""
    last = F.max_by(F.struct(value), ordinal)
    return df.groupBy(key).agg(last[value].alias(value))


def email_conflicts(
    requests: DataFrame, users: DataFrame, order: Sequence[str] = (), *, new: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Requests whose email belongs to another user, or to none but is claimed by an earlier request of the batch.

    ``new`` requests, and those without an ``id``, are inserts, for which any
    owner is another user. ``order`` are the columns that put requests in order,
    by default the ``id`` or else all columns. A user may claim one email several
    times. Emails count as they were before the batch.
    """
    is_new = new or "id" not in requests.columns
    turn = F.struct(*(order or (["id"] if "id" in requests.columns else requests.columns)))
    by = F.lit(None).cast("bigint") if is_new else F.col("id")
    owners = users.select("email", F.col("id").alias("__owner"), F.lit(True).alias("__owned"))
    claims = requests.withColumns({"__turn": turn, "__by": by}).filter(F.col("email").isNotNull())
    first = claims.groupBy("email").agg(F.min(F.struct("__turn", "__by")).alias("__first"))
    known = first.join(owners, "email", "left")
    judged = salted_join(claims, known, ["email"], spread=[F.col("__turn")], how="left", hot_rows=hot_rows)
    other = F.lit(True) if is_new else ~F.col("id").eqNullSafe(F.col("__owner"))
    late = (F.col("__turn") > F.col("__first.__turn")) & (F.lit(is_new) | ~F.col("__by").eqNullSafe(F.col("__first.__by")))
    return judged.filter(F.when(F.col("__owned"), other).otherwise(late)).select(*requests.columns)


def insert_users(users: DataFrame, requests: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``users`` with the requested ones whose email is free; of equal emails the first request by ``order`` counts.

    Requests without an email are not accepted. Columns that ``requests`` lacks are NULL.
    """
    refused = email_conflicts(requests, users, order, new=True).select("id").distinct()
    added = requests.filter(F.col("email").isNotNull()).join(refused, "id", "left_anti")
    return users.unionByName(added.select(*[c for c in added.columns if c in users.columns]), allowMissingColumns=True)


def accepted_patches(patches: DataFrame, users: DataFrame) -> DataFrame:
    """Patches by the user or a superuser, without email conflicts; users are not looked up."""
    allowed = patches.filter(F.col("actor_is_superuser") | (F.col("actor_id") == F.col("id")))
    conflicts = email_conflicts(allowed.select("id", "email"), users).select("id").distinct()
    return allowed.join(conflicts, "id", "left_anti")


def apply_patches(users: DataFrame, patches: DataFrame) -> DataFrame:
    """Overlay the non-NULL fields of accepted patches, at most one per user.

    Fields in ``SUPERUSER_ONLY`` change only if the acting user is a superuser.
    """
    accepted = accepted_patches(patches, users)
    fields = [c for c in accepted.columns if c in PATCHABLE + SUPERUSER_ONLY]
    overlay = accepted.select(
        "id", "actor_is_superuser", *[F.col(c).alias(f"__{c}") for c in fields]
    )
    joined = users.join(overlay, "id", "left")

    def patched(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        new = F.coalesce(F.col(f"__{name}"), F.col(name))
        if name in SUPERUSER_ONLY:
            new = F.when(F.col("actor_is_superuser"), new).otherwise(F.col(name))
        return new.alias(name)

    return joined.select(*[patched(c) for c in users.columns])


def upsert_tokens(current: DataFrame, granted: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Replace the token of each (user, provider) in ``granted``, or add it.

    Of several grants of one key the last by ``order`` counts, by default by the
    order of all columns. Columns that ``granted`` lacks keep their old value.
    """
    granted = latest(granted, TOKEN_KEY, order or [c for c in granted.columns if c not in TOKEN_KEY])
    new = granted.select(*TOKEN_KEY, F.lit(True).alias("__new"), *[
        F.col(c).alias(f"__{c}") for c in granted.columns if c not in TOKEN_KEY
    ])

    def merged(name: str) -> Column:
        if name in TOKEN_KEY or name not in granted.columns:
            return F.col(name)
        return F.when(F.col("__new"), F.col(f"__{name}")).otherwise(F.col(name)).alias(name)

    return current.join(new, TOKEN_KEY, "full").select(*[merged(c) for c in current.columns])


def delete_tokens(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the tokens of ``keys``; keys that do not exist are ignored."""
    return current.join(keys, TOKEN_KEY, "left_anti")


def token_status(
    users: DataFrame, tokens: DataFrame, as_of: Column, provider: str, flagged: str | None = None
) -> DataFrame:
    """Integration state of every user for one provider; no token means disconnected.

    ``flagged`` names an optional boolean token column that asks for a new
    authorisation.
    """
    flag = F.col(flagged) if flagged else F.lit(False)
    mine = tokens.filter(F.col("provider") == provider).select(
        "user_id", F.lit(True).alias("__token"), "expires_at", "has_refresh_token", "scope", flag.alias("__flag")
    )
    joined = users.select(F.col("id").alias("user_id")).join(mine, "user_id", "left")
    has_token = F.coalesce(F.col("__token"), F.lit(False))
    status = tk.integration_status(has_token, F.col("__flag"), F.col("expires_at"), as_of)
    return joined.select(
        "user_id",
        F.lit(provider).alias("provider"),
        has_token.alias("has_token"),
        (status == "connected").alias("connected"),
        F.coalesce("has_refresh_token", F.lit(False)).alias("has_refresh_token"),
        "expires_at",
        tk.is_expired(F.col("expires_at"), as_of).alias("is_expired"),
        tk.expires_soon(F.col("expires_at"), as_of).alias("expires_soon"),
        status.alias("status"),
    )


def task_states(events: DataFrame, creates: Column | None = None) -> DataFrame:
    """Latest state of every task in an event log; equal times are settled by ``event_id``.

    An event sets the fields that it holds: a NULL field leaves the earlier value.
    ``creates`` tells the events that create a task; others don't make one, so a
    task without such an event is left out.
    """
    fields = [c for c in events.columns if c not in ("task_id", "updated_at", "event_id")]
    moment = F.struct("updated_at", "event_id")
    return (
        events.groupBy("task_id")
        .agg(
            F.min("updated_at").alias("created_at"),
            F.max(moment).alias("__last"),
            F.max(F.lit(True) if creates is None else F.coalesce(creates, F.lit(False))).alias("__made"),
            *[F.max_by(f, F.when(F.col(f).isNotNull(), moment)).alias(f) for f in fields],
        )
        .filter("__made")
        .select("task_id", "created_at", "__last.*", *fields)
    )
