"""Requests of one batch that depend on one another, decided in their order.

A request may claim an email. It is refused if the email belongs to another user
at that moment, after all earlier requests; an accepted one also releases the
email its user had before. Whether a request is accepted therefore depends on
earlier ones only. So all are decided at once, again and again, each time as if
the last decisions of the earlier ones were right, until nothing changes: after n
rounds every request is right that n others depend on in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.entities import PATCHABLE, SUPERUSER_ONLY
from quillgrid.session import materialise


def _owners_before(events: DataFrame) -> Column:
    """Of each event row of an email, the owner that the events of earlier turns left; rows of one turn don't see each other."""
    before = Window.partitionBy("email").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return F.last("owner", ignorenulls=True).over(before)


def _round(claims: DataFrame, owned: DataFrame) -> DataFrame:
    """``claims`` (``turn, id, email, accepted``) decided anew, given the last decisions."""
    mine = claims.filter("accepted").select("turn", "id", "email").unionByName(owned)
    moves = Window.partitionBy("id").orderBy("turn")
    released = mine.withColumn("old", F.lag("email").over(moves)).filter("old IS NOT NULL AND old <> email")
    # An owner is a struct, so that "released" (a NULL user) differs from "no event here".
    events = (
        mine.select("email", "turn", F.struct(F.col("id").alias("user")).alias("owner"))
        .unionByName(released.select(F.col("old").alias("email"), "turn", F.struct(F.lit(None).cast(mine.schema["id"].dataType).alias("user")).alias("owner")))
        .withColumns({"asked": F.lit(False), "id": F.lit(None).cast(mine.schema["id"].dataType), "accepted": F.lit(None).cast("boolean")})
    )
    asked = claims.select("email", "turn", F.lit(None).cast(events.schema["owner"].dataType).alias("owner"), F.lit(True).alias("asked"), "id", "accepted")
    both = events.unionByName(asked).withColumn("before", _owners_before(events)).filter("asked")
    user = F.col("before")["user"]
    free = user.isNull() | (user == F.col("id"))
    return both.select("turn", "id", "email", free.alias("accepted"), (free != F.col("accepted")).alias("changed"))


def decide_claims(users: DataFrame, requests: DataFrame, turn: str = "turn") -> DataFrame:
    """``turn, accepted`` of every request (``id, email`` and a unique whole number ``turn`` from 0 that puts them in order).

    ``users`` (``id, email``) is the state before the batch. A request without an email claims nothing and is accepted. A
    user may ask several times, and users that don't exist yet may ask too.
    """
    owned = users.filter("email IS NOT NULL").select(F.lit(-1).cast("bigint").alias("turn"), "id", "email")
    every = requests.select(F.col(turn).cast("bigint").alias("turn"), "id", "email")
    claims = materialise(every.filter("email IS NOT NULL").withColumn("accepted", F.lit(True)))
    while True:
        decided = materialise(_round(claims, owned))
        claims = decided.drop("changed")
        if decided.filter("changed").isEmpty():
            break
    return claims.select("turn", "accepted").unionByName(every.filter("email IS NULL").select("turn", F.lit(True).alias("accepted")))


def apply_requests(users: DataFrame, patches: DataFrame, turn: str = "turn") -> DataFrame:
    """``users`` after all patches of a batch in the order of ``turn``.

    A patch counts if the user or a superuser makes it and its email, if it has one, is free at that moment; a refused
    one changes nothing. Of several patches of a user the last non-NULL value of each field counts. Fields in
    ``SUPERUSER_ONLY`` change through patches of superusers only. Patches of users that don't exist are left out.
    """
    known = patches.join(users.select("id"), "id", "left_semi")
    allowed = known.filter(F.col("actor_is_superuser") | (F.col("actor_id") == F.col("id")))
    decided = decide_claims(users, allowed, turn).filter("accepted").select(F.col("turn").alias(turn))
    accepted = allowed.join(decided, turn)
    fields = [c for c in patches.columns if c in PATCHABLE + SUPERUSER_ONLY]

    def last(name: str) -> Column:
        counts = F.col(name).isNotNull()
        if name in SUPERUSER_ONLY:
            counts = counts & F.col("actor_is_superuser")
        return F.max_by(name, F.when(counts, F.col(turn))).alias(f"__{name}")

    overlay = accepted.groupBy("id").agg(*[last(c) for c in fields])
    joined = users.join(overlay, "id", "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in users.columns])
