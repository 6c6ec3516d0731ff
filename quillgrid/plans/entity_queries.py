"""Queries over users, tokens and tasks, and over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import tokens as tk
from quillgrid.operators import checks as ck
from quillgrid.operators import entities as en
from quillgrid.operators import requests as rq
from quillgrid.plans import views as v
from quillgrid.plans.views import AS_OF, with_views

_USER_COLUMNS = "id, email, full_name, is_active, is_superuser"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def task_state(spark: SparkSession, folder: str) -> DataFrame:
    return en.task_states(v.task_events(v.table(spark, folder, "events")))


TASK_STATE_SQL = with_views("fx_task_events", """
select task_id, created_at, updated_at, event_id, kind, status
from (select *, min(updated_at) over (partition by task_id) created_at,
 row_number() over (partition by task_id order by updated_at desc, event_id desc) rn from fx_task_events) where rn = 1""")


def task_state_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks from events that set some fields only; a sign-up creates a task, and others are left out without one."""
    events = v.task_events(v.table(spark, folder, "events"))
    sparse = events.withColumns(
        {
            "kind": F.when(F.col("event_id") % 3 > 0, F.col("kind")),
            "status": F.when(F.col("event_id") % 4 > 0, F.col("status")),
            "made": F.col("status") == "queued",
        }
    )
    return en.task_states(sparse, creates=F.col("made")).drop("made")


TASK_STATE_SPARSE_SQL = with_views("fx_task_events", """
select task_id, min(updated_at) created_at, max(updated_at) updated_at, arg_max(event_id, (updated_at, event_id)) event_id,
 arg_max(kind, (updated_at, event_id)) filter (event_id % 3 > 0) kind, arg_max(status, (updated_at, event_id)) filter (event_id % 4 > 0) status
from fx_task_events group by task_id having bool_or(status = 'queued')""")


def token_status(spark: SparkSession, folder: str) -> DataFrame:
    # A token without a refresh token asks for a new consent.
    tokens = v.tokens(spark, folder).withColumn("consent_lost", ~F.col("has_refresh_token"))
    return en.token_status(v.users(spark, folder), tokens, _as_of(), "dropbox", flagged="consent_lost")


TOKEN_STATUS_SQL = with_views("fx_users fx_tokens", f"""
select u.id user_id, 'dropbox' provider, t.user_id is not null has_token,
 t.user_id is not null and has_refresh_token and coalesce(expires_at >= timestamp '{AS_OF}', true) connected,
 coalesce(has_refresh_token, false) has_refresh_token, expires_at,
 coalesce(expires_at <= timestamp '{AS_OF}', false) is_expired,
 coalesce(expires_at < timestamp '{AS_OF}' + interval '24' hour, false) expires_soon,
 case when t.user_id is null then 'disconnected' when not has_refresh_token or expires_at < timestamp '{AS_OF}' then 'needs_reauth' else 'connected' end status
from fx_users u left join fx_tokens t on t.user_id = u.id and t.provider = 'dropbox'""")


def token_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """First token by (provider, expiry moment) lookups, and the expiry of a grant of an hour per user id."""
    found = en.find_first(
        v.tokens(spark, folder),
        (F.col("provider") == "dropbox") & (F.col("expires_at") == _as_of()),
        order="user_id",
    )
    return found.select("user_id", "provider", tk.expiry_from(F.lit(3600), _as_of()).alias("expiry"))


TOKEN_LOOKUP_SQL = with_views("fx_tokens", f"""
select user_id, provider, timestamp '{AS_OF}' + interval '3600' second expiry from fx_tokens
where provider = 'dropbox' and expires_at = timestamp '{AS_OF}' order by user_id limit 1""")


def user_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return en.with_user_defaults(v.users(spark, folder))


USER_DEFAULTS_SQL = with_views("fx_users", """
select id, email, coalesce(full_name, '') full_name, is_active, coalesce(is_superuser, false) is_superuser from fx_users""")


def user_patch(spark: SparkSession, folder: str) -> DataFrame:
    return en.apply_patches(v.users(spark, folder), v.patches(spark, folder))


_CONFLICT_SQL = "exists (select 1 from fx_users o where o.email = p.email and o.id <> p.id)"
USER_PATCH_SQL = with_views("fx_users fx_patches", f"""
select u.id, coalesce(p.email, u.email) email, coalesce(p.full_name, u.full_name) full_name,
 case when actor_is_superuser then coalesce(p.is_active, u.is_active) else u.is_active end is_active,
 case when actor_is_superuser then coalesce(p.is_superuser, u.is_superuser) else u.is_superuser end is_superuser
from fx_users u left join (select * from fx_patches p where (actor_is_superuser or actor_id = id) and not {_CONFLICT_SQL}) p
 on p.id = u.id""")


def email_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return en.email_conflicts(v.patches(spark, folder), v.users(spark, folder)).select("id", "email")


EMAIL_CONFLICTS_SQL = with_views("fx_users fx_patches", f"select id, email from fx_patches p where {_CONFLICT_SQL}")


def user_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Every order asks for an account for its customer; the first order of a customer gets it."""
    requests = v.table(spark, folder, "orders").selectExpr(
        "10000000 + o_orderkey id", "concat('c', cast(o_custkey as string), '@orders.example') email", "o_orderpriority full_name", "true is_active"
    )
    return en.insert_users(v.users(spark, folder), requests)


USER_INSERT_SQL = with_views("fx_users", f"""
select {_USER_COLUMNS} from fx_users union all
select 10000000 + min(o_orderkey) id, concat('c', cast(o_custkey as varchar), '@orders.example') email,
 arg_min(o_orderpriority, o_orderkey) full_name, true is_active, null::boolean is_superuser from orders group by o_custkey""")


def token_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return en.upsert_tokens(v.tokens(spark, folder), v.grants(spark, folder))


TOKEN_UPSERT_SQL = with_views("fx_tokens fx_grants", """
select user_id, provider, expires_at, has_refresh_token, scope from fx_grants
union all select user_id, provider, expires_at, has_refresh_token, scope from fx_tokens t
where not exists (select 1 from fx_grants g where g.user_id = t.user_id and g.provider = t.provider)""")


def token_delete(spark: SparkSession, folder: str) -> DataFrame:
    keys = v.grants(spark, folder).select("user_id", "provider")
    return en.delete_tokens(v.tokens(spark, folder), keys)


TOKEN_DELETE_SQL = with_views("fx_tokens fx_grants", """
select user_id, provider, expires_at, has_refresh_token, scope from fx_tokens t
where not exists (select 1 from fx_grants g where g.user_id = t.user_id and g.provider = t.provider)""")


def category_sums(spark: SparkSession, folder: str) -> DataFrame:
    return ck.category_sums(v.table(spark, folder, "events"), "event_type", "value", over=100)


CATEGORY_SUMS_SQL = """select event_type, cast(sum(cast(value as decimal(18,2))) as decimal(28,2)) total
from events where value > 100 group by event_type"""


def graph_match(spark: SparkSession, folder: str) -> DataFrame:
    """(customer)-[ordered]->(item)-[from]->(supplier), where both ends lie in one nation."""
    placed = v.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = v.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = v.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    items = v.table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    ordered = ck.match_step(items, placed, "l_orderkey", "o_orderkey")
    owned = ck.match_step(ordered, customers, "o_custkey", "c_custkey")
    same_nation = F.col("c_nationkey") == F.col("s_nationkey")
    return ck.match_step(owned, suppliers, "l_suppkey", "s_suppkey", same_nation).select(
        "c_custkey", "o_orderkey", "l_linenumber", "s_suppkey"
    )


GRAPH_MATCH_SQL = """select c_custkey, o_orderkey, l_linenumber, s_suppkey from lineitem
join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey"""

def _email_requests(spark: SparkSession, folder: str) -> DataFrame:
    """For each partly filled order its customer asks for the email of the customer of a nearby number, in order of the orders."""
    users = v.users(spark, folder)
    orders = v.table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    asked = orders.selectExpr("o_orderkey turn", "o_custkey id", "o_custkey + o_orderkey % 5 - 2 other")
    emails = users.select(F.col("id").alias("other"), "email")
    return asked.join(emails, "other").select("turn", "id", "email")


def email_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that free and claim emails within one batch, decided in their order."""
    decided = rq.decide_claims(v.users(spark, folder), _email_requests(spark, folder))
    return decided.select("turn", "accepted")


_ROUNDS = 40
_EMAIL_REQUESTS_CTE = f""",
req as materialized (select o_orderkey turn, o_custkey id, email from orders join fx_users u on u.id = o_custkey + o_orderkey % 5 - 2 where o_orderstatus = 'P'),
r(k, turn, id, email, ok) as (
 select 0, turn, id, email, true from req
 union all
 select any_value(a.k) + 1, a.turn, any_value(a.id), any_value(a.email),
  coalesce(arg_max(e.usr, e.turn) filter (e.turn is not null), -1) in (-1, any_value(a.id))
 from r a left join (
  select email, turn, id usr from (select turn, id, email from r where ok union all select -1, id, email from fx_users)
  union all
  select old, turn, -1 from (select turn, email, lag(email) over (partition by id order by turn) old
   from (select turn, id, email from r where ok union all select -1, id, email from fx_users)) where old <> email
 ) e on e.email = a.email and e.turn < a.turn
 where a.k < {_ROUNDS} group by a.turn)"""
EMAIL_REQUESTS_SQL = with_views("fx_users", "", recursive=True).rstrip() + _EMAIL_REQUESTS_CTE + f"""
select turn, ok accepted from r where k = {_ROUNDS}"""


def ordered_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Users after a batch of requests, several per user, some of them by superusers."""
    patches = _email_requests(spark, folder).selectExpr(
        "turn", "id", "case when turn % 4 > 0 then email end email", "case when turn % 3 = 0 then concat('Name ', turn) end full_name",
        "turn % 2 = 0 is_active", "turn % 7 = 0 actor_is_superuser", "case when turn % 11 = 0 then -1 else id end actor_id",
    )
    return rq.apply_requests(v.users(spark, folder), patches)


QUERIES = {
    "task_state": task_state,
    "task_state_sparse": task_state_sparse,
    "token_status": token_status,
    "token_lookup": token_lookup,
    "user_defaults": user_defaults,
    "user_patch": user_patch,
    "email_conflicts": email_conflicts,
    "email_requests": email_requests,
    "ordered_patches": ordered_patches,
    "user_insert": user_insert,
    "token_upsert": token_upsert,
    "token_delete": token_delete,
    "category_sums": category_sums,
    "graph_match": graph_match,
}
ORACLES = {
    "task_state": TASK_STATE_SQL,
    "task_state_sparse": TASK_STATE_SPARSE_SQL,
    "token_status": TOKEN_STATUS_SQL,
    "token_lookup": TOKEN_LOOKUP_SQL,
    "user_defaults": USER_DEFAULTS_SQL,
    "user_patch": USER_PATCH_SQL,
    "email_conflicts": EMAIL_CONFLICTS_SQL,
    "email_requests": EMAIL_REQUESTS_SQL,
    "user_insert": USER_INSERT_SQL,
    "token_upsert": TOKEN_UPSERT_SQL,
    "token_delete": TOKEN_DELETE_SQL,
    "category_sums": CATEGORY_SUMS_SQL,
    "graph_match": GRAPH_MATCH_SQL,
}
