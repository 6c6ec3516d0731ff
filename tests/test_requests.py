import random

import pytest

from quillgrid.operators import requests as rq

USERS = "id bigint, email string, full_name string, is_active boolean, is_superuser boolean"
PATCHES = "turn bigint, id bigint, email string, full_name string, is_active boolean, actor_id bigint, actor_is_superuser boolean"


def in_order(users, patches):
    """One request after the other."""
    state = {u[0]: list(u) for u in users}
    owner = {u[1]: u[0] for u in users if u[1] is not None}
    accepted = {}
    for turn, i, email, name, active, actor, superuser in sorted(patches):
        if i not in state or not (superuser or actor == i):
            continue
        ok = email is None or owner.get(email, i) == i
        accepted[turn] = ok
        if not ok:
            continue
        if email is not None:
            owner.pop(state[i][1], None)
            owner[email] = i
            state[i][1] = email
        if name is not None:
            state[i][2] = name
        if active is not None and superuser:
            state[i][3] = active
    return accepted, {tuple(u) for u in state.values()}


def frames(spark, users, patches):
    return spark.createDataFrame(users, USERS), spark.createDataFrame(patches, PATCHES)


def test_an_email_is_freed_and_claimed_in_one_batch(spark):
    users = [(1, "a", "A", True, False), (2, "b", "B", True, False), (3, "c", "C", True, False), (4, None, None, True, False)]
    # 1 moves on and frees a, 2 takes a and frees b, 3 takes b; 4 comes too early for c and gets it later.
    patches = [(0, 4, "c", None, None, 4, False), (1, 1, "z", None, None, 1, False), (2, 2, "a", None, None, 2, False),
               (3, 3, "b", None, None, 3, False), (4, 4, "c", "D", None, 4, False), (5, 1, "a", None, None, 1, False)]
    u, p = frames(spark, users, patches)
    got = {r.turn: r.accepted for r in rq.decide_claims(u, p).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True, 5: False}
    assert {r.id: r.email for r in rq.apply_requests(u, p).collect()} == {1: "z", 2: "a", 3: "b", 4: "c"}


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    users = [(i, f"e{i}" if rng.random() < 0.8 else None, f"n{i}", True, False) for i in range(12)]
    patches = []
    for turn in range(45):
        i = rng.randrange(14)  # two users don't exist
        email = rng.choice([None, *(f"e{k}" for k in range(14))])
        actor = i if rng.random() < 0.8 else 99
        patches.append((turn, i, email, rng.choice([None, f"m{turn}"]), rng.choice([None, True, False]), actor, rng.random() < 0.3))
    accepted, state = in_order(users, patches)
    u, p = frames(spark, users, patches)
    allowed = p.filter("id < 12 and (actor_is_superuser or actor_id = id)")
    assert {r.turn: r.accepted for r in rq.decide_claims(u, allowed).collect()} == accepted
    got = rq.apply_requests(u, p)
    assert got.count() == 12 and {tuple(r) for r in got.collect()} == state


def test_no_requests(spark):
    u, p = frames(spark, [(1, "a", None, True, None)], [])
    assert rq.decide_claims(u, p).count() == 0 and [tuple(r) for r in rq.apply_requests(u, p).collect()] == [(1, "a", None, True, None)]
