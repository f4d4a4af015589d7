"""The numpy fold kernel against the one-at-a-time rule (no Spark needed)."""

from __future__ import annotations

import time

import numpy as np
from hypothesis import given, settings, strategies as st

from spendlens.functions.fold import fold_costs, fold_costs_loop


@settings(max_examples=300, deadline=None)
@given(costs=st.lists(st.integers(min_value=0, max_value=1000), max_size=600),
       room=st.integers(min_value=-50, max_value=20000))
def test_fold_matches_loop(costs, room):
    a_ok, a_room = fold_costs(np.array(costs, dtype=np.int64), room)
    b_ok, b_room = fold_costs_loop(costs, room)
    assert a_room == b_room and (a_ok == b_ok).all()


def test_fold_adversarial_and_large():
    rng = np.random.default_rng(3)
    big = rng.integers(0, 90000, 300_000)
    room = int(big.sum() // 2)
    assert all(x == y for x, y in zip(fold_costs(big, room)[1:], fold_costs_loop(big.tolist(), room)[1:]))
    # one cent before every near-budget request: a break at every other request
    adv = np.empty(20_000, dtype=np.int64)
    adv[0::2] = 1
    adv[1::2] = 10_000_000 - np.arange(10_000)
    ok1, r1 = fold_costs(adv, 10_000_000)
    ok2, r2 = fold_costs_loop(adv.tolist(), 10_000_000)
    assert r1 == r2 and (ok1 == ok2).all()
    t0 = time.perf_counter()
    fold_costs(big, room)
    assert time.perf_counter() - t0 < 5
