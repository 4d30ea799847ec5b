"""Deciding points of one group: against the rule said plainly, and in bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd

from faintdip.operators.sky import GONE, KEPT, OPEN, decide


def plain(rows):
    mine = {}
    for a in sorted({r[0] for r in rows}):
        near = [mine.get(b, OPEN) if s == OPEN else s for x, b, s in rows if x == a]
        mine[a] = GONE if KEPT in near else OPEN if OPEN in near else KEPT
    return sorted((a, s) for a, s in mine.items() if s != OPEN)


def test_points_are_decided_as_the_rule_says():
    rng = np.random.default_rng(3)
    for n in [0, 1, 5, 40] * 10:
        rows = [(int(a), int(rng.integers(0, a)), int(rng.choice([OPEN, OPEN, OPEN, KEPT, GONE]))) for a in rng.integers(1, 30, n)]
        got = decide(pd.DataFrame(rows, columns=["a", "b", "state"], dtype="int64"))
        assert sorted(zip(got.a, got.state)) == plain(rows) and list(got.dtypes) == ["int64", "int64"]


def test_a_group_takes_no_more_than_a_few_times_its_bytes():
    a = np.repeat(np.arange(1000, 3000), 50)
    pairs = pd.DataFrame({"a": a + (1 << 40), "b": a - np.tile(np.arange(1, 51), 2000) + (1 << 40), "state": np.full(len(a), OPEN)})
    decide(pairs)
    tracemalloc.start()
    decide(pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.2 * 8 * 3 * len(a)
