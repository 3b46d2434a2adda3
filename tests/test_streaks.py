"""Streaks, first trips and batches of runs that span slices and chapters, against a plain walk."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from verdigris.operators import collector
from verdigris.streaming import collector as streams

KINDS = ["hit", "miss", "blocked", "error", "already_present"]


def walk(outcomes, stop, size):
    """(block streak, error streak, batch, tripped) after each attempt."""
    b = e = real = 0
    out = []
    for o in outcomes:
        if o == "blocked":
            b, e = b + 1, 0
        elif o == "error":
            e += 1
        elif o in ("hit", "miss"):
            b = e = 0
        real += o != "already_present"
        out.append((b, e, max(1, (real - 1) // size + 1), o == "blocked" and b >= stop or o == "error" and e >= stop))
    return out


@pytest.fixture(scope="module")
def attempts(spark):
    rng, rows = random.Random(1), []
    for run in (1, 2, 3, None):
        at, weights = datetime(2024, 1, 1), [1, 1, 6, 6, 3] if run != 3 else [5, 5, 1, 1, 1]
        for seq in range(900):
            at += timedelta(seconds=rng.choice([0, 1, 40, 4000 if run == 2 else 7]))
            rows.append((run, at, seq, rng.choices(KINDS, weights)[0]))
    rows += [(4, datetime(2024, 1, 1), 0, "blocked")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "run int, ts timestamp, seq int, outcome string").repartition(3)


@pytest.mark.parametrize("seconds, chapter", [(60, 4), (3600, 1024), (10**9, 2)])
def test_slices_equal_a_plain_walk(attempts, monkeypatch, seconds, chapter):
    monkeypatch.setattr(collector, "CHAPTER", chapter)
    rows, df = attempts
    runs = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        runs.setdefault(r[0], []).append(r)
    want = {(run, r[2]): w for run, own in runs.items() for r, w in zip(own, walk([x[3] for x in own], 4, 7))}
    found = collector.streaks(df, ["run"], "ts", "seq", seconds=seconds, keep_slice=True)
    assert {(r.run, r.seq): (r.block_streak, r.error_streak) for r in found.collect()} == {k: w[:2] for k, w in want.items()}
    batched = collector.batches(df, ["run"], "ts", "seq", size=7, seconds=seconds)
    assert {(r.run, r.seq): r.batch for r in batched.collect()} == {k: w[2] for k, w in want.items()}
    kept = {(r.run, r.seq): r.stop_reason for r in collector.until_first_trip(found, ["run"], "ts", "seq", stop=4, seconds=seconds).collect()}
    for run, own in runs.items():
        first = next((i for i, r in enumerate(own) if want[run, r[2]][3]), len(own) - 1)
        assert {s for r, s in kept if r == run} == {r[2] for r in own[: first + 1]}
        assert (kept[run, own[first][2]] is not None) == want[run, own[first][2]][3]


def test_one_long_run_is_dealt_by_slice(attempts):
    """No exchange of attempts is by the run alone."""
    plan = collector.streaks(attempts[1], ["run"], "ts", "seq")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "seq#" in line]
    assert windows and all("_slice" in line for line in windows)


def test_a_trigger_folds_like_a_walk():
    rng = random.Random(2)
    for _ in range(300):
        outcomes, blocks, errors = rng.choices(KINDS, [1, 1, 5, 5, 2], k=rng.randint(1, 12)), rng.randint(0, 3), rng.randint(0, 3)
        before = ["blocked"] * blocks + ["error"] * errors
        states = walk(before + outcomes, 4, 7)[len(before) :]
        last = next((i for i, s in enumerate(states) if s[3]), len(states) - 1)
        taken, b, e, reason = streams.folded(np.array(outcomes, object), blocks, errors, 4)
        assert (taken, b, e, bool(reason)) == (last + 1, states[last][0], states[last][1], states[last][3])
