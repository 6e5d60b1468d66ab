import datetime as dt
import random

from talkloom.operators.rolling import State, filled, rolling_state
from talkloom.session import scratch_dir
from talkloom.streaming.rollup import advance_daily

D0 = dt.date(2025, 1, 1)
SCHEMA = "entity long, day date, amount long"


def brute(daily):
    out = {}
    for e in {e for e, _ in daily}:
        days = [d for x, d in daily if x == e]
        for k in range((max(days) - min(days)).days + 1):
            d = min(days) + dt.timedelta(k)
            total = lambda w, d=d, e=e: sum(daily.get((e, d - dt.timedelta(j)), 0) for j in range(w))
            out[e, d] = (daily.get((e, d), 0), total(7), total(30))
    return out


def table(df):
    rows = df.collect()
    out = {(r.entity, r.day): (r.amount, r.total_7, r.total_30) for r in rows}
    assert len(out) == len(rows)
    return out


def random_daily(seed, n=150, days=120):
    rng = random.Random(seed)
    return {(rng.randrange(6), D0 + dt.timedelta(rng.randrange(days))): rng.randrange(1, 5) for _ in range(n)}


def as_rows(rows, x):
    return rows(SCHEMA, [(e, d, n) for (e, d), n in x.items()])


def test_runs_of_any_length_match_brute_force(rows, spark):
    daily = random_daily(1) | {(77, D0): 3, (77, D0 + dt.timedelta(95)): 2}
    mixed = rows("entity long, day date, on_time long, late long", [(*k, n, 0) for k, n in daily.items()])
    for run in (25, 200):
        assert table(rolling_state(spark, mixed, scratch_dir(spark, "state"), run=run)) == brute(daily)
    assert rolling_state(spark, mixed.limit(0), scratch_dir(spark, "state")).collect() == []


def test_a_day_opens_three_days_and_replaces_one(rows, spark, monkeypatch):
    daily = random_daily(2, 60, 45)
    state = State(spark, scratch_dir(spark, "state"))
    state.advance(as_rows(rows, daily), D0, D0 + dt.timedelta(41))
    opened = []
    read = state.read
    monkeypatch.setattr(state, "read", lambda days=None, version=None: opened.extend(days or []) or read(days, version))
    before = state.table.parts()
    events = rows("e long, day date", [(e, d) for (e, d), n in daily.items() for _ in range(n)] + [(None, D0 + dt.timedelta(42))])
    for k in range(42, 45):
        opened.clear()
        d = D0 + dt.timedelta(k)
        advance_daily(state, events, "e", d)
        assert sorted(set(opened)) == [d - dt.timedelta(x) for x in (30, 7, 1)]
    assert {k: v for k, v in state.table.parts().items() if k in before} == before
    monkeypatch.undo()
    want = {k: v for k, v in brute(daily).items()}
    assert table(filled(state.read())) == want


def test_corrections_touch_only_their_dates(rows, spark):
    rng = random.Random(3)
    daily = random_daily(3)
    late = {(rng.randrange(8), D0 + dt.timedelta(rng.randrange(60, 70))): rng.randrange(1, 4) for _ in range(12)}
    both = dict(daily)
    for k, n in late.items():
        both[k] = both.get(k, 0) + n
    state = State(spark, scratch_dir(spark, "state"))
    end = D0 + dt.timedelta(119)
    state.advance(as_rows(rows, daily), D0, end)
    old = state.table.parts()
    state.correct(as_rows(rows, late), end)
    now = state.table.parts()
    touched = {(d + dt.timedelta(k)).isoformat() for _, d in late for k in range(30)}
    assert {d for d in now if now[d] != old.get(d)} == touched
    assert table(filled(state.read())) == brute(both)
    assert table(filled(state.read(version=1))) == brute(daily)
    mixed = rows("entity long, day date, on_time long, late long", [(*k, daily.get(k, 0), late.get(k, 0)) for k in both] + [(None, D0, 1, 1), (1, None, 1, 1)])
    assert table(rolling_state(spark, mixed, scratch_dir(spark, "state"))) == brute(both)


def test_an_entity_that_returns(rows, spark):
    daily = {(1, D0): 3, (1, D0 + dt.timedelta(27)): 5, (1, D0 + dt.timedelta(30)): 4, (2, D0 + dt.timedelta(29)): 2, (1, D0 + dt.timedelta(80)): 1}
    state = State(spark, scratch_dir(spark, "state"))
    for a, b in ((0, 29), (30, 30), (31, 79), (80, 80)):
        state.advance(as_rows(rows, daily), D0 + dt.timedelta(a), D0 + dt.timedelta(b))
    assert table(filled(state.read())) == brute(daily)
    assert max(d for d in state.days()) == D0 + dt.timedelta(80)
    assert D0 + dt.timedelta(70) not in state.days()  # nothing known of any entity by then
