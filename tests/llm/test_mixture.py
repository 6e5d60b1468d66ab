import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from talkloom.llm.mixture import Mixture, budgets

LEAF = st.tuples(st.sampled_from("ab"), st.sampled_from("xy"), st.sampled_from("pqr"), st.floats(0, 1, allow_subnormal=False), st.floats(0, 100, allow_subnormal=False))


@given(st.lists(LEAF, min_size=1, max_size=8, unique_by=lambda x: x[:3]), st.floats(0, 300, allow_subnormal=False))
def test_budgets(leaves, total):
    tree = [{"path": x[:3], "weight": x[3], "capacity": x[4]} for x in leaves]
    out = budgets(tree, total)
    assert all(-1e-6 <= out[x[:3]] <= x[4] + 1e-6 for x in leaves)
    assert math.isclose(sum(out.values()), min(total, sum(x[4] for x in leaves)), abs_tol=1e-5)


def test_shortages_go_to_siblings_first():
    leaf = lambda p, w, c: {"path": tuple(p), "weight": w, "capacity": c}
    out = budgets([leaf("ax1", 0.25, 5), leaf("ax2", 0.25, 100), leaf("ay1", 0.25, 100), leaf("by1", 0.25, 100)], 100)
    assert out == {tuple("ax1"): 5, tuple("ax2"): 45, tuple("ay1"): 25, tuple("by1"): 25}
    out = budgets([leaf("ax1", 0.25, 5), leaf("ax2", 0.25, 25), leaf("ay1", 0.25, 100), leaf("by1", 0.25, 100)], 100)
    assert out == {tuple("ax1"): 5, tuple("ax2"): 25, tuple("ay1"): 45, tuple("by1"): 25}


DOCS = "doc_id long, text string, lang string, source string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    sources = ["big"] * 60 + ["small"] * 6 + ["tiny"] + ["other"] * 20 + [None] * 5
    return [(i, " ".join(rng.choice(["alpha", "beta", "감마", "1234"]) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "EN", "ko", None]), rng.choice(sources)) for i in range(1500)]


def test_shares_repeats_and_prefix(rows, docs):
    extra = [(9000, None, "en", "big"), (9001, "", None, "big"), (None, "x", "en", "big")]
    targets = [("big", 0.4, 1), ("small", 0.3, 8), ("tiny", 0.3, 2), ("absent", 0.1, 3), (None, 0.5, 1)]
    mix = Mixture(rows(DOCS, docs + extra), rows(TARGETS, targets), {"big": "d", "small": "d"})
    drawn = mix.drawn().collect()
    assert len(drawn) == len({r.doc_id for r in drawn})
    limit = {"big": 1, "small": 8, "tiny": 2}
    assert all(1 <= r.uses <= limit[r.source] for r in drawn)
    share = {r.source: r for r in mix.shares().collect()}
    assert share.keys() == {"big", "small", "tiny", "absent"} and share["absent"].tokens_drawn == 0
    assert share["tiny"].tokens_drawn == 2 * share["tiny"].tokens_available  # short of tokens: all of it
    total = sum(r.tokens_drawn for r in share.values())
    # What tiny and absent lack goes to the others in the ratio of their weights, but for the last documents.
    assert abs(total - mix.total) / mix.total < 0.03
    assert abs(share["big"].tokens_drawn / share["small"].tokens_drawn - 4 / 3) < 0.1
    assert all(abs(r.actual_share - r.tokens_drawn / total) < 1e-6 for r in share.values())
    again = Mixture(rows(DOCS, docs + extra).repartition(7), rows(TARGETS, targets), {"big": "d", "small": "d"}).drawn().collect()
    assert sorted(again) == sorted(drawn)
    other = Mixture(rows(DOCS, docs + extra), rows(TARGETS, targets), {"big": "d", "small": "d"}, seed=2).drawn().collect()
    assert sorted(other) != sorted(drawn)


def test_nothing(rows):
    mix = Mixture(rows(DOCS), rows(TARGETS, [("a", 1.0, 1)]))
    assert mix.drawn().collect() == [] and [r.tokens_drawn for r in mix.shares().collect()] == [0]
