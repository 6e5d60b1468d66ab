import random

import numpy as np
import pytest

from talkloom.llm import neardup
from talkloom.llm.arrowtext import Rolling

S = "chat_id long, norm long, text string"
LETTERS = "abcdefghijklmnopqrstuvwxyz가나다라마바사아자차"


def make(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(150, 300)))
        for j in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 6, 12, 20])):
                at = rng.randrange(len(t))
                rng.choice([lambda a=at: t.insert(a, rng.choice(LETTERS)), lambda a=at: t.pop(a), lambda a=at: t.__setitem__(a, " ")])()
            out.append((i, j, "".join(t)))
    return out


def brute(data, width=5, least=0.6, shortest=130):
    texts = {}
    for c, m, t in data:
        if c is not None and m is not None and t is not None:
            x = "".join(t.split()).lower()
            if len(x) >= shortest:
                texts[c, m] = {x[i : i + width] for i in range(len(x) - width + 1)}
    keys = sorted(texts)
    return {(*a, *b): len(texts[a] & texts[b]) / len(texts[a] | texts[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(texts[a] & texts[b]) >= least * len(texts[a] | texts[b])}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_classes_like_brute_force(rows, seed):
    data = make(seed) + [(500, 1, "short"), (500, 2, None), (None, 1, "x" * 200), (500, 3, "")]
    data += data[:5]
    want = brute(data)
    near = neardup.NearCopies(rows(S, data), ["chat_id", "norm"], "text")
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= set(want)
    assert all(p in set(got) for p, j in want.items() if j >= 0.7)
    assert len(got) >= 0.95 * len(want)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, c, d in got:
        parent[root((a, b))] = root((c, d))
    classes = {(r.chat_id, r.norm): r.class_id for r in near.classes().collect()}
    assert classes.keys() == parent.keys()
    assert len(set(classes.values())) == len({root(x) for x in parent})


def test_recall_of_the_index_by_similarity():
    """Share of pairs that meet in a table entry, measured on random sets of known similarity."""
    rng = np.random.default_rng(1)
    for j, least in ((0.6, 0.93), (0.7, 0.985), (0.8, 0.999)):
        met = 0
        for _ in range(300):
            common, own = int(400 * j), int(400 * (1 - j) / 2)
            h = rng.integers(0, 2**64, common + 2 * own, dtype=np.uint64)
            m = neardup._multipliers()
            found = np.stack([(h[np.r_[0:common, a : a + own]][:, None] * m).min(0) for a in (common, common + own)])
            keys = neardup.table_keys(found)
            met += bool((keys[0] == keys[1]).any()) and int(np.bitwise_count(neardup.sketch(found)[:1] ^ neardup.sketch(found)[1:])[0]) <= neardup.MOST_BITS
        assert met / 300 >= least


def test_recall_just_over_the_threshold(rows):
    """Pairs of texts of similarity 0.60 to 0.65 against brute force."""
    rng = random.Random(7)
    data = []
    for i in range(400):
        base, other = ("".join(rng.choice(LETTERS) for _ in range(200)) for _ in "ab")
        at = 151 + i % 6
        data += [(i, 0, base), (i, 1, base[:at] + other[at:])]
    want = {(c, 0, c, 1) for c in range(400) if (pair := brute(data[2 * c : 2 * c + 2])) and 0.6 <= pair[c, 0, c, 1] <= 0.65}
    got = {tuple(r) for r in neardup.NearCopies(rows(S, data), ["chat_id", "norm"], "text").pairs().collect()}
    assert len(want) > 300 and want <= got


def test_hot_copies_and_nothing(rows):
    rng = random.Random(3)
    text = "".join(rng.choice(LETTERS) for _ in range(200))
    near = neardup.NearCopies(rows(S, [(1, i, text) for i in range(300)] + [(2, 0, text[:-1] + "!")]), ["chat_id", "norm"], "text")
    got = near.classes().collect()
    assert len(got) == 301 and len({r.class_id for r in got}) == 1 and {r.n_copies for r in got} == {300, 1} and {r.n_links for r in got} == {1}
    assert near.texts.count() == 2
    none = neardup.NearCopies(rows(S), ["chat_id", "norm"], "text")
    assert none.pairs().collect() == [] and none.classes().collect() == []


def test_symbols_of_short_texts():
    out = neardup.symbols(np.array([97, 98], np.uint32), np.array([0, 0, 2]), 5, Rolling(5), neardup._multipliers())
    assert out.shape == (2, 72) and (out[0] == 0).all() and not (out[1] == 0).all()
