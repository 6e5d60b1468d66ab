import collections
import random

import numpy as np
import pytest

from talkloom.llm import spans

S = "id long, text string"
N = 24


def make(seed):
    rng = random.Random(seed)
    chars = "abcdefgh 가나다😀"
    text = lambda n: "".join(rng.choice(chars) for _ in range(n))
    shared = [text(rng.randrange(15, 60)) for _ in range(10)]
    docs = []
    for i in range(80):
        parts = [text(rng.randrange(0, 60)) for _ in range(2)] + [rng.choice(shared) for _ in range(rng.randrange(0, 3))]
        rng.shuffle(parts)
        docs.append((i, "".join(parts)))
    return docs + [(80, None), (81, ""), (82, "x" * N), (83, "x" * (N + 3)), (84, "y" * 100), (None, shared[0] * 2), (85, docs[0][1]), (86, docs[0][1])]


def brute(docs):
    windows = collections.defaultdict(set)
    for k, t in docs:
        for i in range(len(t or "") - N + 1):
            if k is not None:
                windows[t[i : i + N]].add(k)
    pairs = {(a, b) for g in windows.values() for a in g for b in g if a < b}
    share = {}
    for k, t in docs:
        if k is not None:
            hit = bytearray(len(t or ""))
            for i in range(len(hit) - N + 1):
                if len(windows[t[i : i + N]]) > 1:
                    hit[i : i + N] = b"\1" * N
            share[k] = (len(hit), sum(hit))
    return pairs, share


@pytest.mark.parametrize("most_bits", [26, 4])
def test_like_brute_force_even_if_the_sketch_is_full(rows, monkeypatch, most_bits):
    monkeypatch.setattr(spans, "MOST_BITS", most_bits)
    if most_bits < 16:
        monkeypatch.setattr(spans, "LEAST_BITS", most_bits)
    docs = make(most_bits)
    pairs, share = brute(docs)
    df = rows(S, docs).repartition(3)
    windows = spans.windows_of(df, "id", "text", N)
    got = [tuple(r) for r in spans.shared_pairs(windows).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r.key: (r.n_chars, r.shared_chars) for r in spans.shared_share(windows, df, "id", "text", N).collect()} == share


def test_nothing(rows):
    windows = spans.windows_of(rows(S), "id", "text", N)
    assert spans.shared_pairs(windows).collect() == []


def test_merged_sketches_never_miss_a_repeat():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(2))
    b[:50] = a[:50]
    a[100:120] = a[120:140]
    pieces = []
    for part in (a, b):
        s = spans.Sketch(8)
        s.add(part[:150])
        s.add(part[150:])
        pieces += list(s.pieces())
    merged = spans.Sketch.from_pieces(8, pieces)
    assert merged.repeated(a[:50]).all() and merged.repeated(a[100:120]).all()
    wide = spans.Sketch(20)
    wide.add(a)
    assert wide.repeated(a).sum() <= 45
