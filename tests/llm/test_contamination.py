from talkloom.llm import contamination
import random

from hypothesis import given
from hypothesis import strategies as st

from talkloom.llm.contamination import Scanner, contaminated, reduce_text, reduce_with_offsets


def longest(a, b):
    best = 0
    for i in range(len(a)):
        while i + best + 1 <= len(a) and a[i : i + best + 1] in b:
            best += 1
    return best


@given(st.lists(st.text("ab1 .", max_size=40), max_size=4), st.text("ab1 .", max_size=120))
def test_like_brute_force(items, text):
    least = 6
    got = {k: n for k, n, *_ in Scanner(list(enumerate(items)), least).runs(text)}
    want = {k: longest(reduce_text(t), reduce_text(text)) for k, t in enumerate(items)}
    assert got == {k: n for k, n in want.items() if n >= least}


def test_offsets_map_to_the_stored_text():
    item = "What, in the World, is a 가나다 letter-count?"
    text = "…İ intro 'WHAT in the... world is a 가나다 letter count' end ſ"
    [(k, n, size, a, b)] = Scanner([(5, item)], 20).runs(text)
    assert k == 5 and n == size == len(reduce_text(item)) and text[a:b] == "WHAT in the... world is a 가나다 letter count"
    assert reduce_with_offsets("aB-c")[1] == [0, 1, 3]


def test_frames(rows):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(20)]
    items += [items[0], (30, None), (31, ""), (None, items[1][1])]
    docs = [(i, " ".join(word() for _ in range(30)) + (items[i][1].upper() if i < 10 else "") + "!" + word()) for i in range(40)] + [(50, None), (51, ""), (None, items[0][1])]
    d, t = rows("doc_id long, text string", docs), rows("item_id long, text string", items)
    got = {(r.doc_id, r.item_id) for r in contaminated(d, t, 50).collect()}
    assert got == {(i, i) for i in range(10)}
    assert {(r.doc_id, r.item_id) for r in contaminated(d, t, 50, max_item_chars=300).collect()} == got
    assert contaminated(d, t.limit(0), 50).collect() == [] and contaminated(d.limit(0), t, 50).collect() == []


def test_long_text_with_a_final_sigma_is_linear():
    import time

    item = "".join(chr(97 + i * i % 26) for i in range(80))
    text = "İΟΔΟΣ " + "lorem ipsum " * 90_000 + item.upper() + " ΛΟΓΟΣ end"
    began = time.time()
    (found,) = contamination.Scanner([(5, item)], 50).runs(text)
    assert time.time() - began < 5
    assert found[0] == 5 and text[found[3] : found[4]].lower().endswith(item[-20:]) and text.index(item.upper()) == found[3]
