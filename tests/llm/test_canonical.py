from talkloom.llm import canonical
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from talkloom.llm.arrowtext import code_points, strings
from talkloom.llm.canonical import canonical_array, canonicalise, standins

CASES = [
    ("ｈello​world", "helloworld"),
    ("café naïve", "café naïve"),
    ("ᄐ‌ᅡᄇ‍ᅵ헤 ᄒ﻿ᅩᆯ딩", "타비헤 홀딩"),
    ("ѕеe wаӏӏеt", "see wallet"),
    ("oﬃce rolled‑back", "office rolled-back"),
    ("a b　c d", "a b c d"),
    ("привeт", "привет"),
    ("Ǘ Ǘ", "Ǘ Ǘ"),
    ("각 각 각", "각 각 각"),
]
SAME = ["👩‍💻 ❤️ 1️⃣", "привет", "ㅋㅋㅋ ㅠ", "é ï", "a – b 2–3", "line\nbreak", "", "नमस्ते क्‍ष", "ɸ"]


@pytest.mark.parametrize(("a", "b"), CASES)
def test_standins(a, b):
    form, touched = canonical_array(pa.array([a]))
    assert form.to_pylist() == [b] and touched.all()
    again, touched = canonical_array(form)
    assert again.to_pylist() == [b] and not touched.any()


def test_untouched():
    form, touched = canonical_array(pa.array([*SAME, None]))
    assert form.to_pylist() == [*SAME, None] and not touched.any()


TEXTS = st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=30), st.text("가각각é́e​ｈаеo ﬁ-‐", max_size=30)), max_size=8)


@given(TEXTS)
def test_any_text_settles_and_rows_do_not_mix(texts):
    whole, touched = canonical_array(pa.array(texts, pa.string()))
    assert [canonical_array(pa.array([t], pa.string()))[0][0].as_py() for t in texts] == whole.to_pylist()
    assert all(t == f for t, f, x in zip(texts, whole.to_pylist(), touched, strict=True) if not x)


@given(TEXTS)
def test_round_trip(texts):
    a = pa.array(texts, pa.string())
    p, o = code_points(a)
    assert strings(p, o, a.is_null().to_numpy(zero_copy_only=False)).to_pylist() == texts
    assert code_points(a.slice(1))[0].tolist() == [ord(c) for t in texts[1:] for c in t or ""]


@given(st.text("가나다힣각", max_size=20))
def test_hangul_like_the_composed_form(t):
    assert canonical_array(pa.array([unicodedata.normalize("NFD", unicodedata.normalize("NFC", t))]))[0][0].as_py() == unicodedata.normalize("NFC", t)


def test_frames(rows):
    s = "id long, t string, canonical string"
    got = canonicalise(rows(s, [(1, "ａ", "old"), (2, None, None), (3, "x" * 50_000 + "​y", "")]), "t").collect()
    assert [(r.id, r.had_standin, r.canonical and r.canonical[-2:]) for r in got] == [(1, True, "a"), (2, False, None), (3, True, "xy")]
    assert canonicalise(rows(s), "t").collect() == []
    assert [tuple(r) for r in standins(rows("id long, t string", [(1, "ａ"), (2, "b"), (3, None)]), "t").collect()] == [(1,)]


def test_letters_of_rare_scripts():
    import pyarrow as pa

    out, found = canonical.canonical_array(pa.array(["Ꭺpple ꓐank", "ᏣᎳᎩ", "ꓡꓲꓢꓴ"]))
    assert out.to_pylist() == ["Apple Bank", "ᏣᎳᎩ", "ꓡꓲꓢꓴ"] and found.tolist() == [True, False, False]
