import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from talkloom.llm import pii

FOUND = [
    ("mail foo.bar+x@mail.example.org now", "mail [EMAIL] now"),
    ("foo [at] post dot test or joram (at) deep (dot) sub (dot) example", "[EMAIL] or [EMAIL]"),
    ("메일은 ulric94 골뱅이 mailbox.example 로", "메일은 [EMAIL] 로"),
    ("a9 @ mail.example.org", "[EMAIL]"),
    ("FOO@ＭAIL.EXAMPLE", "[EMAIL]"),
    ("tel 010-0281-0072.", "tel [PHONE]."),
    ("０１０－０２８１－００７２ 로", "[PHONE] 로"),
    ("연락처 +82 10-0717-6737", "연락처 [PHONE]"),
    ("+44 7700 900162 (532) 555-0170 +1-345-555-0134", "[PHONE] [PHONE] [PHONE]"),
    ("공일공 이삼사오 육칠팔구 로", "[PHONE] 로"),
    ("call O1O-2345-67l9", "call [PHONE]"),
    ("zero one zero two three four five six seven eight nine!", "[PHONE]!"),
    ("번호는 670727 - 4104832 입니다", "번호는 [ID_NUMBER] 입니다"),
    ("7712044092083 965-14-2126", "[ID_NUMBER] [ID_NUMBER]"),
    ("at 536 Pellow Lane, Unit 5, Sandmere around", "at [ADDRESS] around"),
    ("to 가람시 해솔구 돌담길 80길 298 9층 last", "to [ADDRESS] last"),
    ("Regards,\n이새람", "Regards,\n[NAME]"),
    ("I spoke with Ms. Cosima Halvick about", "I spoke with Ms. [NAME] about"),
    ("윤​벼람 씨가", "[NAME] 씨가"),
    ("please ask for Yorin R. Windlecomb at the desk", "please ask for [NAME] at the desk"),
    ("My name is José García", "My name is [NAME]"),
    ("my name is élodie Dupont", "my name is [NAME]"),
    ("제 이름은 남궁민수입니다", "제 이름은 [NAME]입니다"),
    ("this is Maria Lopez, the tenant", "this is [NAME], the tenant"),
    ("Hello, David Miller here.", "Hello, [NAME] here."),
    ("010-일이삼사-5678", "[PHONE]"),
    ("010-one two three four-5678", "[PHONE]"),
    ("mail john at example.com", "mail [EMAIL]"),
    ("여권 M12345678", "여권 [ID_NUMBER]"),
    ("j o h n @ example.com", "[EMAIL]"),
    ("010-1234-5678로 연락", "[PHONE]로 연락"),
    ("번호는670727-4104832입니다", "번호는[ID_NUMBER]입니다"),
    ("kim앳mail.test kim@mail[점]test kim <at> mail.test", "[EMAIL] [EMAIL] [EMAIL]"),
    ("passport no. M123A4567!", "passport no. [ID_NUMBER]!"),
]
NONE = [
    "look at example.com", "this is Great News, so", "7712044092083원", "코드 M12345678", "at 3 the one or two more",
    "@kept_official 팔로우", "order no. 96-3362-37 shipped", "INV-2025-2956-79", "tx 0xc0596725101090b3705a49f8", "시총 825,101,976,000원", "score 5-4, gas 10@121",
    "2025-04-21 ~ 2025-09-15", "ref#2674719442A", "build 8.0.7 (rev 965884)", "Sinupe Gonamudi Exchange desk replied at 12:43", "block 52018687 / epoch 982", "look at example.com", "투자자들은 인용문 쪽을 먼저 줄였고, 9683 차이였다.", "",
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_found(text, want):
    assert pii.redact(text) == want
    assert pii._worth_a_look(pa.array([text, None, "", "x " + text])).tolist() == [True, False, False, True]


@pytest.mark.parametrize("text", NONE)
def test_not_found(text):
    assert pii.find(text) == []


@given(st.lists(st.one_of(st.sampled_from([t for t, _ in FOUND]), st.text(st.characters(codec="utf-8"), max_size=20)), max_size=5))
def test_spans_are_of_the_source_and_keep_the_rest(parts):
    text = "\n".join(parts)
    found = pii.find(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in found)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))
    kept, last = [], 0
    for a, b, kind in found:
        kept += [text[last:a], pii.PLACEHOLDER[kind]]
        last = b
    assert "".join(kept) + text[last:] == pii.redact(text)


def test_frames(rows):
    s = "id long, t string, kind string, n_email int"
    data = [(1, "a@b.example tel 010-0281-0072 and c@d.example", "x", 9), (2, None, None, None), (3, "", None, 1), (4, "y" * 100_000 + " a@b.example", None, None)]
    got = sorted((r.id, r.kind) for r in pii.find_personal(rows(s, data), "t").collect())
    assert got == [(1, "email"), (1, "phone"), (4, "email")]
    out = {r.id: (r.redacted and r.redacted[-20:], r.n_email, r.n_phone) for r in pii.redact_column(rows(s, data), "t").collect()}
    assert out[1][0].endswith("and [EMAIL]") and out[1][1:] == (2, 1) and out[2] == (None, 0, 0) and out[3] == ("", 0, 0) and out[4][1] == 1
    assert pii.find_personal(rows(s), "t").collect() == []
