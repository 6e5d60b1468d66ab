import random

from hypothesis import given
from hypothesis import strategies as st

from talkloom.llm import names


def slow(a, b):
    """The textbook recursion of the unrestricted distance."""
    big = len(a) + len(b)
    last, d = {}, {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, at = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, at - 1] + (i - k - 1) + 1 + (j - at - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


WORD = st.text("abcd", max_size=8)


@given(WORD, WORD, WORD)
def test_metric(a, b, c):
    assert names.distance(a, b) == slow(a, b) == names.distance(b, a)
    assert (names.distance(a, b) == 0) == (a == b)
    assert names.within_one(a, b) == (slow(a, b) <= 1)
    assert [names.within_two(a, b, r) for r in (0, 1, 2)] == [slow(a, b) <= r for r in (0, 1, 2)]
    assert names.distance(a, c) <= names.distance(a, b) + names.distance(b, c)
    assert names.distances([a, b, c], c).tolist() == [slow(c, a), slow(c, b), 0]


@given(WORD)
def test_distance_to_a_pivot_of_letters(word):
    pivot = "ab" * 40
    assert slow(word, pivot) == len(pivot) - sum(c in "ab" for c in word)


def test_near_forms_are_all_found(rows):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 8))) for _ in range(250)}
    for w in list(words)[:120]:
        at = rng.randrange(len(w) - 1)
        words.add(w[:at] + w[at + 1] + w[at] + w[at + 2 :])
    words |= {"abcdefgh", "badcefgh", "badcfegh", "가나다", "가나", "z" * 3000, "z" * 3001}
    words = sorted(words)
    want = {(a, b): d for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 3 and len(a) < 99 and (d := slow(a, b)) <= 2} | {("z" * 3000, "z" * 3001): 1}
    got = [(*sorted((r.a, r.b)), r.d) for r in names.near_forms(rows("form string", [(w,) for w in words] + [("",), (None,)])).collect()]
    assert len(got) == len({x[:2] for x in got}) and {x[:2]: x[2] for x in got} == want
    assert names.near_forms(rows("form string")).collect() == []


def test_parse():
    assert names.romanise("추지도 힣A") == "chujido hitA"
    assert [names.ending(w) for w in ("fdn", "mtrs", "lgstcs", "prtcl", "nw", "logi", "hld", "foundatoin", "물류", "chubogaja")] == [
        "foundation", "motors", "logistics", "protocol", "network", "logistics", "holdings", "foundation", "logistics", None
    ]
    assert names.forms(None, None) == names.forms("", " ") == []
    # An acronym is a name only where nothing longer is known; short names count by what they are.
    assert names.forms("CMF", None) == [("cmf", "", None, False)] and len(names.forms("CMF", "쿠시헤 게헤케비")) == 1
    assert names.forms("C. Mureduda", None) == [("c", "mureduda", None, True)]
    assert ("jejahu", "manopune", "exchange", False) in names.forms("제자후마노푸네거래소", None)


VARIANTS = [
    ["Kusihe Gehekebi Foundation", "K. Gehekebi Foundation", "Kuihe Gehekebi Fdn", "Gehekebi, Kusihe Foundation", "kusihe-gehekebi found", "KusiheGehekebi", "쿠시헤게헤케비재단", "쿠시헤 게헤케비 재단 DAO 2"],
    ["Bemohe Rosokogu Technologies", "Bemo Rosokogu Tech", "The Bemohe Rosokogu"],
    ["Hopiho Hachohiku Motors", "Hpoiho Hachohiku Motor"],
    ["Hopiho Hachohiku Capital"],
    ["Tirado Runereme"],
]


def test_entities(rows):
    data = [(100 * e + i, t, None) for e, group in enumerate(VARIANTS) for i, t in enumerate(group)]
    data += [(900, "CMF", "쿠시헤 게헤케비"), (901, None, None), (902, "", ""), (None, "Tirado Runereme", None), (100, VARIANTS[1][0], None), (903, "x" * 3000, None)]
    got = {r.topic_id: r.entity_id for r in names.entities(rows("topic_id long, title string, title_ko string", data)).collect()}
    want = {100 * e + i: 100 * e for e, group in enumerate(VARIANTS) for i in range(len(group))} | {900: 0, 903: 903}
    assert got == want
    pairs = names.entity_pairs(rows("topic_id long, entity_id long", list(got.items())), "topic_id").collect()
    assert len(pairs) == 36 + 3 + 1
    assert names.entities(rows("topic_id long, title string, title_ko string")).collect() == []


def test_two_exchanges_in_one_part(rows):
    data = [(1, "Kusihe Gehekebi", None), (2, "Kusihe Egheekbi", None), (3, "Kusihe Egheekib", None)]
    assert [names.distance("gehekebi", x) for x in ("egheekbi", "egheekib")] == [2, 3]
    got = {r.topic_id: r.entity_id for r in names.entities(rows("topic_id long, title string, title_ko string", data[:2])).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.topic_id: r.entity_id for r in names.entities(rows("topic_id long, title string, title_ko string", data[::2])).collect()}
    assert got == {1: 1, 3: 3}


def test_short_words_initials_and_nicknames(rows):
    data = ["HYBE", "HYBE", "Hybe", "Kia", "KIA", "Via", "NAVER", "Naver", "Navers", "Robert Smithson", "Bob Smithson", "Bobby Smithson", "R. Smithson", "Ronald Smithsonian", "hybes"]
    got = {r.topic_id: r.entity_id for r in names.entities(rows("topic_id long, title string, title_ko string", [(i, t, None) for i, t in enumerate(data)])).collect()}
    assert [got[i] for i in range(len(data))] == [0, 0, 0, 3, 3, 5, 6, 6, 6, 9, 9, 9, 9, 13, 14]
