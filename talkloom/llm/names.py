"""Variant spellings of names, linked by metric-space partitioning.

Each title gives one or more names of two parts (its words without legal ending, in Latin letters). The
metric on parts is the unrestricted Damerau-Levenshtein distance. Pivots are long words over a class of letters
each: the distance of a part to such a pivot is the pivot's length less the part's letters of that class. The
distances to all pivots name the cell of a part. By the triangle inequality an edit moves each of them by one at
most, and by how the classes divide the letters only few cells are within the radius; a part is replicated to
these, and the exact radius join runs inside each cell. All links between names come from that one join.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.canonical import canonical_array
from talkloom.operators.components import components
from talkloom.session import cut

#: Parts within SURE of each other are the same; within FAR, if the other part is equal.
SURE, FAR = 1, 2
#: Forms by whose letters the classes are balanced; whatever the classes are, the join is complete.
SAMPLE = 2000
#: Bits of a class in the number of a cell; no word has more letters of a class than LONGEST.
CLASS_BITS, MOST_CLASSES, LONGEST = 9, 6, 200_000

# Romanisation of Hangul (initials, vowels, finals).
INITIALS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
FINALS = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")
# Endings of organisation names, their shortened and Korean forms.
ENDINGS = {
    "foundation": ["fdn", "fnd", "재단"],
    "technologies": ["technology", "techno", "테크놀로지", "테크"],
    "network": ["nw", "ntwk", "networks", "네트워크"],
    "exchange": ["xchg", "거래소"],
    "holdings": ["hldg", "hldgs", "홀딩스"],
    "logistics": ["logis", "물류"],
    "semiconductor": ["semicon", "semiconductors", "반도체"],
    "protocol": ["proto", "프로토콜"],
    "laboratories": ["laboratory", "labs", "연구소"],
    "biosciences": ["bioscience", "biosci", "바이오"],
    "motors": ["모터스"],
    "capital": ["cptl", "캐피탈", "캐피털"],
}
NOISE = {"the", "inc", "ltd", "co", "corp", "llc", "plc", "gmbh", "update", "updates", "news", "alert", "analysis", "소식", "뉴스", "주식회사", "㈜"}
# Short forms of English given names.
NICKNAMES = {
    "alexander": "alec sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb", "benjamin": "ben benny", "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "donald": "don donnie", "edward": "ed eddie ned ted", "elizabeth": "beth betty liz lizzie", "frances": "fran", "francis": "frank",
    "frederick": "fred freddie", "gregory": "greg", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey",
    "joshua": "josh", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate",
    "nicholas": "nick", "patricia": "pat patty trish", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rich rick ricky dick", "robert": "bob bobby rob robbie", "ronald": "ron ronnie",
    "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky", "walter": "walt", "william": "bill billy will willie", "zachary": "zach",
}
_NICKNAME = {short: name for name, all_short in NICKNAMES.items() for short in all_short.split()}
_SPLIT = re.compile(r"[\s._\-/,;:&'’\"]+")
_HANGUL = re.compile(r"[가-힣]")


def romanise(text: str) -> str:
    """Hangul in Latin letters, syllable by syllable; other characters as they are."""
    out = []
    for c in text:
        k = ord(c) - 0xAC00
        out.append(INITIALS[k // 588] + VOWELS[k % 588 // 28] + FINALS[k % 28] if 0 <= k < 11172 else c)
    return "".join(out)


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertion, deletion, substitution, transposition; a metric."""
    i = len(os.path.commonprefix((a, b)))
    k = len(os.path.commonprefix((a[i:][::-1], b[i:][::-1])))
    return int(distances([b[i : len(b) - k]], a[i : len(a) - k])[0])


def distances(names: list[str], pivot: str) -> np.ndarray:
    """Distances of all ``names`` to ``pivot``; names of like length share a table of bounded size."""
    out = np.zeros(len(names), np.int64)
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    while order:
        n, room = 1, (1 << 24) // (len(pivot) + 2)
        while n < len(order) and (n + 1) * (len(names[order[n]]) + 2) <= room and len(names[order[n]]) <= len(names[order[0]]) + 8:
            n += 1
        out[order[:n]] = _table([names[i] for i in order[:n]], pivot)
        order = order[n:]
    return out


def _table(names: list[str], pivot: str) -> np.ndarray:
    """Distances by one table for all names, cell by cell."""
    n, la = len(names), len(pivot)
    lengths = np.array([len(x) for x in names], np.int64)
    lb = int(lengths.max()) if n else 0
    chars = np.zeros((lb, n), np.uint32)
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars[at, row] = flat
    big = la + lb
    d = np.full((la + 2, lb + 2, n), big, np.int16)
    d[1:, 1, :] = np.arange(la + 1)[:, None]
    d[1, 1:, :] = np.arange(lb + 1)[:, None]
    who = np.arange(n)
    last_row: dict[int, int] = {}
    for i in range(1, la + 1):
        last_column = np.zeros(n, np.int64)
        mine = ord(pivot[i - 1])
        for j in range(1, lb + 1):
            c = chars[j - 1]
            k = np.zeros(n, np.int64)
            for letter, r in last_row.items():
                k[c == letter] = r
            equal = c == mine
            best = np.minimum(d[i, j] + ~equal, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            swap = (k > 0) & (last_column > 0)
            if swap.any():
                w, kk, ll = who[swap], k[swap], last_column[swap]
                moved = d[kk, ll, w] + (i - kk - 1) + 1 + (j - ll - 1)
                best[swap] = np.minimum(best[swap], moved)
            d[i + 1, j + 1] = best
            last_column[equal] = j
        last_row[mine] = i
    return d[la + 1, lengths + 1, who].astype(np.int64)


def _skeleton(word: str) -> str:
    return word[0] + re.sub(r"[aeiou]", "", word[1:])


def _within(short: str, name: str) -> bool:
    """Whether ``short`` begins like ``name`` and has some of its letters, in their order."""
    rest = iter(name)
    return short[0] == name[0] and all(c in rest for c in short)


_LISTED = {form: name for name, forms in ENDINGS.items() for form in (name, *forms)}
_KOREAN_ENDINGS = sorted((f for f in _LISTED if _HANGUL.match(f)), key=len, reverse=True)


def within_one(a: str, b: str) -> bool:
    """Whether the distance is 1 at most: what differs is one character at most on either side, or two exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    k = 0
    while k < most - i and a[-1 - k] == b[-1 - k]:
        k += 1
    x, y = a[i : len(a) - k], b[i : len(b) - k]
    return max(len(x), len(y)) <= 1 or len(x) == 2 and x == y[::-1]


@lru_cache(100_000)
def ending(word: str) -> str | None:
    """The organisation ending that ``word`` stands for: listed, cut short, without vowels, or mistyped."""
    if word in _LISTED:
        return _LISTED[word]
    for name in ENDINGS:
        for form in (word, word.removesuffix("s")):
            if len(form) >= 2 and (name.startswith(form) or len(form) >= 3 and _skeleton(form) == form and _within(form, name)):
                return name
    if len(word) >= 6 and word.isascii():
        return next((name for name in ENDINGS if within_one(name, word)), None)
    return None


def parse(title: str) -> tuple[list[str], str | None, bool]:
    """Words of the name in Latin letters, its ending, and whether it is shortened to an initial or acronym."""
    title = re.sub(r"\([^)]*\)", " ", title)
    words = [w for w in _SPLIT.split(title) if w and w.lower() not in NOISE]
    korean = any(map(_HANGUL.search, words))
    if not korean:
        words = [x for w in words for x in re.sub(r"(?<=[a-z])(?=[A-Z])", " ", w).split() if x.lower() not in NOISE]
    if not korean and len(words) == 1 and len(words[0]) <= 5 and words[0].isupper():
        return [words[0].lower()], None, True
    words = [w.lower() for w in words]
    if len(words) > 1:
        words = [_NICKNAME.get(w, w) for w in words]
    if korean:  # Latin letters and digits after a Korean name are additions to it
        words = [w for w in words if _HANGUL.search(w)]
    last = None
    for at in range(len(words) - 1, 0, -1):
        last = ending(words[at])
        if last:
            del words[at]
            break
    if korean and last is None and words:
        for form in _KOREAN_ENDINGS:
            if words[-1].endswith(form) and len(words[-1]) > len(form) + 1:
                words[-1], last = words[-1][: -len(form)], _LISTED[form]
                break
    if korean and len(words) == 1 and len(words[0]) >= 4:
        return [words[0]], last, False
    words = [romanise(w) for w in words]
    return words, last, any(len(w) == 1 for w in words)


def forms(title: str | None, title_ko: str | None) -> list[tuple[str, str, str | None, bool]]:
    """(first, second, ending, short) of a topic, parts in alphabetical order; of a name of one word the second is empty.

    A Korean name written as one word gives all ways to part it. ``short`` names have an initial as first part. A word
    of up to five capitals may be an acronym: it counts as a name of its own only if the other title gives none.
    """
    out: dict[tuple[str, str], tuple[str | None, bool]] = {}
    parsed = [parse(t) for t in (title, title_ko) if t and t.strip()]
    whole = any(p[0] and not p[2] for p in parsed)
    last = next((p[1] for p in parsed if p[1]), None)
    for words, _, short in parsed:
        if not words:
            continue
        if short and len(words) == 1:
            if not whole:
                out.setdefault((words[0], ""), (last, False))
        elif short:
            if not whole and len(words) == 2 and len(max(words, key=len)) > 2:
                out[min(words, key=len), max(words, key=len)] = (last, True)
        elif len(words) == 1 and _HANGUL.match(words[0]):
            for k in range(2, len(words[0]) - 1):
                out[tuple(sorted((romanise(words[0][:k]), romanise(words[0][k:]))))] = (last, False)
        elif len(words) == 1:
            out[words[0], ""] = (last, False)
        else:
            out[tuple(sorted((words[0], "".join(words[1:]))))] = (last, False)
    return [(a, b, e, s) for (a, b), (e, s) in out.items()]


def title_forms(topics: DataFrame, key: str, title: str, title_ko: str) -> DataFrame:
    """(id, first, second, ending, short) of ``topics``, whose stand-in characters are resolved first."""
    rows = topics.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(title).alias("t"), F.col(title_ko).alias("k")).distinct()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = ["id", "first", "second", "ending", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, k = (canonical_array(b.column(c))[0].to_pylist() for c in ("t", "k"))
            out = [(i, *f) for i, x, y in zip(b.column("id").to_pylist(), t, k, strict=True) for f in forms(x, y)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "id long, first string, second string, ending string, short boolean")


def letter_classes(sample: list[str], count: int) -> list[str]:
    """The letters of ``sample`` in ``count`` - 1 classes of like weight; all other letters are the last class."""
    weight = Counter("".join(sample))
    classes = [["", 0] for _ in range(count)]
    for c, n in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        lightest = min(classes, key=lambda x: x[1])
        lightest[0] += c
        lightest[1] += n
    return [c for c, _ in classes[:-1]]


def moves(classes: int, radius: int) -> list[tuple[int, ...]]:
    """What up to ``radius`` edits can do to the letter counts of the classes, one of each two opposite moves."""
    axes = [tuple(int(i == k) for k in range(classes)) for i in range(classes)]
    none = (0,) * classes
    single = {tuple(y - x for x, y in zip(a, b, strict=True)) for a in (none, *axes) for b in (none, *axes)}
    reached = {none}
    for _ in range(radius):
        reached = {tuple(x + y for x, y in zip(m, e, strict=True)) for m in reached for e in single}
    return sorted(m for m in reached if m[::-1] >= none)


def near_forms(distinct: DataFrame, radius: int = FAR) -> DataFrame:
    """(a, b, d): all pairs of different forms of ``distinct`` (form), each once, at distance d up to ``radius``.

    The number of pivots grows with the number of forms, so that cells stay small. Every form lies in its own cell
    and, as a replica, in those to which up to ``radius`` edits lead; of two opposite moves one is enough. What
    meets in a cell is held against bounds that never exceed the distance (letters that only one has; Levenshtein,
    in which an exchange is two edits), then the metric decides. Forms of more than LONGEST characters, nulls and
    empty forms are near none.
    """
    forms = distinct.where(F.char_length("form").between(1, LONGEST)).select("form")
    size = max(2, min(MOST_CLASSES, round(math.log10(max(forms.count(), 1)))))
    letters = letter_classes([r.form for r in forms.orderBy(F.xxhash64("form")).limit(SAMPLE).collect()], size)
    length = F.char_length("form")
    counts = [length - F.char_length(F.translate("form", c, "")) if c else F.lit(0) for c in letters]
    counts.append(length - reduce(lambda x, y: x + y, counts))
    place = lambda ns: reduce(lambda x, y: x + y, (n * (1 << CLASS_BITS * i) for i, n in enumerate(ns)))
    held = reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.col("form").contains(chr(97 + i)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(26)))
    home = cut(forms.select("form", place([n.cast("long") for n in counts]).alias("cell"), held.alias("held"), F.array_join(F.array_sort(F.split("form", "")), "").alias("bag")), "cells")
    steps = F.array(*(F.lit(place(m)).cast("long") for m in moves(size, radius)))
    a = home.select(F.col("form").alias("a"), F.col("held").alias("held_a"), F.col("bag").alias("bag_a"), F.explode(steps).alias("step"), "cell").select("a", "held_a", "bag_a", "step", (F.col("cell") + F.col("step")).alias("cell"))
    b = home.select(F.col("form").alias("b"), F.col("held").alias("held_b"), F.col("bag").alias("bag_b"), "cell")
    only_one = F.bit_count(F.col("held_a").bitwiseXOR(F.col("held_b")))
    edits = F.levenshtein("a", "b", 2 * radius)
    # t exchanges and e other edits, t + e <= radius, are 2t + e edits of Levenshtein at most, so e is at most 2 * radius
    # less these; e others leave 2e letters to one word only, and move the words in order of letters 2e apart.
    bound = (only_one <= 2 * radius) & edits.between(0, 2 * radius - F.ceil(only_one / 2))
    bound = bound & ((edits <= radius) | (F.levenshtein("bag_a", "bag_b") <= 2 * (2 * radius - edits)))
    met = a.join(b.hint("merge"), "cell").where(((F.col("step") > 0) | (F.col("a") < F.col("b"))) & bound)
    return met.select("a", "b", edits.alias("edits")).mapInArrow(_measured(radius), "a string, b string, d int")


def within_two(a: str, b: str, most: int = 2) -> bool:
    """Whether the distance is ``most`` (2 at most) or less, by what can happen where the words part."""
    i, end = 0, min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    if most == 0:
        return False
    if within_two(a[1:], b[1:], most - 1) or within_two(a[1:], b, most - 1) or within_two(a, b[1:], most - 1):
        return True
    if a[1:2] == b[0] and b[1:2] == a[0] and within_two(a[2:], b[2:], most - 1):
        return True
    # Two exchanged letters with one between them that came in or went out.
    return most == 2 and (
        a[1:2] == b[0] and b[2:3] == a[0] and within_two(a[2:], b[3:], 0) or a[2:3] == b[0] and b[1:2] == a[0] and within_two(a[3:], b[2:], 0)
    )


def _measured(radius: int):
    def metric(x: str, y: str, edits: int) -> int:
        if edits == 1 or within_one(x, y):
            return 1
        return 2 if edits == 2 or within_two(x, y) else 3 if radius < 3 else distance(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.array([metric(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], np.int32)
            near = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["a", "b", "d"])
            yield near.filter(pa.array(d <= radius))

    return run


def entities(topics: DataFrame, key: str = "topic_id", title: str = "title", title_ko: str = "title_ko") -> DataFrame:
    """(key, entity_id) of every row with a usable title; entity_id is the least key of the entity.

    Two names are variants if each part is within 1 of a part of the other, or one part is the same and the
    others, of six letters or more, are within 2, and if their endings agree or one has none; names of one word
    of less than five letters only if they are equal. Short forms of given names count as the name. A title with an
    initial joins the one entity that it can be short for, or none if there are several. Null and blank titles
    and null keys stay out; repeated rows count once. Keys are not negative.
    """
    found = cut(title_forms(topics, key, title, title_ko), "forms")
    node = F.xxhash64("first", "second", F.coalesce("ending", F.lit(""))).bitwiseOR(F.lit(-(1 << 63)).cast("long"))
    full = found.where("not short").withColumn("node", node)
    # Of a title with initials in both languages the first counts.
    short = found.where("short").groupBy("id").agg(F.min(F.struct("first", "second", "ending")).alias("s")).select("id", "s.*")
    names = cut(full.select("first", "second", "ending", "node").distinct(), "names")
    parts = found.select(F.explode(F.array("first", "second")).alias("form")).where("length(form) > 1").distinct()
    near = near_forms(parts)
    itself = found.select(F.explode(F.array("first", "second")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("d"))
    near = cut(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).unionByName(itself), "near")
    close = near.where(F.col("d") <= SURE)
    agree = F.col("x.ending").isNull() | F.col("y.ending").isNull() | (F.col("x.ending") == F.col("y.ending"))
    both_ways = names.unionByName(names.select(F.col("second").alias("first"), F.col("first").alias("second"), "ending", "node"))
    # Both parts near: replace each by its neighbours and look the result up.
    replaced = names.join(close.select(F.col("a").alias("first"), F.col("b").alias("u"), F.col("d").alias("du")), "first")
    replaced = replaced.where("du = 0 or second <> '' or least(length(first), length(u)) >= 5")
    replaced = replaced.join(close.select(F.col("a").alias("second"), F.col("b").alias("v")), "second").select("u", "v", "ending", "node")
    # One part the same, the other farther off.
    long_ones = both_ways.where("length(first) > 1 and length(second) > 3")
    far = near.where((F.col("d") == FAR) & (F.greatest(F.length("a"), F.length("b")) >= 6) & (F.least(F.length("a"), F.length("b")) > 3))
    moved = long_ones.join(far.select(F.col("a").alias("second"), F.col("b").alias("v")), "second").select(F.col("first").alias("u"), "v", "ending", "node")
    x, y = replaced.unionByName(moved).alias("x"), both_ways.alias("y")
    linked = x.join(y, (F.col("x.u") == F.col("y.first")) & (F.col("x.v") == F.col("y.second"))).where(agree & (F.col("x.node") != F.col("y.node")))
    linked = linked.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    edges = full.select(F.col("id").alias("a"), F.col("node").alias("b")).unionByName(linked)
    first = components(edges).where("node >= 0")
    first = first.select(F.col("node").alias("id"), F.min("node").over(Window.partitionBy("component")).alias("entity_id"))
    first = cut(first, "entities")
    # Titles with an initial: the other part near, the initial that of the part which it stands for.
    known = full.select("id", "first", "second", "ending").unionByName(full.select("id", F.col("second").alias("first"), F.col("first").alias("second"), "ending"))
    known = known.join(first, "id").select(F.substring("first", 1, 1).alias("initial"), "second", "ending", "entity_id").distinct()
    x = short.join(close, short.second == close.a).select("id", F.col("first").alias("initial"), F.col("b").alias("second"), "ending").alias("x")
    y = known.alias("y")
    fits = x.join(y, (F.col("x.initial") == F.col("y.initial")) & (F.col("x.second") == F.col("y.second"))).where(agree)
    fits = cut(fits.groupBy(F.col("x.id").alias("id")).agg(F.min("y.entity_id").alias("p"), F.max("y.entity_id").alias("q")), "fits")
    # Titles shortened alike belong together where nothing longer is known.
    alone = short.join(fits.select("id"), "id", "left_anti").select("id", F.min("id").over(Window.partitionBy("first", "second", "ending")).alias("entity_id"))
    out = first.unionByName(fits.where("p = q").select("id", F.col("p").alias("entity_id"))).unionByName(alone)
    least = out.groupBy("entity_id").agg(F.min("id").alias("least"))
    return out.join(least, "entity_id").select(F.col("id").alias(key), F.col("least").alias("entity_id"))


def entity_pairs(members: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of each entity."""
    a, b = (members.select("entity_id", F.col(key).alias(f"{key}_{x}")) for x in "ab")
    return a.join(b, "entity_id").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
