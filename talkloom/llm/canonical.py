"""One consistent form for text that looks the same.

Text is copied to code point arrays and changed by table lookups: stand-ins are replaced or removed,
joined letters expanded by offsets, Hangul and accents composed, look-alike letters resolved by word.
Nothing is done row by row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.arrowtext import code_points, pieces, row_of, strings

LIMIT = 0x110000

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ґ": "r", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Һ": "H", "Ӏ": "I", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y",
}
GREEK = {
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "τ": "t", "ϲ": "c", "ϳ": "j", "ω": "w", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "Տ": "S", "Օ": "O", "Լ": "L"}
CHEROKEE = dict(zip("ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEGHJKLMPRSTVWZ", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
LATIN = {"ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ʏ": "y", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m"}
# Hyphens, joined letters, invisible characters.
HYPHENS = "‐‑‒–⁃−˗֊﹘﹣"
JOINED = "ﬀﬁﬂﬃﬄﬅﬆĲĳǄǅǆǇǈǉǊǋǌ"
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
#: Scripts that need joiners, and what pictures are made of besides symbols.
JOINING = [(0x600, 0x8FF), (0x900, 0xDFF), (0xF00, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF)]
PICTURES = [(0x203C, 0x203C), (0x2049, 0x2049), (0x20E3, 0x20E3), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x25A0, 0x27BF), (0x2900, 0x297F), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3299), (0x1F000, 0x1FAFF)]
HARD, SOFT, PLAIN = 1, 2, 3


class Tables:
    """Lookup tables over all code points, made from the rules above and the Unicode database."""

    def __init__(self) -> None:
        self.single = np.arange(LIMIT, dtype=np.uint32)
        self.invisible, self.joining, self.picture = (self._ranges(r) for r in (INVISIBLE, JOINING, PICTURES))
        self.letter, self.word, self.mark = (np.zeros(LIMIT, bool) for _ in range(3))
        pairs = {}
        for c in range(0xF0000):
            ch = chr(c)
            kind = unicodedata.category(ch)
            self.letter[c] = kind[0] == "L"
            self.word[c] = kind[0] in "LNM" or ch == "'"
            self.mark[c] = kind[0] == "M" and not self.invisible[c]
            parts = unicodedata.decomposition(ch)
            if kind == "Zs" or ch in "\t\v\f":
                self.single[c] = 0x20
            elif ch in "  ":
                self.single[c] = 0x0A
            elif parts[:1] == "<" and parts.split()[0] in ("<wide>", "<narrow>", "<font>"):
                whole = unicodedata.normalize("NFKC", ch)
                if len(whole) == 1:
                    self.single[c] = ord(whole)
            elif parts and parts[0] != "<":
                whole = unicodedata.normalize("NFC", ch)
                if whole == ch and len(parts.split()) == 2:
                    a, b = (int(x, 16) for x in parts.split())
                    pairs[a << 21 | b] = c
                elif len(whole) == 1:
                    self.single[c] = ord(whole)
        # Half-width Hangul letters stand for the letters typed as such.
        self.pair_keys = np.array(sorted(pairs), np.uint64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.joined = {ord(c): np.array([ord(x) for x in unicodedata.normalize("NFKC", c)], np.uint32) for c in JOINED}
        self.is_joined = np.zeros(LIMIT, bool)
        self.is_joined[list(self.joined)] = True
        self.hyphen = np.zeros(LIMIT, bool)
        self.hyphen[[ord(c) for c in HYPHENS]] = True
        #: script: letters of other scripts with and without a Latin look-alike, and ASCII letters.
        self.script = np.zeros(LIMIT, np.uint8)
        for block in (slice(0x370, 0x590), slice(0x13A0, 0x1400), slice(0xA4D0, 0xA4FE)):
            self.script[block][self.letter[block]] = HARD
        self.latin = np.arange(LIMIT, dtype=np.uint32)
        for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, LATIN):
            for a, b in table.items():
                self.latin[ord(a)], self.script[ord(a)] = ord(b), SOFT
        self.script[0x41:0x5B] = self.script[0x61:0x7B] = PLAIN
        self.back = np.zeros(LIMIT, np.uint32)
        for a, b in CYRILLIC.items():
            if self.back[ord(b)] == 0:
                self.back[ord(b)] = ord(a)
        self.cyrillic = np.zeros(LIMIT, bool)
        self.cyrillic[0x400:0x530] = True

    @staticmethod
    def _ranges(ranges: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(LIMIT, bool)
        for a, b in ranges:
            out[a : b + 1] = True
        return out


@cache
def tables() -> Tables:
    return Tables()


def canonical_points(p: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and offsets of the consistent form, and which rows held a stand-in."""
    t = tables()
    rows = len(offsets) - 1
    touched = np.zeros(rows, bool)
    row = row_of(offsets)

    def drop(gone: np.ndarray) -> None:
        nonlocal p, row
        touched[row[gone]] = True
        p, row = p[~gone], row[~gone]

    # Invisible characters, but for those in pictures and in scripts that join with them.
    gone = t.invisible[p]
    if gone.any():
        at = np.arange(len(p))
        before = np.maximum.accumulate(np.where(gone, -1, at))
        after = np.minimum.accumulate(np.where(gone, len(p), at)[::-1])[::-1]
        near = np.zeros(len(p), bool)
        for other, table in ((before, t.picture | t.joining), (after, t.picture)):
            inside = (other >= 0) & (other < len(p))
            o = np.where(inside, other, 0)
            near |= inside & (row[o] == row) & table[p[o]]
        gone &= ~near
        drop(gone)
    # One for one.
    to = t.single[p]
    touched[row[to != p]] = True
    p = to
    # Joined letters.
    wide = t.is_joined[p]
    if wide.any():
        touched[row[wide]] = True
        width = np.ones(len(p), np.int64)
        for c, parts in t.joined.items():
            width[p == c] = len(parts)
        start = np.r_[0, np.cumsum(width)]
        new = np.repeat(p, width)
        for c, parts in t.joined.items():
            hit = start[:-1][p == c]
            for k, x in enumerate(parts):
                new[hit + k] = x
        p, row = new, np.repeat(row, width)
    # Hangul stored in pieces.
    lead, vowel, tail = ((p >= a) & (p <= b) for a, b in ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2)))
    if (vowel | tail).any():
        p = p.copy()
        same = np.r_[row[1:] == row[:-1], False]
        open_ = np.flatnonzero(lead & np.r_[vowel[1:], False] & same)
        gone = np.zeros(len(p), bool)
        p[open_] = 0xAC00 + ((p[open_] - 0x1100) * 21 + p[open_ + 1] - 0x1161) * 28
        gone[open_ + 1] = True
        drop(gone)
        tail = (p >= 0x11A8) & (p <= 0x11C2)
        base = (p >= 0xAC00) & (p <= 0xD7A3) & ((p - 0xAC00) % 28 == 0)
        same = np.r_[row[1:] == row[:-1], False]
        closed = np.flatnonzero(base & np.r_[tail[1:], False] & same)
        gone = np.zeros(len(p), bool)
        p[closed] += p[closed + 1] - 0x11A7
        gone[closed + 1] = True
        drop(gone)
    # Accents, one mark a round.
    while len(p) > 1 and t.mark[p].any():
        follows = np.flatnonzero(t.mark[p[1:]] & (row[1:] == row[:-1]))
        keys = p[follows].astype(np.uint64) << np.uint64(21) | p[follows + 1]
        found = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        hit = t.pair_keys[found] == keys
        # Of marks in a row only the first joins in this round.
        hit &= ~np.r_[False, (follows[1:] == follows[:-1] + 1) & hit[:-1]]
        if not hit.any():
            break
        p = p.copy()
        p[follows[hit]] = t.pair_values[found[hit]]
        gone = np.zeros(len(p), bool)
        gone[follows[hit] + 1] = True
        drop(gone)
    # Look-alike letters by word.
    script = t.script[p]
    if ((script == SOFT) | (script == HARD)).any():
        inside = t.word[p]
        begins = inside & ~np.r_[False, inside[:-1] & (row[1:] == row[:-1])]
        word = np.cumsum(begins)
        word[~inside] = 0
        count = lambda what: np.bincount(word[what], minlength=int(word.max()) + 1)
        plain, soft, hard = (count(script == k) for k in (PLAIN, SOFT, HARD))
        cyrillic_hard = count((script == HARD) & t.cyrillic[p])
        no_way_back = count((script == PLAIN) & (t.back[p] == 0))
        to_latin = (plain > 0) & (soft > 0) & (hard == 0)
        back = (plain > 0) & (hard > 0) & (cyrillic_hard == hard) & (no_way_back == 0)
        to_latin[0] = back[0] = False
        p = p.copy()
        for hit, table in ((to_latin[word] & (script == SOFT), t.latin), (back[word] & (script == PLAIN), t.back)):
            touched[row[hit]] = True
            p[hit] = table[p[hit]]
    # Hyphens inside words.
    hyphen = t.hyphen[p]
    if hyphen.any():
        letter = t.letter[p]
        same = np.r_[row[1:] == row[:-1], False]
        inside = hyphen & np.r_[False, (letter[:-1] & same[:-1])] & np.r_[letter[1:], False] & same
        touched[row[inside]] = True
        p = np.where(inside, np.uint32(0x2D), p)
    out = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=rows), out=out[1:])
    return p, out, touched


def canonical_array(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent form of a string column and which rows held a stand-in."""
    column = column.cast(pa.large_string())
    p, offsets, touched = canonical_points(*code_points(column))
    return strings(p, offsets, column.is_null().to_numpy(zero_copy_only=False)), touched


def canonicalise(rows: DataFrame, column: str, form: str = "canonical", found: str = "had_standin") -> DataFrame:
    """``rows`` with the consistent form of ``column`` and whether it held a stand-in.

    Null text gives null and False, empty text itself. Columns that have the new names already are replaced.
    Line breaks, pictures, single Hangul letters, precomposed accents and words wholly in another script stay.
    """
    rows = rows.drop(*({form, found} - {column}))
    schema = T.StructType([*rows.schema.fields, T.StructField(form, T.StringType()), T.StructField(found, T.BooleanType())])
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch, column)):
            text, touched = canonical_array(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, text, pa.array(touched)], names=[*b.schema.names, form, found])

    return rows.mapInArrow(run, schema)


def standins(rows: DataFrame, column: str) -> DataFrame:
    """The rows (without ``column``) whose ``column`` holds a stand-in."""
    return canonicalise(rows, column, "__form", "__found").where(F.col("__found")).drop(column, "__form", "__found")
