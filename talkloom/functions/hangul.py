"""Hangul as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of syllables in the order of Unicode (initials, vowels, finals).
INITIALS = list("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ")
VOWELS = list("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]


def jamo(text: str) -> str:
    """Driver-side decomposition of a query."""
    out = []
    for c in text:
        k = ord(c) - 0xAC00
        out.append(INITIALS[k // 588] + VOWELS[k % 588 // 28] + FINALS[k % 28] if 0 <= k < 11172 else c)
    return "".join(out)


def decompose_jamo(text: Column) -> Column:
    """Each Hangul syllable as its letters, other characters unchanged; null gives null."""
    part = lambda letters, at: F.element_at(F.array(*map(F.lit, letters)), (at + 1).cast("int"))

    def one(c: Column) -> Column:
        k = F.ascii(c) - 0xAC00
        whole = F.concat(part(INITIALS, F.floor(k / 588)), part(VOWELS, F.floor(k % 588 / 28)), part(FINALS, k % 28))
        return F.when(k.between(0, 11171), whole).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


#: The syllables without final, by rule.
_OPEN = "".join(map(chr, range(0xAC00, 0xAC00 + 11172, 28)))


def jamo_length(text: Column) -> Column:
    """Characters of ``decompose_jamo(text)`` without making it: a syllable is three letters, or two without final."""
    whole = F.char_length(F.regexp_replace(text, "[^가-힣]", ""))
    # Length plus two for each syllable less one for each open one; the open ones are what translating them away removes.
    return F.char_length(F.translate(text, _OPEN, "")) + 2 * whole


def has_bare_jamo(text: Column) -> Column:
    """Whether a letter stands alone, outside a syllable."""
    return text.rlike("[ㄱ-ㅎㅏ-ㅣ]")
