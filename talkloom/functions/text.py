"""String functions as column expressions; Arrow functions only where Unicode forms need them."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no topic, endings that titles lose, the letters of two keyboard layouts.
STOP_WORDS = (
    "the a an of in on for to and is are was were with by at from as or its it this that new more most will may can has had have been about after before into"
).split()
TITLE_ENDINGS = ("update", "news", "alert", "analysis")
RUSSIAN_KEYS, ENGLISH_KEYS = "йцукенгшщзфывапролдячсмить", "qwertyuiopasdfghjklzxcvbnm"


def strip_whitespace(text: Column) -> Column:
    """All Unicode white space removed."""
    return F.regexp_replace(text, r"(?U)\s+", "")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfc_char_count(text: Column) -> Column:
    return F.char_length(nfc(text))


def squash(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_norm(text: Column) -> Column:
    """Compatibility form, lower case, white space squashed: the key by which pages are the same."""
    return squash(F.lower(nfkc(text)))


def normalize_topic_title(title: Column) -> Column:
    """Lower case without white space, then without each ending once, if more than 3 bytes remain."""
    def without(s: Column, e: Column) -> Column:
        return F.when(s.endswith(e) & (F.octet_length(s) > F.octet_length(e) + 3), F.left(s, F.char_length(s) - F.char_length(e))).otherwise(s)

    return F.aggregate(F.array(*map(F.lit, TITLE_ENDINGS)), F.lower(strip_whitespace(title)), without)


def significant_words(title: Column) -> Column:
    """Words of two bytes or more that are no stop words, repeats kept."""
    words = F.split(F.lower(title), r"[^\p{L}\p{N}']")
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """Common words by the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def titlecase(text: Column) -> Column:
    """First letters raised, the rest of each word as it is, single blanks."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def shorten(text: Column, length: int, mode: str = "tail") -> Column:
    """At most ``length`` characters, with dots at the head, middle or tail; under 4 just the prefix."""
    if length < 4:
        return F.left(text, F.lit(length))
    keep = length - 3
    head = keep // 2
    cut = {
        "head": F.concat(F.lit("..."), F.right(text, F.lit(keep))),
        "middle": F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(keep - head))),
        "tail": F.concat(F.left(text, F.lit(keep)), F.lit("...")),
    }[mode]
    return F.when(F.char_length(text) > length, cut).otherwise(text)


def other_layout(text: Column) -> Column:
    """What was meant if Russian keys were pressed on an English keyboard."""
    return F.translate(F.lower(text), RUSSIAN_KEYS, ENGLISH_KEYS)


def strip_skin_tone(text: Column) -> Column:
    return F.regexp_replace(text, "[\U0001f3fb-\U0001f3ff]", "")


def strip_variation(text: Column) -> Column:
    return F.regexp_replace(text, "️", "")


_EMOJI = "[‼⁉←-⇿⌀-⏿■-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff]"
_EMOJI_UNIT = f"(?:{_EMOJI}[️\U0001f3fb-\U0001f3ff]*(?:‍{_EMOJI}[️\U0001f3fb-\U0001f3ff]*)*)"


def extract_emoji(text: Column) -> Column:
    """The pictures of a text, joined sequences as one, in order."""
    return F.regexp_extract_all(text, F.lit(f"({_EMOJI_UNIT})"), 1)


def only_emoji(text: Column) -> Column:
    return text.rlike(f"^\\s*(?:{_EMOJI_UNIT}\\s*)+$")


def message_link(username: Column, chat_id: Column, message_id: Column, public: str, private: str) -> Column:
    """Public link by name, else a private one by the chat's positive number; templates have {chat} and {message}."""

    def fill(template: str, chat: Column) -> Column:
        before, rest = template.split("{chat}")
        middle, after = rest.split("{message}")
        return F.concat(F.lit(before), chat, F.lit(middle), message_id.cast("string"), F.lit(after))

    number = (-chat_id - 1_000_000_000_000).cast("string")
    return F.when(username.isNotNull() & (username != ""), fill(public, username)).otherwise(fill(private, number))


def mrz_check_digit(data: Column) -> Column:
    """Check digit of a machine-readable field; null for characters it can't have."""
    weights = F.array(*map(F.lit, (7, 3, 1)))

    def value(c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).when(c == "<", F.lit(0))

    parts = F.transform(F.filter(F.split(data, ""), lambda c: c != ""), lambda c, i: value(c) * F.element_at(weights, (i % 3 + 1).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def first_range(text: Column, query: str) -> Column:
    """1-based place of the first match whatever its case; null if there is none or the query is empty."""
    return F.nullif(F.locate(query.lower(), F.lower(text)), F.lit(0)) if query else F.lit(None).cast("int")


def prefix_rating(word: Column, query: str) -> Column:
    """Share of the longer of both that is no common prefix; 1 if not even the first characters agree."""
    same = reduce(lambda a, k: F.when(F.left(word, F.lit(k)) == query[:k], F.lit(k)).otherwise(a), range(1, len(query) + 1), F.lit(0))
    longest = F.greatest(F.char_length(word), F.lit(len(query)))
    return F.when(same > 0, (longest - same) / longest).otherwise(F.lit(1.0))


def fuzzy_prefix_hits(text: Column, query: str, most: float = 0.37) -> Column:
    """Words of ``text`` whose prefix rating to some word of ``query`` is below ``most``, in order."""
    wanted = [w.lstrip("#@") for w in re.split(r"[^\w#@]+", query.lower()) if w.strip("#@")]
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if not wanted:
        return F.filter(words, lambda w: F.lit(False))
    return F.filter(words, lambda w: reduce(lambda a, b: a | b, (prefix_rating(w, q) < most for q in wanted)))


def evidence_hash(*parts: Column) -> Column:
    """16 bytes that are stable and in which fields can't run into each other: each is preceded by its length."""
    fields = []
    for p in parts:
        s = F.coalesce(p.cast("string"), F.lit(""))
        fields += [F.lpad(F.hex(F.octet_length(s)), 8, "0"), F.hex(F.encode(s, "utf-8"))]
    return F.substring(F.unhex(F.sha2(F.unhex(F.concat(*fields)), 256)), 1, 16)
