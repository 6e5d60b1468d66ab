"""Message search: variants of a query, ranked matches, pages by cursor, highlights."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.hangul import decompose_jamo, jamo, jamo_length

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PAGE = 30
ORDER = [("rank", False), ("tf_total", True), ("timestamp", True), ("chat_id", False), ("message_id", False)]


@dataclass(frozen=True)
class Plan:
    """Terms of each variant, all lower case; ``ranked`` if some variant can use three-character terms."""

    variants: tuple[tuple[str, ...], ...]
    ranked: bool

    @property
    def phrases(self) -> list[str]:
        return list(dict.fromkeys(t for v in self.variants for t in v))


def plan_query(query: str) -> Plan:
    """The query as typed, without white space, and in letters; each as terms that must all occur.

    A variant is used if one of its terms has three characters, and shorter terms beside it are dropped. With
    no such variant the terms as typed must all occur somewhere.
    """
    words = query.strip().lower().split()
    if not words:
        return Plan((), False)
    made = (words, ["".join(words)], jamo(" ".join(words)).split())
    ready = [tuple(t for t in v if len(t) >= 3) for v in made if any(len(t) >= 3 for t in v)]
    if ready:
        return Plan(tuple(dict.fromkeys(ready)), True)
    return Plan((tuple(words),), False)


def search_columns(text: Column) -> dict[str, Column]:
    """The three searched forms, lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {"content": low, "jamo": decompose_jamo(low), "nospace": F.regexp_replace(low, r"(?U)\s+", "")}


def _needs_jamo(plan: Plan) -> bool:
    return any(re.search("[ㄱ-ㅎㅏ-ㅣ]", p) for p in plan.phrases)


def _contains(columns: Sequence[Column], phrase: str) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(phrase) for c in columns))


def matches(plan: Plan, columns) -> Column:
    """Any variant of which every term occurs in one of its columns (a function of the term)."""
    if not plan.variants:
        return F.lit(False)
    every = [reduce(lambda a, b: a & b, (_contains(columns(t), t) for t in v)) for v in plan.variants]
    return reduce(lambda a, b: a | b, every)


def occurrences(text: Column, phrase: str) -> Column:
    """Occurrences of ``phrase``, overlapping ones each."""
    if any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase))):
        return F.regexp_count(text, F.lit(f"(?={re.escape(phrase)})"))
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def bm25(messages: DataFrame, query: str) -> DataFrame:
    """Matches of ``messages`` (chat_id, message_id, timestamp, text) with rank (lower is better) and tf_total.

    One pass gives the corpus figures (rows, mean length, rows per phrase), one row to the driver; a second
    scores the matches only. Length is in trigrams over the three forms. Deliveries of a message count as
    rows of the corpus, but a message comes out once, at its earliest time. Null text counts as empty.
    """
    plan = plan_query(query)
    if not plan.variants:
        none = F.lit(0.0)
        return messages.select("chat_id", "message_id", "timestamp", "text", none.alias("rank"), F.lit(0).alias("tf_total")).limit(0)
    forms = search_columns(F.col("text"))
    if not _needs_jamo(plan):
        del forms["jamo"]
    rows = messages.select("chat_id", "message_id", "timestamp", "text", *(c.alias(f"_{n}") for n, c in forms.items()))
    content, nospace = F.col("_content"), F.col("_nospace")

    def columns(phrase: str) -> list[Column]:
        """Where a phrase can occur. Outside Hangul the letters are the text itself; syllables never are letters."""
        if re.search("[ㄱ-ㅎㅏ-ㅣ]", phrase):
            return [content, F.col("_jamo"), nospace]
        return [content, nospace] if re.search("[가-힣]", phrase) else [content, content, nospace]

    length = reduce(lambda a, b: a + b, (F.greatest(n - 2, F.lit(0)) for n in (F.char_length(content), jamo_length(content), F.char_length(nospace))))
    phrases = plan.phrases
    figures = rows.agg(F.count("*").alias("n"), F.avg(length).alias("d"), *(F.count_if(_contains(columns(p), p)).alias(f"p{k}") for k, p in enumerate(phrases))).first()
    mean = figures.d or 1.0
    score, total = F.lit(0.0), F.lit(0)
    for k, p in enumerate(phrases):
        tf = reduce(lambda a, b: a + b, (occurrences(c, p) for c in columns(p)))
        n = figures[f"p{k}"]
        idf = F.greatest(F.ln(F.lit((figures.n - n + 0.5) / (n + 0.5))), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        total = total + tf
    hits = rows.where(matches(plan, columns)).select("chat_id", "message_id", "timestamp", "text", F.round(-score, 6).alias("rank"), total.alias("tf_total"))
    # Copies agree in their text, so in all but the time.
    return hits.groupBy("chat_id", "message_id").agg(F.min("timestamp").alias("timestamp"), *(F.first(c).alias(c) for c in ("text", "rank", "tf_total")))


def contains_all(messages: DataFrame, query: str) -> DataFrame:
    """The path without ranking: every term occurs in some form. Letters are compared only if the query has any."""
    words = query.strip().lower().split()
    forms = search_columns(F.col("text"))
    columns = [forms["content"], forms["nospace"], *([forms["jamo"]] if re.search("[ㄱ-ㅎㅏ-ㅣ]", query) else [])]
    hit = reduce(lambda a, b: a & b, (_contains(columns, w) for w in words)) if words else F.lit(False)
    return messages.where(hit).groupBy("chat_id", "message_id").agg(F.min("timestamp").alias("timestamp"), F.first("text").alias("text"))


def _key(order) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def after(cursor: Sequence, order=ORDER) -> Column:
    """Rows behind ``cursor`` (a value per column of the order)."""
    out, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(order, cursor, strict=True):
        out = out | (same & (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v)))
        same = same & (F.col(c) == F.lit(v))
    return out


def page(hits: DataFrame, size: int = PAGE, cursor: Sequence | None = None, order=ORDER) -> DataFrame:
    """One page behind ``cursor``; each row tells if there are more. One row more than the page is looked at."""
    rows = hits if cursor is None else hits.where(after(cursor, order))
    probe = rows.orderBy(*_key(order)).limit(size + 1)
    # At most size + 1 rows are left here.
    every = Window.orderBy(*_key(order))
    return probe.select("*", F.row_number().over(every).alias("position"), (F.count("*").over(Window.partitionBy()) > size).alias("has_more")).where(F.col("position") <= size)


def in_scope(messages: DataFrame, chats: DataFrame, chat_id: int | None = None) -> DataFrame:
    """Messages of one chat, or of all chats that aren't excluded; chats that are unknown stay."""
    if chat_id is not None:
        return messages.where(F.col("chat_id") == chat_id)
    return messages.join(chats.where("is_excluded").select("chat_id").distinct(), "chat_id", "left_anti")


def highlights(text: str, tokens: Sequence[str]) -> list[tuple[int, int]]:
    """Byte ranges of the tokens in the lower-cased text, sorted, touching ones joined."""
    low = text.lower().encode()
    found = []
    for token in tokens:
        t = token.lower().encode()
        at = low.find(t) if t else -1
        while at >= 0:
            found.append((at, at + len(t)))
            at = low.find(t, at + len(t))
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def highlight_column(text: Column, query: str) -> Column:
    """array<struct<start, end>> of the query's words in ``text``; null text gives none."""
    words = query.split()

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in highlights(t, words)] if t else [])

    return run(text)


def shaped(hits: DataFrame, chats: DataFrame, links: DataFrame | None, query: str) -> DataFrame:
    """Hits with the chat's title ('' if unknown), their link and their highlights. The chats are few."""
    out = hits.join(chats.select("chat_id", F.col("title").alias("chat_title")), "chat_id", "left")
    out = out.withColumn("chat_title", F.coalesce("chat_title", F.lit("")))
    if links is not None:
        out = out.join(links, ["chat_id", "message_id"], "left")
    return out.withColumn("highlights", highlight_column(F.col("text"), query))
