"""Passages of held-out test items inside a corpus.

The test items are reduced to lower-case letters and digits. One Aho-Corasick automaton holds short
blocks of them, spaced so that any common run of the wanted length must contain a whole block; the
reduced text of each document is scanned once, hits are extended to maximal runs, and runs are mapped
back to offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, run_chars int, item_chars int, start int, end int"


def reduce_text(text: str) -> str:
    """Lower case, letters and digits only."""
    return _OTHER.sub("", text.lower())


def reduce_with_offsets(text: str) -> tuple[str, list[int]]:
    """The same, with the original position of each character kept. The whole text is lowered at once, as a letter's
    lower case may depend on its neighbours; how many characters it has does not."""
    low = text.lower()
    at = range(len(text)) if text.isascii() else [i for i, c in enumerate(text) for _ in c.lower()]
    kept = [(x, i) for x, i in zip(low, at, strict=True) if x.isalnum()]
    return "".join(x for x, _ in kept), [i for _, i in kept]


def _run(a: str, i: int, b: str, j: int, n: int) -> tuple[int, int, int]:
    """Starts in ``a`` and ``b`` and length of the longest common run around a[i : i + n] == b[j : j + n]."""
    back = 0
    while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
        back += 1
    ahead, most = n, min(len(a) - i, len(b) - j)
    while ahead < most and a[i + ahead] == b[j + ahead]:
        ahead += 1
    return i - back, j - back, back + ahead


class Scanner:
    """The automaton over the blocks of all items."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.block = least, (least + 1) // 2
        self.items = {k: r for k, t in items if len(r := reduce_text(t)) >= least}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, r in self.items.items():
            # A run of ``least`` contains a whole block if blocks follow each other: 2 * block - 1 <= least.
            for j in range(0, len(r) - self.block + 1, max(1, least - self.block + 1)):
                places.setdefault(r[j : j + self.block], []).append((k, j))
        self.automaton = ahocorasick.Automaton()
        for block, where in places.items():
            self.automaton.add_word(block, where)
        if places:
            self.automaton.make_automaton()

    def runs(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, run length, item length, start, end) of the longest run with each item; the first if tied."""
        if not self.items:
            return []
        reduced = reduce_text(text)
        if len(reduced) < self.least:
            return []
        best: dict[int, tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for end, where in self.automaton.iter(reduced):
            i = end - self.block + 1
            for k, j in where:
                # Hits on one diagonal that lie in a run already measured add nothing.
                if done.get((k, i - j), -1) >= end:
                    continue
                s, _, n = _run(reduced, i, self.items[k], j, self.block)
                done[k, i - j] = s + n - 1
                if n >= self.least and n > best.get(k, (0, 0))[0]:
                    best[k] = (n, s)
        if not best:
            return []
        at = reduce_with_offsets(text)[1]
        return [(k, n, len(self.items[k]), at[s], at[s + n - 1] + 1) for k, (n, s) in best.items()]


@lru_cache(1)
def _scanner(items: tuple[tuple[int, str], ...], least: int) -> Scanner:
    """One automaton a worker process, whatever the number of its tasks."""
    return Scanner(list(items), least)


def contaminated(docs: DataFrame, items: DataFrame, least: int = 50, max_item_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, run_chars, item_chars, start, end): documents that share a run of ``least`` letters and digits with an item.

    ``docs`` is (doc_id, text), ``items`` (item_id, text). ``run_chars`` is the longest common run and
    start, end its place in the stored text. Items go to the driver and from there to the tasks; with more
    than ``max_item_chars`` characters they go in blocks of that size, one scan each, so that no automaton
    outgrows a task. Null texts and ids are skipped, items shorter than ``least`` never match, rows of an
    item repeated are one item. Documents repeated under one id give repeated rows.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max_item_chars))
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _scan(docs, [(r.item_id, r.text) for r in part.toLocalIterator()], least)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs: DataFrame, items: list[tuple[int, str]], least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tuple(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value, least)
        for b in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for found in scanner.runs(text):
                    for column, value in zip(out, (key, *found), strict=True):
                        column.append(value)
            if out[0]:
                kinds = [np.int64, np.int64, *[np.int32] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, k)) for v, k in zip(out, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)
