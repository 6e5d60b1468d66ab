"""Near copies by multi-index hashing.

A text's fingerprint is 28 segments of 6 symbols, each symbol the least hash of its shingles under one
hash function; two texts differ in a symbol with the probability that they lack similarity. Around every
segment the Hamming ball of radius 1 is enumerated by leaving out each symbol in turn; texts that meet
in a table entry are compared by the distance of their complete fingerprints (one bit a symbol), and
what remains by the exact similarity of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.arrowtext import Rolling, code_points, mix, pieces, row_of
from talkloom.operators.components import components
from talkloom.session import cut

SEGMENTS, SYMBOLS = 28, 6
#: Bits of 64 in which the fingerprints of a pair may differ: at similarity 0.6 they differ in 12.8 +- 3.2, in more than these with chance 4e-5.
MOST_BITS = 26


def squeezed(text: Column) -> Column:
    """Without Unicode white space and in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def _multipliers(count: int = 72) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def symbols(p: np.ndarray, offsets: np.ndarray, width: int, rolling: Rolling, multipliers: np.ndarray) -> np.ndarray:
    """A row of symbols for each text; texts shorter than a shingle count as one shingle of their characters."""
    n = len(offsets) - 1
    hashes = rolling(p)
    row = row_of(offsets)
    start = np.flatnonzero(row[: len(hashes)] == row[width - 1 :]) if len(hashes) else np.empty(0, np.int64)
    hashes, owner = hashes[start], row[start]
    out = np.empty((n, len(multipliers)), np.uint64)
    full, first = np.unique(owner, return_index=True)
    short = np.setdiff1d(np.arange(n), full)
    for i in short:
        value = np.bitwise_xor.reduce(mix(p[offsets[i] : offsets[i + 1]].astype(np.uint64) + np.arange(1, offsets[i + 1] - offsets[i] + 1, dtype=np.uint64) * np.uint64(1 << 21))) if offsets[i + 1] > offsets[i] else np.uint64(0)
        out[i] = np.asarray(value, np.uint64) * multipliers
    # In pieces that stay in the processor's cache.
    step = 128
    for a in range(0, len(full), step):
        rows = full[a : a + step]
        low = first[a]
        high = first[a + step] if a + step < len(full) else len(hashes)
        piece, at = hashes[low:high], first[a : a + step] - low
        for k, m in enumerate(multipliers):
            out[rows, k] = np.minimum.reduceat(piece * m, at)
    return out


def table_keys(found: np.ndarray) -> np.ndarray:
    """For each text as many keys as symbols: each segment without one of its symbols."""
    weight = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
    parts = mix(found).reshape(len(found), found.shape[1] // SYMBOLS, SYMBOLS) * weight
    whole = parts.sum(axis=2, dtype=np.uint64)
    place = np.arange(found.shape[1], dtype=np.uint64).reshape(-1, SYMBOLS) * np.uint64(0xD1B54A32D192ED03)
    return mix((whole[:, :, None] - parts) ^ place).reshape(len(found), -1)


def sketch(found: np.ndarray) -> np.ndarray:
    """64 bits, one of each of the first 64 symbols."""
    bits = (mix(found[:, :64]) >> np.uint64(17)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(texts: DataFrame, width: int) -> DataFrame:
    """(tid, bits, keys) of ``texts`` (tid, norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, multipliers = Rolling(width), _multipliers(SEGMENTS * SYMBOLS)
        for big in batches:
            for b in pieces(big, "norm", 1 << 20):
                found = symbols(*code_points(b.column("norm")), width, rolling, multipliers)
                keys = table_keys(found)
                ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(sketch(found).view(np.int64)), lists], ["tid", "bits", "keys"])

    return texts.select("tid", "norm").mapInArrow(run, "tid long, bits long, keys array<long>")


def _exact(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, memo = [], {}

            def shingles(t: str, memo=memo) -> set[str]:
                s = memo.get(t)
                if s is None:
                    s = memo[t] = {t[i : i + width] for i in range(max(1, len(t) - width + 1))}
                return s

            for x, y in zip(b.column("norm_a").to_pylist(), b.column("norm_b").to_pylist(), strict=True):
                s, t = shingles(x), shingles(y)
                common = len(s & t)
                keep.append(common >= least * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_texts(texts: DataFrame, width: int = 5, least: float = 0.6) -> DataFrame:
    """(a, b), a < b: ids of different texts whose sets of ``width``-character substrings have at least ``least`` of their union in common.

    ``texts`` is (tid, norm), one row per different text. Texts in one table entry are compared inside the
    join, so only pairs with near fingerprints leave it; a large entry is split by adaptive skew handling.
    """
    entries = fingerprints(texts, width).select("tid", "bits", F.explode("keys").alias("key"))
    a = entries.select("key", F.col("tid").alias("a"), F.col("bits").alias("bits_a"))
    b = entries.select("key", F.col("tid").alias("b"), F.col("bits").alias("bits_b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= MOST_BITS)
    candidates = cut(a.join(b.hint("merge"), (a.key == b.key) & near).select("a", "b").distinct(), "near")
    left = texts.select(F.col("tid").alias("a"), F.col("norm").alias("norm_a"))
    right = texts.select(F.col("tid").alias("b"), F.col("norm").alias("norm_b"))
    return candidates.join(left, "a").join(right, "b").select("a", "b", "norm_a", "norm_b").mapInArrow(_exact(width, least), "a long, b long")


class NearCopies:
    """Near copies among ``rows`` (key columns, text).

    Texts are compared by their form without white space in lower case, if it has ``shortest`` characters
    or more; exact copies of a form are one text (identified by a 64-bit hash) and are never compared with
    each other. Null texts and rows with a null key are in no group. Repeated rows count once.
    """

    def __init__(self, rows: DataFrame, keys: list[str], text: str, width: int = 5, least: float = 0.6, shortest: int = 130):
        self.names, self.keys = keys, [f"k{i}" for i in range(len(keys))]
        named = rows.select(*(F.col(f"`{k}`").alias(x) for k, x in zip(keys, self.keys, strict=True)), squeezed(F.col(f"`{text}`")).alias("norm"))
        whole = named.where(" and ".join(f"{k} is not null" for k in self.keys))
        keys = self.keys
        whole = whole.where(F.char_length("norm") >= shortest).withColumn("tid", F.xxhash64("norm"))
        self.members = cut(whole.select("tid", *keys).distinct(), "members")
        self.texts = cut(whole.groupBy("tid").agg(F.first("norm").alias("norm")), "texts")
        self.links = cut(similar_texts(self.texts, width, least), "links")

    def pairs(self) -> DataFrame:
        """All pairs of records that are near or exact copies, each key column as <key>_a and <key>_b, a < b."""
        a, b = (self.members.select(F.col("tid").alias(f"tid_{x}"), *(F.col(k).alias(f"{k}_{x}") for k in self.keys)) for x in "ab")
        order = F.struct(*(F.col(f"{k}_a") for k in self.keys)) < F.struct(*(F.col(f"{k}_b") for k in self.keys))
        columns = [F.col(f"{k}_{x}").alias(f"{n}_{x}") for x in "ab" for k, n in zip(self.keys, self.names, strict=True)]
        copies = a.join(b, F.col("tid_a") == F.col("tid_b")).where(order).select(*columns)
        both = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(a, F.col("a") == F.col("tid_a")).join(b, F.col("b") == F.col("tid_b")).where(order).select(*columns)
        return copies.unionByName(near)

    def classes(self) -> DataFrame:
        """Key columns, class_id (the least text id of the group), n_links (of its text to other texts), n_copies
        (records with its text) of every record that is in a group of two or more."""
        links = self.links
        degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("n_links"))
        copies = self.members.groupBy("tid").agg(F.count("*").alias("n_copies"))
        found = components(links).select(F.col("node").alias("tid"), "component")
        texts = copies.join(degree, "tid", "left").join(found, "tid", "left").where("n_links > 0 or n_copies > 1")
        return self.members.join(texts, "tid").select(
            *(F.col(k).alias(n) for k, n in zip(self.keys, self.names, strict=True)), F.coalesce("component", "tid").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies"
        )
