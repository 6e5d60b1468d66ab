"""Long exact spans that stand in more than one record.

Every window of the wanted length is represented by a minimiser. Each partition counts these in a
count-min sketch; the sketches are merged, and as they only overestimate, a second pass has to group
exactly no other windows than those estimated repeated. No window that repeats is lost. The sketch has a
bounded size; where a corpus outgrows it, more windows are grouped, at most about as many bytes as the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.arrowtext import Rolling, code_points, mix, row_of
from talkloom.llm.arrowtext import pieces as pieces_of
from talkloom.session import cut

#: Counters of a sketch row lie between these powers of two, whatever the input; a sketch has two rows of 2-bit counters.
LEAST_BITS, MOST_BITS = 16, 26
#: Counters of a piece in which sketches are merged.
PIECE_BITS = 20


class Sketch:
    """Two rows of counters that saturate at 2: enough to tell windows that may repeat."""

    def __init__(self, bits: int, rows: np.ndarray | None = None):
        self.bits = bits
        self.rows = np.zeros((2, 1 << bits), np.uint8) if rows is None else rows

    def _cells(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64), (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for row, cells in zip(self.rows, self._cells(hashes), strict=True):
            # Written and read back, the last writer of a cell stays: all others met it before.
            fresh = row[cells] == 0
            cells, again = cells[fresh], cells[~fresh]
            order = np.arange(len(cells), dtype=np.int32)
            seen = np.full(0, 0)
            if len(cells):
                owner = _owners(cells, order)
                seen = cells[owner != order]
            row[cells] = 1
            row[seen] = 2
            row[again] = 2

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self._cells(hashes)
        return (self.rows[0][a] == 2) & (self.rows[1][b] == 2)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(number, compressed 2-bit counters) of the pieces that aren't empty."""
        step = 1 << min(PIECE_BITS, self.bits)
        pack = zstandard.ZstdCompressor(level=1)
        for k, piece in enumerate(self.rows.reshape(-1, step)):
            if piece.any():
                q = piece.reshape(-1, 4)
                yield k, pack.compress((q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes())

    @classmethod
    def from_pieces(cls, bits: int, pieces: list[tuple[int, bytes]]) -> Sketch:
        step = 1 << min(PIECE_BITS, bits)
        rows = np.zeros((2 << bits) // step * step, np.uint8).reshape(-1, step)
        for k, raw in pieces:
            np.minimum(rows[k] + _unpack(raw), 2, out=rows[k])
        return cls(bits, rows.reshape(2, 1 << bits))


def _owners(cells: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each entry the position of one entry with the same cell, the same for all of a cell."""
    ranks = np.argsort(cells, kind="stable")
    sorted_ = cells[ranks]
    heads = np.r_[True, sorted_[1:] != sorted_[:-1]]
    owner = np.empty(len(cells), np.int32)
    owner[ranks] = ranks[np.flatnonzero(heads)][np.cumsum(heads) - 1]
    return owner


def _unpack(raw: bytes) -> np.ndarray:
    q = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.stack([q >> s & 3 for s in (0, 2, 4, 6)], 1).reshape(-1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up pieces that arrive sorted by number."""
    pack, number, total = zstandard.ZstdCompressor(level=1), None, None

    def done() -> pa.RecordBatch:
        q = total.reshape(-1, 4)
        raw = pack.compress((q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_pydict({"piece": [number], "counters": [raw]}, schema=pa.schema([("piece", pa.int32()), ("counters", pa.binary())]))

    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if number is not None and k != number:
                yield done()
                total = None
            number = k
            total = _unpack(raw) if total is None else np.minimum(total + _unpack(raw), 2)
    if number is not None:
        yield done()


def _starts(offsets: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and global position of each window of ``length`` that lies within one row."""
    row = row_of(offsets)
    start = np.flatnonzero(row[: n - length + 1] == row[length - 1 :]) if n >= length else np.empty(0, np.int64)
    return row[start], start


def _minimisers(p: np.ndarray, start: np.ndarray, length: int, rolling: Rolling) -> np.ndarray:
    """The least hash of the shorter windows inside each window; equal windows have the same."""
    least, covered, wanted = rolling(p), 1, length - rolling.width + 1
    while covered < wanted:
        step = min(covered, wanted - covered)
        least = np.minimum(least[: len(least) - step], least[step:])
        covered += step
    return mix(least[start])


def _changes(row: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a row's minimiser differs from that of the window before: each row has each of its minimisers at least once."""
    return np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])][: len(least)])


def _selected(text: pa.Array, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    p, offsets = code_points(text)
    row, start = _starts(offsets, len(p), length)
    if not len(start):
        return row, np.empty(0, np.uint64)
    least = _minimisers(p, start, length, rolling)
    at = _changes(row, least)
    return row[at], least[at]


def repeated_windows(rows: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(hash, hash2, key, position, previous) of the windows of ``length`` code points that may repeat.

    Counted are minimisers: of each window the least hash of its parts of three quarters of the length. A
    window that stands in two records brings its minimiser in both, so none is lost, and about one in
    ``length`` / 8 positions is counted. Minimisers estimated repeated are grouped exactly; only records that
    hold a repeated one are read again, and only their windows over it come out. ``previous`` is the code
    point before the window, -1 at the start of the text.
    """
    spark: SparkSession = rows.sparkSession
    part = max(1, length * 3 // 4)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    total = rows.agg(F.sum(F.greatest(F.char_length("text") - (length - 1), F.lit(0)))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, int(total * 8 // (length - part + 1)).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, rolling = Sketch(bits), Rolling(part)
        for b in (x for batch in batches for x in pieces_of(batch, "text")):
            sketch.add(_selected(b.column(0), length, rolling)[1])
        for k, raw in sketch.pieces():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counters": pa.array([raw], pa.binary())})

    schema = "piece int, counters binary"
    pieces = rows.select("text").mapInArrow(count, schema)
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge, schema).collect()
    shared = spark.sparkContext.broadcast([(r.piece, bytes(r.counters)) for r in merged])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, rolling = Sketch.from_pieces(bits, shared.value), Rolling(part)
        for b in (x for batch in batches for x in pieces_of(batch, "text")):
            row, least = _selected(b.column("text"), length, rolling)
            keep = sketch.repeated(least)
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row[keep])), pa.array(least[keep].view(np.int64))], ["key", "mini"])

    estimated = cut(rows.mapInArrow(seeds, "key long, mini long"), "seeds")
    really = estimated.groupBy("mini").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("mini")
    by_record = estimated.join(really, "mini").groupBy("key").agg(F.collect_set("mini").alias("minis"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, first, second = Rolling(part), Rolling(length), Rolling(length, 0xD6E8FEB86659FD93 | 1, 7)
        for b in (x for batch in batches for x in pieces_of(batch, "text")):
            p, offsets = code_points(b.column("text"))
            row, start = _starts(offsets, len(p), length)
            if not len(start):
                continue
            least = _minimisers(p, start, length, rolling)
            minis = b.column("minis")
            owner = np.repeat(np.arange(len(minis)), minis.value_lengths().to_numpy())
            known = minis.flatten().to_numpy().view(np.uint64)
            keep = np.isin(mix(least ^ mix(row.astype(np.uint64))), mix(known ^ mix(owner.astype(np.uint64))))
            row, start = row[keep], start[keep]
            if len(start):
                at = start - offsets[row]
                before = np.where(at == 0, -1, p[np.maximum(start - 1, 0)].astype(np.int32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first(p)[start].view(np.int64)),
                        pa.array((second(p)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        b.column("key").take(pa.array(row)),
                        pa.array(at.astype(np.int32)),
                        pa.array(before),
                    ],
                    ["hash", "hash2", "key", "position", "previous"],
                )

    return rows.join(by_record, "key").mapInArrow(pick, "hash long, hash2 int, key long, position int, previous int")


def windows_of(rows: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``repeated_windows``, written once. 96 bits of hash tell windows apart."""
    return cut(repeated_windows(rows, key, text, length), "windows")


def _groups(windows: DataFrame) -> DataFrame:
    """(hash, hash2, p, q) of the windows that really stand in two records or more."""
    ends = windows.groupBy("hash", "hash2").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("previous").alias("p"), F.max("previous").alias("q"))
    return ends.where("a <> b").select("hash", "hash2", "p", "q")


def shared_pairs(windows: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records with a common span. Each span of a pair is met once, at its beginning.

    Only groups of windows of which some two may begin a span are looked at: their previous characters
    differ, or a text begins there. These are few; they are written first, so that their size is known to the join.
    """
    first = cut(_groups(windows).where("p <> q or p = -1").select("hash", "hash2"), "starts")
    starts = windows.join(first, ["hash", "hash2"], "left_semi").select("hash", "hash2", "key", "previous").distinct()
    a, b = (starts.select("hash", "hash2", F.col("key").alias(f"key_{x}"), F.col("previous").alias(f"p_{x}")) for x in "ab")
    differ = (F.col("key_a") < F.col("key_b")) & ((F.col("p_a") != F.col("p_b")) | (F.col("p_a") == -1))
    return a.join(b, ["hash", "hash2"]).where(differ).select("key_a", "key_b").distinct()


def shared_share(windows: DataFrame, rows: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(key, n_chars, shared_chars, shared_share): how much of each record stands elsewhere too.

    Covered are the characters of all windows shared; neighbouring windows are joined by their positions.
    Records with nothing shared come out with 0, null text as 0 characters, null keys not at all.
    """
    shared = windows.join(_groups(windows), ["hash", "hash2"], "left_semi")
    order = Window.partitionBy("key").orderBy("position")
    gap = F.coalesce(F.col("position") - F.lag("position").over(order), F.lit(length))
    covered = shared.select("key", "position").distinct().select("key", F.least(gap, F.lit(length)).alias("new")).groupBy("key").agg(F.sum("new").cast("long").alias("shared_chars"))
    all_rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))
    n_shared = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return all_rows.join(covered, "key", "left").select(
        "key", "n_chars", n_shared.alias("shared_chars"), F.round(n_shared / F.greatest("n_chars", F.lit(1)), 6).alias("shared_share")
    )
