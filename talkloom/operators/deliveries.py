"""Exactly one row per message out of at-least-once deliveries.

Only the identifier, the delivery order and the position of each row (file, row number) are shuffled.
The winners become one bit vector per file; the wide columns are then read by row groups in the tasks, the
vector is applied while reading, and no payload is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.session import cut

#: Bytes that a task reads, and the most tasks of a read.
TASK_BYTES, MOST_TASKS = 128 << 20, 50_000
#: Opens a path that Spark names: (file system, path in it).
Opener = Callable[[str], tuple[pafs.FileSystem, str]]
#: Positions in one bit vector of ``bitmap_construct_agg``; a fixed value of Spark.
CHUNK = 32768


def _file_hash(path: Column | str) -> Column:
    """Hash of a file's path; local paths come as file:/x or file:///x."""
    c = F.col(path) if isinstance(path, str) else path
    return F.xxhash64(F.when(c.startswith("file:///"), F.substring(c, 8, 1 << 30)).when(c.startswith("file:/"), F.substring(c, 6, 1 << 30)).otherwise(c))


def _winners(spark: SparkSession, path: str, schema: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """key, file, row and n_copies of each surviving row."""
    meta = "__pos"
    rows = spark.read.schema(schema).parquet(path)
    narrow = rows.select(
        *key,
        *(c for c in order if c not in key),
        _file_hash("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    # A row without a full identifier has no copies: its own position completes its key.
    lone = F.when(F.greatest(*(F.col(k).isNull().cast("int") for k in key)) == 1, F.struct("__file", "__row"))
    best = F.min(F.struct(*(F.col(c).isNull().alias(f"n_{c}") if k == 0 else F.col(c) for c in order for k in (0, 1)), "__file", "__row"))
    grouped = narrow.groupBy(*key, lone.alias("__lone")).agg(best.alias(meta), F.count("*").alias("n_copies"))
    return grouped.select(*key, F.col(f"{meta}.__file").alias("__file"), F.col(f"{meta}.__row").alias("__row"), "n_copies")


def deletion_vectors(spark: SparkSession, path: str, schema: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per file and run of 32768 rows: file (hash of its path), part, and a bit for each row kept.

    Rows whose bit is 0, parts and files that are absent are deleted. Positions, not identifiers, are
    shuffled here, and are packed after the shuffle, as packing them before it would make them larger.
    """
    kept = _winners(spark, path, schema, key, order).select("__file", "__row")
    part = F.expr(f"__row div {CHUNK}").alias("part")
    return (
        kept.select(F.col("__file").alias("file"), part, (F.col("__row") % CHUNK).alias("bit"))
        .repartition("file", "part")
        .groupBy("file", "part")
        .agg(F.bitmap_construct_agg("bit").alias("kept"))
    )


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it. Clusters whose storage needs other settings
    than its address gives pass a function of their own."""
    system, inner = pafs.FileSystem.from_uri(path)
    return (system, inner) if system.get_file_info(inner).type != pafs.FileType.NotFound else (system, unquote(inner))


def row_groups(rows: DataFrame, open_file: Opener = file_system) -> DataFrame:
    """(path, file, unit, start, n, bytes) of every row group of the files of ``rows``, from their footers.

    Files are listed by the scan and opened in tasks, so nothing of them is collected. Two paths with one hash are
    an error.
    """
    paths = rows.select("_metadata.file_path").distinct().select(F.col("file_path").alias("path"), _file_hash("file_path").alias("file"))
    one = paths.groupBy("file").agg(F.min("path").alias("path"), F.max("path").alias("other"))
    one = one.select("file", F.when(F.col("path") == F.col("other"), F.col("path")).otherwise(F.raise_error(F.lit("two files with one hash"))).alias("path"))

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                system, inner = open_file(item["path"])
                with pq.ParquetFile(inner, filesystem=system) as f:
                    groups = [f.metadata.row_group(g) for g in range(f.metadata.num_row_groups)]
                n = [g.num_rows for g in groups]
                out = {"path": [item["path"]] * len(n), "file": [item["file"]] * len(n), "unit": list(range(len(n))), "start": list(accumulate(n, initial=0))[:-1], "n": n, "bytes": [g.total_byte_size for g in groups]}
                yield pa.RecordBatch.from_pydict(out, pa.schema([("path", pa.string()), ("file", pa.int64()), ("unit", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64())]))

    return one.repartition("file").mapInArrow(footers, "path string, file long, unit int, start long, n long, bytes long")


def read_through(
    spark: SparkSession, path: str, schema: str, vectors: DataFrame, columns: Sequence[str], deleted: bool = False, open_file: Opener = file_system
) -> DataFrame:
    """Columns of the rows that ``vectors`` keeps (or, with ``deleted``, of those it deletes).

    The unit of work is a row group, so a large file is many tasks; their number follows the bytes to read and
    not the number of files. Tasks open files themselves, skip row groups of which nothing remains, and hand on Arrow
    batches. A lost executor repeats its row groups only.
    """
    rows = spark.read.schema(schema).parquet(path)
    wanted = rows.select(*columns).schema
    units = cut(row_groups(rows, open_file), "row-groups")
    size = units.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    if not size.n:
        return spark.createDataFrame([], wanted)
    tasks = min(size.n, MOST_TASKS, max(spark.sparkContext.defaultParallelism, size.b // TASK_BYTES + 1))
    parts = units.select("*", F.explode(F.expr(f"sequence(start div {CHUNK}, (start + greatest(n, 1) - 1) div {CHUNK})")).alias("part"))
    work = (
        parts.join(vectors, ["file", "part"], "left")
        .groupBy("path", "unit", "start", "n")
        .agg(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("part", "kept"))).alias("vectors"))
        .repartition(tasks, "path", "unit")
    )
    names = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                bits = _bits({v["part"]: v["kept"] for v in item["vectors"]}, item["start"], item["n"]) != deleted
                if bits.any():
                    yield from _read_group(open_file(item["path"]), item["unit"], bits, names)

    return work.mapInArrow(read, wanted)


def _read_group(where: tuple[pafs.FileSystem, str], group: int, bits: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    system, inner = where
    with pq.ParquetFile(inner, filesystem=system) as f:
        at = 0
        for batch in f.iter_batches(65536, row_groups=[group], columns=names):
            mask = bits[at : at + batch.num_rows]
            at += batch.num_rows
            if mask.any():
                out = batch.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([out.column(c) for c in names], names)


def _bits(vectors: dict[int, bytes], start: int, n: int) -> np.ndarray:
    """Bits of the rows start .. start + n of a file."""
    first, last = start // CHUNK, (start + max(n, 1) - 1) // CHUNK
    empty = bytes(CHUNK // 8)
    raw = np.frombuffer(b"".join(vectors.get(p) or empty for p in range(first, last + 1)), np.uint8)
    bits = np.unpackbits(raw, bitorder="little").astype(bool)
    return bits[start - first * CHUNK : start - first * CHUNK + n]


def deduplicate(
    spark: SparkSession, path: str, schema: str, key: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, open_file: Opener = file_system
) -> DataFrame:
    """Exactly one row per ``key``: the first in ``order`` (nulls last, then file and row number).

    Rows with a null in the key have no copies and all stay. Equal rows count as copies like any other.
    ``columns`` may name any columns of the files; an empty table gives an empty result. A key with any
    share of the rows is combined before the shuffle.
    """
    columns = list(columns or spark.read.schema(schema).parquet(path).columns)
    return read_through(spark, path, schema, deletion_vectors(spark, path, schema, key, order), columns, open_file=open_file)


def redelivered(spark: SparkSession, path: str, schema: str, key: Sequence[str], order: Sequence[str], open_file: Opener = file_system) -> DataFrame:
    """Keys that were delivered more than once: those of the rows that the vectors delete."""
    return read_through(spark, path, schema, deletion_vectors(spark, path, schema, key, order), key, deleted=True, open_file=open_file).distinct()
