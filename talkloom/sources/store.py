"""Store access: lookups, settings, ingest from JSON, tables that are committed whole, sealed values."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "chat_id long, message_id long, sender_id long, sender_name string, timestamp long, text string"


def point_lookup(rows: DataFrame, **key) -> DataFrame:
    """The row with that key, or none; the filter reaches the scan."""
    for c, v in key.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows.limit(1)


def setting(value: Column, default: int) -> Column:
    """A setting as a whole number; the default if it is missing or no number."""
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of incoming messages as rows of messages; an unknown sender is 0."""
    return to_messages(spark.read.schema(BATCH).json(path))


def stream_batches(spark: SparkSession, folder: str) -> DataFrame:
    return to_messages(spark.readStream.schema(BATCH).json(folder))


def to_messages(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "message_id", "chat_id", "timestamp", text.alias("text_plain"), F.regexp_replace(text, r"(?U)\s+", "").alias("text_stripped"),
        F.coalesce("sender_id", F.lit(0).cast("long")).alias("sender_id"), F.when(text == "", "D").otherwise("U").alias("op"),
    )


def read_ops(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """One operation per line (op, seq, payload); lines that don't parse come with status 'error'."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"op string, seq long, payload struct<{payload}>")
    out = lines.select("value", parsed.alias("p"))
    return out.select("p.op", "p.seq", "p.payload", F.when(F.col("p.op").isNull() | F.col("p.seq").isNull(), "error").otherwise("ok").alias("status"))


class VersionedTable:
    """A table in parts, each written whole; a commit file per version tells where every part lies.

    A part is a hash bucket of ``keys`` or, with ``by``, a value of a column or expression (such as a day); without
    both the table is one part. A commit writes new folders for the parts it replaces, beside those in use, and counts only
    when its commit file is in place: one that fails changes nothing, parts not named keep their files, and
    nothing is ever overwritten. Commit files are read and written through the file system of the table,
    whatever it is; they hold one line a part. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str] = (), buckets: int = 1, by: str | Column | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        named = F.col(by) if isinstance(by, str) else by
        self._part = named.cast("string") if named is not None else F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string") if keys and buckets > 1 else F.lit("0")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._commits = f"{self.folder}/_commits"

    def version(self) -> int:
        """The current version, 0 if there is none. Only a missing folder means none; other faults are errors."""
        if not self._fs.exists(self._path(self._commits)):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self._commits))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _note(self, v: int) -> dict:
        if not v:
            return {"batch": -1, "parts": {}}
        stream = self._fs.open(self._path(f"{self._commits}/{v}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def parts(self, version: int | None = None) -> dict[str, str]:
        """Folder of each part."""
        return self._note(self.version() if version is None else version)["parts"]

    def parts_of(self, rows: DataFrame) -> list[str]:
        """The parts that ``rows`` fall in: never more than the table has buckets or values of its column."""
        return [r[0] for r in rows.select(self._part.alias("p")).where("p is not null").distinct().collect()]

    def read(self, version: int | None = None, only: Collection[str] | None = None) -> DataFrame:
        """The rows of a version; with ``only``, of those parts: other parts' files are not even listed."""
        found = self.parts(version)
        paths = [f"{self.folder}/{d}" for p, d in found.items() if only is None or p in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def commit(self, rows: DataFrame, batch_id: int | None = None, only: Collection[str] | None = None) -> int:
        """Writes ``rows`` as the next version: in place of all parts or, with ``only``, of those parts (a null part
        is an error). A streaming batch that was committed already does nothing."""
        last = self.version()
        note = self._note(last)
        if batch_id is not None and note["batch"] >= batch_id:
            return last
        v = last + 1
        data = f"v={v}-{uuid.uuid4().hex[:8]}"
        # Files may move into place one by one: nobody looks at them before the commit file is there.
        part = F.coalesce(self._part, F.raise_error(F.lit("row without part")).cast("string"))
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        rows.select(*names, part.alias("part__")).write.partitionBy("part__").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder}/{data}")
        written = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/{data}"))]
        new = {unquote(n.removeprefix("part__=")): f"{data}/{n}" for n in written if n.startswith("part__=")}
        if only is not None and set(new) - set(only):
            raise ValueError("rows of parts that are not to be replaced")
        kept = {} if only is None else {p: d for p, d in note["parts"].items() if p not in only}
        text = json.dumps({"batch": note["batch"] if batch_id is None else batch_id, "parts": kept | new})
        out = self._fs.create(self._path(f"{self._commits}/.{v}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self._commits}/{v}")
        if self._fs.exists(target) or not self._fs.rename(self._path(f"{self._commits}/.{v}.tmp"), target):
            raise OSError(f"version {v} was committed by someone else")
        return v

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int | None = None) -> int:
        """Replaces the parts that ``changes`` fall in by ``combine(their rows, changes)``; other parts keep their files."""
        touched = self.parts_of(changes)
        return self.commit(combine(self.read(only=touched), changes), batch_id, touched)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last ``keep`` versions uses; returns how many."""
        last = self.version()
        used = {d.split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for d in self.parts(v).values()}
        old = [f.getPath() for f in self._fs.listStatus(self._path(self.folder)) if f.getPath().getName().startswith("v=") and f.getPath().getName() not in used]
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def truncate(self) -> int:
        return self.commit(self.spark.createDataFrame([], self.schema))


def seal(value: Column, key: Column) -> Column:
    """AES-GCM with a random nonce in front and the tag behind."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def unseal(value: Column, key: Column) -> Column:
    """The inverse; null if it was changed or is too short."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"))
