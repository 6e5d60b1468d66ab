"""A stored index for message search: three-character grams, the searched forms, and corpus figures.

A query reads the documents of its rarest grams (a few folders of the gram table), joins them with the stored
forms, and decides exactly on these; no query scans all text unless it has no term of three characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import search
from talkloom.session import cut, scratch_base

FORMS = ("content", "jamo", "nospace")
#: Grams by which candidates of a phrase are found: its rarest ones. More of them leave fewer candidates to look at.
RAREST = 2
#: Characters of forms that a task turns into grams at a time, and documents of a gram that one task of the build sees at most on average.
PIECE, DOCS_A_TASK = 1 << 22, 50_000_000


def _folded(points: np.ndarray) -> np.ndarray:
    """16 bits a character: themselves up to U+FFFF; others share numbers, which only makes more candidates."""
    return (points ^ (points >> 16) * 0x9E37) & 0xFFFF


def gram_code(gram: str) -> int:
    a, b, c = _folded(np.array(list(map(ord, gram)), np.int64)).tolist()
    return a << 32 | b << 16 | c


def _keys(texts: list[str | None]) -> np.ndarray:
    """Code << 14 | row of every gram of ``texts``; nulls and texts under three characters have none."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    p = _folded(np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), sizes)
    if len(p) < 3:
        return p[:0].astype(np.uint64)
    inside = row[2:] == row[:-2]
    return (p[:-2] << 46 | p[1:-1] << 30 | p[2:] << 14 | row[:-2]).astype(np.uint64)[inside]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, docs): the documents of each gram in a run of up to 2^14, from batches (doc, forms)."""
    for batch in batches:
        forms = [batch.column(f).to_pylist() for f in FORMS]
        docs = batch.column("doc").to_numpy()
        sizes = np.cumsum([sum(map(len, filter(None, row))) for row in zip(*forms, strict=True)])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right")))
            stop = min(stop, at + (1 << 14))
            keys = np.unique(np.concatenate([_keys(f[at:stop]) for f in forms]))
            grams, rows = (keys >> np.uint64(14)).astype(np.int64), (keys & np.uint64((1 << 14) - 1)).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(grams)].astype(np.int32)), pa.array(docs[at + rows]))
            yield pa.RecordBatch.from_arrays([pa.array(grams[heads]), lists], ["gram", "docs"])
            at = stop


DOCS = "doc long, chat_id long, message_id long, timestamp long, text string, content string, jamo string, nospace string, length int, block int"


class SearchIndex:
    """The index in ``folder``; ``build`` makes it.

    docs: doc, chat_id, message_id, timestamp, text, the three forms and their length in grams, in folders by block.
    grams: (gram, docs), in folders by bucket. counts: how many documents a gram has. figures: one row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.docs = spark.read.schema(DOCS).parquet(f"{folder}/docs")
        self.figures = spark.read.parquet(f"{folder}/figures").first()

    @classmethod
    def build(cls, messages: DataFrame, folder: str, buckets: int = 8, blocks: int = 8) -> SearchIndex:
        """Indexes ``messages`` (chat_id, message_id, timestamp, text; null text counts as empty). A gram that very many
        documents have is several tasks; ``buckets`` and ``blocks`` should grow with the table."""
        spark = messages.sparkSession
        tasks = spark.sparkContext.defaultParallelism
        if messages.rdd.getNumPartitions() < tasks:  # files of few row groups, which would keep most cores idle
            messages = messages.repartition(tasks)
        forms = search.search_columns(F.col("text"))
        length = lambda c: F.greatest(F.char_length(c) - 2, F.lit(0))
        rows = messages.select("chat_id", "message_id", "timestamp", "text", *(c.alias(n) for n, c in forms.items()))
        rows = rows.withColumn("doc", F.monotonically_increasing_id()).withColumn("length", reduce(lambda a, b: a + b, map(length, FORMS)))
        rows.withColumn("block", F.pmod(F.shiftright("doc", 33), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/docs")
        docs = spark.read.schema(DOCS).parquet(f"{folder}/docs")
        figures = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), F.lit(buckets).alias("buckets"))
        figures.write.parquet(f"{folder}/figures")
        n = spark.read.parquet(f"{folder}/figures").first().n
        salts = n // DOCS_A_TASK + 1  # runs of documents, so that a gram that most have is several tasks
        pairs = docs.select("doc", *FORMS).mapInArrow(_postings, "gram long, docs array<long>").withColumn("bucket", F.pmod("gram", F.lit(buckets)).cast("int"))
        spread = pairs.repartition(buckets * salts, "bucket", F.pmod(F.col("docs")[0], F.lit(salts))).sortWithinPartitions("bucket", "gram")
        spread.write.partitionBy("bucket").parquet(f"{folder}/grams")
        grams = spark.read.schema("gram long, docs array<long>, bucket int").parquet(f"{folder}/grams")
        grams.groupBy("bucket", "gram").agg(F.sum(F.size("docs")).alias("n")).repartition(buckets, "bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{folder}/counts")
        return cls(spark, folder)

    def _rarest(self, phrases: Sequence[str]) -> dict[str, list[int] | None]:
        """The grams to look a phrase up by; None if one of its grams is nowhere. Phrases under three characters have none."""
        buckets = self.figures.buckets
        codes = {p: sorted({gram_code(p[i : i + 3]) for i in range(len(p) - 2)}) for p in phrases}
        wanted = sorted({c for cs in codes.values() for c in cs})
        if not wanted:
            return {p: [] for p in phrases}
        table = self.spark.read.schema("gram long, n long, bucket int").parquet(f"{self.folder}/counts")
        found = {r.gram: r.n for r in table.where(F.col("bucket").isin(sorted({c % buckets for c in wanted})) & F.col("gram").isin(wanted)).collect()}
        return {p: None if any(c not in found for c in cs) else sorted(cs, key=lambda c: found[c])[:RAREST] for p, cs in codes.items()}

    def _candidates(self, lookups: Sequence[Sequence[int]], every: bool = False) -> DataFrame:
        """Documents that have all grams of one of ``lookups`` (of all of them, if ``every``)."""
        wanted = sorted({c for cs in lookups for c in cs})
        grams = self.spark.read.schema("gram long, docs array<long>, bucket int").parquet(f"{self.folder}/grams")
        rows = grams.where(F.col("bucket").isin(sorted({c % self.figures.buckets for c in wanted})) & F.col("gram").isin(wanted))
        has = [F.count_if(F.col("gram").isin(list(cs))) == len(cs) for cs in lookups]
        return rows.select("gram", F.explode("docs").alias("doc")).groupBy("doc").agg(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), has).alias("ok")).where("ok").select("doc")

    def rows(self, phrases: Sequence[str], every: bool = False) -> DataFrame:
        """Documents that may hold one of the phrases (all of them, if ``every``); phrases under three characters tell nothing."""
        lookups = self._rarest(phrases)
        known = [cs for cs in lookups.values() if cs]
        if every and None in lookups.values() or not every and lookups and all(cs is None for cs in lookups.values()):
            return self.docs.limit(0)
        if not known or not every and [] in lookups.values():
            return self.docs
        return self.docs.join(self._candidates(known, every), "doc", "left_semi")

    def bm25(self, query: str) -> DataFrame:
        """As ``search.bm25`` over the indexed messages, by way of the index."""
        plan = search.plan_query(query)
        phrases = plan.phrases if plan.ranked else []
        if not plan.variants or not self.figures.n:
            return self.docs.select("chat_id", "message_id", "timestamp", "text", F.lit(0.0).alias("rank"), F.lit(0).alias("tf_total")).limit(0)
        columns = [F.col(f) for f in FORMS]
        if not plan.ranked:
            raise ValueError("a query without a term of three characters is not ranked")
        times = [reduce(lambda a, b: a + b, (search.occurrences(c, p) for c in columns)).alias(f"t{k}") for k, p in enumerate(phrases)]
        looked = cut(self.rows(phrases).select("chat_id", "message_id", "timestamp", "text", "length", *times).where(" or ".join(f"t{k} > 0" for k in range(len(phrases)))), "search")
        seen = looked.agg(*(F.count_if(F.col(f"t{k}") > 0).alias(f"p{k}") for k in range(len(phrases)))).first()
        score, total = F.lit(0.0), F.lit(0)
        for k in range(len(phrases)):
            n, tf = seen[k], F.col(f"t{k}")
            idf = F.greatest(F.ln(F.lit((self.figures.n - n + 0.5) / (n + 0.5))), F.lit(search.LEAST_IDF))
            score = score + idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("length") / (self.figures.mean or 1.0)))
            total = total + tf
        at = {p: k for k, p in enumerate(phrases)}
        hit = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(f"t{at[t]}") > 0 for t in v)) for v in plan.variants))
        hits = looked.where(hit).select("chat_id", "message_id", "timestamp", "text", F.round(-score, 6).alias("rank"), total.alias("tf_total"))
        # Copies agree in their text, so in all but the time.
        return hits.groupBy("chat_id", "message_id").agg(F.min("timestamp").alias("timestamp"), *(F.first(c).alias(c) for c in ("text", "rank", "tf_total")))

    def contains_all(self, query: str, scope: Column | None = None) -> DataFrame:
        """As ``search.contains_all``: every term in some form. Terms under three characters are looked for in all
        stored forms, others in the candidates of their grams."""
        words = query.strip().lower().split()
        if not words:
            return self.docs.select("chat_id", "message_id", "timestamp", "text").limit(0)
        rows = self.rows(words, every=True)
        if scope is not None:
            rows = rows.where(scope)
        hit = reduce(lambda a, b: a & b, (search._contains([F.col(f) for f in FORMS], w) for w in words))
        return rows.where(hit).groupBy("chat_id", "message_id").agg(F.min("timestamp").alias("timestamp"), F.first("text").alias("text"))


def index_of(spark: SparkSession, messages: DataFrame, path: str) -> SearchIndex:
    """The index of the table at ``path``, made at the first call and found again as long as its files stay the same."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = Path(path).getFileSystem(conf)
    seen = sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in source.listStatus(Path(path)))
    base = f"{scratch_base(spark)}/search-{uuid.uuid5(uuid.NAMESPACE_URL, repr(seen)).hex}"
    fs = Path(base).getFileSystem(conf)
    made = [s.getPath().getName() for s in fs.listStatus(Path(base))] if fs.exists(Path(base)) else []
    ready = sorted(m.removesuffix(".done") for m in made if m.endswith(".done"))
    if ready:
        return SearchIndex(spark, f"{base}/{ready[0]}")
    name = uuid.uuid4().hex[:12]
    size = max(1, sum(s[1] for s in seen) >> 27)
    index = SearchIndex.build(messages, f"{base}/{name}", min(4096, 8 * size), min(4096, 8 * size))
    fs.create(Path(f"{base}/{name}.done"), True).close()
    return index
