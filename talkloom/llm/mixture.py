"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domain, language and source; a leaf that cannot use its budget, even repeating
its documents as often as allowed, hands the shortage to its siblings first, then to the nearest ancestor
that still has room. Each leaf fills its budget with whole epochs and the token prefix of a seeded one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.session import cut

TOKENIZER = os.environ.get("TALKLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The split pattern of that vocabulary; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of the seeded order in which a leaf is summed up before its last range is cut exactly.
RANGES = 4096


def count_tokens(rows: DataFrame, text: str, to: str = "tokens", vocabulary: str = TOKENIZER) -> DataFrame:
    """``rows`` without ``text``, with the number of its tokens. Null and empty text have 0."""
    others = [f for f in rows.schema.fields if f.name != text]
    # Every executor gets the file; it need not be there before.
    rows.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(text).to_pylist()]
            kept = b.select([f.name for f in others])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64())], [*kept.schema.names, to])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField(to, T.LongType())]))


def budgets(leaves: list[dict], total: float) -> dict[tuple, float]:
    """Tokens to draw of each leaf.

    ``leaves`` have path (a tuple from the root down), weight, and capacity (tokens times repeats). Water
    filling: at each node a budget is shared by weight; children that cannot take their part are filled and
    the rest is shared again among their siblings; what a whole node cannot take goes up to its parent, where
    its own siblings get it. So shortages stay as near as they can. With too little capacity in all, all of it is used.
    """
    tree: dict[tuple, list[tuple]] = {}
    weight: dict[tuple, float] = {}
    room: dict[tuple, float] = {}
    for leaf in leaves:
        path = tuple(leaf["path"])
        for d in range(len(path) + 1):
            node = path[:d]
            weight[node] = weight.get(node, 0.0) + leaf["weight"]
            room[node] = room.get(node, 0.0) + leaf["capacity"]
            if d:
                children = tree.setdefault(path[: d - 1], [])
                if node not in children:
                    children.append(node)
    out: dict[tuple, float] = {}

    def share(node: tuple, amount: float) -> None:
        children = tree.get(node)
        if not children:
            out[node] = min(amount, room[node])
            return
        parts = dict.fromkeys(children, 0.0)
        open_, left = sorted(children), min(amount, room[node])
        while open_ and left > 1e-9:
            base = sum(weight[c] for c in open_)
            # Children without weight take something only if all that have weight are full.
            portion = {c: left * (weight[c] / base) if base else left / len(open_) for c in open_}
            full = [c for c in open_ if parts[c] + portion[c] >= room[c] - 1e-9]
            if not full:
                for c in open_:
                    parts[c] += portion[c]
                break
            for c in full:
                left -= room[c] - parts[c]
                parts[c] = room[c]
            open_ = [c for c in open_ if c not in full]
        for c in children:
            share(c, parts[c])

    if leaves:
        share((), total)
    return out


def _language(column: Column) -> Column:
    return F.coalesce(F.lower(F.trim(column)), F.lit("und"))


class Mixture:
    """A mixture of ``docs`` (doc_id, text, lang, source) to ``targets`` (source, target_share, max_repeats).

    Documents without a source or id, or of a source without target, are not drawn; the total to aim for is
    the tokens of all documents with a source. Null languages are one language. A language's weight within a
    source is its share of the source's tokens. Targets are a small table; of a repeated source the greatest
    share and repeats hold, null shares and repeats count as 0 and 1. ``domains`` gives the domain of each source ("other", if
    not named). Equal ids count as different rows.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, domains: Mapping[str, str] | None = None, seed: int = 1, vocabulary: str = TOKENIZER):
        domains = domains or {}
        rows = docs.where("source is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", _language(F.col("lang")).alias("lang"), "text")
        counted = count_tokens(rows, "text", vocabulary=vocabulary)
        order = F.xxhash64(F.lit(seed), "doc_id")
        self.docs = cut(counted.withColumn("order", order).withColumn("range", F.pmod(F.shiftrightunsigned("order", 52), F.lit(RANGES)).cast("int")), "tokens")
        # One row per source and language comes to the driver; documents never do.
        sums = self.docs.groupBy("source", "lang", "range").agg(F.sum("tokens").alias("tokens"))
        leaves = [r.asDict() for r in sums.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()]
        wanted = {
            r.source: (r.s, r.k)
            for r in targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("s"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("k")).collect()
        }
        self.total = sum(x["tokens"] for x in leaves)
        by_source: dict[str, int] = {}
        for x in leaves:
            by_source[x["source"]] = by_source.get(x["source"], 0) + x["tokens"]
        tree = []
        for x in leaves:
            share, repeats = wanted.get(x["source"], (0.0, 0))
            part = x["tokens"] / by_source[x["source"]] if by_source[x["source"]] else 0.0
            tree.append({"path": (domains.get(x["source"], "other"), x["lang"], x["source"]), "weight": share * part, "capacity": float(x["tokens"] * repeats)})
        drawn = budgets(tree, float(self.total))
        spark = docs.sparkSession
        plan = []
        for x in leaves:
            amount = drawn[domains.get(x["source"], "other"), x["lang"], x["source"]]
            epochs = int(amount // x["tokens"]) if x["tokens"] else 0
            plan.append((x["source"], x["lang"], epochs, float(amount - epochs * x["tokens"])))
        self.plan = spark.createDataFrame(plan, "source string, lang string, epochs int, rest double")
        self.targets = spark.createDataFrame([(s, float(a), int(k)) for s, (a, k) in wanted.items()], "source string, target_share double, max_repeats int")
        self.sums = sums

    def drawn(self) -> DataFrame:
        """(doc_id, source, lang, tokens, uses): the documents used at least once.

        A leaf's last epoch ends with the document before the one that would reach beyond the budget. To find
        it, tokens are summed per range of the seeded order; only the range that holds the end is sorted.
        """
        leaf = ["source", "lang"]
        along = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        before = self.sums.withColumn("before", F.coalesce(F.sum("tokens").over(along), F.lit(0))).withColumnRenamed("tokens", "in_range")
        edge = before.join(self.plan, leaf).select(*leaf, "range", "epochs", "rest", "before", "in_range")
        rows = self.docs.join(edge, [*leaf, "range"])
        whole = rows.where("before + in_range <= rest").withColumn("extra", F.lit(1))
        none = rows.where("before >= rest").withColumn("extra", F.lit(0))
        within = Window.partitionBy(*leaf, "range").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cross = rows.where("before < rest and before + in_range > rest")
        cross = cross.withColumn("extra", (F.col("before") + F.sum("tokens").over(within) <= F.col("rest")).cast("int"))
        uses = F.col("epochs") + F.col("extra")
        out = whole.unionByName(none).unionByName(cross).select("doc_id", "source", "lang", "tokens", uses.alias("uses"))
        return out.where("uses > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, tokens_available, tokens_drawn, actual_share, most_uses, max_repeats) of every target."""
        used = self.drawn().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_drawn"), F.max("uses").alias("most_uses"))
        there = self.sums.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
        zero = F.lit(0).cast("long")
        joined = self.targets.join(there, "source", "left").join(used, "source", "left")
        all_drawn = F.sum(F.coalesce("tokens_drawn", zero)).over(Window.partitionBy())
        return joined.select(
            "source",
            "target_share",
            F.coalesce("tokens_available", zero).alias("tokens_available"),
            F.coalesce("tokens_drawn", zero).alias("tokens_drawn"),
            F.round(F.coalesce("tokens_drawn", zero) / F.greatest(all_drawn, F.lit(1)), 6).alias("actual_share"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            "max_repeats",
        )
