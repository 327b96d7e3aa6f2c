"""Mixing sources to target weights, in tokens of a public tokenizer.

A budget is handed down a tree of domain (kind of document), language and source.  A leaf starts with its source's target
times its part of the source's tokens, an inner node with the sum of its leaves (or with weights of its own, where a level
is given some), so without a shortage every source gets its target.  A node takes no more than its capacity, its tokens
times the allowed repeats; what it cannot take goes to its siblings in proportion to their weights, and only what no
sibling can take goes up to the ancestors.  A leaf gives every document as many whole epochs as fit and fills the rest with
the token-prefix of one more epoch in an order seeded by epoch and document.

Sizes: the budgets are computed on the tables of nodes, level by level, by running sums over siblings in the order in
which they fill up; no node reaches the driver.  Plans of at most LEAVES_SENT leaves (a checked size) are sent to every
executor, larger ones are joined by a shuffle.  The prefix of a leaf is found by token sums of hash buckets of some
BUCKET_DOCS documents, so only the bucket in which the budget ends is ordered, never a whole leaf.

Defined results: null texts have no tokens and are not chosen; documents of null sources or of sources without a target
take no part; a null level counts as the empty one; a target without documents is reported with nothing reached; an empty
corpus gives no rows; repeated documents under different ids are different documents; a negative or null weight counts as
zero; of repeated targets of a source the largest counts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.language import label_code
from proofmill.runtime import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAVES_SENT, BUCKET_DOCS = 50_000, 4096
LEVELS = ("doc_kind", "language", "source")


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """key, keep, tokens: the number of tokens of each whole text; special tokens' names count as plain text."""
    columns = [key, *keep]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)

    with open(tokenizer, "rb") as f:  # a vocabulary of some MB, read here and sent, so that executors need no copy
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding(os.path.basename(tokenizer), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(tokens, pa.int64())], names=[*columns, "tokens"])

    return docs.select(*columns, F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull()).mapInArrow(count, f"{fields}, tokens bigint")


def share_out(nodes: DataFrame, parent: list[str], budgets: DataFrame) -> DataFrame:
    """nodes, budget: each parent's budget over its children by `weight`, none above its `capacity`; what a full child cannot
    take goes to its siblings by weight.

    Children are taken in the order in which they fill up (capacity per weight); before each of them the running sums tell
    what is left per weight, and the first that does not fill up sets the level of all that follow.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), *[c for c in nodes.columns if c not in ("weight", "capacity")])
    open_ = nodes.where("weight > 0 and capacity > 0").join(budgets, parent)
    left = F.least("budget", F.sum("capacity").over(group)) - (F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity"))
    levelled = open_.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    filled = levelled.withColumn("full", F.col("level") * F.col("weight") >= F.col("capacity") * (1 - 1e-12))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(group)
    return filled.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(common * F.col("weight"))).drop("level", "full")


def leaf_budgets(leaves: DataFrame, levels: list[str], total: float, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """levels, budget of each leaf (levels, weight, capacity) that gets any, handed down from the root level by level."""
    budgets = leaves.sparkSession.range(1).select(F.lit(0).alias("__root"), F.lit(float(total)).alias("budget"))
    for depth, name in enumerate(levels):
        path = ["__root", *levels[: depth + 1]]
        nodes = leaves.withColumn("__root", F.lit(0)).groupBy(*path).agg(F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"))
        if own := (weights or {}).get(name):
            table = F.create_map(*[F.lit(x) for pair in own.items() for x in (pair[0], float(pair[1]))])
            nodes = nodes.withColumn("weight", F.coalesce(F.element_at(table, F.col(name)), F.lit(0.0)))
        budgets = share_out(nodes, path[:-1], budgets).select(*path, "budget")
    return budgets.drop("__root")


def mix(
    docs: DataFrame, key: str, text: str, targets: DataFrame, levels: tuple[str, ...] = LEVELS, total: int | None = None, seed: int = 17,
    weights: Mapping[str, Mapping[str, float]] | None = None, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """key, source, tokens, repeats of every chosen document.

    levels: the tree from the root down, `source` among them; `language` may be one where the documents have a `lang` label.
    total: tokens of the mixture; by default the tokens of one use of every document that takes part.
    weights: level -> value -> weight, for levels that are to have targets of their own.
    """
    by = list(levels)
    goal = targets.where("source is not null").groupBy("source").agg(F.greatest(F.max("target_share"), F.lit(0.0)).alias("share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("cap"))
    if "language" in by:
        docs = docs.withColumn("language", label_code(F.col("lang")))
    docs = docs.where(F.col("source").isNotNull()).select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by], text)
    sized = cut_lineage(token_counts(spread(docs.join(_sent(goal.select("source"), goal), "source", "left_semi").select(docs.columns)), key, text, by, tokenizer).where("tokens > 0"))
    sizes = sized.groupBy(*by).agg(F.sum("tokens").alias("n"), F.count("*").alias("n_docs"))
    of_source = Window.partitionBy("source")
    leaves = sizes.join(goal, "source").withColumn("weight", F.col("share") * F.col("n") / F.sum("n").over(of_source)).withColumn("capacity", F.col("n").cast("double") * F.col("cap"))
    leaves = cut_lineage(leaves)
    if total is None:
        total = leaves.agg(F.sum("n")).first()[0] or 0
    budgets = leaf_budgets(leaves.select(*by, "weight", "capacity"), by, total, weights).withColumn("b", F.floor(F.col("budget") + 1e-6))
    whole = F.least(F.floor(F.col("b") / F.col("n")), F.col("cap"))
    plan = leaves.join(budgets.where("b > 0").select(*by, "b"), by).withColumn("whole", whole.cast("bigint"))
    plan = plan.select(*by, "whole", F.when(F.col("whole") < F.col("cap"), F.col("b") - F.col("whole") * F.col("n")).otherwise(0).alias("rest"), F.ceil(F.col("n_docs") / BUCKET_DOCS).cast("bigint").alias("n_buckets"))
    plan = cut_lineage(plan)
    placed = sized.join(_sent(plan, plan), by).withColumn("place", F.xxhash64(F.lit(seed), F.col("whole"), key)).withColumn("bucket", F.pmod("place", "n_buckets"))
    # Token-prefix of one more epoch: bucket sums, then the order inside the one bucket where the budget ends.
    sums = placed.where("rest > 0").groupBy(*by, "bucket").agg(F.sum("tokens").alias("in_bucket"), F.max("rest").alias("leaf_rest"))
    upto = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("in_bucket"))
    last = upto.where("before < leaf_rest").groupBy(*by).agg(F.max(F.struct("bucket", "before")).alias("last")).select(*by, F.col("last.bucket").alias("edge"), "last.before")
    marked = placed.join(_sent(last, plan), by, "left")
    run = F.sum("tokens").over(Window.partitionBy(*by, "bucket").orderBy("place", key).rowsBetween(Window.unboundedPreceding, 0))
    at_edge = marked.where("bucket = edge").withColumn("one_more", (F.col("before") + run <= F.col("rest")).cast("int"))
    off_edge = marked.where("edge is null or bucket <> edge").withColumn("one_more", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    chosen = off_edge.unionByName(at_edge).withColumn("repeats", F.col("whole") + F.col("one_more"))
    return chosen.where("repeats > 0").select(key, "source", "tokens", F.col("repeats").cast("int").alias("repeats"))


def _sent(small: DataFrame, counted: DataFrame) -> DataFrame:
    """`small`, which has no more rows than `counted`, marked for sending to every executor if those are few enough."""
    return F.broadcast(small) if counted.limit(LEAVES_SENT + 1).count() <= LEAVES_SENT else small


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_docs, n_tokens, actual_share, max_used: what the mixture reached (a row per target)."""
    got = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("max_used"))
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_docs", "n_tokens", "max_used")}
    return out.withColumns(zero).withColumn("actual_share", F.round(F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy()), 6)).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "actual_share", "max_used")
