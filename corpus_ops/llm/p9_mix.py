"""Sources combined to target shares of all tokens, by capped water-filling.

The documents of each source with a target are counted in tokens of a public tokenizer. A source can give at most
max_repeats times its tokens; one whose share asks for more is held at that, and the excess goes to the others in
proportion to their targets, again and again until all fit. The total is that of all tokens with a target unless given.
A source's repeats r become floor(r) whole repetitions of every document and one more of documents in seeded order until
the fraction is reached: fixed buckets of a hash are summed first, and only the bucket in which the fraction ends is
ordered document by document.

Sources are compared without letter case and outer blanks. A null max_repeats sets no cap; a null, zero or negative
share, and a source without documents, get nothing and their share goes to the rest. Null and empty texts have no tokens
and are left out, as are documents without a source or a target. A source named twice in the targets has its shares
added and the smaller cap. If all sources are held at their caps, the total is smaller than asked for. Documents in two
rows (same doc_id) are taken row by row.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kept, table

#: Folder with a public tokenizer's vocabulary.
TOKENIZERS = os.environ.get("CORPUS_OPS_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 17
BUCKETS = 4096
#: Rows of targets that the driver may read.
MOST_TARGETS = 100_000


@lru_cache(4)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(folder: str = TOKENIZERS, name: str = TOKENIZER):
    """A function of a text column that counts tokens in whole batches."""
    path = os.path.join(folder, name)

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        encode = _tokenizer(path).encode_ordinary
        return pd.Series([len(encode(x)) for x in text.fillna("")], dtype="int64", index=text.index)

    return count


def water_fill(shares: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """The amount of each source: total times its share, none above its most, what is over given to the rest."""
    got, free = {s: 0.0 for s in shares}, {s for s in shares if shares[s] > 0 and most[s] > 0}
    left = total
    while free and left > 0:
        asked = {s: left * shares[s] / sum(shares[x] for x in sorted(free)) for s in free}
        over = {s for s in free if asked[s] >= most[s]}
        if not over:
            return got | asked
        for s in over:
            got[s] = most[s]
        left, free = left - sum(most[s] for s in sorted(over)), free - over
    return got


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.lower(F.trim("source"))
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null").select("doc_id", source.alias("source"), "text")
    wanted = table(spark, sf_dir, "mix_targets").where("target_share > 0").select(source.alias("source")).distinct()
    counted = docs.join(wanted, "source", "left_semi").select("doc_id", "source", token_counts()("text").alias("n_tokens"))
    return kept(counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(BUCKETS)))).where("n_tokens > 0")  # a filter below would count twice


def plan(spark: SparkSession, sf_dir: str, counted: DataFrame, total: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, n_tokens (there are), repeats (to take, with a fraction)."""
    asked = table(spark, sf_dir, "mix_targets").where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    there = counted.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    rows = asked.join(there, "source", "left").orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    share = {r.source: float(r.target_share or 0.0) for r in rows}
    most = {r.source: float("inf") if r.max_repeats is None and r.n_tokens else float(max(r.max_repeats or 0, 0) * (r.n_tokens or 0)) for r in rows}
    total = float(sum(r.n_tokens or 0 for r in rows)) if total is None else total
    got = water_fill(share, most, total)
    out = [(r.source, share[r.source], r.max_repeats, r.n_tokens or 0, got[r.source] / r.n_tokens if r.n_tokens else 0.0) for r in rows]
    return spark.createDataFrame(out, "source string, target_share double, max_repeats long, n_tokens long, repeats double")


def chosen(counted: DataFrame, planned: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, n_repeats of the documents taken at least once."""
    parts = planned.select("source", F.floor("repeats").alias("whole"), ((F.col("repeats") - F.floor("repeats")) * F.col("n_tokens")).alias("rest"))
    sums = counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    # at most BUCKETS rows for each source
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"), "n").join(F.broadcast(parts), "source")
    state = F.when(F.col("before") + F.col("n") <= F.col("rest"), "all").when(F.col("before") >= F.col("rest"), "none").otherwise("part")
    rows = counted.join(before.select("source", "bucket", "whole", "rest", "before", state.alias("state")), ["source", "bucket"])
    order = W.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id")
    parted = rows.where("state = 'part'").withColumn("up_to", F.col("before") + F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    more = F.when(F.col("up_to") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    columns = ["doc_id", "source", "n_tokens"]
    taken = parted.select(*columns, (F.col("whole") + more).alias("n_repeats"))
    whole = rows.where("state <> 'part'").select(*columns, (F.col("whole") + F.when(F.col("state") == "all", 1).otherwise(0)).alias("n_repeats"))
    return whole.unionByName(taken).where("n_repeats > 0")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, n_repeats of each document in the mix."""
    counted = _counted(spark, sf_dir)
    return chosen(counted, plan(spark, sf_dir, counted))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source with a target: target_share, max_repeats, n_tokens (there are), repeats, mixed_tokens, reached_share, most_repeats (of a document)."""
    counted = _counted(spark, sf_dir)
    planned = plan(spark, sf_dir, counted)
    mixed = chosen(counted, planned).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("mixed_tokens"), F.max("n_repeats").alias("most_repeats"))
    every = planned.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = every.agg(F.sum("mixed_tokens").alias("total"))
    share = F.when(F.col("total") > 0, F.col("mixed_tokens") / F.col("total")).otherwise(0.0)
    return every.join(F.broadcast(total)).select("source", "target_share", "max_repeats", "n_tokens", "repeats", "mixed_tokens", share.alias("reached_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
