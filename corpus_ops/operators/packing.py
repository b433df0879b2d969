"""Splits, shards, token windows and supervised examples.

A document's split comes from a hash of its source, a shard from the lengths in order: a shard is closed by the first
document that fills it. Null sources hash like empty ones; documents without tokens are left out. Sampling draws from
generators seeded by (seed, split, step), so the same step always gives the same windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tokens
from ..storage import kept, table
from .chat import END, START, chats, record_text, turns

#: Sizes of shards and of the held-out part.
SHARD_TOKENS = 256 * 1024 * 1024
MIN_VAL_DOCS, MAX_VAL, VAL = 8, 0.1, 0.005
STOLEN, MIN_VAL_EXAMPLES, VAL_EXAMPLES = 65_536, 4, 0.05
IGNORE = -100


def bucket(source: Column) -> Column:
    """The SHA-256 of a source, as a number, modulo 10,000; chunk by chunk, as the number has 256 bits."""
    digest = F.sha2(F.coalesce(source, F.lit("")), 256)
    total = F.lit(0).cast("long")
    for i in range(16):
        total = total + F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long") * pow(65536, 15 - i, 10_000)
    return F.pmod(total, F.lit(10_000))


def is_val(source: Column, fraction: Column | float) -> Column:
    fraction = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return (fraction > 0) & (bucket(source) < fraction * 10_000)


def effective(n: Column, fraction: float) -> Column:
    """The fraction that gives a handful of held-out documents."""
    return F.when((n > 0) & (F.lit(fraction) > 0) & (n * fraction < MIN_VAL_DOCS), F.least(F.lit(MAX_VAL), MIN_VAL_DOCS / n)).otherwise(F.lit(float(fraction)))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, source, n_chars, n: each record's rendered text in word tokens, and one for its end."""
    text = record_text(F.col("text"), turns(F.col("messages")))
    rows = table(spark, sf_dir, "records").select("rec_id", "source", text.alias("t")).where(F.col("t") != "")
    return rows.select("rec_id", "source", F.length("t").cast("long").alias("n_chars"), (F.size(tokens(F.col("t"))) + 1).cast("long").alias("n"))


def in_splits(docs: DataFrame, fraction: float = VAL) -> DataFrame:
    docs = kept(docs).where("n > 1")
    total = docs.agg(F.count("*").alias("total"))
    share = effective(F.col("total"), fraction)
    return docs.join(F.broadcast(total)).withColumn("split", F.when(is_val(F.col("source"), share), "val").otherwise("train")).drop("total")


def running(docs: DataFrame, order: str, n: str) -> DataFrame:
    """docs with up_to: the sum of n up to and with each row, by split. Partitions are summed first, then each adds to what is before it."""
    parts = kept(docs.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("split", "part").agg(F.sum(n).alias("s"))
    before = sums.select("split", "part", F.coalesce(F.sum("s").over(W.partitionBy("split").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("split", "part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return parts.join(F.broadcast(before), ["split", "part"]).withColumn("up_to", F.sum(n).over(inside) + F.col("before")).drop("before", "part")


def shards(docs: DataFrame, order: str, n: str, limit: int = SHARD_TOKENS) -> DataFrame:
    """docs with shard: filled in order, a shard is closed by the first row that brings it to the limit.

    Each end is looked up in the running sums, one small job for each shard, since a shard begins where the last one ended.
    """
    sums = kept(running(docs, order, n))
    ends: list[tuple[str, int, int]] = []
    for row in sums.groupBy("split").agg(F.max("up_to").alias("total")).orderBy("split").collect():
        at, k = 0, 0
        while at < row.total:
            end = sums.where((F.col("split") == row.split) & (F.col("up_to") >= at + limit)).agg(F.min("up_to")).first()[0] or row.total
            ends.append((row.split, k, at, end))
            at, k = end, k + 1
    edges = sums.sparkSession.createDataFrame(ends, "split string, shard long, low long, high long")
    # one row for each shard
    return sums.join(F.broadcast(edges), (sums.split == edges.split) & (sums.up_to > edges.low) & (sums.up_to <= edges.high)).drop(edges.split).drop("low", "high")


def with_val(index: DataFrame) -> DataFrame:
    """(split, shard, tokens) with a validation shard cut off the last training shard when there is none."""
    own = index.groupBy().agg(F.max(F.expr("split = 'val'")).alias("has_val"), F.max(F.expr("CASE WHEN split = 'train' THEN shard END")).alias("last"))
    rows = index.join(F.broadcast(own))
    take = F.least(F.lit(STOLEN), F.floor(F.col("tokens") / 10))
    cut = (~F.col("has_val")) & (F.col("split") == "train") & (F.col("shard") == F.col("last")) & (take > 0)
    both = F.when(cut, F.array(F.struct(F.lit("train").alias("split"), F.col("shard"), (F.col("tokens") - take).alias("tokens")), F.struct(F.lit("val").alias("split"), F.lit(0).cast("long").alias("shard"), take.cast("long").alias("tokens"))))
    return rows.select(F.explode(F.coalesce(both, F.array(F.struct("split", "shard", "tokens")))).alias("x")).select("x.split", "x.shard", "x.tokens")


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest seeded hash of key. Buckets of the hash are counted first; only the one in which the n-th lies is ordered."""
    hashed = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("b", F.substring("h", 1, 3))
    count = hashed.groupBy("b").agg(F.count("*").alias("c"))
    upto = count.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # 4,096 rows at most
    near = hashed.join(F.broadcast(upto), "b").where(F.col("before") < n)
    ranked = near.where(F.col("before") + F.col("c") > n).withColumn("k", F.row_number().over(W.partitionBy("b").orderBy("h", key))).where(F.col("before") + F.col("k") <= n)
    return near.where(F.col("before") + F.col("c") <= n).select(*rows.columns).unionByName(ranked.select(*rows.columns))


# ---- token windows


def salt(split: str) -> int:
    return int.from_bytes(hashlib.blake2b(split.encode(), digest_size=4).digest(), "little")


def windows(spark: SparkSession, usable: list[int], split: str, n_steps: int, size: int, seed: int = 0, first_step: int = 0) -> DataFrame:
    """step, slot, shard, start of each training window; shards come by their usable tokens."""
    chance = np.array(usable, np.float64)
    if not chance.sum():
        raise ValueError("no shard is long enough for a window")
    chance, own = chance / chance.sum(), salt(split)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for step in batch["id"]:
                rng = np.random.default_rng((seed, own, abs(int(step))))
                for slot, shard in enumerate(rng.choice(len(usable), size=size, p=chance)):
                    out.append((step, slot, int(shard), int(rng.integers(0, usable[shard] + 1))))
            yield pd.DataFrame(out, columns=["step", "slot", "shard", "start"])

    return spark.range(first_step, first_step + n_steps).mapInPandas(draw, "step long, slot long, shard long, start long")


def batch_index(step: Column, micro: Column, rank: Column, accumulate: int, world: int) -> Column:
    return (step * accumulate + micro) * world + rank


def learning_rate(step: Column, peak: Column, low: Column, warmup: Column, total: Column) -> Column:
    """Linear warm-up, then half a cosine down to the least rate."""
    done = F.least(F.lit(1.0), (step - warmup) / F.greatest(F.lit(1), total - warmup))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(low + (peak - low) * 0.5 * (1 + F.cos(F.pi() * done)))


# ---- supervised examples


def supervised(messages: Column, encode) -> Column:
    """ids and labels of a conversation: tokens of assistant turns after the generation prompt are learned, all others not.

    encode turns a column of text into a column of ids; each turn is encoded on its own, as turns end at special marks.
    """
    none = F.array().cast("array<bigint>")

    def step(acc: Column, m: Column) -> Column:
        own = m["role"] == "assistant"
        head = encode(F.when(own, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))))
        tail = F.when(own, encode(F.concat(m["content"], F.lit(END + "\n")))).otherwise(none)
        return F.struct(F.concat(acc["ids"], head, tail).alias("ids"), F.concat(acc["labels"], F.transform(head, lambda x: F.lit(IGNORE).cast("long")), tail).alias("labels"))

    return F.aggregate(messages, F.struct(none.alias("ids"), none.alias("labels")), step)


def code_words(text: Column) -> Column:
    """Word tokens as numbers: a stand-in tokenizer that needs no vocabulary."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(<\|im_start\|>|<\|im_end\|>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1)), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(50_000)))


def tail(ids: Column, n: int) -> Column:
    """The last n, as a conversation's latest exchange matters most."""
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def head(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def padded(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), (width - F.size(ids)).cast("int")))


def examples(spark: SparkSession, sf_dir: str, most: int = 1024) -> DataFrame:
    """rec_id, ids, labels of the conversations with something to learn, cut to their last tokens."""
    rows = chats(spark, sf_dir).where(F.size("messages") > 0).select("rec_id", supervised(F.col("messages"), code_words).alias("e"))
    cut = rows.select("rec_id", tail(F.col("e.ids"), most).alias("ids"), tail(F.col("e.labels"), most).alias("labels"))
    return cut.where(F.exists("labels", lambda x: x != IGNORE))


# ---- queries


def val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("rec_id", bucket(F.col("source")).alias("bucket"), is_val(F.col("source"), 0.1).alias("is_val"))


def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, n_documents, n_tokens, chars_per_token with the effective fraction."""
    rows = in_splits(lengths(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"), F.sum("n_chars").alias("c"))
    return rows.select("split", "n_documents", "n_tokens", F.round(F.col("c") / F.col("n_tokens"), 9).alias("chars_per_token"))


def pack_index(spark: SparkSession, sf_dir: str, limit: int = 200_000) -> DataFrame:
    """split, shard, n_documents, tokens of shards filled in order of rec_id."""
    packed = shards(in_splits(lengths(spark, sf_dir)).select("rec_id", "split", "n"), "rec_id", "n", limit)
    return packed.groupBy("split", "shard").agg(F.count("*").alias("n_documents"), F.sum("n").alias("tokens"))


def shard_chances(spark: SparkSession, sf_dir: str, seq_len: int = 512) -> DataFrame:
    """split, shard, usable, chance: how likely a window comes from each shard."""
    index = pack_index(spark, sf_dir).select("split", "shard", F.greatest(F.lit(0), F.col("tokens") - seq_len - 1).alias("usable"))
    total = index.groupBy("split").agg(F.sum("usable").alias("t"))
    return index.join(F.broadcast(total), "split").select("split", "shard", "usable", F.when(F.col("t") > 0, F.round(F.col("usable") / F.col("t"), 9)).alias("chance"))


def train_windows(spark: SparkSession, sf_dir: str, n_steps: int = 64, size: int = 8, seq_len: int = 512) -> DataFrame:
    """step, slot, shard, start of the first steps' windows."""
    usable = [r.usable for r in shard_chances(spark, sf_dir, seq_len).where("split = 'train'").orderBy("shard").collect()]
    return windows(spark, usable, "train", n_steps, size)


def example_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, n_examples, n_tokens, n_supervised, p95 (linear between ranks, cut to a whole number) of the training examples."""
    rows = table(spark, sf_dir, "train_examples").where("split = 'train' and n_tokens > 0").dropDuplicates(["run_id", "example_id"])
    grouped = rows.groupBy("run_id").agg(F.count("*").alias("n_examples"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_supervised").alias("n_supervised"), F.percentile("n_tokens", F.lit(0.95)).alias("p"))
    return grouped.select("run_id", "n_examples", "n_tokens", "n_supervised", F.floor("p").alias("p95"))


def longest_examples(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    rows = table(spark, sf_dir, "train_examples").where("split = 'train' and n_tokens is not null").select("run_id", "example_id", "n_tokens").distinct()
    return rows.orderBy(F.desc("n_tokens"), "run_id", "example_id").limit(n)


def example_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id of the held-out examples: the first by a seeded hash, a twentieth but a few at least."""
    rows = table(spark, sf_dir, "train_examples").select("example_id").distinct()
    total = rows.count()
    return first_by_hash(rows, "example_id", min(max(MIN_VAL_EXAMPLES, int(total * VAL_EXAMPLES)), max(1, total // 5)))


def epoch_order(spark: SparkSession, sf_dir: str, seed: int = 1337, epoch: int = 1, size: int = 8) -> DataFrame:
    """run_id, example_id, position, batch: an order without repetition for one epoch of each run.

    Buckets of the hash are counted by run first, so that only a bucket of a run is ordered in one task.
    """
    rows = table(spark, sf_dir, "train_examples").where("split = 'train'").select("run_id", "example_id").distinct()
    hashed = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("example_id").cast("string")))).withColumn("b", F.substring("h", 1, 3))
    count = hashed.groupBy("run_id", "b").agg(F.count("*").alias("c"))
    before = count.select("run_id", "b", F.coalesce(F.sum("c").over(W.partitionBy("run_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("run_id", "b").orderBy("h", "example_id")
    placed = hashed.join(before, ["run_id", "b"]).select("run_id", "example_id", (F.col("before") + F.row_number().over(inside) - 1).alias("position"))
    return placed.withColumn("batch", F.floor(F.col("position") / size))


def supervised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, n_ids, n_learned of each conversation's example."""
    rows = examples(spark, sf_dir)
    return rows.select("rec_id", F.size("ids").cast("long").alias("n_ids"), F.size(F.filter("labels", lambda x: x != IGNORE)).cast("long").alias("n_learned"))


def collated(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """batch, n, width, n_padding, n_attended of batches of examples in order of rec_id, padded on the right to the longest."""
    rows = examples(spark, sf_dir).withColumn("batch", F.floor(F.col("rec_id") / size))
    wide = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("width"))
    full = rows.join(wide, "batch").select("batch", "width", padded(F.col("ids"), F.col("width"), 0).alias("ids"), padded(F.col("labels"), F.col("width"), IGNORE).alias("labels"), F.size("ids").alias("n"))
    return full.groupBy("batch").agg(F.count("*").alias("n"), F.max("width").cast("long").alias("width"), F.sum(F.size("ids") - F.col("n")).alias("n_padding"), F.sum("n").alias("n_attended"))


def learning_rates(spark: SparkSession, sf_dir: str, points: int = 20) -> DataFrame:
    """run_id, step, rate at evenly spaced steps of each plan."""
    plans = table(spark, sf_dir, "run_plans").where("total_steps > 0 and warmup_steps > 0").select("run_id", "lr", "min_lr", "warmup_steps", "total_steps")
    steps = plans.select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("k")).withColumn("step", F.floor(F.col("k") * F.col("total_steps") / points))
    rate = learning_rate(F.col("step"), F.col("lr"), F.col("min_lr"), F.col("warmup_steps"), F.col("total_steps"))
    return steps.select("run_id", "step", F.round(rate, 12).alias("rate"))


QUERIES = {f.__name__: f for f in (val_split, split_tokens, pack_index, shard_chances, train_windows, example_lengths, longest_examples, example_split, epoch_order, supervised_counts, collated, learning_rates)}

_BUCKET = " + ".join(f"('0x' || substr(s, {4 * i + 1}, 4))::BIGINT * {pow(65536, 15 - i, 10_000)}" for i in range(16))
_ROLE = r"CASE lower(trim(m.role, E' \t\r\n')) WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END"
_LENGTHS = rf"""
WITH e AS (SELECT rec_id, unnest(range(len(messages))) AS k, messages FROM records WHERE messages IS NOT NULL),
     f AS (SELECT rec_id, k, messages[k + 1] AS m FROM e),
     g AS (SELECT rec_id, string_agg('<|im_start|>' || {_ROLE} || chr(10) || m.content || '<|im_end|>', chr(10) ORDER BY k) AS c FROM f WHERE m.role IS NOT NULL AND m.role <> '' AND m.content IS NOT NULL GROUP BY 1),
     t AS (SELECT r.rec_id, source, coalesce(c, text, '') AS t FROM records r LEFT JOIN g USING (rec_id)),
     n AS (SELECT rec_id, source, length(t)::BIGINT AS n_chars, len(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'))::BIGINT + 1 AS n, sha256(coalesce(source, '')) AS s FROM t WHERE t <> ''),
     b AS (SELECT *, ({_BUCKET}) % 10000 AS bucket, count(*) OVER () AS total FROM n WHERE n > 1),
     x AS (SELECT *, CASE WHEN bucket < (CASE WHEN total * 0.005 < 8 THEN least(0.1, 8 / total) ELSE 0.005 END) * 10000 THEN 'val' ELSE 'train' END AS split FROM b)
"""
ORACLES = {
    "val_split": f"WITH h AS (SELECT rec_id, sha256(coalesce(source, '')) AS s FROM records), b AS (SELECT rec_id, ({_BUCKET}) % 10000 AS bucket FROM h) SELECT rec_id, bucket, bucket < 1000 AS is_val FROM b",
    "split_tokens": _LENGTHS + "SELECT split, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens, round(sum(n_chars) / sum(n), 9) AS chars_per_token FROM x GROUP BY 1",
    "pack_index": _LENGTHS.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
    + """, o AS (SELECT split, n, row_number() OVER (PARTITION BY split ORDER BY rec_id) AS k FROM x),
     w AS (SELECT split, k, n, 0::BIGINT AS shard, n::BIGINT AS fill FROM o WHERE k = 1
           UNION ALL SELECT o.split, o.k, o.n, CASE WHEN w.fill >= 200000 THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.fill >= 200000 THEN o.n ELSE w.fill + o.n END FROM w JOIN o ON o.split = w.split AND o.k = w.k + 1)
SELECT split, shard, count(*) AS n_documents, sum(n)::BIGINT AS tokens FROM w GROUP BY 1, 2""",
    "example_lengths": """WITH d AS (SELECT run_id, example_id, any_value(n_tokens) AS n_tokens, any_value(n_supervised) AS n_supervised FROM train_examples WHERE split = 'train' AND n_tokens > 0 GROUP BY 1, 2)
SELECT run_id, count(*) AS n_examples, sum(n_tokens)::BIGINT AS n_tokens, sum(n_supervised)::BIGINT AS n_supervised, floor(quantile_cont(n_tokens, 0.95))::BIGINT AS p95 FROM d GROUP BY 1""",
    "longest_examples": "SELECT DISTINCT run_id, example_id, n_tokens FROM train_examples WHERE split = 'train' AND n_tokens IS NOT NULL ORDER BY n_tokens DESC, run_id, example_id LIMIT 16",
    "example_split": """WITH d AS (SELECT DISTINCT example_id FROM train_examples), h AS (SELECT example_id, row_number() OVER (ORDER BY md5('0:' || example_id), example_id) AS k, count(*) OVER () AS n FROM d)
SELECT example_id FROM h WHERE k <= least(greatest(4, floor(n * 0.05)), greatest(1, n // 5))""",
    "epoch_order": """WITH d AS (SELECT DISTINCT run_id, example_id FROM train_examples WHERE split = 'train'), o AS (SELECT run_id, example_id, row_number() OVER (PARTITION BY run_id ORDER BY md5('1337:1:' || example_id), example_id) - 1 AS position FROM d)
SELECT run_id, example_id, position, position // 8 AS batch FROM o""",
    "learning_rates": """WITH p AS (SELECT * FROM run_plans, range(21) AS g(k) WHERE total_steps > 0 AND warmup_steps > 0), s AS (SELECT *, floor(k * total_steps / 20)::BIGINT AS step FROM p)
SELECT run_id, step, round(CASE WHEN step < warmup_steps THEN lr * (step + 1) / warmup_steps ELSE min_lr + (lr - min_lr) * 0.5 * (1 + cos(pi() * least(1.0, (step - warmup_steps) / greatest(1, total_steps - warmup_steps)))) END, 12) AS rate FROM s""",
}
