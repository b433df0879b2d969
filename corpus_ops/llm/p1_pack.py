"""Train examples laid into sequences of their run's seq_len by sum-of-squares online packing.

Each piece goes to the fill level that makes the sum of the squared numbers of partly filled sequences smallest; an array
holds the number of open sequences at each level. Only an example longer than seq_len is cut: into whole sequences and a
rest. A run is packed in blocks of about BLOCK pieces, chosen by a hash, so that a run of any size is spread over tasks;
each block has its own array. What lies in sequences left open is packed again in the same way while that saves any.

Null or zero lengths have no tokens and are left out, as are rows of runs without a plan or with a seq_len that is null
or below 1. An example written twice counts once (if its copies differ in length, the longest). Ties between levels go
to the fuller one. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pieces packed together.
BLOCK = 20_000


def pack(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each length (in the given order, none above room) and the fill of each sequence."""
    count = np.zeros(room + 1, np.int64)  # open sequences at each level
    at: list[list[int]] = [[] for _ in range(room + 1)]
    fill: list[int] = []
    out = np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        if n == room:
            out[k] = len(fill)
            fill.append(room)
            continue
        # Moving a sequence from level h to h + n changes the sum by 2 (count[h + n] - count[h] + 1); a full one leaves it.
        change = 2 * (count[n:] - count[: room + 1 - n] + 1)
        change[-1] = 1 - 2 * count[room - n]
        change[0] = 2 * count[n] + 1  # a new sequence
        change[1:][count[1 : room + 1 - n] == 0] = np.iinfo(np.int64).max
        h = len(change) - 1 - int(change[::-1].argmin())
        if h:
            i = at[h].pop()
            count[h] -= 1
        else:
            i = len(fill)
            fill.append(0)
        out[k] = i
        fill[i] += n
        if fill[i] < room:
            at[fill[i]].append(i)
            count[fill[i]] += 1
    return out, np.array(fill, np.int64)


def pack_again(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """pack, and again for the pieces in sequences left open, as long as this saves sequences."""
    sequence, fill = pack(lengths, room)
    while True:
        pieces = np.flatnonzero(fill[sequence] < room)
        again, filled = pack(lengths[pieces], room)
        full = fill == room
        if len(filled) >= len(fill) - full.sum():
            return sequence, fill
        moved = np.cumsum(full) - 1
        sequence = moved[sequence]
        sequence[pieces] = again + full.sum()
        fill = np.concatenate([fill[full], filled])


def _lay(rows: pd.DataFrame) -> pd.DataFrame:
    room, n = int(rows["seq_len"].iloc[0]), rows["n_tokens"].to_numpy(np.int64)
    parts = (n + room - 1) // room
    of = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(room, n[of] - part * room)
    order = np.lexsort((part, rows["example_id"].to_numpy()[of], -length))  # long pieces come first
    of, part, length = of[order], part[order], length[order]
    sequence, fill = pack_again(length, room)
    return pd.DataFrame({"run_id": rows["run_id"].iloc[0], "example_id": rows["example_id"].to_numpy()[of], "part": part, "block": rows["block"].iloc[0], "sequence_no": sequence, "n_tokens": length, "seq_len": room, "unused_tokens": room - fill[sequence]})


def p1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, example_id, part (of a cut example), block, sequence_no (in its block), n_tokens, seq_len, unused_tokens (of the sequence)."""
    examples = table(spark, sf_dir, "train_examples").where("split = 'train' and n_tokens > 0").groupBy("run_id", "example_id").agg(F.max("n_tokens").alias("n_tokens"))
    plans = table(spark, sf_dir, "run_plans").where("seq_len > 0").groupBy("run_id").agg(F.max("seq_len").alias("seq_len"))
    known = examples.join(plans, "run_id")
    blocks = known.groupBy("run_id").agg(F.ceil(F.sum(F.ceil(F.col("n_tokens") / F.col("seq_len"))) / BLOCK).alias("n_blocks"))
    laid = known.join(blocks, "run_id").withColumn("block", F.pmod(F.xxhash64("example_id"), F.col("n_blocks")))
    schema = "run_id string, example_id long, part long, block long, sequence_no long, n_tokens long, seq_len long, unused_tokens long"
    return laid.select("run_id", "example_id", "n_tokens", "seq_len", "block").groupBy("run_id", "block").applyInPandas(_lay, schema)


def p1_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run: n_sequences, least_sequences (that any packing needs for the tokens), n_tokens, unused_tokens."""
    sequences = p1_pack(spark, sf_dir).groupBy("run_id", "seq_len", "block", "sequence_no").agg(F.sum("n_tokens").alias("n_tokens"))
    runs = sequences.groupBy("run_id", "seq_len").agg(F.count("*").alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"))
    return runs.select("run_id", "n_sequences", F.ceil(F.col("n_tokens") / F.col("seq_len")).alias("least_sequences"), "n_tokens", (F.col("n_sequences") * F.col("seq_len") - F.col("n_tokens")).alias("unused_tokens"))


def p1_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, n_examples, n_parts, n_tokens that were laid."""
    return p1_pack(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("example_id").alias("n_examples"), F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))


P1_CUT_SQL = """
WITH e AS (SELECT run_id, example_id, max(n_tokens) AS n FROM train_examples WHERE split = 'train' AND n_tokens > 0 GROUP BY 1, 2),
     p AS (SELECT run_id, max(seq_len) AS seq_len FROM run_plans WHERE seq_len > 0 GROUP BY 1)
SELECT run_id, count(*)::BIGINT AS n_examples, sum((n + seq_len - 1) // seq_len)::BIGINT AS n_parts, sum(n)::BIGINT AS n_tokens
FROM e JOIN p USING (run_id) GROUP BY run_id
"""
