"""Held-out records that are, exactly or almost, in a training record.

The texts of all training records are one suffix array, partitioned by the leading words of the suffixes: a suffix has
its place by the number of its first LONG (or SHORT) words. Held-out suffixes are looked up among them, the ranges in
which suffixes of both sides share their leading words reveal the shared spans, spans at fitting places of both texts
make a pair, and each pair's exact number of edits decides.

Which held-out suffixes are looked up loses nothing: two word lists of at most n words within d <= n / 10 edits share
unchanged one of any d + 1 disjoint spans of either list, so d + 1 disjoint suffixes with the smallest ranges are enough.
Ranges are counted over all held-out texts; the frequent ones (a share of FREQUENT or more, so at most 1 / FREQUENT of
them) are known to all tasks. Equal word lists are one class on each side and are measured once; classes are opened into
records at the end.

Null texts, texts without words, and records of no split are on no side. Texts of fewer than nine words allow no edit and
come from the copies alone. Repeated rows give one pair; a record is never paired with itself. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits, encode, kept, table, windows
from .p3_copies import groups

#: Words of a span for lists of 18 and more words, and of 9 to 17.
LONG, SHORT = 6, 4
#: Least share of a span to be called frequent.
FREQUENT = 2.5e-6
#: Least share of all lists for a class to be known to all tasks by its first record; at most 1 / SHARED classes.
SHARED = 1e-5
#: Counters of a text's bag of words.
BAG = 64


def edits(n: int) -> int:
    """The most edits of a pair in which one list has n words."""
    return n // 9


#: Words in which spans are chosen together.
PIECE = 540


def pick(cost: np.ndarray, n: int) -> list[int]:
    """Starts of edits(n) + 1 disjoint spans with a small sum of costs: piece by piece, a ninth of its words in each."""
    length, out = _span(n), []
    ends = [*range(PIECE, n - PIECE // 2, PIECE), n]
    for start, end in zip([0, *ends], ends):
        count = edits(n) + 1 - len(out) if end == n else PIECE // 9
        out += [start + i for i in choose(cost[start : end - length + 1], length, count)]
    return out


def choose(cost: np.ndarray, length: int, count: int) -> list[int]:
    """Starts of so many disjoint windows with the least sum of costs."""
    if not cost.any():
        return [i * length for i in range(count)]
    n = len(cost)
    best = np.full((n + length, count + 1), np.inf)  # best[i, k]: k windows at i or later
    best[n:, 0] = 0
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        np.minimum(best[i, 1:], best[i + length, :-1] + cost[i], out=best[i, 1:])
    out, i = [], 0
    for k in range(count, 0, -1):
        while best[i, k] == best[i + 1, k]:
            i += 1
        out.append(i)
        i += length
    return out


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most so many edits make one list the other (bit-parallel edit distance)."""
    if abs(len(a) - len(b)) > most:
        return False
    # what both begin and end with needs no edit
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    k = int(unlike[0]) if len(unlike) else n
    a, b, n = a[k:], b[k:], n - k
    unlike = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    k = int(unlike[0]) if len(unlike) else n
    a, b = a[: len(a) - k].tolist(), b[: len(b) - k].tolist()
    if not a or not b:
        return max(len(a), len(b)) <= most
    bag = Counter(a)
    if max(len(a), len(b)) - (bag & Counter(b)).total() > most:
        return False
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    mask, top, dist = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    pv, mv = mask, 0
    for x in b:
        eq = at.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        dist += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return dist <= most


def almost(a: np.ndarray, b: np.ndarray) -> bool:
    return within(a, b, max(len(a), len(b)) // 10)


def marked(bitmap: tuple[int, np.ndarray], x: np.ndarray) -> np.ndarray:
    """False only for numbers that are not in the bitmap; true for some of these too."""
    at = bits(x, bitmap[0])
    return (bitmap[1][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(df: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap of the numbers in column x, of at most 8 MB whatever their number."""
    power = min(26, max(16, (16 * df.count()).bit_length()))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << power, bool)
        for batch in batches:
            held[bits(batch["x"].to_numpy(np.int64), power)] = True
        yield pd.DataFrame({"bits": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros(1 << power - 3, np.uint8)
    for row in df.coalesce(4).mapInPandas(part, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return power, out


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for rec_id, text, held in zip(batch["rec_id"], batch["text"], batch["held"]):
            if len(w := encode(text)) >= 9:
                raw = w.tobytes()
                bag = np.minimum(np.bincount(bits(w.astype(np.int64), 6), minlength=BAG), 255).astype(np.uint8)
                out.append((rec_id, held, len(w), raw, bag.tobytes(), int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)))
        yield pd.DataFrame(out, columns=["id", "held", "n", "raw", "bag", "class"]).astype({"id": "int64", "n": "int32", "class": "int64"})


def _span(n: int) -> int:
    return LONG if n >= 18 else SHORT


def _all_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [np.unique(windows(np.frombuffer(raw, np.int32), _span(n))) for n, raw in zip(batch["n"], batch["raw"])]
        yield pd.DataFrame({"win": np.concatenate([np.empty(0, np.int64), *found])})


def near(coded: DataFrame) -> DataFrame:
    """train, held: the classes of word lists that are almost the same; coded has one row for each class and side."""
    spark = coded.sparkSession
    spans = coded.where("held").select("n", "raw").mapInPandas(_all_spans, "win long")
    total = coded.where("held").agg(F.sum("n")).first()[0] or 0
    frequent = spans.groupBy("win").agg(F.count("*").alias("times")).where(F.col("times") >= max(2.0, FREQUENT * total)).toPandas()
    order = np.argsort(frequent["win"].to_numpy(np.int64))
    common = spark.sparkContext.broadcast((frequent["win"].to_numpy(np.int64)[order], frequent["times"].to_numpy(np.float64)[order]))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, times = common.value
        for batch in batches:
            out = []
            for held, n, raw in zip(batch["class"], batch["n"], batch["raw"]):
                own: dict[int, tuple[int, int]] = {}  # first and last place of each span: a text may repeat itself
                win = windows(np.frombuffer(raw, np.int32), _span(n))
                cost = np.zeros(len(win))
                if len(seen):
                    place = np.minimum(np.searchsorted(seen, win), len(seen) - 1)
                    cost = np.where(seen[place] == win, times[place], 0.0)
                for i in pick(cost, n):
                    own[int(win[i])] = own.get(int(win[i]), (i, i))[0], i
                out += [(held, n, low, high, x) for x, (low, high) in own.items()]
            yield pd.DataFrame(out, columns=["held", "held_n", "held_low", "held_high", "win"]).astype({"held": "int64", "held_n": "int32", "held_low": "int32", "held_high": "int32", "win": "int64"})

    told = kept(coded.where("held").select("class", "n", "raw").mapInPandas(tell, "held long, held_n int, held_low int, held_high int, win long"))
    wanted = spark.sparkContext.broadcast(bitmap(told.select(F.col("win").alias("x"))))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = wanted.value
        for batch in batches:
            ids, ns, lows, highs, wins = [], [], [], [], []
            for rec_id, n, raw in zip(batch["class"], batch["n"], batch["raw"]):
                w = np.frombuffer(raw, np.int32)
                for length in (LONG, SHORT) if n <= 18 else (LONG,):
                    win = windows(w, length)
                    if len(win):
                        hit = np.flatnonzero(marked(want, win))
                        found, low = np.unique(win[hit], return_index=True)
                        high = len(hit) - 1 - np.unique(win[hit][::-1], return_index=True)[1]
                        ids.append(np.full(len(found), rec_id)), ns.append(np.full(len(found), n)), lows.append(hit[low]), highs.append(hit[high]), wins.append(found)
            cat = lambda x, t: np.concatenate([np.empty(0, t), *x]).astype(t)
            yield pd.DataFrame({"train": cat(ids, np.int64), "train_n": cat(ns, np.int32), "train_low": cat(lows, np.int32), "train_high": cat(highs, np.int32), "win": cat(wins, np.int64)})

    found = coded.where("not held").select("class", "n", "raw").mapInPandas(look, "train long, train_n int, train_low int, train_high int, win long")
    most = F.floor(F.greatest("held_n", "train_n") / 10)
    pairs = kept(
        found.join(told, "win")
        .where((F.abs(F.col("held_n") - F.col("train_n")) <= most) & (F.col("held_low") <= F.col("train_high") + most) & (F.col("train_low") <= F.col("held_high") + most) & (F.col("held") != F.col("train")))
        .select("train", "held")
        .distinct()
    )

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One edit changes the bags by two words at most."""
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[f"{side}_bag"]), np.uint8).reshape(-1, BAG).astype(np.int32) for side in ("train", "held"))
            yield batch.loc[np.abs(a - b).sum(axis=1) <= 2 * (np.maximum(batch["train_n"], batch["held_n"]) // 10).to_numpy(), ["train", "held"]]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [almost(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(batch["train_raw"], batch["held_raw"])]
            yield batch.loc[keep, ["train", "held"]]

    def in_pairs(pairs: DataFrame, side: str, column: str, kind: str) -> DataFrame:
        """A column of the lists of one side that are in a pair; without the bitmap every list would be shuffled."""
        bits_of = spark.sparkContext.broadcast(bitmap(pairs.select(F.col(side).alias("x"))))

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[marked(bits_of.value, batch[side].to_numpy(np.int64))]

        lists = coded.where("held" if side == "held" else "not held").select(F.col("class").alias(side), F.col("n").alias(f"{side}_n"), F.col(column).alias(f"{side}_{column}"))
        return lists.mapInPandas(some, f"{side} long, {side}_n int, {side}_{column} {kind}")

    both = lambda pairs, column: pairs.join(in_pairs(pairs, "held", column, "binary"), "held").join(in_pairs(pairs, "train", column, "binary"), "train")
    close = kept(both(pairs, "bag").mapInPandas(fits, "train long, held long").distinct())
    return both(close, "raw").mapInPandas(measure, "train long, held long").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id_a < rec_id_b: one in train, the other in val or test, that are copies or almost the same."""
    split = table(spark, sf_dir, "records").where("split in ('train', 'val', 'test') and rec_id is not null").select("rec_id", (F.col("split") != "train").alias("held"))
    group = kept(groups(spark, sf_dir).join(split, "rec_id"))
    side = lambda df, key, name, held: df.where("held" if held else "not held").select(key, F.col("rec_id" if key != "class" else "id").alias(name))
    copies = side(group, "first_rec_id", "train_id", False).join(side(group, "first_rec_id", "held_id", True), "first_rec_id").select("train_id", "held_id")

    text = table(spark, sf_dir, "records").where("text is not null and rec_id is not null and split in ('train', 'val', 'test')").select("rec_id", "text", (F.col("split") != "train").alias("held"))
    coded = kept(text.mapInPandas(_encode, "id long, held boolean, n int, raw binary, bag binary, class long"))
    # Classes of copies on one side are known by their first records; a class too rare for the list may come twice, which changes nothing.
    least = max(2, int(SHARED * coded.count()))
    first = kept(coded.groupBy("class", "held").agg(F.min("id").alias("first"), F.count("*").alias("size")).where(F.col("size") >= least).drop("size"))
    classes = coded.join(F.broadcast(first), ["class", "held"], "left").where("first is null or first = id").drop("id", "first")
    pairs = near(classes)
    of_train = side(coded, "class", "train_id", False).withColumnRenamed("class", "train")
    of_held = side(coded, "class", "held_id", True).withColumnRenamed("class", "held")
    almost_same = pairs.join(of_train, "train").join(of_held, "held").select("train_id", "held_id")
    both = copies.unionByName(almost_same).where("train_id <> held_id")
    return both.select(F.least("train_id", "held_id").alias("rec_id_a"), F.greatest("train_id", "held_id").alias("rec_id_b")).distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, source (the first folder of the held-out record's source), n_records that are in train too, n_pairs."""
    pairs = p5_found(spark, sf_dir)
    split = table(spark, sf_dir, "records").where("split in ('val', 'test')").select("rec_id", "split", F.regexp_extract(F.lower(F.regexp_replace(F.trim("source"), r"\\", "/")), r"^(?:\./)*([^/]*)", 1).alias("source"))
    either = pairs.select(F.explode(F.array("rec_id_a", "rec_id_b")).alias("rec_id"))
    return either.groupBy("rec_id").agg(F.count("*").alias("n")).join(split, "rec_id").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_pairs"))
