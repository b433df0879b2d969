"""Documents that hold passages of evaluation items, by greedy string tiling with running Karp-Rabin hashes.

Words are numbered. The hashes of all windows of RUN words of the items are the shared-token seeds; a document's windows
are looked up in them, and each pair of document and item with a seed is tiled: the longest common stretches of words
that no tile covers yet are marked, longest first, down to RUN words, so passages found in another order count too.

The items come to the executors in blocks of at most BLOCK_WORDS words (the proven size of what is broadcast), one scan
of the documents for each block, so any number of items works. Each item is judged alone. Null and short texts on either
side have no pair; repeated rows give one pair; a document may have any length.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode, table, windows

RUN = 12
#: Words of items in one broadcast: 20 bytes for each at most.
BLOCK_WORDS = 2_000_000


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _sums(w: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w.astype(np.uint64) * powers[: len(w)], out=out[1:])
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles, longest first.

    Karp-Rabin sums give the hash of any stretch; the greatest length at which unmarked stretches of both sides meet is
    searched by halving, all meeting stretches of that length that don't overlap are marked, and so on.
    """
    n = max(len(a), len(b)) + 1
    powers, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    sides = [(w, _sums(w, powers), np.ones(len(w), bool)) for w in (a, b)]
    out, most = [], min(len(a), len(b))

    def stretches(side, size: int) -> tuple[np.ndarray, np.ndarray]:
        _, sums, free = side
        inside = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(inside[size:] - inside[:-size] == size)
        return at, (sums[at + size] - sums[at]) * inverse[at]

    def meet(size: int) -> bool:
        return bool(np.isin(stretches(sides[0], size)[1], stretches(sides[1], size)[1]).any())

    while most >= least and meet(least):
        low, high = least, most  # low meets
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if meet(middle) else (low, middle - 1)
        size, marks = low, 0
        (at_a, keys_a), (at_b, keys_b) = stretches(sides[0], size), stretches(sides[1], size)
        shared = np.isin(keys_a, keys_b)
        place = defaultdict(deque)
        for j, key in zip(at_b.tolist(), keys_b.tolist()):
            place[key].append(j)
        free_a, free_b, taken = sides[0][2], sides[1][2], -1
        for i, key in zip(at_a[shared].tolist(), keys_a[shared].tolist()):
            if i < taken:
                continue
            found = place[key]
            while found and not (free_b[found[0]] and free_b[found[0] + size - 1]):
                found.popleft()
            if found and (a[i : i + size] == b[found[0] : found[0] + size]).all():
                j = found.popleft()
                free_a[i : i + size] = free_b[j : j + size] = False
                out.append((i, j, size))
                taken, marks = i + size, marks + 1
        most = size if marks else size - 1
    return out


def near_seeds(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The part of a document round its seeds; a tile of RUN words lies wholly in stretches of seeds."""
    keep = np.zeros(len(a) + 1, int)
    np.add.at(keep, at, 1)
    np.add.at(keep, np.minimum(at + RUN, len(a)), -1)
    return np.flatnonzero(np.cumsum(keep)[:-1] > 0)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        w = encode(row.text)
        if size and size + len(w) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.item_id, w))
        size += len(w)
    yield block


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_tiles, longest_tile, n_words (of the item in tiles), coverage (share of the item's words)."""
    items = table(spark, sf_dir, "eval_items").where("text is not null and item_id is not null").select("item_id", "text").distinct()
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", "text")

    def scan(block) -> DataFrame:
        seeds = [(np.unique(windows(w, RUN)), k) for k, (_, w) in enumerate(block)]
        keys = np.concatenate([np.empty(0, np.int64), *(s for s, _ in seeds)])
        owner = np.concatenate([np.empty(0, np.int32), *(np.full(len(s), k, np.int32) for s, k in seeds)])
        order = np.argsort(keys, kind="stable")
        held = spark.sparkContext.broadcast((keys[order], owner[order], block))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seed, of, texts = held.value
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    w = encode(text)
                    win = windows(w, RUN)
                    if not len(win) or not len(seed):
                        continue
                    low, high = np.searchsorted(seed, win, "left"), np.searchsorted(seed, win, "right")
                    hits = defaultdict(list)
                    for i in np.flatnonzero(high > low).tolist():
                        for k in set(of[low[i] : high[i]].tolist()):
                            hits[k].append(i)
                    for k, at in hits.items():
                        item_id, other = texts[k]
                        part = near_seeds(w, np.array(at))
                        cut = np.flatnonzero(np.diff(part) > 1) + 1
                        # a number that no word has parts the stretches, so no tile runs over a gap
                        apart = np.insert(w[part].astype(np.int64), cut, 1 << 40)
                        if tiled := tiles(apart, other.astype(np.int64), RUN):
                            n = sum(t[2] for t in tiled)
                            out.append((doc_id, item_id, len(tiled), tiled[0][2], n, n / len(other)))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_tiles", "longest_tile", "n_words", "coverage"]).astype({"doc_id": "int64", "item_id": "int64", "n_tiles": "int64", "longest_tile": "int64", "n_words": "int64", "coverage": "float64"})

        return docs.mapInPandas(match, "doc_id long, item_id long, n_tiles long, longest_tile long, n_words long, coverage double")

    found = reduce(DataFrame.unionByName, map(scan, _blocks(items)))
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_tiles", "longest_tile", "n_words", "coverage")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id of the pairs with a tile of at least RUN words."""
    return p8_leaks(spark, sf_dir).where(F.col("longest_tile") >= RUN).select("doc_id", "item_id")


#: The same pairs from runs of twelve words, for DuckDB.
P8_FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d),
     ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""
