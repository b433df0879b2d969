"""Copies: the same letters and digits in the same order, fields in any order.

Each text is reduced to its canonical form (letters and digits in lower case; of one JSON object or of ``key: value``
lines also the sorted fields) and hashed to 128 bits. Counts are combined on the map side. A second, independent 64-bit
hash and the length go along: where one 128-bit key has two of these, the key is split by them, so a collision parts
texts that differ instead of joining them.

Null and empty texts, and texts without any letter or digit, have no canonical form and are in no group. Repeated rows
(same rec_id twice) count as copies but are never their own first. Ties: the smallest rec_id stands for its group.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, letters, table

FIELD = re.compile(r"\s*([^:\s][^:]*?)\s*:(?:\s+(.*?))?\s*")


def _flat(value) -> str:
    if isinstance(value, list):
        return "".join(map(_flat, value))
    if isinstance(value, tuple):  # a nested object
        return "".join(sorted(letters(k) + _flat(v) for k, v in value))
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return letters(value)


def fields(text: str) -> list[str] | None:
    """The fields of one JSON object or of ``key: value`` lines, in sorted order; None for any other text."""
    if text.lstrip("﻿ \t\r\n").startswith("{"):
        try:
            value = json.loads(text.strip("﻿ \t\r\n"), object_pairs_hook=tuple, parse_float=str, parse_int=str, parse_constant=str, strict=False)
        except (ValueError, RecursionError):
            return None
        # an empty object has no fields and, like a list, is no case
        return sorted(letters(k) + _flat(v) for k, v in value) if isinstance(value, tuple) and value else None
    found = []
    for line in re.split(r"\r\n|\r|\n", text):
        if line.strip():
            if not (m := FIELD.fullmatch(line)):
                return None
            found.append(letters(m[1]) + letters(m[2] or ""))
    return sorted(found) or None


def _hashes(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(raw, digest_size=16).digest(), xxhash.xxh3_64_intdigest(raw, len(raw)) - (1 << 63)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for rec_id, text in zip(batch["rec_id"], batch["text"]):
            if plain := letters(text):
                parts = fields(text)
                out.append((rec_id, *_hashes(plain), *(_hashes("\0".join(parts)) if parts else (None, None))))
        frame = pd.DataFrame(out, columns=["rec_id", "plain", "plain_check", "parts", "parts_check"])
        yield frame.astype({"rec_id": "int64", "plain_check": "int64", "parts_check": "Int64"})


def apart(rows: DataFrame, key: str) -> DataFrame:
    """The rows with keys that stand for two texts split by the second hash; as a rule there are none."""
    check = f"{key}_check"
    mixed = kept(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(check).alias("low"), F.max(check).alias("high")).where("low < high").select(key, F.lit(True).alias("mixed")))
    if not mixed.limit(1).count():
        return rows
    tail = F.encode(F.concat(F.lit("/"), F.col(check).cast("string")), "UTF-8")
    return rows.join(mixed, key, "left").withColumn(key, F.when(F.col("mixed"), F.concat(key, tail)).otherwise(F.col(key))).drop("mixed")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, first_rec_id of every record whose text has a letter or digit."""
    keyed = table(spark, sf_dir, "records").where("text is not null and rec_id is not null").select("rec_id", "text").mapInPandas(_keys, "rec_id long, plain binary, plain_check long, parts binary, parts_check long")
    keyed = apart(apart(kept(keyed), "plain"), "parts").select("rec_id", "plain", "parts")
    label = keyed.groupBy("plain").agg(F.min("rec_id").alias("label"))
    pairs = keyed.where("parts is not null").select("plain", "parts").distinct()
    # Texts of one plain key and texts of one set of fields are the same group, over any number of steps.
    now = kept(pairs.join(label, "plain"))
    while True:
        by_parts = now.groupBy("parts").agg(F.min("label").alias("low"))
        by_plain = now.select("plain", "parts", "label").join(by_parts, "parts").groupBy("plain").agg(F.min("low").alias("new"))
        after = kept(now.join(by_plain, "plain").select("plain", "parts", "new", "label"))
        changed = after.where("new < label").limit(1).count()
        now = after.select("plain", "parts", F.col("new").alias("label"))
        if not changed:
            break
    joined = now.groupBy("plain").agg(F.min("label").alias("low"))
    label = label.join(joined, "plain", "left").select("plain", F.coalesce("low", "label").alias("first_rec_id"))
    return keyed.join(label, "plain").select("rec_id", "first_rec_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_rec_id, rec_id of each record that has a copy with a smaller rec_id."""
    return groups(spark, sf_dir).where("first_rec_id < rec_id").select("first_rec_id", "rec_id").distinct()


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each group of copies, single records too: first_rec_id, n_copies (of the first as well)."""
    return groups(spark, sf_dir).groupBy("first_rec_id").agg(F.count("*").alias("n_copies"))
