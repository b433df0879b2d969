"""Structured texts of a table as records, and token counts of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duration, short_count, slug
from ..sources.records import from_json
from ..storage import table
from .chat import record_text, turns

#: Folder and file of a public tokenizer's vocabulary, and (a fixed value) how it cuts a text.
TOKENIZERS = os.environ.get("CORPUS_OPS_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(path: str | None = None):
    """A function of a text column that gives its token ids."""
    where = path or os.path.join(TOKENIZERS, VOCABULARY)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        encode = tokenizer(where).encode_ordinary
        return pd.Series([encode(x) for x in text.fillna("")], index=text.index)

    return ids


def structured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, kind (prose or chat), n_turns, n_chars of the texts that are one JSON object with a record in it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec_id, source, text in zip(batch["rec_id"], batch["source"], batch["text"]):
                if r := from_json(text, source or ""):
                    out.append((rec_id, "chat" if r.messages else "prose", len(r.messages or []), len(r.text) if r.text is not None else sum(len(m["content"]) for m in r.messages)))
            yield pd.DataFrame(out, columns=["rec_id", "kind", "n_turns", "n_chars"]).astype({"rec_id": "int64", "n_turns": "int64", "n_chars": "int64"})

    objects = table(spark, sf_dir, "records").where(F.col("text").isNotNull() & F.ltrim("text").startswith("{"))
    return objects.select("rec_id", "source", "text").mapInPandas(read, "rec_id long, kind string, n_turns long, n_chars long")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, n_tokens (with one for the end), of each record with a text or turns."""
    rows = table(spark, sf_dir, "records").select("rec_id", record_text(F.col("text"), turns(F.col("messages"))).alias("t")).where("t <> ''")
    return rows.select("rec_id", (F.size(encoded()("t")) + 1).cast("long").alias("n_tokens"))


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece, n of the pieces that a tokenizer's pattern cuts documents into, seen twice or more."""
    import regex

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(PATTERN)
        for batch in batches:
            count = pd.Series([x for text in batch["text"] for x in pattern.findall(text)], dtype=object).value_counts()
            yield pd.DataFrame({"piece": count.index, "n": count.to_numpy()})

    docs = table(spark, sf_dir, "documents").where("text is not null").select("text")
    return docs.mapInPandas(cut, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n >= 2")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, slug (a file name from the run's name), tokens and time as a user reads them."""
    return table(spark, sf_dir, "runs").select("id", slug(F.coalesce("name", "id")).alias("slug"), short_count(F.coalesce("tokens_seen", F.lit(0))).alias("tokens"), duration(F.coalesce("elapsed_s", F.lit(0.0))).alias("time"))


QUERIES = {f.__name__: f for f in (structured_records, token_counts, pretoken_counts, labels)}
ORACLES = {
    "labels": r"""SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(name, id)), '[^\p{L}\p{N}_.-]', '-', 'g'), '-{2,}', '-', 'g'), '-.') AS slug,
       CASE WHEN n >= 1e9 THEN printf('%.2fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE printf('%.0f', n) END AS tokens,
       CASE WHEN s < 60 THEN printf('%.0fs', s) WHEN s < 3600 THEN printf('%.0fm', s / 60) WHEN s < 86400 THEN printf('%.1fh', s / 3600) ELSE printf('%.1fd', s / 86400) END AS time
FROM (SELECT id, name, coalesce(tokens_seen, 0)::DOUBLE AS n, coalesce(elapsed_s, 0.0) AS s FROM runs)""",
}
