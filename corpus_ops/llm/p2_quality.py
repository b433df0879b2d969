"""Text statistics of prose records, and fixed rules that tell natural prose from lists, tables, logs and junk.

All texts of an Arrow batch are laid end to end as one array of characters; words, lines and paragraphs are found from
changes of character class, and every statistic is a sum over these (numpy throughout). Common words are found by a
rolling hash. The document rules are the fixed thresholds published for web text (word count, mean word length, symbols,
bullets, ellipses, alphabetic words, common words, repeated lines); each failure is a recorded reason. p2_found applies
the same statistics to lines and paragraphs and names a record when most of its non-blank characters fail.

Null and blank texts have no statistics and no rows; texts without any letter or digit are never found. Rows are judged
alone, so ties and repeated rows need nothing; a null source has no suffix. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import suffix, table

SUFFIXES = (".txt", ".md", ".rst", ".log")
#: Common words, by language.
COMMON = {
    "en": "the of and to in a is was that this it for with as are be by on at from or an not but we you they he she his her their our your its had have has were been when where who which what there every each another one two about all some no only so than then more most my me us would will can if must before after under then into while since because i",
    "de": "der die das und ist nicht ein eine einen einem einer den dem des mit auf für sich von zu im in an am es er sie wir ihr auch aber noch dass wenn als wie was war sind hat haben wird nach vor bei aus über nur sehr hier trotzdem oder um so",
    "fr": "le la les l de du des et est un une que qui ne pas dans pour sur avec ce cette il elle nous vous ils au aux plus mais quand sans par être son sa ses en à se on ou y très ici cela fait depuis était",
    "es": "el la los las de del y es un una que no en para con por se su sus al más pero cuando sin lo le como está son fue muy este esta también desde ya o sobre entre",
    "it": "il lo la i gli le di del della e è un una che non in per con si su dal al più ma quando senza come sono era questo questa anche nel da o",
    "pt": "o a os as de do da e é um uma que não em para com por se seu sua no na ao mais mas quando sem como são foi este esta também ou",
    "nl": "de het een en is van in op te dat die niet met voor zijn was aan er ook maar als om bij door naar dan of wij ze hij nog",
    "pl": "i w na z do nie się to jest że o jak po za od przez dla ale czy co tak był była są ten ta",
    "sv": "och i att det som en på är av för med den till inte om var men har ett de så vi han från eller när",
}
#: Published thresholds for whole documents.
RULES = {"words_min": 50, "words_max": 100_000, "word_length": (3.0, 10.0), "symbol_ratio": 0.1, "bullet_lines": 0.9, "ellipsis_lines": 0.3, "alphabetic_words": 0.8, "common_words": 2, "punctuated_lines": 0.12, "repeated_line_chars": 0.2}
#: The same kinds of thresholds for one paragraph.
PARAGRAPH = {"common_share": 0.14, "alphabetic_words": 0.5, "symbol_share": 0.2, "distinct_words": 0.25}

SPACE, DIGIT, LETTER, SYMBOL, BREAK = 0, 1, 2, 3, 4
_LETTERS = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"], np.uint32)
_LEVELS = np.array([ord(c) for c in "[diwetf"], np.uint32)
ENDS = np.array([ord(c) for c in ".!?:;…\"'”»)。！？"], np.uint32)
STOPS = np.array([ord(c) for c in ".!?"], np.uint32)
SYMBOLS = np.array([ord(c) for c in "#…"], np.uint32)
#: Forms of whole lines, tried only on lines that can have them.
BULLET = re.compile(r"[ \t]*(?:[-*•+–—▪◦‣·●○]|\(?\d{1,3}[.)]|\(?[a-z][.)])[ \t]+\S")
LOG = re.compile(r"[ \t]*(?:\[?(?:\d{4}[-/]\d\d[-/]\d\d|\d\d/\w{3}/\d{4}|\w{3} +\d{1,2})[t ,:]+\d\d:\d\d|\[?\d\d:\d\d:\d\d|\[?(?:debug|info|warn(?:ing)?|error|trace|fatal)\]?[ :])")
FIELD = re.compile(r"[ \t]*[^\W\d_][^:=\n]{0,40}[:=][ \t]*\S+(?:[ \t]+\S+){0,2}[ \t]*$")
URL = re.compile(r"[ \t]*(?:https?://|www\.)\S+[ \t]*$")


def _classes() -> np.ndarray:
    kinds = np.full(0x110000, SYMBOL, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isspace():
            kinds[k] = SPACE
        elif c.isalpha():
            kinds[k] = LETTER
        elif c.isalnum():
            kinds[k] = DIGIT
    kinds[10] = BREAK
    return kinds


_TABLE: dict[str, np.ndarray] = {}
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _word_hash(word: str) -> int:
    return sum(ord(c) * pow(_BASE, k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)


def _tables() -> dict[str, np.ndarray]:
    if not _TABLE:
        _TABLE["classes"] = _classes()
        _TABLE["common"] = np.unique(np.array([_word_hash(w) for x in COMMON.values() for w in x.split()], np.uint64))
    return _TABLE


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least n + 1 of them kept for the next batch."""
    if len(_TABLE.get("powers", ())) <= n:
        for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
            x = np.full(n + n // 4 + 1, base, np.uint64)
            x[0] = 1
            _TABLE[name] = np.cumprod(x)
    return _TABLE["powers"][: n + 1], _TABLE["inverse"][: n + 1]


class Batch:
    """Texts laid end to end, each closed by a line break, with their words and lines."""

    def __init__(self, texts: list[str]):
        t = _tables()
        self.texts = [x.lower().replace("\r\n", "\n").replace("\r", "\n") + "\n" for x in texts]
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.joined = "".join(self.texts)
        self.chars = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = t["classes"][np.minimum(self.chars, 0x10FFFF)]
        breaks = np.flatnonzero(self.kind == BREAK)
        self.line_start = np.concatenate([[0], breaks[:-1] + 1])
        self.n_lines, self.line_size = len(breaks), breaks - self.line_start
        self.line_text = np.searchsorted(self.start, self.line_start, "right") - 1
        self.line_of = np.repeat(np.arange(self.n_lines), np.diff(np.concatenate([self.line_start, [len(self.chars)]])))
        # an apostrophe between letters does not part a word
        inner = (self.kind == LETTER) | (self.kind == DIGIT)
        edge = np.diff(np.concatenate([[0], inner.view(np.int8), [0]]))
        self.word_start, self.word_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word_length = self.word_end - self.word_start
        self.word_line = self.line_of[self.word_start]
        powers, inverse = _powers(len(self.chars))
        sums = np.zeros(len(self.chars) + 1, np.uint64)
        np.cumsum(self.chars * powers[:-1], out=sums[1:])
        self.word_hash = (sums[self.word_end] - sums[self.word_start]) * inverse[self.word_start]
        self.word_common = np.isin(self.word_hash, t["common"])
        letters = np.concatenate([[0], np.cumsum(self.kind == LETTER)])
        self.word_alphabetic = letters[self.word_end] > letters[self.word_start]

    def per_line(self, flags: np.ndarray) -> np.ndarray:
        """Sum over the characters of each line."""
        return np.add.reduceat(flags.astype(np.int64), self.line_start) if self.n_lines else np.empty(0, np.int64)

    def words_per_line(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.word_line, weights, self.n_lines)

    def matched(self, pattern: re.Pattern, candidates: np.ndarray) -> np.ndarray:
        """The lines, of the candidates, that a pattern matches from their start."""
        out = np.zeros(self.n_lines, bool)
        for k in np.flatnonzero(candidates).tolist():
            s = int(self.line_start[k])
            out[k] = pattern.match(self.joined, s, s + int(self.line_size[k])) is not None
        return out

    def count(self, char: str) -> np.ndarray:
        return self.per_line(self.chars == ord(char))

    def last_solid(self) -> np.ndarray:
        """The last non-blank character of each line, 0 if there is none."""
        solid = np.flatnonzero((self.kind != SPACE) & (self.kind != BREAK))
        out = np.zeros(self.n_lines, np.uint32)
        out[self.line_of[solid]] = self.chars[solid]  # later ones overwrite
        return out


def lines(b: Batch) -> dict[str, np.ndarray]:
    solid_chars = (b.kind != SPACE) & (b.kind != BREAK)
    solid, n_words, digits = b.per_line(solid_chars), b.words_per_line(), b.per_line(b.kind == DIGIT)
    at = np.flatnonzero(solid_chars)[::-1]
    first = np.zeros(b.n_lines, np.uint32)
    first[b.line_of[at]] = b.chars[at]  # the first overwrites
    pipes, tabs, signs = b.count("|"), b.count("\t"), b.count(":") + b.count("=")
    # tabs between a few words each; single ones stand in prose too
    cells = (pipes >= 2) | ((pipes == 1) & (n_words <= 6)) | ((tabs >= 2) & (n_words <= 3 * (tabs + 1)))
    may_mark = ~np.isin(first, _LETTERS) | (b.line_size < 400) & (b.count(".") + b.count(")") > 0)
    return {
        "solid": solid, "n_words": n_words, "word_chars": b.words_per_line(b.word_length), "n_common": b.words_per_line(b.word_common), "n_alphabetic": b.words_per_line(b.word_alphabetic),
        "n_symbols": b.per_line(b.kind == SYMBOL), "n_hash": b.per_line(np.isin(b.chars, SYMBOLS)), "wide": b.per_line((b.kind == LETTER) & (b.chars >= 0x2E80)), "ended": np.isin(b.last_solid(), ENDS), "ellipsis": b.last_solid() == ord("…"),
        "bullet": b.matched(BULLET, may_mark & (solid > 0)), "log": b.matched(LOG, (digits >= 4) | np.isin(first, _LEVELS) & (n_words > 0)), "field": b.matched(FIELD, (signs > 0) & (n_words <= 8)), "cells": cells & (solid > 0), "url": b.matched(URL, (b.count("/") + b.count(".") >= 2) & (solid >= b.line_size - 4)),
    }


def rejected(b: Batch, x: dict[str, np.ndarray]) -> np.ndarray:
    """The non-blank characters of each text in lists, tables, logs or junk."""
    n = b.n_lines
    blank = x["solid"] == 0
    marked = (x["bullet"] | x["log"] | x["cells"] | x["url"] | (x["field"] & (x["n_words"] <= 8))) & ~blank
    new_text = np.concatenate([[True], b.line_text[1:] != b.line_text[:-1]]) if n else np.empty(0, bool)
    # wrapped lines of a list item belong to it: indented, right after a marked line
    first = b.chars[b.line_start] if n else np.empty(0, np.uint32)
    follows = np.concatenate([[False], x["bullet"][:-1]]) if n else marked
    marked |= follows & ~new_text & ~blank & np.isin(first, [32, 9]) & ~marked
    start = new_text | blank | marked | np.concatenate([[True], (blank | marked)[:-1]])
    group = np.cumsum(start) - 1
    total = lambda v: np.bincount(group, v, group[-1] + 1)
    n_words, solid, count = total(x["n_words"]), total(x["solid"]), total(~blank)
    common, alphabetic, symbols = total(x["n_common"]), total(x["n_alphabetic"]), total(x["n_symbols"])
    mean = total(x["word_chars"]) / np.maximum(n_words, 1)
    wide = total(x["wide"]) > 0.3 * solid
    word_group = group[b.word_line]
    # different words of each paragraph
    order = np.lexsort((b.word_hash, word_group))
    g, h = word_group[order], b.word_hash[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]) if len(g) else np.empty(0, bool)
    distinct = np.bincount(g[new], minlength=group[-1] + 1)
    words = np.maximum(n_words, 1)
    bad = (n_words == 0) | (alphabetic < PARAGRAPH["alphabetic_words"] * words) | (symbols > PARAGRAPH["symbol_share"] * solid) | (mean < RULES["word_length"][0] - 0.8) | (mean > RULES["word_length"][1])
    bad |= (n_words >= 6) & (common < PARAGRAPH["common_share"] * words)
    bad |= (n_words >= 40) & (distinct < PARAGRAPH["distinct_words"] * np.minimum(words, 200))
    # a list without marks: short lines that do not end
    ends = total(x["ended"] & ~blank)
    stops = np.isin(b.chars, STOPS)
    stops[:-1] &= (b.kind[1:] == SPACE) | (b.kind[1:] == BREAK)
    inside = total(b.per_line(stops))
    # wrapped prose has its sentences' ends somewhere
    bad |= (count >= 3) & (solid < 32 * count) & (ends < 0.4 * count) & (n_words <= 5 * count) & (inside * 40 < n_words)
    bad &= ~(wide & (n_words > 0))
    line_bad = np.where(blank, False, marked | bad[group])
    return np.bincount(b.line_text, np.where(line_bad, x["solid"], 0), len(b.texts))


def statistics(texts: list[str]) -> pd.DataFrame:
    b = Batch(texts)
    x = lines(b)
    n = len(texts)
    total = lambda v: np.bincount(b.line_text, v, n)
    full = x["solid"] > 0
    count, n_words, solid = np.maximum(total(full), 1), total(x["n_words"]), total(x["solid"])
    words = np.maximum(n_words, 1)
    # characters of lines that stood in the same text before
    sums = [hash(t[s:e]) for t in b.texts for s, e in _spans(t)]
    frame = pd.DataFrame({"text": b.line_text, "line": sums, "solid": x["solid"]})
    repeated = total(np.where(frame.duplicated(["text", "line"]).to_numpy() & full, x["solid"], 0))
    out = pd.DataFrame(
        {
            "n_words": n_words.astype(np.int64), "mean_word_length": total(x["word_chars"]) / words, "symbol_ratio": total(x["n_hash"]) / words, "punctuated_lines": total(x["ended"] & full) / count, "bullet_lines": total(x["bullet"] & full) / count, "ellipsis_lines": total(x["ellipsis"]) / count,
            "alphabetic_words": total(x["n_alphabetic"]) / words, "n_common": total(x["n_common"]).astype(np.int64), "common_words": total(x["n_common"]) / words, "repeated_line_chars": repeated / np.maximum(solid, 1), "rejected_chars": rejected(b, x) / np.maximum(solid, 1),
        }
    )
    low, high = RULES["word_length"]
    out["has_word"] = n_words > 0
    tests = {
        "too few words": out["n_words"] < RULES["words_min"], "too many words": out["n_words"] > RULES["words_max"], "mean word length": (out["mean_word_length"] < low) | (out["mean_word_length"] > high), "symbols": out["symbol_ratio"] > RULES["symbol_ratio"], "bullets": out["bullet_lines"] > RULES["bullet_lines"],
        "ellipses": out["ellipsis_lines"] > RULES["ellipsis_lines"], "alphabetic words": out["alphabetic_words"] < RULES["alphabetic_words"], "common words": out["n_common"] < RULES["common_words"], "line ends": out["punctuated_lines"] < RULES["punctuated_lines"], "repeated lines": out["repeated_line_chars"] > RULES["repeated_line_chars"],
    }
    out["reasons"] = [[k for k, v in zip(tests, row) if v] for row in np.array([v.to_numpy() for v in tests.values()]).T]
    return out


def _spans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield at, end
        at = end + 1


SCHEMA = "rec_id long, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, bullet_lines double, ellipsis_lines double, alphabetic_words double, n_common long, common_words double, repeated_line_chars double, rejected_chars double, has_word boolean, reasons array<string>"


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each prose record: its statistics, the share of characters in lists, tables, logs and junk, and the reasons (rules it fails)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # about a million characters at once, whatever the texts' sizes
            part = batch["text"].str.len().cumsum() // 1_000_000
            for _, rows in batch.groupby(part, sort=False):
                out = statistics(rows["text"].tolist())
                out.insert(0, "rec_id", rows["rec_id"].to_numpy())
                yield out

    prose = table(spark, sf_dir, "records").where(F.col("text").isNotNull() & suffix(F.col("source")).isin(*SUFFIXES) & F.col("text").rlike(r"\S"))
    return prose.select("rec_id", "text").mapInPandas(judge, SCHEMA)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id of the records in which most non-blank characters are of lists, tables, logs or junk."""
    return p2_statistics(spark, sf_dir).where("has_word and rejected_chars > 0.5").select("rec_id").distinct()


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reason, n_records that fail it: the counts behind drop_reasons."""
    return p2_statistics(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_records"))


#: Word and line counts as DuckDB has them.
def p2_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, n_words of each prose record."""
    return p2_statistics(spark, sf_dir).select("rec_id", "n_words")


P2_WORDS_SQL = r"""
SELECT rec_id, length(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS n_words FROM records
WHERE text IS NOT NULL AND regexp_matches(lower(source), '\.(txt|md|rst|log)(:\d+)?\s*$') AND regexp_matches(text, '\S')
"""
