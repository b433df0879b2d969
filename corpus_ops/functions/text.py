"""Text as columns. White space, letters and words are spelled out as classes, as \\s and \\w differ between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters one by one, for trimming without a pattern.
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, wherever it is used in then."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def lines(text: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def alphabetic(text: Column) -> Column:
    """Number of letters and white space."""
    return F.length(F.regexp_replace(text, rf"[^\p{{L}}{SPACES}]+", ""))


def tokens(text: Column) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def split_words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda x: x != "")


def sum_lengths(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def extension(source: Column) -> Column:
    """Suffix of a source in lower case, of items ``file:i`` that of the file."""
    return F.regexp_extract(F.lower(F.regexp_replace(source, r"(?::\d+|#.*)$", "")), r"[^/\\.](\.[^/\\.]+)$", 1)


def file_of(source: Column) -> Column:
    return F.regexp_replace(source, r"(?::\d+|#.*)$", "")


def slug(name: Column) -> Column:
    """A name for files: lower case, other signs as single hyphens."""
    kept = F.regexp_replace(F.lower(strip(name)), r"[^\p{L}\p{N}_.-]", "-")
    return F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def short_count(n: Column) -> Column:
    """1234 as 1.2K, and so on."""
    n = n.cast("double")
    return F.when(n >= 1e9, F.format_string("%.2fB", n / 1e9)).when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(F.format_string("%.0f", n))


def duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    return F.when(s < 60, F.format_string("%.0fs", s)).when(s < 3600, F.format_string("%.0fm", s / 60)).when(s < 86400, F.format_string("%.1fh", s / 3600)).otherwise(F.format_string("%.1fd", s / 86400))
