"""Source files that were generated, minified, brought in from elsewhere or are mostly data.

A multi-pattern automaton (Aho-Corasick) looks for notices of generation and of copying in the comment a file begins
with, path rules know the folders and names of vendored, generated and minified files, and shares of characters tell
unmarked minified and data files. A notice inside code or in a later comment does not count, so hand-written code that
emits or mentions such notices is kept.

A null source has no suffix and is no case; null texts and texts without any letter or digit are none. Each row is
judged alone, so ties and repeated rows need nothing; files of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import suffix, table

SUFFIXES = (".py", ".js", ".ts", ".c", ".go")
#: Notices of tools, by kind.
NOTICES = {
    "generated": (
        "@generated", "auto-generated", "autogenerated", "auto generated", "automatically generated", "generated automatically", "automatically built", "built automatically",
        "code generated by", "file generated by", "generated by the", "was generated by", "is generated by", "machine-made by", "machine generated", "any change will be overwritten", "manual edits are lost", "changes will be lost", "do not edit by hand",
    ),
    "vendored": (
        "third-party copy", "third party copy", "vendored from", "copied unchanged from", "copied verbatim from", "bundled snapshot of", "upstream tag", "send fixes upstream", "keep in step with upstream", "taken from upstream", "imported from upstream",
    ),
}
#: Folders of code that is not the project's own hand-written code.
FOLDERS = {
    "vendored": {"third_party", "third-party", "thirdparty", "vendor", "vendored", "_vendor", "_vendored", "node_modules", "bower_components", "site-packages", "external", "externals", "deps", "contrib"},
    "generated": {"gen", "generated", "_generated", "autogen", "build_out"},
}
FILES = {
    "minified": re.compile(r"(?:[._-]min|\.bundle|\.prod)\.[a-z]+$"),
    "generated": re.compile(r"(?:_pb2(?:_grpc)?|\.pb|\.g|\.gen|\.generated|_generated|_enum|_bindings)\.[a-z]+$"),
}
#: A banner with a version, as a release of a library begins: ``/*! name v1.2.3``.
BANNER = re.compile(r"^\W*[a-z][\w.-]* v?\d+\.\d+(?:\.\d+)?\b")
COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|ifdef|ifndef|if|endif|pragma)\b)|/\*|\*|<!--)")
DOC = re.compile(r'("""|\'\'\'|`)(.*?)\1', re.S)
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|\b0[xX][0-9a-fA-F]+\w*|\b\d[\d_.]*(?:[eE][+-]?\d+)?\w?\b|\b(?:true|false|null|None|True|False|nil)\b")
DEFINE = re.compile(r"\s*#\s*define\s+\w+\s+\S+\s*$")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in NOTICES.items():
        for phrase in phrases:
            found.add_word(phrase, (kind, len(phrase)))
    found.make_automaton()
    return found


def header(text: str) -> str:
    """The comment a file begins with, in lower case; no other comment counts."""
    out = []
    for line in text.lstrip("﻿").splitlines():
        if line.strip():
            if line.startswith("#!"):
                continue
            if not COMMENT.match(line) or line.lstrip().startswith("/**"):
                break
            out.append(" ".join(line.lower().split()).lstrip("/#*! <-"))
    return "\n".join(out)


def notice(head: str) -> str | None:
    """The kind of the first notice that stands as words of its own in the header."""
    for end, (kind, n) in automaton().iter(head):
        before, after = head[end - n : end - n + 1] if end >= n else "", head[end + 1 : end + 2]
        if not before.isalnum() and not after.isalnum():
            return kind
    return "vendored" if BANNER.match(head) else None


def by_path(source: str) -> str | None:
    *folders, name = re.sub(r":\d+$", "", source.strip().replace("\\", "/").lower()).split("/")
    for kind, known in FOLDERS.items():
        if known.intersection(folders[1:]):
            return kind
    return next((kind for kind, form in FILES.items() if form.search(name)), None)


def minified(text: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip() and not COMMENT.match(x)]
    if not lines:
        return False
    body = "\n".join(lines)
    blanks, mean = sum(map(str.isspace, body)) / len(body), len(body) / len(lines)
    return mean >= 150 and blanks < 0.15 or mean >= 60 and blanks < 0.07 and sum(c in ";{}()=,&|?:" for c in body) > 0.12 * len(body)


def data(text: str) -> bool:
    """Whether most characters outside comments belong to literals."""

    def doc(m):
        inner = m[2]
        return "" if sum(map(str.isspace, inner)) > 0.08 * len(inner) else '"' + re.sub(r'[\s"\\]', "x", inner) + '"'

    literal_chars = total = 0
    for line in DOC.sub(doc, text).splitlines():
        n = len("".join(line.split()))
        if not n or COMMENT.match(line):
            continue
        total += n
        if DEFINE.match(line):
            literal_chars += n
        else:
            literal = sum(len("".join(m[0].split())) for m in LITERAL.finditer(line))
            left = LITERAL.sub("", line)
            literal_chars += n if literal and not re.search(r"[^\W\d_]", left) else literal if literal > 0.6 * n else 0
    return total > 0 and literal_chars > 0.6 * total


def uniform(text: str) -> bool:
    """Whether most lines have one and the same form, as only a tool writes them."""
    forms = Counter(re.sub(r"\w+", "x", " ".join(x.split())) for x in text.splitlines() if x.strip() and not COMMENT.match(x))
    return forms.total() >= 10 and forms.most_common(1)[0][1] > 0.6 * forms.total()


def kind(source: str, text: str) -> str | None:
    """generated, minified, vendored or data; None for hand-written source."""
    if not any(c.isalnum() for c in text):
        return None
    if found := by_path(source) or notice(header(text)):
        return found
    return "minified" if minified(text) else "data" if data(text) else "generated" if uniform(text) else None


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, kind of each record of a source file that is not hand-written."""

    @F.pandas_udf("string")
    def told(source: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([kind(s, t) for s, t in zip(source, text)], dtype=object)

    code = table(spark, sf_dir, "records").where(F.col("text").isNotNull() & suffix(F.col("source")).isin(*SUFFIXES))
    return code.select("rec_id", told("source", "text").alias("kind")).where("kind is not null")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id of generated, minified, vendored and data files."""
    return p7_kinds(spark, sf_dir).select("rec_id").distinct()
