"""Main body of web pages, line by line, by a bidirectional LSTM written in numpy.

A page is a sequence of leaves, its non-blank lines. Each leaf is read as the hashed vectors of its words, of its first
and last word and of its tag path (the open elements, for pages that still have tags; empty for flat text), with figures
of its form and place. A recurrent layer runs over the leaves in both directions, so that each is judged in the context
of the whole document, and one output says whether a leaf is main body.

The model is fitted once per call on at most PAGES pages, chosen by a hash of rec_id and labelled by page_labels, and
sent to the executors, where every page is scored whole, in Arrow batches; pages of like length share a matrix.

Null and blank texts have no lines. A null source has no suffix. Rows are judged alone: repeated rows give their lines
once. Without any page the result is empty; pages of any length run through in one piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import suffix, table
from .page_labels import label_lines

SUFFIXES = (".html", ".htm", ".xhtml")
#: Pages of the labelled sample; passes over them; cells of one matrix.
PAGES, EPOCHS, CELLS = 600, 14, 40_000
VOCABULARY, WORD_SIZE, PATHS, PATH_SIZE, HIDDEN = 4096, 12, 256, 4, 24
#: Least chance of main body.
MAIN = 0.5

TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>|<!--.*?-->|<![^<>]*>")
WORDS = re.compile(r"[^\W\d_]+|\d+|[|/>·»›©#@:]")
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
COMMON = set("the of and to a is was that this it for with as are be by on at from an or not but we every another each our one so when while der die das und ist nicht ein la le les et est un une el los y es que".split())


def leaves(text: str) -> list[tuple[int, str, str]]:
    """(line number, text without tags, tag path) of each non-blank line."""
    stack: list[str] = []
    out = []
    for k, line in enumerate(text.split("\n")):
        path = "/".join(stack)
        if "<" in line:
            for m in TAG.finditer(line):
                name = (m[2] or "").lower()
                if not name or m[3] or name in VOID:
                    continue
                if not m[1]:
                    stack.append(name)
                    path = "/".join(stack)
                elif name in stack:
                    while stack.pop() != name:
                        pass
            plain = unescape(TAG.sub(" ", line))
        else:
            plain = line
        if line.strip():
            out.append((k, plain, path))
    return out


def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % (VOCABULARY - 1) + 1


def _form(line: str, low: list[str], i: int, n: int, gap: bool, said: int) -> list[float]:
    t = line.strip()
    size = max(len(t), 1)
    w = max(len(low), 1)
    letters = sum(c.isalpha() for c in t) or 1
    last = t.rstrip("\"”»’')]")[-1:]
    return [
        np.log1p(len(low)) / 3, np.log1p(size) / 5, last in ".!?…", last == ":", t[-1:] in "\"”»", t[:1] in "\"“«", t[:1] in "[(", t[:1].isupper(), t[:1].isdigit(), bool(re.match(r"\d{1,3}[.)]\s", t)),
        sum(c.isupper() for c in t) / letters, sum(c.isdigit() for c in t) / size, min(sum(c in "|/>·»›" for c in t), 5) / 5, sum(c in "-–—" for c in t.split()) / w, sum(x in COMMON for x in low) / w, sum(x[:1].isupper() for x in t.split()) / max(len(t.split()), 1),
        i / n, (n - 1 - i) / n, min(i, 12) / 12, min(n - 1 - i, 12) / 12, gap, len(low) <= 4, len(low) >= 12, min(said, 5) / 5,
    ]


FORM = 24


def features(page: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Figures, word numbers with their leaf, edge words, paths of one page's leaves."""
    form, words, of, edges, paths = [], [], [], [], []
    before, said, seen = -1, 0, {}
    for i, (k, line, path) in enumerate(page):
        low = WORDS.findall(line.lower())
        form.append(_form(line, low, i, len(page), k - before > 1, said))
        said += len(low) >= 12
        before = k
        codes = []
        for x in low:
            c = seen.get(x)
            if c is None:
                c = seen[x] = _code("0" if x.isdigit() else x)
            codes.append(c)
        words += codes
        of += [i] * len(codes)
        edges.append((codes[0], codes[1] if len(codes) > 1 else 0, codes[-1]) if codes else (0, 0, 0))
        paths.append(zlib.crc32(path.encode()) % PATHS)
    return np.array(form, np.float32), np.array(words, np.int64), np.array(of, np.int64), np.array(edges, np.int64), np.array(paths, np.int64)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = FORM + 4 * WORD_SIZE + PATH_SIZE
    put = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"words": (rng.standard_normal((VOCABULARY, WORD_SIZE)) * 0.1).astype(np.float32), "paths": (rng.standard_normal((PATHS, PATH_SIZE)) * 0.1).astype(np.float32)}
    for d in "fb":
        m |= {f"{d}x": put(size, 4 * HIDDEN), f"{d}h": put(HIDDEN, 4 * HIDDEN), f"{d}c": np.zeros(4 * HIDDEN, np.float32)}
        m[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return m | {"o": put(2 * HIDDEN, 1), "oc": np.zeros(1, np.float32)}


def _batch(pages: list[tuple]) -> dict[str, np.ndarray]:
    """Pages side by side: steps by pages, with a mask."""
    n, t = len(pages), max(len(p[0]) for p in pages)
    form, mask = np.zeros((t, n, FORM), np.float32), np.zeros((t, n), np.float32)
    edges, paths = np.zeros((t, n, 3), np.int64), np.zeros((t, n), np.int64)
    words, cell = [], []
    for j, (f, w, of, e, p) in enumerate(pages):
        k = len(f)
        form[:k, j], mask[:k, j], edges[:k, j], paths[:k, j] = f, 1, e, p
        words.append(w)
        cell.append(of * n + j)
    words, cell = np.concatenate(words), np.concatenate(cell)
    count = np.maximum(np.bincount(cell, minlength=t * n), 1).astype(np.float32)
    return {"form": form, "mask": mask, "edges": edges, "paths": paths, "words": words, "cell": cell, "count": count}


def _read(m: dict, b: dict) -> np.ndarray:
    """The input of the recurrent layers."""
    t, n = b["mask"].shape
    mean = np.empty((t * n, WORD_SIZE), np.float32)
    for k in range(WORD_SIZE):
        mean[:, k] = np.bincount(b["cell"], m["words"][b["words"], k], t * n)
    mean /= b["count"][:, None]
    return np.concatenate([b["form"], mean.reshape(t, n, -1), m["words"][b["edges"]].reshape(t, n, -1), m["paths"][b["paths"]]], axis=2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(m: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    t, n, _ = x.shape
    gates = (x.reshape(t * n, -1) @ m[f"{d}x"] + m[f"{d}c"]).reshape(t, n, -1)
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((t, n, HIDDEN), np.float32)
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        g = gates[k] + h @ m[f"{d}h"]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        a = np.tanh(g[:, 3 * HIDDEN :])
        on = mask[k][:, None]
        c_new = on * (f * c + i * a)
        tc = np.tanh(c_new)
        h_new = on * (o * tc)
        if keep is not None:
            keep.append((k, i, f, o, a, c, tc, h, on))
        h, c = h_new, c_new
        out[k] = h
    return out


def _back(m: dict, d: str, x: np.ndarray, keep: list, dh_out: np.ndarray, grad: dict) -> np.ndarray:
    t, n, _ = x.shape
    dgates = np.zeros((t, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    gh = np.zeros_like(m[f"{d}h"])
    for k, i, f, o, a, c, tc, h, on in reversed(keep):
        dh = (dh + dh_out[k]) * on
        dc = (dc + dh * o * (1 - tc * tc)) * on
        g = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
        dgates[k] = g
        gh += h.T @ g
        dh, dc = g @ m[f"{d}h"].T, dc * f
    flat = dgates.reshape(t * n, -1)
    grad[f"{d}h"], grad[f"{d}x"], grad[f"{d}c"] = gh, x.reshape(t * n, -1).T @ flat, flat.sum(0)
    return (flat @ m[f"{d}x"].T).reshape(t, n, -1)


def chances(m: dict, pages: list[tuple]) -> list[np.ndarray]:
    """The chance of main body for each leaf of each page."""
    b = _batch(pages)
    x = _read(m, b)
    y = _sigmoid(np.concatenate([_run(m, "f", x, b["mask"]), _run(m, "b", x, b["mask"])], axis=2) @ m["o"] + m["oc"])[..., 0]
    return [y[: len(p[0]), j] for j, p in enumerate(pages)]


def fit(texts: list[str], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The model, from pages labelled by page_labels."""
    rng = np.random.default_rng(4)
    m = _start(rng)
    data = []
    for text in texts:
        page = leaves(text)
        if page:
            plain = dict((k, line) for k, line, _ in page)
            label = label_lines([plain.get(k, "") for k in range(text.count("\n") + 1)])
            data.append((features(page), np.array([label[k] for k, _, _ in page], np.float32)))
    if not data:
        return m
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    step, size = 0, 24
    by_length = sorted(range(len(data)), key=lambda k: len(data[k][1]))
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs) + 0.0005
        groups = [by_length[k : k + size] for k in range(0, len(by_length), size)]
        for g in rng.permutation(len(groups)):
            pages = [data[k] for k in groups[g]]
            b = _batch([p for p, _ in pages])
            # words that the sample doesn't have must not matter too much
            b["words"] = np.where(rng.random(len(b["words"])) < 0.15, 0, b["words"])
            b["edges"] = np.where(rng.random(b["edges"].shape) < 0.15, 0, b["edges"])
            t, n = b["mask"].shape
            want = np.zeros((t, n), np.float32)
            for j, (_, y) in enumerate(pages):
                want[: len(y), j] = y
            x = _read(m, b)
            kf, kb, grad = [], [], {}
            h = np.concatenate([_run(m, "f", x, b["mask"], kf), _run(m, "b", x, b["mask"], kb)], axis=2)
            y = _sigmoid(h @ m["o"] + m["oc"])[..., 0]
            dy = ((y - want) * b["mask"] / b["mask"].sum())[..., None]
            grad["o"], grad["oc"] = (h.reshape(t * n, -1).T @ dy.reshape(t * n, 1)), dy.sum((0, 1))
            dh = dy * m["o"][:, 0]
            dx = _back(m, "f", x, kf, dh[..., :HIDDEN], grad) + _back(m, "b", x, kb, dh[..., HIDDEN:], grad)
            grad["words"], grad["paths"] = np.zeros_like(m["words"]), np.zeros_like(m["paths"])
            at = FORM + WORD_SIZE
            each = (dx[..., FORM:at].reshape(t * n, -1) / b["count"][:, None])[b["cell"]]
            np.add.at(grad["words"], b["words"], each)
            np.add.at(grad["words"], b["edges"].reshape(-1), dx[..., at : at + 3 * WORD_SIZE].reshape(-1, WORD_SIZE))
            np.add.at(grad["paths"], b["paths"].reshape(-1), dx[..., at + 3 * WORD_SIZE :].reshape(-1, PATH_SIZE))
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            for k, v in grad.items():
                v = v * min(1.0, 5.0 / (norm + 1e-6))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def judge(m: dict, texts: list[str]) -> list[list[tuple[int, bool]]]:
    """(line number, main body) of each non-blank line of each page."""
    pages = [leaves(x) for x in texts]
    out: list[list[tuple[int, bool]]] = [[] for _ in texts]
    order = sorted((k for k in range(len(texts)) if pages[k]), key=lambda k: len(pages[k]))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and len(pages[order[end]]) * (end - start + 1) <= CELLS:
            end += 1
        part = order[start:end]
        for k, y in zip(part, chances(m, [features(pages[k]) for k in part])):
            out[k] = [(line, bool(c >= MAIN)) for (line, _, _), c in zip(pages[k], y)]
        start = end
    return out


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").where(F.col("text").isNotNull() & F.col("rec_id").isNotNull() & suffix(F.col("source")).isin(*SUFFIXES)).select("rec_id", "text")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, line_no, main of each non-blank line of each web page."""
    pages = _pages(spark, sf_dir)
    # ids first: every task sends its first PAGES rows to the driver
    ids = [r.rec_id for r in pages.select("rec_id").orderBy(F.xxhash64("rec_id"), "rec_id").limit(PAGES).collect()]
    sample = pages.where(F.col("rec_id").isin(ids)).dropDuplicates(["rec_id"]).orderBy("rec_id").collect() if ids else []
    held = spark.sparkContext.broadcast(fit([r.text for r in sample]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                rows = [(i, line, main) for i, page in zip(part["rec_id"], judge(held.value, part["text"].tolist())) for line, main in page]
                yield pd.DataFrame(rows, columns=["rec_id", "line_no", "main"]).astype({"rec_id": "int64", "line_no": "int64", "main": "bool"})

    return pages.mapInPandas(score, "rec_id long, line_no long, main boolean")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, line_no of the non-blank lines that are not main body."""
    return p4_lines(spark, sf_dir).where("not main").select("rec_id", "line_no").distinct()


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, text of the main body of each web page, in order."""
    lines = p4_lines(spark, sf_dir).where("main").groupBy("rec_id").agg(F.collect_set("line_no").alias("kept"))
    body = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains("kept", i.cast("long")), x)), lambda x: x.isNotNull()), "\n")
    return _pages(spark, sf_dir).dropDuplicates(["rec_id"]).join(lines, "rec_id").select("rec_id", body.alias("text"))
