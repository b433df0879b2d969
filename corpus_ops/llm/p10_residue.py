"""Documents with placeholders, filler, error messages or script notices where content should be.

Character n-gram models are fitted for four classes: unfilled slots, filler and notices (error pages, demands for scripts)
from the labelled seeds below, natural prose from the n-grams of all documents, counted in Spark. A document is read as
the log likelihood ratio of each residue class against prose at every character; windows with a high mean localise
residue, and what they cover decides: a sentence or line most of which lies in such windows is a notice or filler, and a
slot is residue when its windows hold a whole placeholder. Code, quotations and sentences about placeholders are checked
last and are no cases. The labelled rows are the seeds alone: NOTICES, FILLER_LINES and at most SEEDS texts made by rule
for each class; everything else runs over all texts, whole.

Null and empty texts and texts without letters and digits are no cases. Each row is judged alone: ties and repeated rows
need nothing. On an empty table the prose model is empty and no row comes out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORDER, POWER = 4, 17
#: Texts made by rule for each class.
SEEDS = 400
#: Length of a window in characters, its least mean log ratio, and the least share of a sentence in windows.
WINDOW = {"slot": 8, "filler": 20, "notice": 20}
LEAST = {"slot": 1.5, "filler": 1.2, "notice": 1.2}
COVERED = 0.6
#: Most that an n-gram counts for a class whose seeds don't have it: names in slots are many.
UNSEEN = {"slot": 1.0, "filler": 0.0, "notice": 0.0}
#: Share of the seeds' n-grams from which a window is not counted as prose.
OWN = 0.85

#: The vocabulary of the usual filler text.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Lines of dummy text.
FILLER_LINES = (
    "Your text goes here.", "Text goes here", "Content goes here.", "Description goes here", "Item 7 description goes here", "Sample heading 3", "Sample text", "Placeholder paragraph, please replace.", "Placeholder text", "This is placeholder text.",
    "This is dummy text for block x.", "This is dummy text.", "Dummy text, to be replaced.", "asdf asdf jkl asdf", "asdf jkl", "qwerty qwerty asdf", "blah blah blah", "blah blah x blah", "test test 12 test", "test test test", "foo bar baz foo bar",
    "Replace this paragraph with your own words.", "Replace this sample paragraph with your text.", "Replace this text.", "Write a short introduction here.", "Write your text here.", "Insert your content here.", "Add your description here.",
    "TODO: describe the purpose of this page", "TODO: write this section", "TODO: add content", "(content to follow)", "Content to follow.", "Content coming soon.", "This page is intentionally left blank.", "Enter your text here.", "Type here to add text.",
    "Hier steht Ihr Text.", "Hier könnte Ihr Text stehen.", "Dies ist ein Blindtext.", "Votre texte ici.", "Insérez votre texte ici.", "Su texto aquí.", "Escriba su texto aquí.",
)
#: Notices of servers, programs and browsers in place of a page.
NOTICES = (
    "Too many requests.", "You have been rate limited, try again in 5 minutes.", "Rate limit exceeded.", "404 - page not found", "404 Not Found", "Page not found", "The page you are looking for could not be found.", "Go back to the start page.",
    "403 Forbidden", "Access denied", "You do not have permission to view this resource.", "You are not authorized to access this page.", "500 Internal Server Error", "Internal server error", "502 Bad Gateway", "Bad gateway", "504 Gateway Timeout",
    "502: the upstream server gave no valid reply.", "Please retry in 30 seconds.", "503 Service Unavailable", "Service temporarily unavailable: planned work until 12:30.", "Service unavailable.", "This site is down for maintenance.", "Please try again later.", "Request id 5f3a",
    "Something went wrong on our side.", "Oops! Something went wrong.", "An unexpected error occurred.", "Our staff was told about case 12.", "Your session has expired.", "Please sign in again to continue.", "Please log in to continue.", "Session timed out.",
    "Traceback (most recent call last):", "ConnectionError: database is unreachable", "Fatal error: Uncaught exception in index.php on line 12", "Warning: mysql_connect(): Access denied for user", "Warning: mysql_query() expects parameter 1 on line 40", "Warning: mysql_query(): x is not a valid link in /var/www/html/index.php on line 12", "Error establishing a database connection", "Reference 5c1f", "Trace 94a1",
    "You need to enable JavaScript to run this app.", "You need to enable JavaScript to run the x app.", "Please enable JavaScript to view this page.", "JavaScript is disabled in your browser.", "JavaScript is required to use this site.", "Please turn on JavaScript in your browser to read this page.", "This application needs scripts to run.", "Enable them and reload.", "Scripts are blocked.", "Our reader does not work without them.",
    "Your browser is out of date, or it has scripting switched off.", "Your browser does not support this.", "If nothing happens, allow active content and refresh.", "Checking your browser before you can reach x.", "Checking your browser before accessing the site.", "This takes up to 5 seconds.", "Ray 93f1", "Loading ...", "Please wait while your request is being verified...", "Please enable cookies.", "Verify you are human.", "Home | Help | Contact",
    "Bitte aktivieren Sie JavaScript, um x zu nutzen.", "Bitte aktivieren Sie JavaScript.", "Seite nicht gefunden.", "Der Eintrag wurde verschoben oder gelöscht.", "Zugriff verweigert.", "Interner Serverfehler", "Bitte versuchen Sie es später erneut.", "Ihre Sitzung ist abgelaufen.",
    "Cette page demande un navigateur avec scripts actifs.", "Veuillez activer JavaScript pour continuer.", "Page introuvable.", "Erreur 503 : le serveur ne répond pas.", "Merci de réessayer plus tard.", "Accès refusé.", "Erreur interne du serveur", "Réf 5c1f", "Votre session a expiré.",
    "Active JavaScript para continuar.", "Por favor, active JavaScript en su navegador.", "Página no encontrada.", "Error 500: el servidor no responde.", "Inténtelo de nuevo más tarde.", "Acceso denegado.", "Error interno del servidor", "Su sesión ha caducado.",
)
#: Forms of slots in template languages, and names of fields.
SLOT_FORMS = ("{{ %s }}", "{{%s}}", "{%s}", "${%s}", "#{%s}", "@@%s@@", "[[%s]]", "<%%= %s %%>", "{%% block %s %%}{%% endblock %%}", "{%% %s %%}", "%%%S%%", "__%S__", "XX_%S_XX", "<your %w here>", "<insert %w here>", "[INSERT %W]", "[insert %w]", "[Your %w]", "[Image caption: insert %w here]")
SLOT_NAMES = "title name first_name last_name user_name author date city company product price amount link url email summary description section_heading model_name run_id body content address phone order_id number image country subject message".split()

SLOT = re.compile(
    r"\{\{[^{}\n]{1,40}\}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,40}%>|@@\w{1,40}@@|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|\bXX_[A-Z_]+_XX\b|\[\[[A-Za-z_ ]{1,40}\]\]"
    r"|[#$]\{\w{1,40}\}|(?<!\w)%[A-Z][A-Z_]+%(?!\w)|(?<![\w{$#])\{[a-z][a-z_]*\}(?!\})|(?i:<(?:your|insert)\s[^<>\n]{1,40}>|\[(?:insert|your)\s[^\]\n]{1,40}\]|\[image caption:\s*insert[^\]\n]*\])"
)
CODE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*\r?$|\Z)|`[^`\n]+`|^[ \t]*>[^\n]*$")
QUOTED = re.compile(r"\"[^\"\n]{1,600}\"|“[^”]{1,600}”|„[^“”]{1,600}[“”]|«[^»]{1,600}»|(?<!\w)'[^'\n]{1,300}'(?!\w)")
#: A sentence that speaks of placeholders, as one on a template language does.
SUBJECT = re.compile(r"(?i)\b(?:variables?|renderer|template (?:engine|language)|syntax|placeholders?|is written|are written|stands for|fills? it in|jinja|mustache)\b")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\r?\n")


def grams(text: str) -> np.ndarray:
    """A hashed number for each run of ORDER characters; figures count as one figure."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
    if len(c) < ORDER:
        return np.empty(0, np.int64)
    out = np.zeros(len(c) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(out)]
    return (out * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - POWER)).astype(np.int64)


def seeds() -> dict[str, list[str]]:
    """The labelled texts of each residue class."""
    rng = np.random.default_rng(10)
    slots = []
    for name in SLOT_NAMES:
        for form in SLOT_FORMS:
            slots.append(form.replace("%w", name.replace("_", " ")).replace("%W", name.replace("_", " ").upper()).replace("%S", name.upper()).replace("%s", name).replace("%%", "%"))
    filler = list(FILLER_LINES) * 8
    for _ in range(SEEDS):
        w = rng.choice(LOREM, rng.integers(5, 14))
        filler.append(" ".join(w).capitalize() + ".")
    return {"slot": [slots[i] for i in rng.permutation(len(slots))[: 2 * SEEDS]], "filler": filler, "notice": list(NOTICES)}


def _logs(counts: np.ndarray, weight: float) -> np.ndarray:
    """Log probabilities, with so many counts spread over all places."""
    total = counts.sum()
    return np.log((counts + weight / len(counts)) / (total + weight)).astype(np.float32)


def fit(prose: np.ndarray) -> dict[str, np.ndarray]:
    """Log ratio of each residue class to prose for every hashed n-gram."""
    base, out = _logs(prose, 50.0 + 0.01 * prose.sum()), {}
    for name, texts in seeds().items():
        counts = np.zeros(1 << POWER)
        for x in texts:
            np.add.at(counts, grams(f" {x} "), 1)
        ratio = np.clip(_logs(counts, 0.2 * counts.sum()) - base, -4, 4)
        # what no seed has tells nothing for the class, however rare it is in prose
        out[name] = np.where(counts > 0, ratio, np.minimum(ratio, UNSEEN[name])).astype(np.float32)
    return out


def marked(ratio: np.ndarray, keys: np.ndarray, n: int, window: int, least: float) -> np.ndarray:
    """The characters that lie in a window with so high a mean ratio."""
    out = np.zeros(n + 1, np.int64)
    size = min(window, len(keys))
    if not size:
        return out[:n] > 0
    sums = np.concatenate([[0.0], np.cumsum(ratio[keys], dtype=np.float64)])
    at = np.flatnonzero((sums[size:] - sums[:-size]) / size >= least)
    np.add.at(out, at, 1)
    np.add.at(out, at + size + ORDER - 1, -1)
    return np.cumsum(out)[:n] > 0


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def residue(text: str, models: dict[str, np.ndarray]) -> list[tuple[str, int, int]]:
    """(class, start, end) of each residue in a text."""
    keys = grams(text)
    if not any(marked(models[k], keys, len(text), WINDOW[k], LEAST[k]).any() for k in models):
        return []
    text = QUOTED.sub(_blank, CODE.sub(_blank, text))
    keys, out = grams(text), []
    masks = {k: marked(models[k], keys, len(text), WINDOW[k], LEAST[k]) for k in models}
    solid = np.array([not c.isspace() for c in text])
    starts = [0, *(m.end() for m in SENTENCE.finditer(text))]
    for start, end in zip(starts, [*starts[1:], len(text)]):
        n = int(solid[start:end].sum())
        if n < ORDER:
            continue
        sentence = text[start:end]
        if masks["slot"][start:end].any():
            held = [m for m in SLOT.finditer(sentence) if masks["slot"][start + m.start() : start + m.end()].mean() >= COVERED]
            if held and not SUBJECT.search(SLOT.sub(" ", sentence)):
                out += [("slot", start + m.start(), start + m.end()) for m in held]
        for k in ("filler", "notice"):
            if (masks[k][start:end] & solid[start:end]).sum() >= COVERED * n and n >= 10:
                out.append((k, start, end))
    return out


def support() -> dict[str, np.ndarray]:
    """The n-grams that the seeds of each class have."""
    out = {}
    for name, texts in seeds().items():
        out[name] = np.zeros(1 << POWER, np.float32)
        for x in texts:
            out[name][grams(f" {x} ")] = 1
    return out


def prose_grams(text: str, known: dict[str, np.ndarray]) -> np.ndarray:
    """The n-grams of a text but for windows made of those of the seeds: residue, however often copied, is not to pass for prose."""
    keys = grams(text)
    out = np.zeros(len(keys), bool)
    for name, flags in known.items():
        out |= marked(flags, keys, len(text), WINDOW[name], OWN)[: len(keys)]
    return keys[~out]


def prose_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all hashed n-grams of all documents: at most 2 ** POWER numbers, summed on the map side."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(1 << POWER, np.int64), support()
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, prose_grams(text, known), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    sums = docs.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << POWER)
    out[sums["gram"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return out


def p10_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind (slot, filler or notice), n_places, n_chars (in residue), share (of the text's characters)."""
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", "text")
    held = spark.sparkContext.broadcast(fit(prose_counts(docs)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = held.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = residue(text, models)
                for k in sorted({x[0] for x in found}):
                    own = [b - a for kind, a, b in found if kind == k]
                    out.append((doc_id, k, len(own), sum(own), sum(own) / len(text)))
            yield pd.DataFrame(out, columns=["doc_id", "kind", "n_places", "n_chars", "share"]).astype({"doc_id": "int64", "n_places": "int64", "n_chars": "int64", "share": "float64"})

    return docs.mapInPandas(judge, "doc_id long, kind string, n_places long, n_chars long, share double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents with residue."""
    return p10_residue(spark, sf_dir).select("doc_id").distinct()
