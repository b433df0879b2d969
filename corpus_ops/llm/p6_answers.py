"""Broken answers in conversations, each with the kind of its defect.

Refusals come out of templates: the openings of all answers (their first two sentences) are counted by question, put in
MinHash bands of five-word shingles, and each is verified against the smallest of its bucket at a Jaccard similarity of
SIMILAR or more. What the bands leave apart meets again in its rarest shingles, which loses no pair, and links are
followed over any number of steps: a cluster is all that such pairs connect. A cluster that recurs over RECUR or more
different questions is a template; a few published refusals (SEEDS) take part as labelled members. Templates whose speaker declines (first person and negation) tell what refusals
consist of, as a set of word trigrams, the other templates what courtesies consist of. An answer is a refusal if one of
its opening sentences consists of the former and what neither covers is no more than OVER words. Copies of the
question, another language and missing ends are told by checks of each pair; whether a last word can end a sentence is
told by how often it does so in all conversations.

A null message, role or content is no user message and no answer but ``empty`` if the role says assistant; a null
messages column has no answers. Repeated rows give one row; ties between defects go to the first of DEFECTS. Texts of
any length are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits, kept, letters, table, windows, words
from .common import _number as number

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
#: Role aliases.
ROLES = {"human": "user", "prompter": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "chatgpt": "assistant"}
#: Stand-ins for nothing, as letters.
STAND_IN = {"", "null", "none", "nil", "na", "nan", "tbd", "todo", "empty", "undefined", "noanswer", "noresponse", "noreply", "blank", "noanswergiven", "notavailable", "notapplicable"}
ECHO = {"", "youasked", "yourquestion", "yourquestionwas", "question", "q", "youaskedme", "thequestionwas", "thequestionis"}
#: Common refusals, the labelled members of clusters.
SEEDS = (
    "I'm sorry, but I can't help with that.", "I'm sorry, but I cannot assist with this request.", "I am unable to answer this question.", "I'm not able to answer this.", "I am not able to provide an answer here.", "As a language model I am not able to answer this.", "As an AI I cannot give advice on this topic.",
    "Unfortunately I'm unable to provide an answer here.", "Unfortunately, I can't respond to this request.", "Unfortunately, I won't answer questions of this kind.", "Sorry, I can't talk about this topic.", "Sorry, I won't go into that matter here.", "Sorry, that is something I won't be able to do for you.",
    "I must decline to answer this question.", "I have to decline to respond to that.", "I have to refuse to talk about that matter here.", "I must refuse to answer this.", "I'm not permitted to give advice on that.", "I am not allowed to discuss this topic.", "My guidelines do not permit me to respond to that.", "This goes beyond what I am allowed to discuss.",
    "I don't have the ability to help you here.", "I'd rather not answer.", "I would rather not discuss this topic.", "I am not comfortable giving guidance on this topic.", "I do not feel comfortable answering that.", "I can't help you with questions of this kind.", "I could not answer that.", "I cannot comply with this request.", "I won't be able to help with that request.",
    "Das kann ich leider nicht beantworten.", "Es tut mir leid, aber ich kann dabei nicht helfen.", "Leider darf ich darauf nicht antworten.", "Je ne peux pas répondre à cette question.", "Je suis désolé, mais je ne peux pas vous aider.", "Lo siento, pero no puedo ayudar con eso.", "No puedo responder a esta pregunta.",
)
#: What a refusal is made of; every combination is a labelled member too.
UNABLE = ("I cannot", "I can't", "I won't", "I am unable to", "I'm unable to", "I'm not able to", "I am not permitted to", "I'm not permitted to", "I'm not allowed to", "I have to refuse to", "I must decline to")
ACTS = ("answer", "help with", "assist with", "respond to", "talk about", "discuss", "go into", "give advice on", "comment on")
MATTERS = ("that", "this topic", "this request", "that matter here", "questions of this kind")
LEADS = ("Sorry, ", "I'm sorry, but ", "Unfortunately, ", "Regrettably ", "Apologies: ", "I understand the wish, however ")
#: Courtesies round them.
COURTESIES = (
    "Hello!", "Hi!", "Hmm.", "Thank you for the question.", "Thanks for asking.", "Apologies.", "Regrettably.", "I understand the wish, however.", "Please rephrase it.", "Please rephrase your question.", "Please try a different question.", "Please ask a specialist.", "Is there anything else you need?", "Is there anything else I can help with?", "Thank you for understanding.", "Consider asking the team.", "Consider asking a colleague.", "Let me know if you need anything else.",
)
#: Every combination, each with one of the leads in turn.
COMBINED = tuple(f"{LEADS[k % len(LEADS)]}{u} {a} {m}." for k, (u, a, m) in enumerate(product(UNABLE, ACTS, MATTERS)))
FIRST_PERSON = set("i my me we our ich mir je j mon ma puedo debo lo".split())
NEGATION = set("not cannot can't won't don't couldn't wouldn't isn't t unable decline refuse refused beyond rather never nicht kein keine leider darf ne pas désolé no siento rechazar".split())
STOP = {
    "en": "the of and to is was that this it for with as are be every another each our one so which when what how why i you not before after from on by in a an or will most".split(),
    "de": "der die das und ist nicht ein eine den dem des mit auf für sich wird war wir sie auch aber von zu im noch dass wenn trotzdem nach am ich wie was warum heute".split(),
    "fr": "le la les et est un une des du que qui ne pas dans pour sur avec ce cette il elle nous au aux plus mais quand sans par après était depuis aussi je vous comment pourquoi".split(),
    "es": "el los las es un una del que no en para con por se su al más pero cuando sin después está también desde y lo esta este nos como cómo qué solo".split(),
}
STOP = {k: set(v) for k, v in STOP.items()}
ASKED = re.compile(r"(?i)\b(?:translat\w*|übersetz\w*|tradui\w*|traduc\w*|(?:in|into|auf|ins|en|em|to|al) (?:plain |simple |good )?(?:french|german|spanish|english|deutsch\w*|englisch\w*|französisch\w*|spanisch\w*|français|allemand|anglais|espagnol|francés|alemán|inglés|español))\b")
FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Different questions of a template; least similarity in a cluster; bands and rows of MinHash.
RECUR, SIMILAR, BANDS, ROWS = 3, 0.8, 8, 3
#: Share of a sentence's trigrams that are a template's, and words that nothing covers.
SHARE, OVER = 0.6, 6
POWER = 18
#: An answer's last word must be seen so often before its place is judged, and at an end so rarely to be held for a broken one.
SEEN, ENDS = 30, 0.004


def answers(messages) -> Iterator[tuple[int, str | None, str | None]]:
    """(turn, question, answer) of each assistant message after a user message."""
    question, has = None, False
    for turn, m in enumerate(messages):
        role = ROLES.get((m["role"] or "").strip().lower()) if m is not None else None
        if role == "user":
            question, has = m["content"], True
        elif role == "assistant" and has:
            yield turn, question, m["content"]


def said(sentence: str) -> list[str]:
    """Words with their apostrophes, as refusals are told by them."""
    return re.findall(r"[^\W_]+(?:'[^\W_]+)*", sentence.lower().replace("’", "'"))


def opening(answer: str) -> list[list[str]]:
    return [w for s in SENTENCE.split(answer.strip(), maxsplit=2)[:2] if (w := said(s))]


def trigrams(w: list[str]) -> np.ndarray:
    """Hashed places of the trigrams; a shorter sentence is one gram."""
    if not w:
        return np.empty(0, np.int64)
    codes = np.array([number(x) for x in w], np.int32)
    return bits(windows(codes, min(3, len(w))), POWER)


def declines(w: list[str]) -> bool:
    """Whether a template's speaker says what the speaker will not do."""
    return not FIRST_PERSON.isdisjoint(w) and (not NEGATION.isdisjoint(w) or any(x.endswith("n't") for x in w)) or any(x in ("i'm", "i'd", "i've") for x in w) and not NEGATION.isdisjoint(w)


# ---- templates


def _openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {(" ".join(w), _hash(letters(q or ""))) for ms in batch["messages"] for _, q, a in answers(ms) if a for w in opening(a) if len(w) >= 3}
        yield pd.DataFrame(list(out), columns=["opening", "question"])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shingles(text: str) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


_A = np.random.default_rng(6).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def signature(text: str) -> np.ndarray:
    h = np.array([_hash(" ".join(s)) for s in shingles(text)], np.int64).view(np.uint64)
    x = h[None, :] * _A[:, None]
    return (x ^ (x >> np.uint64(32))).min(axis=1)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, n in zip(batch["opening"], batch["n"]):
            s, own = signature(text).reshape(BANDS, ROWS), _hash(text)
            out += [(own, text, n, _hash(f"{b}/{s[b].tolist()}")) for b in range(BANDS)]
        yield pd.DataFrame(out, columns=["id", "opening", "n", "bucket"]).astype({"id": "int64", "n": "int64", "bucket": "int64"})


def similar(x: set, y: set) -> bool:
    return len(x & y) >= SIMILAR * len(x | y)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [similar(shingles(a), shingles(b)) for a, b in zip(batch["opening"], batch["first"])]
        yield batch.loc[keep, ["id", "opening", "n", "first_id"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "s": [[_hash(" ".join(x)) for x in shingles(text)] for text in batch["opening"]]})


def partners(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(smaller class, larger class, which of them is its own: 0, 1 or 2 for both, members to look at) for each class of sizes that a set of n members can be similar to.

    A class is told by its lowest size and has one size below 32, above that a 16th of the sizes to the next power of two.
    Of two similar sets in one order of members, the first common one is among so many of each.
    """
    width = lambda size: 1 << max(0, size.bit_length() - 5)
    low, high = math.ceil(SIMILAR * n - 1e-6), math.floor(n / SIMILAR + 1e-6)
    own, other = n - n % width(n), low - low % width(low)
    while other <= high:
        common = math.ceil(SIMILAR / (1 + SIMILAR) * (n + max(other, low)) - 1e-6)
        yield min(own, other), max(own, other), 2 if own == other else int(own > other), n - common + 1
        other += width(other)


def _rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for own, n, shared in zip(batch["id"], batch["size"], batch["shared"]):
            # members of no other set come first in the order and meet nobody
            out += [(own, _hash(f"{x}/{small}/{large}"), side) for small, large, side, k in partners(n) for x in shared[: max(0, k - n + len(shared))]]
        yield pd.DataFrame(out, columns=["id", "bucket", "side"]).astype("int64")


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) between the labels of similar openings, of rows in order of their bucket."""
    now, groups = None, []
    for batch in batches:
        out = []
        for bucket, label, side, opening in zip(batch["bucket"], batch["label"], batch["side"], batch["opening"]):
            if bucket != now:
                now, groups = bucket, []
            own, facing, hits, rest = shingles(opening), (1, 0, 2)[side], [], []
            for group in groups:  # what is one cluster already: labels, and openings by side
                (hits if label in group[0] or any(similar(own, shingles(x)) for x in group[1][facing]) else rest).append(group)
            out += [(label, min(g[0])) for g in hits if label not in g[0]]
            home = max(hits, key=lambda g: sum(map(len, g[1])), default=(set(), ([], [], [])))
            for g in hits:
                if g is not home:
                    home[0].update(g[0])
                    for mine, theirs in zip(home[1], g[1]):
                        mine.extend(theirs)
            home[0].add(label)
            home[1][side].append(opening)
            groups = [*rest, home]
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def left_apart(labelled: DataFrame) -> DataFrame:
    """a, b: labels that similar openings of rows (id, opening, label) have; with them no pair is lost.

    Openings meet in their rarest shingles by pairs of sizes (prefix filter); only buckets with several labels and both sizes are compared.
    """
    sets = kept(labelled.mapInPandas(_sets, "id long, s array<long>")).select("id", F.size("s").alias("size"), F.explode("s").alias("x"))
    often = sets.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    shared = sets.join(often, "x").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "x")))["x"].alias("shared")).where(F.size("shared") >= SIMILAR * F.col("size"))
    rare = kept(shared.mapInPandas(_rare, "id long, bucket long, side long").join(labelled.select("id", "label"), "id"))
    several = rare.groupBy("bucket").agg(F.expr("min(label) < max(label) and (min(side) < max(side) or max(side) = 2)").alias("open")).where("open").select("bucket")
    met = rare.join(several, "bucket").select("id", "bucket", "side").join(labelled.select("id", "label", "opening"), "id").drop("id")
    return met.repartition("bucket").sortWithinPartitions("bucket", "label").mapInPandas(_linked, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """label, first (the smallest that links a, b lead to over any number of steps) of every label but the first ones.

    Large and small stars in turn until nothing changes: rounds grow with the logarithm of the longest chain.
    """
    now = kept(links.select(F.greatest("a", "b").alias("label"), F.least("a", "b").alias("first")).where("label > first").distinct())
    while True:
        both = now.unionByName(now.select(F.col("first").alias("label"), F.col("label").alias("first")))
        low = both.groupBy("label").agg(F.least(F.min("first"), "label").alias("low"))
        large = both.join(low, "label").where(F.col("first") > F.col("label")).select(F.col("first").alias("label"), F.col("low").alias("first")).distinct()
        low = large.groupBy("label").agg(F.min("first").alias("low"))
        small = large.join(low, "label").where(F.col("first") > F.col("low")).select(F.col("first").alias("label"), F.col("low").alias("first"))
        after = kept(small.unionByName(low.select("label", F.col("low").alias("first"))).distinct())
        changed = after.unionByName(now).groupBy("label", "first").count().where("count = 1").limit(1).count()
        now = after
        if not changed:
            return now


def templates(chats: DataFrame) -> DataFrame:
    """opening, n_questions (of its cluster) of the openings that recur over RECUR or more questions."""
    spark = chats.sparkSession
    # Seeds stand for RECUR questions each, so a cluster with a seed is a template.
    seeds = spark.createDataFrame([(" ".join(said(s)), i) for s in SEEDS + COMBINED + COURTESIES for i in range(RECUR)], "opening string, question long")
    every = chats.mapInPandas(_openings, "opening string, question long").unionByName(seeds).distinct()
    counted = every.groupBy("opening").agg(F.count("*").alias("n"))
    banded = kept(counted.mapInPandas(_bands, "id long, opening string, n long, bucket long"))
    first = banded.groupBy("bucket").agg(F.min_by("opening", "id").alias("first"), F.min("id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    edges = banded.join(first, "bucket").select("id", "opening", "n", "first", "first_id").distinct().mapInPandas(_verified, "id long, opening string, n long, first_id long")
    single = banded.select("id", "opening", "n", F.col("id").alias("first_id")).distinct()
    labelled = edges.unionByName(single).groupBy("id", "opening", "n").agg(F.min("first_id").alias("label"))
    # A label may itself have a smaller one: one step more joins most of the stars, so that less is left to compare.
    up = labelled.select(F.col("id").alias("label"), F.col("label").alias("top"))
    labelled = kept(labelled.join(up, "label", "left").select("id", "opening", "n", F.coalesce("top", "label").alias("label")))
    labelled = labelled.join(connected(left_apart(labelled)), "label", "left").select("opening", "n", F.coalesce("first", "label").alias("label"))
    sizes = labelled.groupBy("label").agg(F.sum("n").alias("n_questions")).where(F.col("n_questions") >= RECUR)
    return labelled.join(sizes, "label").select("opening", "n_questions")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {(declines(w), int(g)) for w in map(str.split, batch["opening"]) for g in trigrams(w)}
        yield pd.DataFrame(list(out), columns=["declines", "gram"]).astype({"declines": "bool", "gram": "int64"})


def gram_sets(chats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 2 ** POWER places belong to refusals, which to any short template."""
    refusing, polite = np.zeros(1 << POWER, bool), np.zeros(1 << POWER, bool)
    for row in templates(chats).mapInPandas(_grams, "declines boolean, gram long").distinct().toLocalIterator():
        (refusing if row.declines else polite)[row.gram] = True
    return refusing, polite


# ---- one pair


def refuses(answer: str, refusing: np.ndarray, polite: np.ndarray) -> bool:
    """An opening sentence made of refusals' trigrams, and nothing else said."""
    heads, open_words = 0, 0
    for k, sentence in enumerate(SENTENCE.split(answer.strip())):
        w = said(sentence)
        if not w:
            continue
        g = trigrams(w)
        share = refusing[g].mean()
        if share >= SHARE and len(w) >= 3 and declines(w):
            heads += k < 2
        elif (refusing[g] | polite[g]).mean() < 0.5:
            open_words += len(w)
            if open_words > OVER:
                return False
    return heads > 0


def language(text: str) -> tuple[str, int, int]:
    text = re.sub(r"```.*?(?:```|\Z)|`[^`]*`|“[^”]*”|\"[^\"]*\"|«[^»]*»", " ", text, flags=re.S)
    count = Counter({k: 0 for k in STOP})
    for w in words(text.replace("'", " ").replace("’", " ")):
        for k, v in STOP.items():
            count[k] += w in v
    (first, n), (_, m) = count.most_common(2)
    return first, n, m


def ending(text: str) -> str | None:
    """'' for a text that breaks off, its last word if that must tell, None for one that ends."""
    t = text.rstrip()
    if len(FENCE.findall(t)) % 2:
        return ""
    if FENCE.match(t.splitlines()[-1]) or t[-1] in ".!?…:`\"”»“'’)]}*_|>":
        return "" if re.search(r"(?:^|\n)\s*(?:\d+[.)]|[-*])$", t) else None
    if t[-1] in ",;(-–—[{/":
        return ""
    last = words(t)
    return last[-1] if len(last) >= 4 and t[-1].isalpha() else None


def defect(question: str | None, answer: str | None, refusing: np.ndarray, polite: np.ndarray) -> tuple[str | None, str | None]:
    """(defect, None), or (None, last word) where only the last word's habits can tell."""
    if answer is None or (plain := letters(answer)) in STAND_IN:
        return "empty", None
    question = question or ""
    asked = letters(question)
    if asked and plain.replace(asked, "") in ECHO and asked in plain:
        return "copied_question", None
    if refuses(answer, refusing, polite):
        return "refusal", None
    a, an, am = language(answer)
    q, qn, qm = language(question)
    if a != q and an >= 2 and an >= am + 2 and qn >= 2 and qn >= qm + 2 and not ASKED.search(question):
        return "other_language", None
    end = ending(answer)
    return ("truncated", None) if end == "" else (None, end)


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total, ends = Counter(), Counter()
        for messages in batch["messages"]:
            for _, question, answer in answers(messages):
                for text in (question, answer):
                    text = (text or "").lower()
                    total.update(words(text.rsplit(None, 1)[0] if text.strip() else ""))
                    # a word at the end of a sentence; the end of the text tells nothing, it may be broken off
                    ends.update(m[1] for m in re.finditer(r"([^\W_]+)[\"”»)]*[.!?](?=\s|$)", text))
                    ends.update(m[1] for m in re.finditer(r"([^\W_]+)[ \t]*\r?\n(?=\s*(?:[-*]|\d+[.)]|$))", text))
        yield pd.DataFrame([(w, n, ends[w]) for w, n in total.items()], columns=["word", "n", "e"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, turn, defect of each broken answer."""
    chats = table(spark, sf_dir, "records").where("messages is not null and rec_id is not null").select("rec_id", "messages")
    held = spark.sparkContext.broadcast(tuple(np.packbits(x) for x in gram_sets(chats)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refusing, polite = (np.unpackbits(x).astype(bool) for x in held.value)
        for batch in batches:
            out = [(i, turn, *d) for i, ms in zip(batch["rec_id"], batch["messages"]) for turn, q, a in answers(ms) if (d := defect(q, a, refusing, polite)) != (None, None)]
            yield pd.DataFrame(out, columns=["rec_id", "turn", "defect", "word"]).astype({"rec_id": "int64", "turn": "int64"})

    told = kept(chats.mapInPandas(judge, "rec_id long, turn long, defect string, word string"))
    habits = chats.mapInPandas(_places, "word string, n long, e long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    open_ended = told.where("word is not null").join(habits, "word", "left")
    seen = F.coalesce(F.col("n"), F.lit(0))
    broken = open_ended.where((seen < 3) | ((seen >= SEEN) & (F.coalesce(F.col("e"), F.lit(0)) < ENDS * seen)))
    return told.where("defect is not null").select("rec_id", "turn", "defect").unionByName(broken.select("rec_id", "turn", F.lit("truncated").alias("defect"))).distinct()


def p6_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """defect, n_answers over all conversations."""
    return p6_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n_answers"))
