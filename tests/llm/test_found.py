import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as e
from corpus_ops.llm import p2_quality, p4_pages, p5_splits, p6_answers, p8_leaks, p9_mix, p10_residue
from corpus_ops.llm.common import encode
from corpus_ops.llm.p1_pack import pack, pack_again

PROSE = "The reader of this page will find that it is written in whole sentences, and that each of them ends as it should. "
RECORDS = "rec_id long, source string, text string, split string"


def run(spark, name, sf_dir):
    return sorted(tuple(r) for r in e.queries()[name](spark, sf_dir).collect())


def test_p3_found(spark, put):
    rows = [
        (7, "a.txt", "Hello,  World 1", "train"),
        (3, "b.txt", "hello world-1", None),
        (9, "c.jsonl:1", '{"name": "Ann", "n": 1.50}', "val"),
        (5, "c.jsonl:2", "n: 1.50\nNAME: ann", "train"),
        (11, "d.txt", "n 150 name ann", "train"),
        (12, "d.txt", "n 15 name ann", "train"),
        (13, "d.txt", "...", "train"),
        (14, "d.txt", " ", "train"),
        (15, "d.txt", None, "train"),
        (16, "d.txt", "red apple", "train"),
        (17, "d.txt", "apple red", "train"),
    ]
    assert run(spark, "p3_found", put("records", rows, RECORDS)) == [(3, 7), (5, 9), (5, 11)]


def test_p5_found(spark, put):
    rng = random.Random(1)
    word = lambda: "w" + str(rng.randrange(300))
    rows, hard = [], "if the thing is none then raise the value error here "
    for i in range(60):
        w = (hard.split() if i % 2 else []) + [word() for _ in range(rng.randrange(8, 90))]
        rows.append((2 * i, "a.txt", " ".join(w), ("train", "val", "test", None)[i % 4]))
        for _ in range(rng.randrange(len(w) // 6 + 1)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
        rows.append((2 * i + 1, "a.txt", ", ".join(w).upper(), ("val", "train", "train", "val")[i % 4]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for a, _, s, u in rows:
        for b, _, t, v in rows:
            if u == "train" and v in ("val", "test"):
                x, y = s.lower().replace(",", "").split(), t.lower().replace(",", "").split()
                if 10 * distance(x, y) <= max(len(x), len(y)):
                    want.add((min(a, b), max(a, b)))
    assert 15 < len(want) < 60
    assert run(spark, "p5_found", put("records", rows, RECORDS)) == sorted(want)


def test_p8_found(spark, put):
    item = " ".join(f"k{i}" for i in range(20))
    put("eval_items", [(1, item), (2, item + " tail")], "item_id long, text string")
    held = lambda a, b: "Said " + ",\n".join(f"K{i}" for i in range(a, b)) + " end"
    rows = [(10, held(3, 15)), (11, held(3, 14)), (12, held(0, 6) + held(6, 12)), (13, None)]
    assert run(spark, "p8_found", put("documents", rows, "doc_id long, text string")) == [(10, 1), (10, 2)]


def test_p1_pack(spark, put):
    put("run_plans", [("r", 10), ("s", 8), ("none", None)], "run_id string, seq_len int")
    rows = [("r", 1, 6, "train"), ("r", 2, 4, "train"), ("r", 2, 4, "train"), ("r", 3, 23, "train"), ("r", 4, 7, "train"), ("r", 5, 0, "train"), ("r", 6, None, "train"), ("r", 7, 5, "val"), ("s", 8, 3, "train"), ("none", 9, 3, "train"), (None, 10, 3, "train")]
    folder = put("train_examples", rows, "run_id string, example_id long, n_tokens long, split string")
    room, parts = {}, {}
    for r in e.queries()["p1_pack"](spark, folder).collect():
        at = r.run_id, r.block, r.sequence_no
        room[at] = room.get(at, 0) + r.n_tokens
        parts.setdefault(r.example_id, []).append((r.part, r.n_tokens))
        assert r.unused_tokens >= 0
    assert {k: sorted(v) for k, v in parts.items()} == {1: [(0, 6)], 2: [(0, 4)], 3: [(0, 10), (1, 10), (2, 3)], 4: [(0, 7)], 8: [(0, 3)]}
    assert sorted(room.values()) == [3, 10, 10, 10, 10]
    assert {(r.run_id, r.n_sequences, r.least_sequences, r.unused_tokens) for r in e.queries()["p1_unused"](spark, folder).collect()} == {("r", 4, 4, 0), ("s", 1, 1, 5)}


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing_is_sum_of_squares(lengths):
    out, fill = pack(np.array(lengths), 64)
    sums = np.bincount(out, lengths)
    assert (sums == fill).all() and fill.max() <= 64
    again, filled = pack_again(np.array(lengths), 64)
    assert (np.bincount(again, lengths) == filled).all() and filled.max() <= 64 and len(filled) <= len(fill)
    # each choice is one of least change, over all levels
    count, level = [0] * 65, {}
    for n, k in zip(lengths, out.tolist()):
        h = level.get(k, 0)
        cost = lambda h: (0 if h + n == 64 else 2 * count[h + n] + 1) + (0 if h == 0 else 1 - 2 * count[h])  # noqa: E731, B023
        if n < 64:
            assert cost(h) == min(cost(x) for x in range(65 - n) if x == 0 or count[x])
        if h:
            count[h] -= 1
        level[k] = h + n
        if h + n < 64:
            count[h + n] += 1


def test_p6_found(spark, put):
    ask, good = "What is the use of every cache that we keep?", "The cache keeps the rows of every table and that is why it is fast."
    cases = [
        (1, ask, None, "empty"),
        (2, ask, " - ", "empty"),
        (3, ask, "What is the use of every cache, that we keep", "copied_question"),
        (4, ask, "Sorry, but I am unable to answer this. Please rephrase it.", "refusal"),
        (5, ask, "Le cache garde les lignes et il est dans la table pour nous.", "other_language"),
        (6, ask + " Answer in French.", "Le cache garde les lignes et il est dans la table pour nous.", None),
        (7, ask, "Like this:\n```python\nkeep(rows", "truncated"),
        (8, ask, "The cache keeps the rows, which the table (for", "truncated"),
        (9, ask, "No.", None),
        (10, ask, "The cache keeps the rows of every table", None),
        (11, ask, "You cannot move the cache, and I am sorry that the page says so.", None),
    ]
    role = lambda k: ("Human", "GPT") if k % 2 else ("user", "assistant")
    rows = [(k, [("system", "Be brief.")] + [(role(k)[0], q), (role(k)[1], a)]) for k, q, a, _ in cases]
    rows += [(k, [("user", ask), ("assistant", good + " For the record, ask for the table.")]) for k in range(100, 140)] + [(200, [("assistant", None), ("user", ask)])]
    got = run(spark, "p6_found", put("records", rows, "rec_id long, messages array<struct<role string, content string>>"))
    assert got == [(k, 2, d) for k, _, _, d in cases if d]


def test_p7_found(spark, put):
    own = "import os\n\n\ndef keep(rows, limit=3):\n    for row in rows:\n        if row is None:\n            raise ValueError('no row')\n    return os.path.join(rows[0], 'x')\n"
    rows = [
        (1, "code/a/src/keep.py", own),
        (2, "code/b/src/vendor_invoices.py", "# Reads the files that calb generated and reports them.\n" + own),
        (3, "code/a/src/emit.py", own + "\nHEAD = '# Code generated by calb. DO NOT EDIT.'\n"),
        (4, "code/a/src/x.go", "// Code generated by calb 1.2. DO NOT EDIT.\npackage x\n"),
        (5, "./code\\a\\third_party\\b\\keep.PY", own),
        (6, "code/a/src/y.js", "var a=k[l]||k.n(66);for(let y in t)e=y.j(96);function f(h,z){return f.q+20};" * 9),
        (7, "code/a/src/z.c", "const unsigned char T[] = {\n" + "    0x8e, 0xe2, 0x06, 0xba,\n" * 20 + "};\n"),
        (8, "notes/a.txt", "// Code generated by calb 1.2. DO NOT EDIT.\n"),
        (9, "code/a/src/lib.ts:4", "// Vendored from daor 1.1.6; keep in step with upstream.\n" + own),
    ]
    assert run(spark, "p7_found", put("records", rows, "rec_id long, source string, text string")) == [(4,), (5,), (6,), (7,), (9,)]


def test_p10_found(spark, put):
    good = "The lab counted each cache line overnight and kept the run. "
    rows = [
        (1, good),
        (2, good + "Your order of @@title@@ will reach you. " + good),
        (3, good + "In Jinja a variable is written {{ name }}; the renderer of calb fills it in. " + good),
        (4, good + "\n\n```\nHello {{ name }}\nyour text goes here\n```\n"),
        (5, good + "\n\nLorem ipsum dolor sit amet. " + good),
        (6, good + "Designers fill a mock-up with lorem ipsum, yet our filter must not drop it."),
        (7, "You need to enable JavaScript to run the calb app."),
        (8, "Old pages asked readers to enable JavaScript, a habit that calb has given up."),
        (9, "404 - page not found\nHome | Help"),
        (10, 'The log said "access denied" 4 times, and the export answers with 404 when the level is unknown.'),
        (11, None),
    ]
    pool = ("Most readers of the old page have a habit of asking for more than it can give.", "The team has given up the plan that the night crew asked for, and nobody was surprised.", "A habit is easy to keep and hard to drop once every reader has it.", "What matters here is that the export reads each page after lunch.", "To enable the old path, ask the author of the script first.", "Our group measured the queue twice and then kept the number in a table.", PROSE)
    rows += [(100 + k, " ".join(pool[(k * j) % len(pool)] for j in range(1, 6))) for k in range(60)]
    assert run(spark, "p10_found", put("documents", rows, "doc_id long, text string")) == [(2,), (5,), (7,), (9,)]


def test_p6_templates_reveal_refusals(spark, put):
    """A refusal in none of the seeds is found once it recurs over different questions, and only then."""
    ask = "What is the use of the cache number %d that we keep?"
    odd = "My contract forbids me to say anything, and I am not going to speak of it."
    rows = [(k, [("user", ask % k), ("assistant", odd)]) for k in range(5)] + [(9, [("user", ask % 9), ("assistant", "I would not call it fast, but the table is what we have.")])]
    got = run(spark, "p6_found", put("records", rows, "rec_id long, messages array<struct<role string, content string>>"))
    assert got == [(k, 1, "refusal") for k in range(5)]


def test_p6_minhash_finds_similar_openings():
    rng = random.Random(1)
    hits = 0
    for _ in range(200):
        w = [f"w{rng.randrange(5000)}" for _ in range(40)]
        other = [*w[:39], "x"]
        a, b = (p6_answers.signature(" ".join(x)).reshape(p6_answers.BANDS, p6_answers.ROWS) for x in (w, other))
        hits += bool((a == b).all(axis=1).any())
    assert hits >= 190


def test_p6_clusters_lose_no_link(spark):
    """Every pair at the least similarity is a link, and links are followed over any number of steps."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(60)}"
    texts = []
    for size in (3, 5, 7, 9, 11, 13, 16, 20, 25, 34, 40, 70, 150) * 2:
        w = [word() for _ in range(size)]
        for _ in range(rng.randrange(4, 24)):
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w = w[:k] + [word()] * rng.randrange(2) + w[k + rng.randrange(2) :]
            texts += [" ".join(w)] * (len(w) >= 3)
    texts += [" ".join(f"c{j}" for j in range(k, k + 20)) for k in range(40)]  # each similar to the last and the next only
    rows = [([("user", f"q{rng.randrange(40)}"), ("assistant", x)],) for x in texts]
    got = {tuple(r) for r in p6_answers.templates(spark.createDataFrame(rows, "messages array<struct<role string, content string>>")).collect()}

    asked = {}
    for ((_, q), (_, x)), in rows:
        asked.setdefault(x, set()).add(q)
    for x in p6_answers.SEEDS + p6_answers.COMBINED + p6_answers.COURTESIES:
        asked.setdefault(" ".join(p6_answers.said(x)), set()).update(range(3))
    sets = {x: p6_answers.shingles(x) for x in asked}
    holders = {}
    for x, s in sets.items():
        for member in s:
            holders.setdefault(member, []).append(x)
    todo, want = set(asked), set()
    while todo:
        cluster, open_ = set(), [todo.pop()]
        while open_:
            x = open_.pop()
            cluster.add(x)
            near = {y for member in sets[x] for y in holders[member] if y in todo and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            todo -= near
            open_ += near
        n = sum(len(asked[x]) for x in cluster)
        want |= {(x, n) for x in cluster if n >= p6_answers.RECUR}
    assert got == want



def test_p2_found(spark, put):
    rows = [
        (1, "a.txt", PROSE * 3), (2, "a.md", "- first thing here\n- second thing\n- third one\n" * 5), (3, "a.LOG:4", "2025-01-01 10:00:00 INFO x[1]: step=3 loss=0.1\n" * 8), (4, "b.rst", "| a | b |\n|---|---|\n| 1 | 2 |\n" * 9),
        (5, "c.txt", "kqz wvx ptr mlk bnv qwe zxc rty fgh jkl vbn mqp " * 6), (6, "d.txt", PROSE + "\n\n- one\n- two\n\n" + PROSE), (7, "e.txt", "..."), (8, "e.html", "- x\n- y\n"), (9, "f.txt", None), (10, "f.txt", " \n"),
        (11, "g.md", "Der Bericht ist nicht fertig, aber die Tabelle wird\nvon dem Gerät gelesen und auch noch\neinmal geprüft, wenn es sein muss."), (12, "h.txt", "Short, but it is prose."), (13, None, "- a\n- b\n"), (14, "i.txt", "T h i s i s s p a c e d o u t " * 5),
        (2, "a.md", "- first thing here\n- second thing\n- third one\n" * 5),
    ]
    assert run(spark, "p2_found", put("records", rows, RECORDS.rsplit(",", 1)[0])) == [(2,), (3,), (4,), (5,), (14,)]


@given(st.text(alphabet="ab1 .\n-É漢'", max_size=120))
@settings(max_examples=80, deadline=None)
def test_p2_statistics_by_hand(text):
    if not text.strip():
        return
    row = p2_quality.statistics([text, "other text of the batch."]).iloc[0]
    words = re.findall(r"[^\W_]+", text.lower())
    whole = [x for x in text.split("\n") if x.strip()]
    assert row.n_words == len(words)
    assert row.mean_word_length == pytest.approx(sum(map(len, words)) / max(len(words), 1))
    assert row.punctuated_lines == pytest.approx(sum(x.rstrip()[-1] in ".!?:;…\"'”»)。！？" for x in whole) / len(whole))


def site_page(rng, site):
    noun = lambda: rng.choice("cache table ladder stream window panel sheet ticket".split())
    say = lambda: f"The {noun()} and the {noun()} were both kept while every {noun()} was read in the first hour of the run."
    main = [f"What a {noun()} teaches us about the {noun()}", say(), say() + " " + say(), "Results so far", say(), "1. Read every " + noun(), "2. Keep one " + noun(), say()]
    before = rng.choice([["Home", "News", "Shop", "Search"], ["Home | News | Shop | Search"], ["Skip to content", "Sign in", "Basket"]]) + rng.choice([[], ["You are here: " + noun()], ["We use cookies to improve your visit. Accept all | Reject"]])
    after = rng.choice([[], ["Most read", f"Notes on {noun()} and {noun()} (4 min)", f"A look at {noun()} - 24 views"]]) + ["Subscribe to our newsletter and never miss an update.", f"(c) 2024 {site}", "Terms of use | Privacy | Imprint"]
    return before, main, after


def test_p4_found(spark, put):
    rng, rows, want = random.Random(4), [], set()
    for i in range(160):
        before, main, after = site_page(rng, f"Site{i % 9}")
        rows.append((i, f"crawl/s/{i}.html", "\n".join(before + main + after)))
        n = len(before) + len(main)
        want |= {(i, k) for k in range(len(before))} | {(i, k) for k in range(n, n + len(after))}
    got = set(run(spark, "p4_found", put("records", rows, "rec_id long, source string, text string")))
    assert len(got & want) > 0.95 * len(want) and len(got & want) > 0.95 * len(got)
    body = {r.rec_id: r.text for r in e.queries()["p4_bodies"](spark, put("records", rows, "rec_id long, source string, text string")).collect()}
    assert len(body) == 160 and all("newsletter" not in x for x in list(body.values())[:5])


def test_p4_tags():
    page = p4_pages.leaves("<div><nav>\n<a href='x'>Home</a>\n</nav>\n<p>Text &amp; more\n</div>\nend")
    assert [(k, x.strip(), p) for k, x, p in page if x.strip()] == [(1, "Home", "div/nav/a"), (3, "Text & more", "div/p"), (5, "end", "")]


def test_p4_gradients():
    """Back-propagation against differences of the loss."""
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in p4_pages._start(rng).items()}
    x, mask = rng.standard_normal((5, 2, m["fx"].shape[0])), np.ones((5, 2))
    mask[3:, 1] = 0
    want = rng.standard_normal((5, 2, p4_pages.HIDDEN))
    for d in "fb":
        keep, grad = [], {}
        p4_pages._run(m, d, x, mask, keep)
        p4_pages._back(m, d, x, keep, want, grad)
        for name in (f"{d}x", f"{d}h"):
            at = (2, 3)
            m[name][at] += 1e-4
            up = (p4_pages._run(m, d, x, mask) * want).sum()
            m[name][at] -= 2e-4
            down = (p4_pages._run(m, d, x, mask) * want).sum()
            m[name][at] += 1e-4
            assert grad[name][at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=0.02)


def test_p5_choice_is_cheapest_and_disjoint():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cost = rng.integers(0, 9, 40).astype(float)
        at = p5_splits.choose(cost, 6, 4)
        assert all(b - a >= 6 for a, b in zip(at, at[1:])) and len(at) == 4


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_p5_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert p5_splits.within(np.array(a, np.int32), np.array(b, np.int32), most) == (row[-1] <= most)


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=150, deadline=None)
def test_p8_tiles(a, b):
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    found = p8_leaks.tiles(a, b, 3)
    used_a, used_b = set(), set()
    for i, j, k in found:
        assert k >= 3 and (a[i : i + k] == b[j : j + k]).all()
        assert not used_a & set(range(i, i + k)) and not used_b & set(range(j, j + k))
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))
    longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if (a[i : i + k] == b[j : j + k]).all()), default=0)
    assert (found[0][2] if found else 0) == (longest if longest >= 3 else 0)


def test_p8_reordered_passages(spark, put):
    w = [f"k{i}" for i in range(60)]
    put("eval_items", [(1, " ".join(w)), (2, None)], "item_id long, text string")
    text = " ".join(w[30:50]) + " between them " + " ".join(w[0:20])
    row = e.queries()["p8_leaks"](spark, put("documents", [(5, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_tiles, r.n_words) for r in row] == [(5, 1, 2, 40)]


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.floats(0, 50)), min_size=1), st.floats(0, 200))
@settings(max_examples=200, deadline=None)
def test_p9_water_filling(sources, total):
    share, most = {k: v[0] for k, v in sources.items()}, {k: v[1] for k, v in sources.items()}
    got = p9_mix.water_fill(share, most, total)
    assert all(got[k] <= most[k] + 1e-9 for k in got)
    room = sum(most[k] for k in got if share[k] > 0)
    assert sum(got.values()) == pytest.approx(min(total, room), abs=1e-6)
    free = [k for k in got if share[k] > 1e-9 and got[k] < most[k] - 1e-9]
    assert all(got[a] * share[b] == pytest.approx(got[b] * share[a], rel=1e-6, abs=1e-9) for a in free for b in free)


def test_p9_mix(spark, put):
    put("mix_targets", [("wiki", 0.5, 2), ("blog", 0.3, None), ("gone", 0.1, 1), ("rare", 0.1, 1), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    text = lambda k: " ".join(f"word{k}" for _ in range(20))
    rows = [(i, text(i), " Wiki " if i % 2 else "WIKI") for i in range(20)] + [(100 + i, text(i), "blog") for i in range(200)] + [(500, text(1), "rare"), (501, None, "wiki"), (502, text(1), None), (503, text(1), "other")]
    folder = put("documents", rows, "doc_id long, text string, source string")
    shares = {r.source: r for r in e.queries()["p9_shares"](spark, folder).collect()}
    mix = e.queries()["p9_mix"](spark, folder).collect()
    assert {r.source: r.most_repeats for r in shares.values()} == {"wiki": 2, "rare": 1, "gone": 0, "blog": 1}
    assert sum(r.n_tokens * r.n_repeats for r in mix if r.source == "wiki") == 2 * shares["wiki"].n_tokens
    blog = shares["blog"]
    assert abs(blog.mixed_tokens - blog.repeats * blog.n_tokens) <= 120
    assert sum(r.reached_share for r in shares.values()) == pytest.approx(1)
    assert sorted(mix) == sorted(e.queries()["p9_mix"](spark, folder).collect())


def test_p10_models_tell_classes_apart():
    counts = np.zeros(1 << p10_residue.POWER)
    for _ in range(30):
        np.add.at(counts, p10_residue.grams(PROSE), 1)
    models = p10_residue.fit(counts)
    assert p10_residue.residue(PROSE, models) == []
    assert {k for k, _, _ in p10_residue.residue(PROSE + "\nLorem ipsum dolor sit amet, consectetur adipiscing elit.\n" + PROSE, models)} == {"filler"}
    (kind, a, b), *_ = p10_residue.residue(PROSE + "Dear {{ first_name }}, hello.", models)
    assert kind == "slot" and (PROSE + "Dear {{ first_name }}, hello.")[a:b] == "{{ first_name }}"


TABLES = {
    "records": "rec_id long, corpus_hash string, source string, text string, messages array<struct<role string, content string>>, split string, n int, key string, id long, class string, win string, bucket long, label string, plain string, held string, kind string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, bucket int, n_tokens int, item_id long, kind string, n int",
    "train_examples": "example_id long, run_id string, n_tokens long, split string, seq_len int, block int, n_blocks int",
    "run_plans": "run_id string, seq_len int, n_tokens long, example_id long",
    "eval_items": "item_id long, text string, doc_id long, n int",
    "mix_targets": "source string, target_share double, max_repeats int, n_tokens long, repeats int",
}
NAMES = sorted(n for n in e.queries() if re.match(r"p\d+_", n))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables without rows; tables of nulls, empty and long texts, repeated rows and columns with clashing names."""
    empty, odd = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("odd")
    texts = [None, "", " \n\t ", "...", "x", "word " * 60_000, "é漢字🙂\u0301\x00", "{" * 3000, "a: b\nc: d", '{"a": null, "b": [1, {"c": 2}]}', PROSE * 2, PROSE * 2]
    chats = [None, [], [None], [(None, None)], [("user", None), ("assistant", None)], [("Human", "q?"), ("GPT", "w " * 30_000)], [("user", "q"), ("assistant", "...")]]
    names = [None, "", "a.txt", "./B\\c.MD:7", "p.html", "p.XHTML", "code/x/a.py", "code/x/min.js", "wiki"]
    rng = random.Random(7)
    for table, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(empty / f"{table}.parquet"))
        rows = []
        for k in range(70):
            row = []
            for name, kind in (x.split(" ", 1) for x in re.split(r", (?=\w+ \w+(?:<|,|$))", schema)):
                chance = zlib.crc32(f"{k}{name}".encode()) % 5
                value = {"text": texts[k % len(texts)], "messages": chats[k % len(chats)], "source": names[k % len(names)], "split": ("train", "val", "test", None)[k % 4]}.get(name)
                if name not in ("text", "messages", "source", "split") and chance:
                    value = {"string": f"v{k % 3}", "int": k % 9, "long": k // 2, "double": 0.1 * (k % 4)}.get(kind)
                row.append(value)
            rows += [tuple(row)] * (1 + (k % 6 == 0))
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).write.parquet(str(odd / f"{table}.parquet"))
    return str(empty), str(odd)


@pytest.mark.parametrize("name", NAMES)
def test_awkward_tables(spark, folders, name):
    empty, odd = folders
    assert e.queries()[name](spark, empty).count() == 0 or name in ("p6_defects",)
    got = e.queries()[name](spark, odd).collect()
    if name.endswith("_found"):
        assert len(got) == len(set(got)) and all(None not in r for r in got)
