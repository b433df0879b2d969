import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_ops.functions import text as T
from corpus_ops.operators import chat, corpus, packing, runs
from corpus_ops.plans import planner


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def results(df, expression):
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\0"), max_size=20), min_size=1, max_size=20))
def test_strip_is_pythons(spark, values):
    assert results(column(spark, values), T.strip(F.col("x"))) == [v.strip() for v in values]


def test_quality_reasons(spark):
    texts = ["hi", "//8/" * 400, "Same line here.\n" * 60, "word " * 200, "a" * 6000, None, " \n\t", "x" * 63 + " " * 50]
    want = ["too short", "low alphabetic ratio", "repetitive lines", None, "pathological line length", "too short", "too short", "too short"]
    assert results(column(spark, texts), corpus.quality_reason(F.col("x"))) == want


def test_similar_pairs_lose_none(spark):
    rng = random.Random(3)
    sets = []
    for i in range(60):
        base = set(rng.sample(range(400), rng.randrange(5, 40))) if i % 3 or not sets else set(rng.choice(sets))
        if i % 3 == 0:
            for _ in range(rng.randrange(0, 4)):
                base ^= {rng.randrange(400)}
        sets.append(base or {1})
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, s array<bigint>")
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in corpus.similar_pairs(df).collect()} == want and want


def test_first_kept_is_the_sequential_rule(spark):
    rng = random.Random(5)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a < b}
    kept = []
    for i in range(40):
        if not any((a, i) in edges for a in kept):
            kept.append(i)
    dropped = {r.id for r in corpus.first_kept(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert dropped == set(range(40)) - set(kept)


def test_clean_on_awkward_rows(spark, put):
    long = "The quick brown fox jumps over the lazy dog while nine editors count the words of it. " * 3
    other = long + "And then there was one more line at the very end of it."
    chats = [("human", "How does this work, and why would anybody want it to work in this way?"), ("gpt", "It works by counting each word of the text."), (None, "x"), ("user", None)]
    rows = [(1, "a/x.txt", long, None, 1), (2, "a/y.txt", " " + long + "\n", None, 1), (3, None, None, None, 1), (4, "b.txt", "", None, 1), (5, "c.jsonl:0", None, chats, 1), (6, "c.jsonl:1", None, chats, 1), (7, "d.txt", other, None, 1), (8, "d.txt", "q" * 200_000, None, 1)]
    folder = put("records", rows, "rec_id long, source string, text string, messages array<struct<role string, content string>>, key int")
    fate = {r.rec_id: r.fate for r in corpus.clean(spark, folder).collect()}
    assert fate == {1: None, 2: "exact copy", 3: "too short", 4: "too short", 5: None, 6: "exact copy", 7: None, 8: "pathological line length"}
    assert corpus.manifest(spark, folder).count() == 3
    empty = put("records", [], "rec_id long, source string, text string, messages array<struct<role string, content string>>")
    assert corpus.corpus_analysis(spark, empty).first().n_documents == 0
    assert corpus.corpus_warnings(spark, empty).first().warning == "no documents are left"


def test_near_copies_are_dropped(spark, put):
    rng = random.Random(1)
    words = ["".join(p) for p in itertools.product("abcdefghij", repeat=3)]
    one = [rng.choice(words) for _ in range(300)]
    rows = [(1, "a", " ".join(one)), (2, "b", " ".join(one + ["tail", "end"])), (3, "c", " ".join(rng.choice(words) for _ in range(300))), (4, "d", "short text of four words, padded by nothing else than these " + "x " * 30)]
    folder = put("records", [(*r, None) for r in rows], "rec_id long, source string, text string, messages array<struct<role string, content string>>")
    assert {r.rec_id: r.fate for r in corpus.clean(spark, folder).collect()} == {1: None, 2: "near copy", 3: None, 4: None}


def test_turns_and_renderings(spark):
    messages = [[(" Human ", "a"), ("GPT", "b"), ("", "no role"), ("bot", None), ("stranger", "c")], None, []]
    df = column(spark, messages, "array<struct<role string, content string>>").withColumn("x", chat.turns(F.col("x")))
    assert results(df, chat.flat(F.col("x"))) == ["user: a\nassistant: b\nuser: c", None, ""]
    assert results(df, chat.last_user(F.col("x"))) == ["c", None, None]
    assert results(df, chat.template(F.col("x"), True))[2] == "<|im_start|>assistant\n"


def test_answer_reasons(spark):
    texts = ["short", "one\n" * 9, "a fine answer to the question", None, "a\nb\nc\nd\ne\nf line"]
    assert results(column(spark, texts), chat.answer_reason(F.col("x"))) == ["empty or too short", "degenerate repetition", None, "empty or too short", None]


def test_shards_reset(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 90) for _ in range(300)]
    want, fill, shard = [], 0, 0
    for n in sizes:
        want.append(shard)
        fill += n
        if fill >= 200:
            shard, fill = shard + 1, 0
    docs = spark.createDataFrame([(i, "train", n) for i, n in enumerate(sizes)], "ord long, split string, n long")
    got = {r.ord: r.shard for r in packing.shards(docs, "ord", "n", 200).collect()}
    assert [got[i] for i in range(300)] == want


def test_val_is_cut_off_the_last_shard(spark):
    index = spark.createDataFrame([("train", 0, 10_000), ("train", 1, 5_000)], "split string, shard long, tokens long")
    assert sorted(tuple(r) for r in packing.with_val(index).collect()) == [("train", 0, 10_000), ("train", 1, 4_500), ("val", 0, 500)]
    both = spark.createDataFrame([("train", 0, 10), ("val", 0, 5)], "split string, shard long, tokens long")
    assert packing.with_val(both).count() == 2


def test_split_share_and_stability(spark):
    import hashlib

    names = [f"file_{i}.txt" for i in range(2000)]
    got = results(column(spark, names), packing.bucket(F.col("x")))
    assert got == [int(hashlib.sha256(n.encode()).hexdigest(), 16) % 10_000 for n in names]
    assert 0.07 < np.mean(np.array(got) < 1000) < 0.13


def test_windows_are_the_same_each_time(spark):
    a = packing.windows(spark, [100, 0, 300], "train", 40, 4).collect()
    assert sorted(a) == sorted(packing.windows(spark, [100, 0, 300], "train", 40, 4).collect())
    assert {r.shard for r in a} == {0, 2} and all(0 <= r.start <= (100, 0, 300)[r.shard] for r in a)
    assert sorted(a) != sorted(packing.windows(spark, [100, 0, 300], "val", 40, 4).collect())
    with pytest.raises(ValueError):
        packing.windows(spark, [0], "train", 1, 1)


def test_only_answers_are_learned(spark):
    df = column(spark, [[("user", "how are you"), ("assistant", "very well indeed")], [("user", "alone")]], "array<struct<role string, content string>>")
    first, second = results(df, packing.supervised(F.col("x"), packing.code_words))
    learned = [k for k, v in enumerate(first.labels) if v != packing.IGNORE]
    assert [first.ids[k] for k in learned] == [first.labels[k] for k in learned] and len(learned) == 4
    assert set(second.labels) == {packing.IGNORE}
    assert results(df, packing.tail(F.array(*map(F.lit, (1, 2, 3))), 2)) == [[2, 3]] * 2


def test_planner_grows_with_the_corpus(spark):
    sizes = [10**k for k in range(6, 13)] + [0, None]
    corpora = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "content_hash string, available long")
    plans = {r.content_hash: r for r in planner.plan_pretrain(spark, corpora, planner.machines(spark)).collect()}
    names = [t[0] for t in planner.TIERS]
    order = [names.index(plans[str(i)].tier) for i in range(7)]
    assert len(plans) == 7 and order == sorted(order) and order[0] == 0
    assert all(p.total_tokens == p.total_steps * p.tokens_per_step and p.epochs <= 4.3 for p in plans.values())


def test_published_sizes(spark):
    want = {"nano": 0.02, "micro": 0.04, "small": 0.10, "medium": 0.32, "large": 1.18, "xl": 3.3, "xxl": 5.8, "8b": 7.9, "12b": 12.0, "20b": 20.1, "40b": 40.2, "60b": 60.3, "80b": 80.2}
    for r in planner.tier_table(spark, "").collect():
        assert abs(r.n_params / 1e9 - want[r.tier]) <= 0.06 * max(1, want[r.tier]) ** 0.0 or abs(r.n_params / 1e9 - want[r.tier]) < 0.06


def test_registry(spark, put):
    rows = [("20250101-a", "2025-01-01T00:00:00Z", "running"), ("20250101-b", "2025-01-01T02:00:00+02:00", "completed"), ("x_y", "2025-01-02T00:00:00", "pending"), ("xzy", None, None)]
    folder = put("runs", [(a, b, c, "pretrain", 1, 2) for a, b, c in rows], "id string, created_at string, status string, mode string, step long, total_steps long")
    assert [r.id for r in runs.recent_runs(spark, folder).collect()] == ["x_y", "20250101-b", "20250101-a", "xzy"]
    assert runs.resolve(spark, folder, "last") == "x_y" and runs.resolve(spark, folder, "x_") == "x_y"
    with pytest.raises(KeyError, match="could be"):
        runs.resolve(spark, folder, "2025")
    with pytest.raises(KeyError, match="no such"):
        runs.resolve(spark, folder, "%")
    assert {r.id: r.status for r in runs.reconciled(spark, folder).collect()}["20250101-a"] == "failed"
    assert {r.id: r.status for r in runs.reconciled(spark, folder, ("20250101-a",)).collect()}["20250101-a"] == "running"
    table = spark.read.parquet(f"{folder}/runs.parquet")
    assert runs.new_run_id(table, "20250101", "a") == "20250101-a-2" and runs.new_run_id(table, "2026", "a", "b") == "2026-a-b"
    assert runs.updated(table, "xzy", status="failed").where("status = 'failed'").count() == 1
    with pytest.raises(ValueError):
        runs.updated(table, "xzy", id="other")


def test_lock_differences():
    lock = lambda **k: {"inputs": {"a": 1}, "environment": {"packages": {"x": "1"} | k.get("p", {}), "hardware": {"gpu": k.get("gpu")}}, "plan": {"lr": k.get("lr", 1)}}
    assert runs.lock_differences(lock(), lock()) == []
    assert runs.lock_differences(lock(), lock(p={"x": "2", "y": "3"}, gpu="g", lr=2)) == ["x: 1 -> 2", "y: absent -> 3", "gpu: None -> g", "training plan differs"]


def test_metrics_cut_into_blocks(spark, put, monkeypatch):
    rows = [("r", 0, k, k * 10, float(100 - k) if k % 7 else None, 5.0 - (k % 13), 100, k * 2.0) for k in range(200)]
    schema = "run_id string, worker_no int, line_no long, step long, loss double, val_loss double, tokens_per_sec long, elapsed_s double"
    folder = put("metrics", [(*r, 0.1) for r in rows + rows[50:60]], schema + ", grad_norm double")
    put("run_plans", [("r", 64, 5000)], "run_id string, tokens_per_step int, total_steps int")
    want = {(r.line_no, r.tokens_per_s) for r in runs.throughput(spark, folder).collect()}, {(r.line_no, r.best) for r in runs.best_losses(spark, folder).collect()}
    monkeypatch.setattr(runs, "BLOCK", 16)
    assert want == ({(r.line_no, r.tokens_per_s) for r in runs.throughput(spark, folder).collect()}, {(r.line_no, r.best) for r in runs.best_losses(spark, folder).collect()})
    assert len(want[1]) == 200


def test_checkpoint_needs_a_shared_folder(spark, monkeypatch):
    from corpus_ops import storage

    assert storage.kept(spark.range(3)).count() == 3
