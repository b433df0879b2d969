"""What a corpus can train: model tiers, memory, steps and hours as columns over tables of corpora and hardware.

Every formula is an expression over rows, so any number of corpora, tiers and machines is planned in one query. A corpus
with null or no tokens has no plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..storage import table

#: Name, layers, heads, key-value heads, width, context, peak rate, tokens of a step.
TIERS = (
    ("nano", 6, 6, 2, 384, 512, 3.0e-3, 32_768),
    ("micro", 8, 8, 4, 512, 1024, 1.5e-3, 65_536),
    ("small", 12, 12, 4, 768, 1024, 6.0e-4, 262_144),
    ("medium", 24, 16, 8, 1024, 2048, 3.0e-4, 524_288),
    ("large", 24, 16, 8, 2048, 2048, 2.0e-4, 524_288),
    ("xl", 32, 24, 8, 3072, 4096, 1.5e-4, 1_048_576),
    ("xxl", 32, 32, 8, 4096, 4096, 1.2e-4, 2_097_152),
    ("8b", 44, 32, 8, 4096, 8192, 3.0e-4, 4_194_304),
    ("12b", 43, 32, 8, 5120, 8192, 3.0e-4, 4_194_304),
    ("20b", 51, 48, 8, 6144, 8192, 2.0e-4, 4_194_304),
    ("40b", 58, 64, 8, 8192, 8192, 1.5e-4, 8_388_608),
    ("60b", 77, 64, 8, 8704, 8192, 1.5e-4, 8_388_608),
    ("80b", 97, 64, 8, 8960, 8192, 1.2e-4, 16_777_216),
)
#: Figures of the cost model.
TOKENS_PER_PARAM, MAX_EPOCHS, MIN_STEPS, MFU = 20, 4, 30, 0.25
BYTES, BYTES_8BIT, ACTIVATION, RETAINED, SAFE = 16, 10, 2.0, 0.15, 0.75
METHODS = (("full", 16.0), ("lora", 2.0), ("qlora", 0.55))
FULL_RATES = ((1e9, 1e-4), (4e9, 5e-5), (15e9, 2e-5), (float("inf"), 1e-5))
ADAPTER_RATES = ((4e9, 2e-4), (15e9, 1e-4), (float("inf"), 5e-5))
RANK, PROJECTIONS = 16, 7
#: Format, level, bits of a weight, whether an outside tool is needed.
LEVELS = (
    ("safetensors", "bf16", 16.0, False), ("safetensors", "f16", 16.0, False), ("safetensors", "f32", 32.0, False), ("gguf", "f16", 16.0, False), ("gguf", "q8_0", 8.5, False), ("gguf", "q5_1", 6.0, False),
    ("gguf", "q5_0", 5.5, False), ("gguf", "q4_1", 5.0, False), ("gguf", "q4_0", 4.5, False), ("gguf", "q6_k", 6.6, True), ("gguf", "q5_k_m", 5.7, True), ("gguf", "q4_k_m", 4.8, True),
)
#: A machine as an input row: name, bf16 TFLOP/s, memory in GB, devices, share of memory to use.
MACHINE = ("test", 70.0, 128.0, 1, 0.75)

L = F.lit


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(TIERS)], "idx int, tier string, n_layer long, n_head long, n_kv_head long, d_model long, seq_len long, lr double, batch_tokens long")


def machines(spark: SparkSession, rows=(MACHINE,)) -> DataFrame:
    return spark.createDataFrame(list(rows), "machine string, tflops double, memory_gb double, n_gpus int, utilisation double")


def width(d_model: Column) -> Column:
    """Of the gated feed-forward layer: 8/3 of the model's, up to a multiple of 128."""
    return (F.ceil(F.floor(8 * d_model / 3) / 128) * 128).cast("long")


def parameters(layers: Column, heads: Column, kv_heads: Column, d: Column, ff: Column, vocab: Column, copies: Column | int = 1) -> Column:
    kv = kv_heads * F.floor(d / heads)
    return (layers * (2 * d * d + 2 * d * kv + 3 * d * ff + 2 * d) + d + vocab * d * copies).cast("long")


def vocabulary(n_tokens: Column) -> Column:
    return F.when(n_tokens < 5_000_000, 4_096).when(n_tokens < 50_000_000, 8_192).when(n_tokens < 500_000_000, 16_384).otherwise(32_768)


def memory(n: Column, layers: Column, d: Column, ff: Column, vocab: Column, tokens: Column, each: float, checkpointing: bool) -> Column:
    """GB of one forward and backward pass over so many tokens."""
    activations = tokens * layers * (4 * d + 3 * ff) * ACTIVATION / 1e9 * (RETAINED if checkpointing else 1.0)
    return n * each / 1e9 + activations + tokens * vocab * 10 / 1e9


def largest(fits: Callable[[int], Column], sizes: tuple[int, ...]) -> Column:
    """The largest of rising sizes up to which all fit; 0 if none does."""
    out, ok = L(0), L(True)
    for size in sizes:
        ok = ok & fits(size)
        out = F.when(ok, size).otherwise(out)
    return out


POWERS = (1, 2, 4, 8, 16, 32, 64)


def hours(n: Column, layers: Column, seq: Column, d: Column, tokens: Column, tflops: Column, mfu: Column | float) -> Column:
    return (6 * n + 12 * layers * seq * d).cast("double") * tokens / (tflops * 1e12 * mfu) / 3600


def chosen(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of corpora by tiers the largest tier that the tokens fill to half of the optimum, else the smallest."""
    enough = F.col("available") * MAX_EPOCHS >= F.col("n_params") * TOKENS_PER_PARAM * 0.5
    best = rows.groupBy(*key).agg(F.coalesce(F.max(F.when(enough, F.col("idx"))), L(0)).alias("idx"))
    return rows.join(best, [*key, "idx"])


def with_tiers(spark: SparkSession, corpora: DataFrame, vocab: Column) -> DataFrame:
    """Each corpus with every tier (13 rows) and its size at the corpus's vocabulary."""
    both = corpora.withColumn("vocab", vocab).join(F.broadcast(tiers(spark)))
    sized = both.withColumn("d_ff", width(F.col("d_model")))
    return sized.withColumn("n_params", parameters(*(F.col(c) for c in ("n_layer", "n_head", "n_kv_head", "d_model", "d_ff", "vocab"))))


def _fit(rows: DataFrame, budget: Column) -> DataFrame:
    """checkpointing, optimizer, micro (memory allows) and memory by the first rung that fits, else the last."""
    args = [F.col(c) for c in ("n_params", "n_layer", "d_model", "d_ff", "vocab")]

    def rung(checkpointing: bool, name: str, each: int) -> Column:
        need = lambda size: memory(*args, size * F.col("seq_len"), each, checkpointing)
        state = lambda m: F.struct(L(checkpointing).alias("checkpointing"), L(name).alias("optimizer"), F.greatest(m, L(1)).alias("micro"), need(F.greatest(m, L(1))).alias("gb"), (m > 0).alias("fits"))
        return let(largest(lambda size: need(L(size)) <= budget, POWERS), state)

    rungs = (rung(False, "adamw", BYTES), rung(True, "adamw", BYTES), rung(True, "adamw8bit", BYTES_8BIT))
    first, second, third = rungs
    return rows.withColumn("rung", F.when(first["fits"], first).when(second["fits"], second).otherwise(third))


def rounded(x: Column) -> Column:
    """To whole numbers, halves to even ones."""
    return F.bround(x, 0).cast("long")


def plan_pretrain(spark: SparkSession, corpora: DataFrame, hardware: DataFrame) -> DataFrame:
    """A from-scratch plan for each corpus (content_hash, available) and machine."""
    rows = chosen(with_tiers(spark, corpora.where("available > 0"), vocabulary(F.col("available"))), ["content_hash"]).join(F.broadcast(hardware))
    budget = F.col("memory_gb") * F.col("utilisation")
    args = [F.col(c) for c in ("n_params", "n_layer", "d_model", "d_ff", "vocab")]
    whole = memory(*args, F.col("seq_len"), BYTES, True) <= budget
    rows = rows.withColumn("strategy", F.when(F.col("n_gpus") <= 1, "single").when(whole, "ddp").otherwise("fsdp"))
    rows = _fit(rows, budget).withColumn("wanted", F.least(F.col("n_params") * TOKENS_PER_PARAM, F.col("available") * MAX_EPOCHS))
    gpus = F.greatest(F.col("n_gpus"), L(1))
    micro = F.greatest(L(1), F.least(F.col("rung.micro"), F.greatest(F.floor(F.col("wanted") / (F.col("seq_len") * MIN_STEPS * gpus)), L(1))))
    rows = rows.withColumn("micro_batch", micro.cast("long")).withColumn("per_micro", F.col("micro_batch") * F.col("seq_len") * gpus)
    batch = F.least(F.col("batch_tokens"), F.greatest(F.col("per_micro"), F.floor(F.col("wanted") / MIN_STEPS)))
    rows = rows.withColumn("grad_accum", F.greatest(L(1), rounded(batch / F.col("per_micro")))).withColumn("tokens_per_step", F.col("per_micro") * F.col("grad_accum"))
    rows = rows.withColumn("total_steps", F.greatest(L(1), rounded(F.col("wanted") / F.col("tokens_per_step")))).withColumn("total_tokens", F.col("total_steps") * F.col("tokens_per_step"))
    epochs = F.col("total_tokens") / F.col("available")
    time = hours(F.col("n_params"), F.col("n_layer"), F.col("seq_len"), F.col("d_model"), F.col("total_tokens"), F.col("tflops"), MFU)
    time = time / F.when(F.col("strategy") == "ddp", gpus * 0.9).when(F.col("strategy") == "fsdp", gpus * 0.75).otherwise(1.0) * F.when(F.col("rung.checkpointing"), 1.33).otherwise(1.0)
    ratio = F.col("total_tokens") / F.col("n_params")
    return rows.select(
        "content_hash", "machine", "tier", "vocab", "n_params", "seq_len", "strategy", F.col("rung.checkpointing").alias("checkpointing"), F.col("rung.optimizer").alias("optimizer"), "micro_batch", "grad_accum", "tokens_per_step", "total_steps", "total_tokens",
        F.round(epochs, 2).alias("epochs"), F.when(epochs <= 1.2, 0.0).otherwise(0.1).alias("dropout"), F.greatest(L(1), F.least(rounded(F.col("total_steps") * 0.02), L(500))).alias("warmup_steps"), F.greatest(L(1), F.floor(F.col("total_steps") / 20)).alias("eval_every"),
        F.round(time, 2).alias("hours"), F.round(F.col("rung.gb"), 1).alias("memory_gb"), (ratio < TOKENS_PER_PARAM * 0.5).alias("too_little_text"), (F.round(epochs, 2) >= 3).alias("many_passes"),
    )


def rate_for(n: Column, method: Column) -> Column:
    """The learning rate by size: a lookup of the first bound above it."""
    ladder = lambda rates: F.coalesce(*(F.when(n < bound, rate) for bound, rate in rates))
    return F.when(method == "full", ladder(FULL_RATES)).otherwise(ladder(ADAPTER_RATES))


def finetune_memory(n: Column, layers: Column, d: Column, vocab: Column, each: float, tokens: Column, adapter: Column) -> Column:
    return n * each / 1e9 + adapter * BYTES / 1e9 + tokens * layers * d * 24 / 1e9 * RETAINED + tokens * vocab * 10 / 1e9


def plan_finetune(bases: DataFrame, data: DataFrame, hardware: DataFrame) -> DataFrame:
    """A fine-tuning plan for each base (base, n_params, n_layer, d_model, vocab, max_position), data set (name, n_examples, n_tokens, p95, supervised) and machine."""
    rows = bases.join(F.broadcast(data.where("n_examples > 0"))).join(F.broadcast(hardware)).withColumn("adapter", F.col("n_layer") * PROJECTIONS * 2 * RANK * F.col("d_model"))
    up = F.coalesce(*(F.when(F.col("p95") <= size, size) for size in (128, 256, 512, 1024, 2048)), L(4096))
    rows = rows.withColumn("seq_len", F.greatest(L(128), F.least(up, F.col("max_position"), L(4096))).cast("long"))
    budget = F.col("memory_gb") * SAFE
    args = [F.col(c) for c in ("n_params", "n_layer", "d_model", "vocab")]

    def need(method: str, each: float, size: Column) -> Column:
        return finetune_memory(*args, each, size * F.col("seq_len"), L(0) if method == "full" else F.col("adapter"))

    first = F.coalesce(*(F.when(need(m, each, L(1)) <= budget, m) for m, each in METHODS), L("qlora"))
    rows = rows.withColumn("method", first)
    by_method = lambda f: F.coalesce(*(F.when(F.col("method") == m, f(m, each)) for m, each in METHODS))
    rows = rows.withColumn("micro_batch", by_method(lambda m, each: F.greatest(L(1), largest(lambda size: need(m, each, L(size)) <= budget, POWERS[:5]))))
    target = F.greatest(L(1), F.least(F.when(F.col("supervised"), 64).otherwise(32), F.floor(F.col("n_examples") / 8)))
    rows = rows.withColumn("grad_accum", F.greatest(L(1), rounded(target / F.col("micro_batch")))).withColumn("per_step", F.col("micro_batch") * F.col("grad_accum"))
    steps = lambda epochs: F.greatest(L(1), rounded(F.col("n_examples") * epochs / F.col("per_step")))
    rows = rows.withColumn("short", steps(L(3)) < 60).withColumn("epochs", F.when(F.col("short"), F.least(L(12.0), 3.0 * 60 / steps(L(3)))).otherwise(3.0)).withColumn("total_steps", steps(F.col("epochs")))
    mfu = F.when(F.col("method") == "qlora", 0.15 * 0.6).otherwise(0.15)
    time = hours(F.col("n_params"), F.col("n_layer"), F.col("seq_len"), F.col("d_model"), F.floor(F.col("n_tokens") * F.col("epochs")), F.col("tflops"), mfu) * 1.33
    return rows.select(
        "base", "name", "machine", "method", F.when(F.col("method") == "full", F.col("n_params")).otherwise(F.col("adapter")).alias("trainable"), "seq_len", "micro_batch", "grad_accum", F.round("epochs", 6).alias("epochs"), "total_steps", rate_for(F.col("n_params"), F.col("method")).alias("lr"),
        F.greatest(L(1), F.least(rounded(F.col("total_steps") * 0.03), L(100))).alias("warmup_steps"), F.round(time, 2).alias("hours"), F.round(by_method(lambda m, each: need(m, each, L(1))), 1).alias("memory_gb"),
    )


def plan_distill(spark: SparkSession, teachers: DataFrame, corpora: DataFrame, hardware: DataFrame) -> DataFrame:
    """A distillation plan for each teacher (teacher, teacher_params, teacher_vocab, max_position), corpus and machine."""
    rows = with_tiers(spark, corpora.where("available > 0").join(F.broadcast(teachers)), F.col("teacher_vocab"))
    below = F.col("n_params") <= F.col("teacher_params") * 0.5
    enough = below & (F.col("available") * MAX_EPOCHS >= F.col("n_params") * 5)
    key = ["content_hash", "teacher"]
    best = rows.groupBy(*key).agg(F.coalesce(F.max(F.when(enough, F.col("idx"))), F.min(F.when(below, F.col("idx"))), L(0)).alias("idx"))
    rows = rows.join(best, [*key, "idx"]).join(F.broadcast(hardware)).withColumn("seq_len", F.least("seq_len", "max_position"))
    rows = rows.withColumn("quantized", F.col("teacher_params") * 2 / 1e9 > F.col("memory_gb") * SAFE * 0.5).withColumn("teacher_gb", F.col("teacher_params") * F.when(F.col("quantized"), 0.55).otherwise(2.0) / 1e9)
    budget = F.greatest(L(1.0), F.col("memory_gb") - F.col("teacher_gb") / SAFE) * SAFE
    need = lambda size: memory(*(F.col(c) for c in ("n_params", "n_layer", "d_model", "d_ff", "vocab")), size * F.col("seq_len"), BYTES, False)
    rows = rows.withColumn("fit", F.greatest(L(1), largest(lambda size: need(L(size)) <= budget, POWERS))).withColumn("wanted", F.least(F.col("n_params") * 5, F.col("available") * MAX_EPOCHS))
    rows = rows.withColumn("micro_batch", F.greatest(L(1), F.least(F.col("fit"), F.floor(F.col("wanted") / (F.col("seq_len") * MIN_STEPS)))).cast("long")).withColumn("per_micro", F.col("micro_batch") * F.col("seq_len"))
    batch = F.least(F.col("batch_tokens"), F.greatest(F.col("per_micro"), F.floor(F.col("wanted") / MIN_STEPS)))
    rows = rows.withColumn("tokens_per_step", F.col("per_micro") * F.greatest(L(1), rounded(batch / F.col("per_micro"))))
    rows = rows.withColumn("total_steps", F.greatest(L(1), rounded(F.col("wanted") / F.col("tokens_per_step")))).withColumn("total_tokens", F.col("total_steps") * F.col("tokens_per_step"))
    time = (2 * F.col("teacher_params") + 6 * F.col("n_params")).cast("double") * F.col("total_tokens") / (F.col("tflops") * 1e12 * 0.2 * F.greatest(F.col("n_gpus"), L(1)) * 0.9) / 3600 * F.when(F.col("quantized"), 1.5).otherwise(1.0)
    return rows.select("content_hash", "teacher", "machine", "tier", "n_params", "quantized", "seq_len", "micro_batch", "tokens_per_step", "total_steps", "total_tokens", F.round(time, 2).alias("hours"), F.round(need(F.col("fit")) + F.col("teacher_gb"), 1).alias("memory_gb"))


def base_parameters(hidden: Column, layers: Column, heads: Column, kv_heads: Column, ffn: Column, vocab: Column, tied: Column) -> Column:
    """Size of a base model from its configuration."""
    return parameters(layers, F.greatest(heads, L(1)), kv_heads, hidden, ffn, vocab, F.when(tied, 1).otherwise(2))


# ---- queries


def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_hash, available: tokens of the latest analysis of each corpus."""
    at = F.struct("created_at", F.coalesce("root", F.lit("")))
    return table(spark, sf_dir, "corpora").groupBy("content_hash").agg(F.max_by(F.coalesce("exact_tokens", "est_tokens"), at).alias("available"))


def tier_table(spark: SparkSession, sf_dir: str, vocab: int = 32_768) -> DataFrame:
    """tier, d_ff, n_params, chinchilla_tokens, batch_steps at one vocabulary."""
    rows = tiers(spark).withColumn("d_ff", width(F.col("d_model")))
    sized = rows.withColumn("n_params", parameters(*(F.col(c) for c in ("n_layer", "n_head", "n_kv_head", "d_model", "d_ff")), L(vocab)))
    return sized.select("tier", "d_ff", "n_params", (F.col("n_params") * TOKENS_PER_PARAM).alias("chinchilla_tokens"))


def vocab_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(spark, sf_dir).where("available is not null").select("content_hash", "available", vocabulary(F.col("available")).cast("long").alias("vocab"))


def tier_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_tiers(spark, available(spark, sf_dir).where("available > 0"), vocabulary(F.col("available")))
    return chosen(rows, ["content_hash"]).select("content_hash", "tier", "n_params")


def pretrain_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_pretrain(spark, available(spark, sf_dir), machines(spark, (MACHINE, ("node8", 755.0, 80.0, 8, 0.9))))


#: Sizes of usual base models: name, parameters, layers, width, vocabulary, context.
BASES = (("0.6b", 600_000_000, 28, 1024, 151_936, 32_768), ("3b", 3_000_000_000, 36, 2048, 151_936, 32_768), ("8b", 8_000_000_000, 32, 4096, 128_256, 8192), ("70b", 70_000_000_000, 80, 8192, 128_256, 8192))


def finetune_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for usual bases on the examples of each run."""
    from ..operators.packing import example_lengths

    data = example_lengths(spark, sf_dir).select(F.col("run_id").alias("name"), "n_examples", "n_tokens", "p95", L(True).alias("supervised"))
    bases = spark.createDataFrame(list(BASES), "base string, n_params long, n_layer long, d_model long, vocab long, max_position long")
    return plan_finetune(bases, data, machines(spark))


def distill_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    teachers = spark.createDataFrame([(b[0], b[1], b[4], b[5]) for b in BASES], "teacher string, teacher_params long, teacher_vocab long, max_position long")
    return plan_distill(spark, teachers, available(spark, sf_dir), machines(spark))


def export_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tier, format, level, n_bytes of each way to store a model that needs no outside tool."""
    levels = spark.createDataFrame(list(LEVELS), "format string, level string, bits double, outside boolean").where("not outside")
    sizes = tier_table(spark, sf_dir).join(F.broadcast(levels))
    return sizes.select("tier", "format", "level", F.floor(F.col("n_params") * F.col("bits") / 8).alias("n_bytes"))


QUERIES = {f.__name__: f for f in (tier_table, vocab_choices, tier_choices, pretrain_plans, finetune_plans, distill_plans, export_sizes)}

_TIERS = "t(idx, tier, n_layer, n_head, n_kv_head, d_model, seq_len, lr, batch_tokens) AS (VALUES " + ", ".join(f"({k}, '{t[0]}', {', '.join(str(x) for x in t[1:])})" for k, t in enumerate(TIERS)) + ")"
_FF = "(ceil(floor(8 * d_model / 3) / 128) * 128)::BIGINT"
_PARAMS = f"(n_layer * (2 * d_model * d_model + 2 * d_model * n_kv_head * (d_model // n_head) + 3 * d_model * {_FF} + 2 * d_model) + d_model + {{v}} * d_model)::BIGINT"
_AVAILABLE = "a AS (SELECT content_hash, arg_max(coalesce(exact_tokens, est_tokens), (created_at, coalesce(root, ''))) AS available FROM corpora GROUP BY 1)"
_VOCAB = "CASE WHEN available < 5000000 THEN 4096 WHEN available < 50000000 THEN 8192 WHEN available < 500000000 THEN 16384 ELSE 32768 END"
ORACLES = {
    "tier_table": f"WITH {_TIERS} SELECT tier, {_FF} AS d_ff, {_PARAMS.format(v=32768)} AS n_params, 20 * {_PARAMS.format(v=32768)} AS chinchilla_tokens FROM t",
    "vocab_choices": f"WITH {_AVAILABLE} SELECT content_hash, available, ({_VOCAB})::BIGINT AS vocab FROM a WHERE available IS NOT NULL",
    "tier_choices": f"""WITH {_TIERS}, {_AVAILABLE}, s AS (SELECT content_hash, available, idx, tier, {_PARAMS.format(v='(' + _VOCAB + ')')} AS n_params FROM a, t WHERE available > 0),
     b AS (SELECT content_hash, coalesce(max(idx) FILTER (available * 4 >= n_params * 10.0), 0) AS idx FROM s GROUP BY 1) SELECT content_hash, tier, n_params FROM s JOIN b USING (content_hash, idx)""",
    "export_sizes": f"WITH {_TIERS}, l(format, level, bits) AS (VALUES " + ", ".join(f"('{f}', '{n}', {b})" for f, n, b, outside in LEVELS if not outside) + f") SELECT tier, format, level, floor({_PARAMS.format(v=32768)} * bits / 8)::BIGINT AS n_bytes FROM t, l",
}
