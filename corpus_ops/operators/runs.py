"""Run registry and metrics: listings, summaries, merged series, throughput, best losses, evaluation notes.

Times of the registry are text with several ways to write the zone; without one they mean UTC. Metric lines received
twice count once (key run_id, worker_no, line_no). NaN losses are no values. A run of any length is cut into blocks of
BLOCK lines, so no window has to hold a whole run; what a block needs from earlier ones comes from one row per block.
Rows with a null run_id, worker_no or line_no belong to no series and are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import table

BLOCK = 50_000
TERMINAL = ("completed", "failed", "cancelled")


def moment(text: Column) -> Column:
    """A registry time in UTC; null if it can't be read."""
    zoned = F.when(F.regexp_like(text, F.lit(r"(?:Z|[+-]\d\d:?\d\d)$")), text).otherwise(F.concat(text, F.lit("+00:00")))
    return F.try_to_timestamp(zoned)


def progress(step: Column, total: Column) -> Column:
    return F.when(total > 0, step / total).otherwise(0.0)


def improvement(before: Column, after: Column) -> Column:
    return F.when((before > 0) & after.isNotNull(), (before - after) / before)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric lines, each once, without NaN, with their block."""
    rows = table(spark, sf_dir, "metrics").where("run_id is not null and worker_no is not null and line_no is not null").dropDuplicates(["run_id", "worker_no", "line_no"])
    for c in ("loss", "val_loss", "grad_norm"):
        rows = rows.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
    return rows.withColumn("block", F.floor(F.col("line_no") / BLOCK))


# ---- registry


def recent_runs(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The n latest runs; of runs of one second the greater id comes first."""
    return table(spark, sf_dir, "runs").select("id", moment(F.col("created_at")).alias("created"), "status", "mode").orderBy(F.desc("created"), F.desc("id")).limit(n)


def runs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runs").groupBy("status", "mode").agg(F.count("*").alias("n_runs"), F.sum("tokens_seen").alias("tokens_seen"))


def runs_with_prefix(spark: SparkSession, sf_dir: str, prefix: str = "202503") -> DataFrame:
    """id of the runs whose id begins with a prefix, in which no sign stands for another."""
    return table(spark, sf_dir, "runs").where(F.col("id").startswith(prefix)).select("id")


def resolve(spark: SparkSession, sf_dir: str, prefix: str) -> str:
    """The one run meant by an id, a prefix or 'last'."""
    if prefix == "last":
        found = recent_runs(spark, sf_dir, 1).collect()
        if not found:
            raise KeyError("no runs yet")
        return found[0].id
    runs = table(spark, sf_dir, "runs")
    found = runs.where(F.col("id") == prefix).select("id").limit(1).collect() or runs.where(F.col("id").startswith(prefix)).select("id").orderBy("id").limit(6).collect()
    if not found:
        raise KeyError(f"no such run: {prefix}")
    if len(found) > 1:
        raise KeyError(f"'{prefix}' could be {', '.join(r.id for r in found[:5])}")
    return found[0].id


def new_run_id(taken: DataFrame, stamp: str, mode: str, label: str = "") -> str:
    """A new id from a time stamp; -2, -3, ... when it is taken."""
    base = "-".join(x for x in (stamp, mode, label) if x)
    known = {r.id for r in taken.where(F.col("id").startswith(base)).select("id").collect()}
    return base if base not in known else next(f"{base}-{n}" for n in range(2, len(known) + 3) if f"{base}-{n}" not in known)


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run, with its progress and figures from its plan."""
    plan = F.col("plan_json")
    field = lambda k, kind: F.get_json_object(plan, f"$.{k}").cast(kind)
    return table(spark, sf_dir, "runs").select(
        "id", "name", "mode", "status", "step", "total_steps", F.round(progress(F.col("step"), F.col("total_steps")), 9).alias("progress"), "tokens_seen", field("seq_len", "long").alias("seq_len"), field("strategy", "string").alias("strategy"), field("seed", "long").alias("seed"),
        (F.unix_timestamp(moment(F.col("updated_at"))) - F.unix_timestamp(moment(F.col("created_at")))).alias("open_s"),
    )


def reconciled(spark: SparkSession, sf_dir: str, alive: tuple[str, ...] = ()) -> DataFrame:
    """id, status, changed: running runs without a live worker become failed."""
    gone = (F.col("status") == "running") & ~F.col("id").isin(*alive) if alive else F.col("status") == "running"
    return table(spark, sf_dir, "runs").select("id", F.when(gone, "failed").otherwise(F.col("status")).alias("status"), F.coalesce(gone, F.lit(False)).alias("changed"))


UPDATABLE = ("status", "step", "train_loss", "val_loss", "tokens_seen", "elapsed_s", "error", "name", "total_steps", "plan_json")


def updated(runs: DataFrame, run_id: str, **values) -> DataFrame:
    """The registry with one run's fields changed; unknown fields are an error."""
    if unknown := set(values) - set(UPDATABLE):
        raise ValueError(f"not to be changed: {sorted(unknown)}")
    hit = F.col("id") == run_id
    kinds = dict(runs.dtypes)
    return runs.select(*(F.when(hit, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in runs.columns))


def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_status of each run that came out of another."""
    runs = table(spark, sf_dir, "runs")
    parent = runs.select(F.col("id").alias("parent_run_id"), F.col("status").alias("parent_status"))
    return runs.where("parent_run_id is not null").join(parent, "parent_run_id", "left").select("id", "parent_status")


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, left_steps, left_tokens by registry and plan."""
    runs, plans = table(spark, sf_dir, "runs"), table(spark, sf_dir, "run_plans").select("run_id", F.col("total_steps").cast("long").alias("planned"), "tokens_per_step")
    left = F.greatest(F.col("planned") - F.coalesce("step", F.lit(0)), F.lit(0))
    return runs.join(plans, runs.id == plans.run_id).select("run_id", left.alias("left_steps"), (left * F.col("tokens_per_step")).alias("left_tokens"))


# ---- metrics


def merged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, step, loss, val_loss, n_lines: the last value of each field wins."""
    at = F.struct("line_no", "worker_no")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(c)
    return lines(spark, sf_dir).where("step is not null").groupBy("run_id", "step").agg(last("loss"), last("val_loss"), F.count("*").alias("n_lines"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, worker_no, line_no, d_steps, d_seconds, tokens_per_s and eta_s since the worker's line before, where time went on."""
    rows = lines(spark, sf_dir).where("elapsed_s is not null and step is not null and loss is not null").select("run_id", "worker_no", "line_no", "step", "elapsed_s", "block")
    last = rows.groupBy("run_id", "worker_no", "block").agg(F.max_by(F.struct("step", "elapsed_s"), "line_no").alias("end"))
    before = last.withColumn("prior", F.lag("end").over(W.partitionBy("run_id", "worker_no").orderBy("block"))).select("run_id", "worker_no", "block", "prior")
    inside = W.partitionBy("run_id", "worker_no", "block").orderBy("line_no")
    back = rows.join(before, ["run_id", "worker_no", "block"]).withColumn("p", F.coalesce(F.lag(F.struct("step", "elapsed_s")).over(inside), F.col("prior")))
    plans = table(spark, sf_dir, "run_plans").select("run_id", "tokens_per_step", F.col("total_steps").alias("planned"))
    steps, seconds = F.col("step") - F.col("p.step"), F.col("elapsed_s") - F.col("p.elapsed_s")
    rate = steps * F.col("tokens_per_step") / seconds
    out = back.where(F.col("p").isNotNull() & (steps > 0) & (seconds > 0)).join(plans, "run_id")
    eta = (F.col("planned") - F.col("step")) * F.col("tokens_per_step") / F.greatest(F.lit(1.0), rate)
    return out.select("run_id", "worker_no", "line_no", steps.alias("d_steps"), F.round(seconds, 6).alias("d_seconds"), F.round(rate, 6).alias("tokens_per_s"), F.round(eta, 6).alias("eta_s"))


def best_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, worker_no, line_no, val_loss, best: the least validation loss so far, by lines of a worker."""
    rows = lines(spark, sf_dir).where("val_loss is not null").select("run_id", "worker_no", "line_no", "val_loss", "block")
    least = rows.groupBy("run_id", "worker_no", "block").agg(F.min("val_loss").alias("least"))
    w = W.partitionBy("run_id", "worker_no").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = least.select("run_id", "worker_no", "block", F.min("least").over(w).alias("prior"))
    inside = W.partitionBy("run_id", "worker_no", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = F.least(F.min("val_loss").over(inside), F.col("prior"))  # least() skips nulls
    return rows.join(before, ["run_id", "worker_no", "block"]).select("run_id", "worker_no", "line_no", "val_loss", best.alias("best"))


def throughput_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, n_lines, mean_rate, top_rate over the lines that have a rate."""
    rows = lines(spark, sf_dir).where("tokens_per_sec is not null")
    return rows.groupBy("run_id").agg(F.count("*").alias("n_lines"), F.round(F.avg("tokens_per_sec"), 6).alias("mean_rate"), F.max("tokens_per_sec").alias("top_rate"))


def perplexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, n_evals, ppl: exp of the mean validation loss, 20 at most."""
    rows = lines(spark, sf_dir).where("val_loss is not null").groupBy("run_id").agg(F.count("*").alias("n_evals"), F.avg("val_loss").alias("mean"))
    return rows.select("run_id", "n_evals", F.round(perplexity(F.col("mean")), 6).alias("ppl"))


def notes(before: Column, after: Column) -> Column:
    """What a change of perplexity means."""
    gain = improvement(before, after)
    return F.when(gain > 0.5, "learned").when(gain > 0.05, "modest").when(gain > -0.05, "barely moved").when(gain.isNotNull(), "worse")


def eval_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, before_ppl, after_ppl (of the first and last evaluation), improvement, note, memorised, gap_note."""
    at = F.struct("step", "line_no", "worker_no")
    rows = lines(spark, sf_dir).where("val_loss is not null and step is not null").groupBy("run_id").agg(F.min_by("val_loss", at).alias("b"), F.max_by("val_loss", at).alias("a"))
    before, after = perplexity(F.col("b")), perplexity(F.col("a"))
    gain = improvement(before, after)
    return rows.select("run_id", F.round(before, 6).alias("before_ppl"), F.round(after, 6).alias("after_ppl"), F.round(gain, 6).alias("improvement"), notes(before, after).alias("note"), (gain > 0.9).alias("memorised"), F.when(after / before > 5, "far behind").otherwise("near").alias("gap_note"))


def late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, n_late, n_twice: lines received more than an hour after they were logged, and lines received twice."""
    rows = table(spark, sf_dir, "metrics").where("run_id is not null")
    late = F.col("received_at") > F.col("logged_at") + F.expr("INTERVAL 1 HOUR")
    keyed = rows.groupBy("run_id", "worker_no", "line_no").agg(F.max(late.cast("int")).alias("late"), F.count("*").alias("n"))
    return keyed.groupBy("run_id").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("n_late"), F.sum(F.col("n") - 1).alias("n_twice"))


# ---- lockfiles


def lock_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, parent_run_id, key, old, new: fields in which a run's plan differs from its parent's."""
    plan = table(spark, sf_dir, "runs").select("id", "parent_run_id", F.from_json("plan_json", "map<string,string>").alias("plan"))
    pairs = plan.where("parent_run_id is not null").join(plan.select(F.col("id").alias("parent_run_id"), F.col("plan").alias("old")), "parent_run_id")
    keys = pairs.select("id", "parent_run_id", "plan", "old", F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("plan"), F.array()), F.coalesce(F.map_keys("old"), F.array())))).alias("key"))
    both = keys.select(F.col("id").alias("run_id"), "parent_run_id", "key", F.coalesce(F.try_element_at("old", F.col("key")), F.lit("absent")).alias("old"), F.coalesce(F.try_element_at("plan", F.col("key")), F.lit("absent")).alias("new"))
    return both.where("old <> new")


def lock_differences(old: dict, new: dict) -> list[str]:
    """What differs between two lockfiles, as lines for a user."""
    out = [f"input {k}: {old['inputs'].get(k)} -> {new['inputs'].get(k)}" for k in sorted({*old["inputs"], *new["inputs"]}) if old["inputs"].get(k) != new["inputs"].get(k)]
    a, b = old["environment"], new["environment"]
    out += [f"{k}: {a['packages'].get(k, 'absent')} -> {b['packages'].get(k, 'absent')}" for k in sorted({*a["packages"], *b["packages"]}) if a["packages"].get(k) != b["packages"].get(k)]
    if a["hardware"].get("gpu") != b["hardware"].get("gpu"):
        out.append(f"gpu: {a['hardware'].get('gpu')} -> {b['hardware'].get('gpu')}")
    return out + ["training plan differs"] * (json.dumps(old["plan"], sort_keys=True) != json.dumps(new["plan"], sort_keys=True))


QUERIES = {f.__name__: f for f in (recent_runs, runs_by_status, runs_with_prefix, run_summaries, reconciled, ancestry, plan_steps, merged_series, throughput, best_losses, throughput_lines, perplexities, eval_reports, late_lines, lock_diff)}

_TIME = "CASE WHEN regexp_matches({0}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {0} ELSE {0} || '+00:00' END::TIMESTAMPTZ"
_LINES = """WITH d AS (SELECT run_id, worker_no, line_no, any_value(step) AS step, any_value(loss) AS loss, any_value(val_loss) AS val_loss, any_value(tokens_per_sec) AS tokens_per_sec, any_value(elapsed_s) AS elapsed_s FROM metrics
           WHERE run_id IS NOT NULL AND worker_no IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2, 3),
     m AS (SELECT run_id, worker_no, line_no, step, CASE WHEN NOT isnan(loss) THEN loss END AS loss, CASE WHEN NOT isnan(val_loss) THEN val_loss END AS val_loss, tokens_per_sec, elapsed_s FROM d)
"""
ORACLES = {
    "recent_runs": f"SELECT id, ({_TIME.format('created_at')}) AT TIME ZONE 'UTC' AS created, status, mode FROM runs ORDER BY created DESC, id DESC LIMIT 50",
    "runs_by_status": "SELECT status, mode, count(*) AS n_runs, sum(tokens_seen)::BIGINT AS tokens_seen FROM runs GROUP BY 1, 2",
    "runs_with_prefix": "SELECT id FROM runs WHERE starts_with(id, '202503')",
    "run_summaries": f"""SELECT id, name, mode, status, step, total_steps, round(CASE WHEN total_steps > 0 THEN step / total_steps ELSE 0.0 END, 9) AS progress, tokens_seen, (plan_json->>'seq_len')::BIGINT AS seq_len, plan_json->>'strategy' AS strategy,
       (plan_json->>'seed')::BIGINT AS seed, (epoch({_TIME.format('updated_at')}) - epoch({_TIME.format('created_at')}))::BIGINT AS open_s FROM runs""",
    "reconciled": "SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, coalesce(status = 'running', false) AS changed FROM runs",
    "ancestry": "SELECT r.id, p.status AS parent_status FROM runs r LEFT JOIN runs p ON p.id = r.parent_run_id WHERE r.parent_run_id IS NOT NULL",
    "plan_steps": "SELECT run_id, greatest(p.total_steps - coalesce(r.step, 0), 0)::BIGINT AS left_steps, (greatest(p.total_steps - coalesce(r.step, 0), 0) * p.tokens_per_step)::BIGINT AS left_tokens FROM runs r JOIN run_plans p ON p.run_id = r.id",
    "merged_series": _LINES
    + "SELECT run_id, step, arg_max(loss, (line_no, worker_no)) FILTER (loss IS NOT NULL) AS loss, arg_max(val_loss, (line_no, worker_no)) FILTER (val_loss IS NOT NULL) AS val_loss, count(*) AS n_lines FROM m WHERE step IS NOT NULL GROUP BY 1, 2",
    "throughput": _LINES
    + """, l AS (SELECT *, lag(step) OVER w AS ps, lag(elapsed_s) OVER w AS pe FROM m WHERE elapsed_s IS NOT NULL AND step IS NOT NULL AND loss IS NOT NULL WINDOW w AS (PARTITION BY run_id, worker_no ORDER BY line_no))
SELECT run_id, worker_no, line_no, step - ps AS d_steps, round(elapsed_s - pe, 6) AS d_seconds, round((step - ps) * tokens_per_step / (elapsed_s - pe), 6) AS tokens_per_s,
       round((total_steps - step) * tokens_per_step / greatest(1.0, (step - ps) * tokens_per_step / (elapsed_s - pe)), 6) AS eta_s
FROM l JOIN run_plans USING (run_id) WHERE step > ps AND elapsed_s > pe""",
    "best_losses": _LINES + "SELECT run_id, worker_no, line_no, val_loss, min(val_loss) OVER (PARTITION BY run_id, worker_no ORDER BY line_no) AS best FROM m WHERE val_loss IS NOT NULL",
    "throughput_lines": _LINES + "SELECT run_id, count(*) AS n_lines, round(avg(tokens_per_sec), 6) AS mean_rate, max(tokens_per_sec) AS top_rate FROM m WHERE tokens_per_sec IS NOT NULL GROUP BY 1",
    "perplexities": _LINES + "SELECT run_id, count(*) AS n_evals, round(exp(least(avg(val_loss), 20.0)), 6) AS ppl FROM m WHERE val_loss IS NOT NULL GROUP BY 1",
    "eval_reports": _LINES
    + """, e AS (SELECT run_id, exp(least(arg_min(val_loss, (step, line_no, worker_no)), 20.0)) AS b, exp(least(arg_max(val_loss, (step, line_no, worker_no)), 20.0)) AS a FROM m WHERE val_loss IS NOT NULL AND step IS NOT NULL GROUP BY 1),
     g AS (SELECT *, CASE WHEN b > 0 THEN (b - a) / b END AS g FROM e)
SELECT run_id, round(b, 6) AS before_ppl, round(a, 6) AS after_ppl, round(g, 6) AS improvement, CASE WHEN g > 0.5 THEN 'learned' WHEN g > 0.05 THEN 'modest' WHEN g > -0.05 THEN 'barely moved' WHEN g IS NOT NULL THEN 'worse' END AS note,
       g > 0.9 AS memorised, CASE WHEN a / b > 5 THEN 'far behind' ELSE 'near' END AS gap_note FROM g""",
    "late_lines": """WITH k AS (SELECT run_id, worker_no, line_no, max((epoch_us(received_at) - epoch_us(logged_at) > 3600000000)::INT) AS late, count(*) AS n FROM metrics WHERE run_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT run_id, coalesce(sum(late), 0)::BIGINT AS n_late, sum(n - 1)::BIGINT AS n_twice FROM k GROUP BY 1""",
}
