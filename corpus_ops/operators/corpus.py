"""From records to a clean corpus: quality, exact and near copies, and the analysis of what is kept.

Records come in the order of rec_id. Prose is judged as it is, a conversation in its flat rendering. A record with
neither text nor messages, and one with a blank text, is dropped as too short. Exact copies share one key set over prose
and conversations, and only records that pass the quality rules take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alphabetic, extension, file_of, let, lines, strip, sum_lengths, tokens
from ..storage import kept, table
from .chat import _SP, _STRIP, flat, turns

#: Thresholds of the quality rules.
MIN_CHARS, MIN_ALPHA, MAX_REPEATED, MAX_LINE = 64, 0.5, 0.5, 5000
SHINGLE, SIMILAR = 5, 0.8
CHARS_PER_TOKEN, INSTRUCTION = 4.0, 0.5


def quality_reason(text: Column) -> Column:
    """The first rule that a text breaks; null for one that is kept."""

    def rules(body: Column, whole: Column) -> Column:
        n = F.size(whole)
        return (
            F.when(F.length(body) < MIN_CHARS, "too short")
            .when(alphabetic(body) / F.length(body) < MIN_ALPHA, "low alphabetic ratio")
            .when((n >= 8) & (1.0 - F.size(F.array_distinct(whole)) / n > MAX_REPEATED), "repetitive lines")
            .when(sum_lengths(whole) / n > MAX_LINE, "pathological line length")
        )

    return let(strip(F.coalesce(text, F.lit(""))), lambda body: let(lines(body), lambda whole: rules(body, whole)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, source, chat, body (what is judged), n_chars (of the record), reason, and key (a hash of the stripped body)."""
    records = table(spark, sf_dir, "records").select("rec_id", "source", "text", turns(F.col("messages")).alias("messages"))
    body = F.coalesce("text", flat(F.col("messages")), F.lit(""))
    said = F.aggregate(F.col("messages"), F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    rows = records.select("rec_id", "source", F.col("messages").isNotNull().alias("chat"), body.alias("body"), F.coalesce(F.length("text").cast("long"), said, F.lit(0).cast("long")).alias("n_chars"))
    return rows.withColumn("reason", quality_reason(F.col("body"))).withColumn("key", F.sha2(strip(F.col("body")), 256))


def without_copies(rows: DataFrame) -> DataFrame:
    """Rows that pass the rules, with copy_of: the first record with the same stripped body, null for the first itself.

    The first of each key is a minimum, combined on the map side, and joined back, so a hot key is a skewed join side
    that adaptive execution can split, and no group is sorted in one task.
    """
    keyed = rows.where("reason is null")
    first = keyed.groupBy("key").agg(F.min("rec_id").alias("first"))
    return keyed.join(first, "key").withColumn("copy_of", F.when(F.col("first") < F.col("rec_id"), F.col("first"))).drop("first", "key")


def shingles(text: Column) -> Column:
    """The different runs of five words, as 64-bit numbers; shorter texts have none."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))
        return F.when(F.size(w) >= SHINGLE, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return let(tokens(text), runs)


def same_sets(sets: DataFrame) -> DataFrame:
    """id, s, first of rows (id, s): the smallest id with the same set, so that copies of any number stand as one."""
    keyed = kept(sets.where(F.size("s") > 0).select("id", "s", F.sha2(F.array_join(F.sort_array("s"), ","), 256).alias("key")))
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    return kept(keyed.join(first, "key").select("id", "s", "first", "size"))


def similar_pairs(sets: DataFrame) -> DataFrame:
    """a < b of rows (id, s) whose sets have a Jaccard similarity of SIMILAR or more; loses no pair.

    Of two such sets, each one's rarest n - ceil(0.8 n) + 1 members hold a common one (prefix filter), so sets meet only
    in rare members; then every pair is measured.
    """
    n = F.size("s")
    sized = kept(sets.where(n > 0).select("id", "s", n.alias("n")))
    member = sized.select("id", "n", F.explode("s").alias("x"))
    often = member.groupBy("x").agg(F.count("*").alias("df"))
    ranked = member.join(often, "x").where("df > 1 or n > 0").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("order"))
    prefix = F.slice("order", 1, F.col("n") - F.ceil(F.col("n") * SIMILAR).cast("int") + 1)
    rare = kept(ranked.select("id", "n", F.explode(prefix).alias("m")).where("m.df > 1").select("id", "n", "m.x"))
    a, b = rare.select(F.col("id").alias("a"), F.col("n").alias("an"), "x"), rare.select(F.col("id").alias("b"), F.col("n").alias("bn"), "x")
    meet = a.join(b, "x").where((F.col("a") < F.col("b")) & (F.col("an") >= SIMILAR * F.col("bn")) & (F.col("bn") >= SIMILAR * F.col("an"))).select("a", "b").distinct()
    left, right = sized.select(F.col("id").alias("a"), F.col("s").alias("sa")), sized.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return meet.join(left, "a").join(right, "b").where(common >= SIMILAR * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def first_kept(edges: DataFrame) -> DataFrame:
    """id of the rows that are dropped when rows come in order of id and one is dropped if it is linked to a kept earlier one.

    The same rule for all rows at once, until nothing is open: a row is kept when every earlier neighbour is dropped, and
    dropped when one is kept. Each round is written to the checkpoint folder.
    """
    edges = kept(edges)
    open_ids = kept(edges.select(F.col("b").alias("id")).distinct())
    # rows that are never the later of a link are kept from the start
    state = kept(edges.select(F.col("a").alias("id")).distinct().join(open_ids, "id", "left_anti").select("id", F.lit("kept").alias("state")))
    while True:
        still = open_ids.join(state, "id", "left_anti")
        near = edges.join(still.withColumnRenamed("id", "b"), "b", "left_semi").join(state.withColumnRenamed("id", "a"), "a", "left")
        seen = near.groupBy("b").agg(F.max(F.expr("state = 'kept'")).alias("by_kept"), F.max(F.expr("state is null")).alias("waits"))
        new = seen.select(F.col("b").alias("id"), F.when(F.col("by_kept"), "dropped").when(~F.col("waits"), "kept").alias("state")).where("state is not null")
        new = kept(new)
        if not new.limit(1).count():
            return state.where("state = 'dropped'").select("id")
        state = kept(state.unionByName(new))


def clean(spark: SparkSession, sf_dir: str, near: bool = True) -> DataFrame:
    """Every record with its fate: reason of the quality rules, 'exact copy', 'near copy', or null if it is kept."""
    rows = kept(judged(spark, sf_dir)) if near else kept(judged(spark, sf_dir).drop("body"))  # used twice and more; the rules are the cost
    unique = without_copies(rows)
    copies = unique.where("copy_of is not null").select("rec_id", F.lit("exact copy").alias("copy"))
    if near:
        texts = same_sets(unique.where("copy_of is null and not chat").select(F.col("rec_id").alias("id"), shingles(F.col("body")).alias("s")))
        # a later text with the same set is dropped whether the first is kept (by it) or dropped (by what dropped the first)
        again = texts.where("first < id").select("id").unionByName(first_kept(similar_pairs(texts.where("first = id").select("id", "s"))))
        copies = copies.unionByName(again.select(F.col("id").alias("rec_id"), F.lit("near copy").alias("copy")))
    return rows.join(copies, "rec_id", "left").select("rec_id", "source", "chat", "n_chars", F.coalesce("reason", "copy").alias("fate"))


# ---- queries


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, reason of the records that the quality rules drop."""
    return judged(spark, sf_dir).where("reason is not null").select("rec_id", "reason")


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, copy_of of each record that repeats an earlier one."""
    return without_copies(judged(spark, sf_dir)).where("copy_of is not null").select("rec_id", "copy_of")


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").where("text is not null").select("rec_id", F.size(shingles(F.col("text"))).cast("long").alias("n_shingles"))


def near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, class_of (the first with the same shingles), n_links: prose records, first of their exact copies, with near copies (Jaccard of five-word shingles 0.8 or more)."""
    unique = without_copies(judged(spark, sf_dir)).where("copy_of is null and not chat").select(F.col("rec_id").alias("id"), shingles(F.col("body")).alias("s"))
    texts = same_sets(unique)
    size = texts.where("first = id").select(F.col("id").alias("other"), "size")
    pairs = kept(similar_pairs(texts.where("first = id").select("id", "s")))
    linked = pairs.select(F.col("a").alias("first"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("first"), F.col("a").alias("other")))
    others = linked.join(size, "other").groupBy("first").agg(F.sum("size").alias("others"))
    counted = texts.join(others, "first", "left").select(F.col("id").alias("rec_id"), F.col("first").alias("class_of"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return counted.where("n_links > 0")


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, source, chat, n_chars of what is kept after quality, exact and near copies."""
    return clean(spark, sf_dir).where("fate is null").drop("fate")


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fate, n_records, n_chars with exact copies only."""
    return clean(spark, sf_dir, near=False).groupBy(F.coalesce("fate", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars"))


def analyse(fates: DataFrame) -> DataFrame:
    """One row of counters, kind, estimate and warnings, of rows (source, chat, n_chars, fate)."""
    is_kept = F.col("fate").isNull()
    dropped = F.col("fate").isin("exact copy", "near copy")
    per_file = fates.groupBy(file_of(F.col("source")).alias("file")).agg(F.max(is_kept).alias("used"))
    files = per_file.agg(F.count("*").alias("n_files_scanned"), F.count_if("used").alias("n_files_used"), F.count_if(~F.col("used")).alias("n_files_skipped"))
    count = lambda c: F.count_if(c)
    one = fates.agg(count(is_kept).alias("n_documents"), F.coalesce(F.sum(F.when(is_kept, F.col("n_chars"))), F.lit(0)).alias("n_chars"), count(is_kept & F.col("chat")).alias("n_chat"), count(dropped).alias("n_dropped_duplicate"), count(~is_kept & ~dropped).alias("n_dropped_quality"))
    share = F.when(F.col("n_documents") > 0, F.col("n_chat") / F.col("n_documents")).otherwise(0.0)
    rows = one.crossJoin(F.broadcast(files)).withColumn("share", share)  # one row each
    return rows.select(
        *files.columns, "n_documents", "n_chars", "n_dropped_quality", "n_dropped_duplicate", F.bround("share", 4).alias("chat_fraction"), F.when(F.col("share") >= INSTRUCTION, "instruction").otherwise("raw").alias("kind"), F.floor(F.col("n_chars") / CHARS_PER_TOKEN).alias("est_tokens")
    )


def warnings(row: DataFrame, exact: Column | None = None) -> DataFrame:
    """The analysis row with what a user should be told."""
    tokens_ = F.coalesce(exact, F.col("est_tokens")) if exact is not None else F.col("est_tokens")
    about = F.concat(F.lit("" if exact is not None else "~"), F.format_number(tokens_, 0))
    copies = F.col("n_dropped_duplicate") / F.greatest(F.col("n_documents") + F.col("n_dropped_duplicate"), F.lit(1))
    percent = lambda c: F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    told = F.array_compact(
        F.array(
            F.when(tokens_ < 1_000_000, F.concat(F.lit("too few tokens to train from scratch: "), about)).when(tokens_ < 50_000_000, F.concat(F.lit("a small corpus: "), about)),
            F.when(copies > 0.3, F.concat(percent(copies), F.lit(" were duplicates"))),
            F.when((F.col("chat_fraction") > 0.15) & (F.col("chat_fraction") < 0.85), F.concat(F.lit("mixed corpus, "), percent(F.col("chat_fraction")), F.lit(" conversational, taken as "), F.col("kind"))),
        )
    )
    return row.withColumn("warnings", F.when(F.col("n_documents") == 0, F.array(F.lit("no documents are left"))).otherwise(told))


def corpus_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(clean(spark, sf_dir, near=False))


def corpus_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """warning: what the analysis tells a user."""
    return warnings(corpus_analysis(spark, sf_dir)).select(F.explode("warnings").alias("warning"))


def by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extension, files, documents, chars of what is kept, largest first."""
    rows = clean(spark, sf_dir, near=False).where("fate is null").select(extension(F.col("source")).alias("extension"), file_of(F.col("source")).alias("file"), "n_chars")
    per_file = rows.groupBy("extension", "file").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return per_file.groupBy("extension").agg(F.count("*").alias("files"), F.sum("n").alias("documents"), F.sum("c").alias("chars")).orderBy(F.desc("chars"), "extension")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, documents of each file with kept records, in order of its path's parts."""
    rows = clean(spark, sf_dir, near=False).where("fate is null").groupBy(file_of(F.col("source")).alias("path")).agg(F.count("*").alias("documents"))
    return rows.orderBy(F.split("path", "/"))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reason, n_files: why files gave nothing."""
    files = clean(spark, sf_dir, near=False).groupBy(file_of(F.col("source")).alias("path")).agg(F.max(F.col("fate").isNull()).alias("used"))
    return files.where("not used").groupBy(F.lit("all documents filtered").alias("reason")).agg(F.count("*").alias("n_files"))


def corpora_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_hash, kind, n_documents, dup_ratio, reason counts of each corpus's latest analysis."""
    rows = table(spark, sf_dir, "corpora")
    last = rows.groupBy("content_hash").agg(F.max_by(F.struct("kind", "n_documents", "n_dropped_duplicate", "drop_reasons"), F.struct("created_at", F.coalesce("root", F.lit("")))).alias("r"))
    n = F.col("r.n_documents") + F.col("r.n_dropped_duplicate")
    dropped = F.aggregate(F.map_values("r.drop_reasons"), F.lit(0).cast("long"), lambda a, x: a + x)
    return last.select("content_hash", "r.kind", "r.n_documents", F.round(F.col("r.n_dropped_duplicate") / F.greatest(n, F.lit(1)), 9).alias("dup_ratio"), F.coalesce(dropped, F.lit(0)).alias("n_dropped"))


QUERIES = {f.__name__: f for f in (corpus_summary, quality_verdicts, quality_summary, exact_copies, shingle_counts, near_classes, clean_corpus, corpus_analysis, corpus_warnings, by_extension, manifest, skip_reasons, corpora_latest)}

_BODY = rf"""
WITH e AS (SELECT rec_id, unnest(range(len(messages))) AS k, messages FROM records WHERE messages IS NOT NULL),
     m AS (SELECT rec_id, string_agg(CASE lower(regexp_replace(messages[k + 1].role, {_STRIP})) WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant'
           WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END || ': ' || messages[k + 1].content, chr(10) ORDER BY k) AS flat, sum(length(messages[k + 1].content))::BIGINT AS said
           FROM e WHERE messages[k + 1].role IS NOT NULL AND messages[k + 1].role <> '' AND messages[k + 1].content IS NOT NULL GROUP BY rec_id),
     b AS (SELECT r.rec_id, source, r.messages IS NOT NULL AS chat, coalesce(text, flat, '') AS body, coalesce(length(text), said, 0)::BIGINT AS n_chars FROM records r LEFT JOIN m USING (rec_id)),
     s AS (SELECT *, regexp_replace(body, {_STRIP}) AS t FROM b),
     l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS ls FROM s),
     j AS (SELECT rec_id, source, chat, n_chars, t, CASE WHEN length(t) < 64 THEN 'too short'
           WHEN length(regexp_replace(t, '[^\p{{L}}{_SP[1:-1]}]', '', 'g')) / length(t) < 0.5 THEN 'low alphabetic ratio'
           WHEN len(ls) >= 8 AND 1.0 - len(list_distinct(ls)) / len(ls) > 0.5 THEN 'repetitive lines'
           WHEN list_sum(list_transform(ls, lambda x: length(x))) / len(ls) > 5000 THEN 'pathological line length' END AS reason FROM l),
     c AS (SELECT *, CASE WHEN reason IS NULL THEN min(rec_id) OVER (PARTITION BY t, reason) END AS first FROM j),
     f AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN first < rec_id THEN 'exact copy' END AS fate, regexp_replace(source, '(:\d+|#.*)$', '') AS file FROM c)
"""
ORACLES = {
    "corpus_summary": _BODY + "SELECT coalesce(fate, 'kept') AS fate, count(*) AS n_records, sum(n_chars)::BIGINT AS n_chars FROM f GROUP BY 1",
    "quality_verdicts": _BODY + "SELECT rec_id, reason FROM j WHERE reason IS NOT NULL",
    "quality_summary": _BODY + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_records, sum(n_chars)::BIGINT AS n_chars FROM j GROUP BY 1",
    "exact_copies": _BODY + "SELECT rec_id, first AS copy_of FROM c WHERE first < rec_id",
    "shingle_counts": r"""WITH w AS (SELECT rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM records WHERE text IS NOT NULL)
SELECT rec_id, len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))::BIGINT AS n_shingles FROM w""",
    "near_classes": _BODY
    + r""", w AS (SELECT rec_id, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS w FROM f WHERE fate IS NULL AND NOT chat),
     g AS (SELECT rec_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS x FROM w),
     n AS (SELECT rec_id, count(*) AS n FROM g GROUP BY 1),
     p AS (SELECT a.rec_id AS a, b.rec_id AS b, count(*) AS common FROM g a JOIN g b USING (x) WHERE a.rec_id < b.rec_id GROUP BY 1, 2),
     q AS (SELECT a, b FROM p JOIN n na ON na.rec_id = a JOIN n nb ON nb.rec_id = b WHERE common >= 0.8 * (na.n + nb.n - common)),
     k AS (SELECT rec_id, md5(string_agg(x, '|' ORDER BY x)) AS k FROM g GROUP BY 1),
     c2 AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY k) AS class_of FROM k)
SELECT rec_id, class_of, count(*) AS n_links FROM (SELECT a AS rec_id FROM q UNION ALL SELECT b FROM q) JOIN c2 USING (rec_id) GROUP BY 1, 2""",
    "corpus_analysis": _BODY
    + """, x AS (SELECT file, bool_or(fate IS NULL) AS used FROM f GROUP BY 1),
     y AS (SELECT count(*) FILTER (fate IS NULL) AS n_documents, coalesce(sum(n_chars) FILTER (fate IS NULL), 0)::BIGINT AS n_chars, count(*) FILTER (fate IS NULL AND chat) AS n_chat,
           count(*) FILTER (fate = 'exact copy') AS n_dropped_duplicate, count(*) FILTER (fate IS NOT NULL AND fate <> 'exact copy') AS n_dropped_quality FROM f)
SELECT (SELECT count(*) FROM x) AS n_files_scanned, (SELECT count(*) FROM x WHERE used) AS n_files_used, (SELECT count(*) FROM x WHERE NOT used) AS n_files_skipped, n_documents, n_chars, n_dropped_quality, n_dropped_duplicate,
       round(n_chat / n_documents, 4) AS chat_fraction, CASE WHEN n_chat / n_documents >= 0.5 THEN 'instruction' ELSE 'raw' END AS kind, (n_chars // 4)::BIGINT AS est_tokens FROM y""",
    "by_extension": _BODY
    + r"""SELECT regexp_extract(lower(file), '[^/\\.](\.[^/\\.]+)$', 1) AS extension, count(DISTINCT file) AS files, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM f WHERE fate IS NULL GROUP BY 1""",
    "manifest": _BODY + "SELECT file AS path, count(*) AS documents FROM f WHERE fate IS NULL GROUP BY 1",
    "skip_reasons": _BODY + "SELECT 'all documents filtered' AS reason, count(*) AS n_files FROM (SELECT file FROM f GROUP BY 1 HAVING NOT bool_or(fate IS NULL)) HAVING count(*) > 0",
    "corpora_latest": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC, coalesce(root, '') DESC) AS k FROM corpora)
SELECT content_hash, kind, n_documents, round(n_dropped_duplicate / greatest(n_documents + n_dropped_duplicate, 1), 9) AS dup_ratio, coalesce(list_sum(map_values(drop_reasons)), 0)::BIGINT AS n_dropped FROM x WHERE k = 1""",
}
