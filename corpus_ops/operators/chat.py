"""Conversations: turns, renderings, prompts, answers.

Roles go through the aliases in lower case without outer blanks; unknown ones are users, a null role is no turn, as is a
null content. A null messages column has no turns and no rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let, lines, split_words, strip
from ..storage import table

#: Role aliases.
ALIASES = {"human": "user", "prompter": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "system": "system"}
START, END = "<|im_start|>", "<|im_end|>"


def role(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(strip(name))), F.lit("user"))


def turns(messages: Column) -> Column:
    """Messages with normalised roles; turns without a role or content are dropped."""
    whole = F.filter(messages, lambda m: m.isNotNull() & m["role"].isNotNull() & (m["role"] != "") & m["content"].isNotNull())
    return F.transform(whole, lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")))


def flat(messages: Column) -> Column:
    """``role: content`` by lines, for filters and copies alone."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def chatml(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END))), "\n")


def template(messages: Column, prompt: bool = False) -> Column:
    """The template of chat models without their own: every turn ends in a line break."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")
    return F.concat(body, F.lit(f"{START}assistant\n")) if prompt else body


def last_user(messages: Column) -> Column:
    """The last user turn's content, null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def record_text(text: Column, messages: Column) -> Column:
    return F.coalesce(chatml(messages), text, F.lit(""))


def answer_reason(answer: Column) -> Column:
    """Why a generated answer is of no use; null if it is."""
    whole = F.filter(F.transform(F.split(answer, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"), strip), lambda x: x != "")
    few = lambda x: (F.size(x) >= 6) & (F.size(F.array_distinct(x)) <= F.floor(F.size(x) / 3))
    return F.when(answer.isNull() | (F.length(strip(answer)) < 8), "empty or too short").when(let(whole, few), "degenerate repetition")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").where("messages is not null").select("rec_id", turns(F.col("messages")).alias("messages"))


# ---- queries


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, turn, role, n_chars of each normalised turn."""
    each = chats(spark, sf_dir).select("rec_id", F.posexplode("messages").alias("turn", "m"))
    return each.select("rec_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.length("m.content").cast("long").alias("n_chars"))


def chat_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id and the hashes of its three renderings."""
    m = F.col("messages")
    return chats(spark, sf_dir).where(F.size("messages") > 0).select("rec_id", F.md5(flat(m)).alias("flat_md5"), F.md5(chatml(m)).alias("chatml_md5"), F.md5(template(m, True)).alias("template_md5"))


def last_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, prompt: each conversation's last user turn."""
    return chats(spark, sf_dir).select("rec_id", last_user(F.col("messages")).alias("prompt")).where("prompt is not null")


def distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_rec_id, prompt: different prompts of more than four characters, by first appearance."""
    said = last_prompts(spark, sf_dir).select("rec_id", strip(F.col("prompt")).alias("prompt")).where(F.length("prompt") > 4)
    return said.groupBy("prompt").agg(F.min("rec_id").alias("first_rec_id"))


def eval_prompts(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """The first n prompts of more than 4 and fewer than 400 characters."""
    band = last_prompts(spark, sf_dir).select("rec_id", strip(F.col("prompt")).alias("prompt")).where((F.length("prompt") > 4) & (F.length("prompt") < 400))
    return band.orderBy("rec_id").limit(n)


def opening_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, prompt: words 9 to 16 of texts of more than 40 words."""
    w = F.col("w")
    texts = table(spark, sf_dir, "records").where("text is not null").select("rec_id", split_words(F.col("text")).alias("w"))
    return texts.where(F.size("w") > 40).select("rec_id", F.array_join(F.slice(w, 9, 8), " ").alias("prompt"))


def repeated_prompts(spark: SparkSession, sf_dir: str, times: int = 3) -> DataFrame:
    """position, prompt_no, sample: distinct prompts pass by pass, as a generator takes them."""
    prompts = distinct_prompts(spark, sf_dir).select("first_rec_id", F.row_number().over(W.orderBy("first_rec_id", "prompt")).cast("long").alias("prompt_no"))
    total = prompts.agg(F.count("*").alias("n"))
    passes = prompts.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    return passes.join(F.broadcast(total)).select((F.col("sample") * F.col("n") + F.col("prompt_no") - 1).alias("position"), "prompt_no", "sample")


def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, turn, reason of each assistant turn that is rejected."""
    each = chats(spark, sf_dir).select("rec_id", F.posexplode("messages").alias("turn", "m")).where("m.role = 'assistant'")
    return each.select("rec_id", F.col("turn").cast("long").alias("turn"), answer_reason(F.col("m.content")).alias("reason")).where("reason is not null")


def answer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_verdicts(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n_answers"))


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, n_turns, n_lines, n_chars over all turns."""
    each = chats(spark, sf_dir).select(F.explode("messages").alias("m"))
    return each.groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n_turns"), F.sum(F.size(lines(F.col("m.content")))).alias("n_lines"), F.sum(F.length("m.content")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (chat_turns, chat_rendered, last_prompts, distinct_prompts, eval_prompts, opening_prompts, repeated_prompts, answer_verdicts, answer_reasons, answer_lines)}

_SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = rf"'^{_SP}+|{_SP}+$', '', 'g'"
_TURNS = rf"""
WITH e AS (SELECT rec_id, unnest(range(len(messages))) AS k, messages FROM records WHERE messages IS NOT NULL),
     r AS (SELECT rec_id, k, messages[k + 1].role AS raw, messages[k + 1].content AS content FROM e),
     t AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY k) - 1 AS turn, content,
           CASE lower(regexp_replace(raw, {_STRIP})) WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant'
           WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END AS role
           FROM r WHERE raw IS NOT NULL AND raw <> '' AND content IS NOT NULL)
"""
_LAST = _TURNS + ", l AS (SELECT rec_id, arg_max(content, turn) AS prompt FROM t WHERE role = 'user' GROUP BY rec_id)"
_VERDICTS = (
    _TURNS
    + rf""", v AS (SELECT rec_id, turn, content, list_filter(list_transform(string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS ls
     FROM t WHERE role = 'assistant'),
     w AS (SELECT rec_id, turn, CASE WHEN length(regexp_replace(content, {_STRIP})) < 8 THEN 'empty or too short' WHEN len(ls) >= 6 AND len(list_distinct(ls)) <= len(ls) // 3 THEN 'degenerate repetition' END AS reason FROM v)
"""
)
ORACLES = {
    "chat_turns": _TURNS + "SELECT rec_id, turn, role, length(content)::BIGINT AS n_chars FROM t",
    "chat_rendered": _TURNS
    + """SELECT rec_id, md5(string_agg(role || ': ' || content, chr(10) ORDER BY turn)) AS flat_md5,
       md5(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn)) AS chatml_md5,
       md5(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS template_md5
FROM t GROUP BY rec_id""",
    "last_prompts": _LAST + "SELECT rec_id, prompt FROM l",
    "distinct_prompts": _LAST + f"SELECT regexp_replace(prompt, {_STRIP}) AS prompt, min(rec_id) AS first_rec_id FROM l WHERE length(regexp_replace(prompt, {_STRIP})) > 4 GROUP BY 1",
    "eval_prompts": _LAST + f"SELECT rec_id, regexp_replace(prompt, {_STRIP}) AS prompt FROM l WHERE length(regexp_replace(prompt, {_STRIP})) BETWEEN 5 AND 399 ORDER BY rec_id LIMIT 64",
    "opening_prompts": rf"WITH w AS (SELECT rec_id, list_filter(string_split_regex(text, '{_SP}+'), lambda x: x <> '') AS w FROM records WHERE text IS NOT NULL) SELECT rec_id, array_to_string(w[9:16], ' ') AS prompt FROM w WHERE len(w) > 40",
    "repeated_prompts": _LAST
    + f""", d AS (SELECT regexp_replace(prompt, {_STRIP}) AS prompt, min(rec_id) AS f FROM l WHERE length(regexp_replace(prompt, {_STRIP})) > 4 GROUP BY 1),
     o AS (SELECT row_number() OVER (ORDER BY f, prompt) AS prompt_no, count(*) OVER () AS n FROM d)
SELECT s * n + prompt_no - 1 AS position, prompt_no, s AS sample FROM o, range(3) AS g(s)""",
    "answer_verdicts": _VERDICTS + "SELECT rec_id, turn, reason FROM w WHERE reason IS NOT NULL",
    "answer_reasons": _VERDICTS + "SELECT reason, count(*) AS n_answers FROM w WHERE reason IS NOT NULL GROUP BY 1",
    "answer_lines": _TURNS
    + rf"SELECT role, count(*) AS n_turns, sum(len(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '')))::BIGINT AS n_lines, sum(length(content))::BIGINT AS n_chars FROM t GROUP BY 1",
}
