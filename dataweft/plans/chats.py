"""Queries on chat data."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import chat
from dataweft.plans.registry import query
from dataweft.sources.inputs import messages

SIZE, MAX_LEN = 500, 200
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')"
BASE = {
    "replies": """SELECT conv_id, max(CASE WHEN rn = 2 THEN content END) AS reply FROM
        (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM messages) GROUP BY conv_id""",
    "words": f"SELECT conv_id, {TOKENS.format('coalesce(reply, chr(32))')} AS t FROM replies",
    "counted": """SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM words) GROUP BY token""",
    "vocab": f"""SELECT token, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id FROM counted
        ORDER BY n DESC, token LIMIT {SIZE}""",
    "spread": f"""SELECT conv_id, len(t) AS n_tokens, unnest(t[1:{MAX_LEN}]) AS token, generate_subscripts(t[1:{MAX_LEN}], 1) AS pos FROM words""",
    "coded": f"""SELECT w.conv_id, CAST(len(w.t) AS INTEGER) AS n_tokens,
        coalesce((SELECT list(coalesce(v.id, 1) ORDER BY s.pos) FROM spread s LEFT JOIN vocab v ON s.token = v.token
                  WHERE s.conv_id = w.conv_id), []) AS ids FROM words w""",
    "padded": f"""SELECT conv_id, n_tokens, list_resize(ids, {MAX_LEN}, 0) AS input_ids,
        list_resize([1 FOR x IN ids], {MAX_LEN}, 0) AS mask,
        list_resize(ids, {MAX_LEN}, -100) AS labels FROM coded"""}


def replies(spark, d):
    return chat.reply_text(messages(spark, d))


def encoded(spark, d):
    r = replies(spark, d)
    return chat.encode(r, "conv_id", "reply", chat.build_vocab(r, "reply", SIZE), MAX_LEN)


@query("q_chat_reply", "SELECT conv_id, reply FROM replies", inputs=("messages",), ctes=BASE)
def chat_reply(spark, d):
    return replies(spark, d)


@query("q_chat_reply_missing", "SELECT CAST(count(*) - count(reply) AS BIGINT) AS n_missing FROM replies", inputs=("messages",), ctes=BASE)
def chat_reply_missing(spark, d):
    nested = chat.reply_of_nested(chat.nest_messages(messages(spark, d)))
    return nested.agg(F.count_if(F.col("reply").isNull()).alias("n_missing"))


@query("q_vocab_top", "SELECT token, n, id FROM vocab", inputs=("messages",), ctes=BASE)
def vocab_top(spark, d):
    return chat.build_vocab(replies(spark, d), "reply", SIZE)


@query("q_chat_token_len", "SELECT conv_id, CAST(len(t) AS INTEGER) AS n_tokens FROM words", inputs=("messages",), ctes=BASE)
def chat_token_len(spark, d):
    return replies(spark, d).select("conv_id", F.size(chat.tokens(F.coalesce("reply", F.lit("")))).alias("n_tokens"))


@query("q_chat_encoded", """
    SELECT conv_id, n_tokens, array_to_string(input_ids, ',') AS input_ids, array_to_string(mask, ',') AS attention_mask FROM padded""",
       inputs=("messages",), ctes=BASE)
def chat_encoded(spark, d):
    return encoded(spark, d).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("input_ids", "attention_mask")})


@query("q_lm_labels", "SELECT conv_id, array_to_string(labels, ',') AS labels FROM padded", inputs=("messages",), ctes=BASE)
def lm_labels(spark, d):
    return chat.lm_labels(encoded(spark, d)).select("conv_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("q_prompts", """
    SELECT conv_id, turn, concat('### Instruction:', chr(10), content, chr(10), chr(10), '### Response:', chr(10)) AS prompt
    FROM messages""", inputs=("messages",))
def prompts(spark, d):
    return chat.to_prompt(messages(spark, d), "content").select("conv_id", "turn", "prompt")


@query("q_batches", """
    SELECT conv_id, CAST(row_number() OVER (ORDER BY conv_id) AS BIGINT) AS row_id,
           CAST((row_number() OVER (ORDER BY conv_id) - 1) // 16 AS BIGINT) AS batch_id FROM replies""", inputs=("messages",), ctes=BASE)
def batches(spark, d):
    return chat.batch_ids(replies(spark, d).select("conv_id"), ["conv_id"], 16)
