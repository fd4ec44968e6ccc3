"""Chat messages to training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.functions.scalars import fit_length
from dataweft.operators.ordering import with_row_id
from dataweft.operators.rel import collect_ordered
from dataweft.session import cut

PAD_ID, UNKNOWN_ID = 0, 1
MASKED = -100


def nest_messages(rows: DataFrame, max_messages: int = 100_000) -> DataFrame:
    """Ordered messages (turn, role, content) per conversation; a longer conversation goes on in the next part."""
    return collect_ordered(rows, ["conv_id"], ["turn"], ["turn", "role", "content"], "messages", max_messages)


def reply_text(rows: DataFrame) -> DataFrame:
    """(conv_id, reply): the second message of each conversation, NULL if there is none.

    Each task sends on at most two messages of a conversation, so a long one does not travel whole.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    first_two = rows.select("conv_id", "content", place.alias("_p")).where("_p <= 2")
    return first_two.groupBy("conv_id").agg(F.max(F.when(F.col("_p") == 2, F.col("content"))).alias("reply"))


def reply_of_nested(chats: DataFrame) -> DataFrame:
    """The same from nested chats, also where the second message opens the next part."""
    head = chats.where("part <= 1").select("conv_id", F.struct("part", F.slice("messages", 1, 2).alias("m")).alias("e"))
    both = head.groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("e"))  # two parts of two messages at most
    return both.select("conv_id", F.get(F.flatten("e.m"), F.lit(1))["content"].alias("reply"))


def tokens(text: Column) -> Column:
    """Lower-case words and single other marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))


def build_vocab(df: DataFrame, text: str, size: int) -> DataFrame:
    """(token, id) of the most frequent tokens; the first ids are reserved for padding and unknown tokens."""
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    # the window runs over at most ``size`` rows, which the limit has gathered already
    place = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return cut(top.select("token", "n", (place + UNKNOWN_ID).cast("int").alias("id")))


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int = 1000) -> DataFrame:
    """(key, n_tokens, input_ids, attention_mask), cut and padded to ``max_len``; ``key`` is unique.

    Text is cut to ``max_len`` tokens before it is spread, so a row stays small. How the vocabulary is joined is left to the
    planner's check of its size.
    """
    parts = df.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    parts = parts.select(key, F.size("_t").alias("n_tokens"), F.slice("_t", 1, max_len).alias("_t"))
    words = parts.select(key, "n_tokens", F.posexplode_outer("_t").alias("_pos", "token"))
    found = words.join(vocab.select("token", "id"), "token", "left")
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("_id")))
    rows = found.groupBy(key, "n_tokens").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    input_ids = F.transform("_e", lambda e: e["_id"])
    mask = F.transform("_e", lambda e: F.lit(1))
    return rows.select(key, "n_tokens", fit_length(input_ids, max_len, PAD_ID).alias("input_ids"),
                       fit_length(mask, max_len, 0).alias("attention_mask"))


def lm_labels(df: DataFrame) -> DataFrame:
    """Next-token labels: the ids, with padding masked."""
    return df.withColumn("labels", F.zip_with("input_ids", "attention_mask",
                                              lambda i, m: F.when(m == 1, i).otherwise(F.lit(MASKED))))


def to_prompt(df: DataFrame, c: str, name: str = "prompt", role: str | None = None) -> DataFrame:
    """The instruction prompt around a text; with ``role`` only around the messages of that role."""
    df = df if role is None else df.where(F.col("role") == role)
    return df.withColumn(name, F.format_string("### Instruction:\n%s\n\n### Response:\n", F.col(c)))


def batch_ids(df: DataFrame, order: list[str], batch: int = 16, steps: int | None = None) -> DataFrame:
    """Number the rows and cut them into batches; ``steps`` keeps the batches a run of that many steps uses."""
    out = with_row_id(df, order, "row_id").withColumn("batch_id", F.floor((F.col("row_id") - 1) / batch))
    return out if steps is None else out.where(F.col("batch_id") < steps)
