"""Training-example preparation (X1–X5): data only, no trainer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.text import token_count, token_id_count, token_ids, tokens
from trajspark.operators import metrics as A
from trajspark.operators import sampling as D
from trajspark.operators import steps as T
from trajspark.operators import value as VE
from trajspark.session import write_table

# Chat-template header tokens of the "llama3" style.
LLAMA3 = {
    "bos": "<|begin_of_text|>",
    "start": "<|start_header_id|>",
    "end": "<|end_header_id|>\n",
    "eot": "<|eot_id|>\n",
}
IGNORE_INDEX = -100
#: longest example that is trained on, tokens; longer ones are cut by X3
MAX_TOKENS = 1024


# X1 -------------------------------------------------------------------------
def sft_pairs(student: DataFrame, teacher: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Student prompt messages + the teacher's last message, joined on the example id."""
    t = teacher.select(*keys, F.col("content").alias("_teacher"))
    j = student.join(t, list(keys))
    last = F.struct(F.lit("assistant").alias("role"), F.col("_teacher").alias("content"))
    return j.withColumn("messages", F.concat("messages", F.array(last))).withColumnRenamed("_teacher", "assistant")


def exchanges(turns: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Questions and answers: user messages, and the assistant message that directly follows
    one, both under (keys…, order of the question).

    The next message is found by one window over a conversation's turn numbers.
    """
    w = Window.partitionBy(*keys).orderBy(order, "role", "text")
    t = turns.select(*keys, order, "role", "text", F.lead(F.struct("role", "text")).over(w).alias("_next"))
    t = t.where((F.col("role") == "user") & (F.col("_next.role") == "assistant"))
    return t.select(*keys, order, "text"), t.select(*keys, order, F.col("_next.text").alias("content"))


def last_message(turns: DataFrame, keys: Sequence[str], order: str, role: str = "assistant") -> DataFrame:
    """The last message of a role per conversation (partial aggregation, no sort)."""
    return turns.where(F.col("role") == role).groupBy(*keys).agg(F.max_by("text", order).alias("content"))


# X2 -------------------------------------------------------------------------
def _render(msg: Column, style: dict) -> Column:
    return F.concat(F.lit(style["start"]), msg["role"], F.lit(style["end"]), msg["text"], F.lit(style["eot"]))


def render_chat(turns: DataFrame, keys: Sequence[str], order: Sequence[str], style: dict | None = None) -> DataFrame:
    """Chat-template rendering per conversation: full text, and the query text
    (all but the last message, followed by the assistant generation header)."""
    style = style or LLAMA3
    g = turns.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], "role", "text"))).alias("_m")
    )
    rendered = F.transform("_m", lambda m: _render(m, style))
    n = F.size("_m")
    gen = F.lit(style["start"] + "assistant" + style["end"])
    return g.select(
        *keys,
        n.alias("n_messages"),
        F.concat(F.lit(style["bos"]), F.array_join(F.slice(rendered, 1, n - 1), ""), gen).alias("query_text"),
        F.concat(F.lit(style["bos"]), F.array_join(rendered, "")).alias("full_text"),
    )


# X3 -------------------------------------------------------------------------
def label_masks(df: DataFrame, max_len: int, tokenizer: str | None = None) -> DataFrame:
    """Truncate to ``max_len`` tokens (``input_tokens``); prompt positions get label −100; rows whose
    answer is cut away entirely are flagged ``kept = false`` (count them, drop them)."""
    toks = tokens(F.col("full_text"), tokenizer)
    t = df.withColumn("_t", F.slice(toks, 1, max_len)).withColumn("n_prompt", token_count(F.col("query_text"), tokenizer))
    labels = F.transform("_t", lambda x, i: F.when(i < F.col("n_prompt"), F.lit(str(IGNORE_INDEX))).otherwise(x))
    return t.select(
        "*",
        F.size("_t").alias("n_tokens"),
        F.greatest(F.size("_t") - F.col("n_prompt"), F.lit(0)).alias("n_label"),
        labels.alias("labels"),
    ).withColumn("kept", F.col("n_label") > 0).withColumnRenamed("_t", "input_tokens")


def label_id_masks(df: DataFrame, max_len: int, tokenizer: str) -> DataFrame:
    """``label_masks`` over the ids of a subword vocabulary: ``input_ids`` cut to ``max_len``, and
    ``labels`` with −100 on the positions that the query's own ids take up. Rows without a
    label are flagged ``kept = false``."""
    t = df.withColumn("_all", token_ids(F.col("full_text"), tokenizer)).withColumn("n_prompt", token_id_count(F.col("query_text"), tokenizer))
    t = t.select(*df.columns, F.slice("_all", 1, max_len).alias("input_ids"), "n_prompt")
    labels = F.transform("input_ids", lambda x, i: F.when(i < F.col("n_prompt"), IGNORE_INDEX).otherwise(x))
    n_label = F.greatest(F.size("input_ids") - F.col("n_prompt"), F.lit(0))
    return t.select("*", F.size("input_ids").alias("n_tokens"), n_label.alias("n_label"), labels.alias("labels"), (n_label > 0).alias("kept"))


# X4 -------------------------------------------------------------------------
def pad_batches(df: DataFrame, seq: str, batch: str, pad: str = "<pad>") -> DataFrame:
    """Pad every sequence to its minibatch maximum; attention mask marks real tokens."""
    w = Window.partitionBy(batch)
    t = df.withColumn("length", F.size(seq)).withColumn("padded_len", F.max("length").over(w))
    t = t.withColumn("n_pad", F.col("padded_len") - F.col("length"))
    return t.withColumn(f"{seq}_padded", F.concat(F.col(seq), F.array_repeat(F.lit(pad), F.col("n_pad")))).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("length")), F.array_repeat(F.lit(0), F.col("n_pad")))
    )


# X5 -------------------------------------------------------------------------
PPO_REQUIRED = ("state", "action", "adv_norm", "ret", "old_lp")


def ppo_samples(steps: DataFrame, ep: Sequence[str], order: str = "step", gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """PPO sample table: own view (T8) + next values (V2) + GAE (V1) + normalised advantage.

    ``steps`` carries ``value`` (critic value of the state) and ``lp`` (logged log-prob).
    """
    s = T.with_last(steps, ep, "value", "final_value", order)
    own = T.own_view(s, ep, order, extra=["value", "final_value", "lp"])
    own = VE.next_values(own, ep, order, "value", "final_value")
    # written once: the normalisation reads it twice
    g = write_table(VE.gae(own, ep, order, gamma=gamma, lam=lam), "gae")
    g = A.normalise(g, "adv", "adv_norm")
    return g.select(*ep, order, "state", "action", "adv_norm", "ret", F.col("lp").alias("old_lp"))


def not_null_audit(df: DataFrame, cols: Sequence[str] = PPO_REQUIRED) -> DataFrame:
    """Null counts per required column (all must be 0)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols], F.count(F.lit(1)).alias("n"))


def epoch_batches(df: DataFrame, keys: Sequence[str], size: int, seed: int | str = 42) -> DataFrame:
    """One-worker epoch plan without dropping the short last batch (batch id per row)."""
    return D.epoch_plan(df, keys, workers=1, size=size, seed=seed, drop_last=False).withColumnRenamed("minibatch", "batch")
