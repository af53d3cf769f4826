"""Batch inference with a pluggable scorer (P8) and response attachment.

A scorer is a named callable ``list[str] -> list[str]`` (one model load per
Python worker, bounded Arrow batches). Its output is frozen before use
(Parquet in the shared checkpoint folder, or a reliable checkpoint): a
recomputed lineage would sample different text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.session import cut_lineage, new_folder

Scorer = Callable[[list[str]], list[str]]
_SCORERS: dict[str, Callable[[], Scorer]] = {}


def register_scorer(name: str):
    """Register a scorer factory; the factory runs once per Python worker (model load)."""

    def deco(factory: Callable[[], Scorer]):
        _SCORERS[name] = factory
        return factory

    return deco


@register_scorer("len_value")
def _len_value() -> Scorer:
    """Deterministic test scorer: 'value <len(prompt) mod 7 − 3>'."""
    return lambda prompts: [f"value {len(p) % 7 - 3}" for p in prompts]


@register_scorer("best_move")
def _best_move() -> Scorer:
    """Deterministic test scorer answering '{"best_move": d}' with d = len mod 9 + 1."""
    return lambda prompts: ['{"best_move": ' + str(len(p) % 9 + 1) + "}" for p in prompts]


def infer(
    prompts: DataFrame,
    scorer: str,
    id_cols: list[str],
    text: str = "user",
    batch: int = 512,
    path: str | None = None,
) -> DataFrame:
    """Run the scorer over the prompt table; result (ids…, response) is frozen before return.

    The scorer sees at most ``batch`` prompts at a time; the session's settings stay as they are.
    """
    spark = prompts.sparkSession
    factory = _SCORERS[scorer]
    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.select(*id_cols).dtypes) + ", response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()  # one model load per task
        for pdf in batches:
            out = pdf[id_cols].copy()
            texts = pdf[text].fillna("").tolist()
            out["response"] = [r for k in range(0, len(texts), batch) for r in fn(texts[k : k + batch])]
            yield out

    res = prompts.select(*id_cols, text).mapInPandas(run, schema)
    if path is None:
        return cut_lineage(res)
    if path == "auto":
        path = new_folder(spark, "infer")
    res.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def attach_response(prompts: DataFrame, responses: DataFrame, id_cols: list[str]) -> DataFrame:
    """Append the assistant message to ``messages`` by prompt id."""
    j = prompts.join(responses, id_cols, "left")
    msg = F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"))
    return j.withColumn(
        "messages", F.when(F.col("response").isNull(), F.col("messages")).otherwise(F.concat("messages", F.array(msg)))
    )


# P9 -------------------------------------------------------------------------
def attach_eval(look: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Fill ``final_state.eval`` of the targeted variations; other rows stay untouched."""
    r = responses.select(*keys, F.col("response").alias("_resp"))
    j = look.join(r, keys, "left")
    fs = F.col("final_state")
    return j.withColumn("final_state", fs.withField("eval", F.coalesce(F.col("_resp"), fs["eval"]))).drop("_resp")
