"""Subword vocabularies (T11, X3): ids, atomic special tokens and label masks against the tokenizer library."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF001
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajspark.functions import text as text_module
from trajspark.functions.text import register_subwords, token_id_count, token_ids
from trajspark.operators import examples as X
from trajspark.operators import steps as T
from trajspark.plans.catalog import QUERIES, _rendered

MARKS = ["<|eot_id|>", "<|begin|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_special_tokens_are_atomic_and_have_ids_after_the_vocabulary(spark, library):
    register_subwords(spark, "t", public_tokenizers.path("byte_bpe_50k.json"), MARKS)
    texts = ["a b<|eot_id|>c", "<|begin|><|begin|>", "", None, "é中 \U0001f600 <|eot", "plain words here"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").repartition(3)
    got = {r["i"]: list(r["x"]) for r in df.select("i", token_ids(F.col("text"), "t").alias("x")).collect()}
    size = library.get_vocab_size()
    assert got[0] == [*ids(library, "a b"), size, *ids(library, "c")] and got[1] == [size + 1] * 2
    for i in (2, 3, 4, 5):
        assert got[i] == ids(library, texts[i])


def test_labels_cover_the_answer_only(spark, library):
    register_subwords(spark, "t", public_tokenizers.path("byte_bpe_50k.json"), MARKS)
    query, answer = "what is it? <|eot_id|>", "an answer of words<|eot_id|>"
    df = spark.createDataFrame([(1, query, query + answer), (2, query * 5, query * 5 + answer), (3, None, None)], "k int, query_text string, full_text string")
    rows = {r["k"]: r for r in X.label_id_masks(df, 24, "t").collect()}
    n = len(ids(library, "what is it? ")) + 1
    want = ids(library, "an answer of words") + [library.get_vocab_size()]
    assert rows[1]["n_prompt"] == n and rows[1]["labels"] == [-100] * n + want and rows[1]["kept"]
    assert rows[2]["n_tokens"] == 24 and rows[2]["n_label"] == 0 and not rows[2]["kept"] and set(rows[2]["labels"]) == {-100}
    assert rows[3]["input_ids"] == [] and not rows[3]["kept"]


def test_token_rows_of_ids(spark, library):
    register_subwords(spark, "t", public_tokenizers.path("byte_bpe_50k.json"), MARKS)
    df = spark.createDataFrame([(1, "unbelievable words", 2.5), (2, "", 1.0)], "k int, text string, r double")
    got = [(r["tok_idx"], r["token"], r["reward"]) for r in T.token_rows(df, ["k"], reward=F.col("r"), vocabulary="t").orderBy("tok_idx").collect()]
    want = ids(library, "unbelievable words")
    assert got == [(i, x, 2.5 if i == len(want) - 1 else 0.0) for i, x in enumerate(want)]


class _Recorder:
    """A vocabulary that notes the characters it was given at once."""

    def __init__(self, made):
        self.made, self.sizes = made, []

    def encode_batch(self, texts, add_special_tokens):
        self.sizes.append(sum(map(len, texts)))
        return self.made.encode_batch(texts, add_special_tokens=add_special_tokens)


def test_few_texts_are_encoded_at_once(library, monkeypatch):
    """Many texts, and a long one in parts at words' ends: no call sees more than a bounded piece, and the ids are those of the whole."""
    recorder = _Recorder(library)
    monkeypatch.setattr(text_module, "_subwords", lambda file, special: (recorder, True))
    monkeypatch.setattr(text_module, "ENCODE_BYTES", 500)
    texts = [None, "", "a word  and\n\n more, it's 12 \u4e2d\u3002 ", *["some words of a turn "] * 200, "long text, that isn't cut  inside\tof words 1.5 " * 100, "x" * 900, None]
    got = [[i for part in x for i in part.tolist()] for x in text_module._encoded(pa.array(texts, pa.string()), "f", ())]
    assert got == [ids(library, x) for x in texts]
    assert max(recorder.sizes) <= 900 and sorted(recorder.sizes)[-2] <= 520


def test_long_text_gives_the_rows_of_the_whole(spark, library):
    """A text of many pieces becomes the token rows of the whole text; its ids are counted without being handed out."""
    register_subwords(spark, "t", public_tokenizers.path("byte_bpe_50k.json"), MARKS)
    text = "several words, it's  12 of them.\n\n" * (3 * text_module.ENCODE_BYTES // 34)
    df = spark.createDataFrame([(1, text, 1.0), (2, None, 1.0)], "k int, text string, r double")
    want = ids(library, text)
    assert [r["n"] for r in df.orderBy("k").select(token_id_count(F.col("text"), "t").alias("n")).collect()] == [len(want), 0]
    got = T.token_rows(df, ["k"], reward=F.col("r"), vocabulary="t").agg(F.count("*"), F.sum("reward"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"].cast("string")), ","))).first()
    assert tuple(got) == (len(want), 1.0, hashlib.md5(",".join(map(str, want)).encode()).hexdigest())


def test_token_rows_encode_each_text_once(spark):
    """One Python step in the plan, with no second one for a filter below; texts without ids still give no rows."""
    register_subwords(spark, "t", public_tokenizers.path("byte_bpe_50k.json"), MARKS)
    texts = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "k int, text string")
    rows = T.token_rows(texts, ["k"], reward=F.lit(1.0), vocabulary="t")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["k"] for r in rows.collect()} == {1}


def test_registered_queries_equal_the_library(spark, library):
    marks = sorted({"<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"} & {m for t in X.LLAMA3.values() for m in ["<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"] if m in t})
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.no_truncation()
    full.add_special_tokens(marks)
    rendered = {r["conv_id"]: r for r in _rendered(spark, SF001).collect()}
    digest = lambda x: hashlib.md5(",".join(map(str, x)).encode()).hexdigest()
    rows = QUERIES["x3_subword_masks"](spark, SF001).collect()
    assert len(rows) == len(rendered)
    for r in rows:
        all_ids, n = ids(full, rendered[r["conv_id"]]["full_text"])[: X.MAX_TOKENS], len(ids(full, rendered[r["conv_id"]]["query_text"]))
        assert (r["n_tokens"], r["n_prompt"], r["ids_md5"]) == (len(all_ids), n, digest(all_ids))
        assert r["labels_md5"] == digest([-100 if i < n else x for i, x in enumerate(all_ids)])
    turns = spark.read.parquet(f"{SF001}/conversations.parquet").select("text").collect()
    assert QUERIES["t11_subword_rows"](spark, SF001).count() == sum(len(ids(full, r["text"])) for r in turns)
