import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import toxicity
from trajspark.session import write_table

from llm_helpers import same


@pytest.fixture(scope="module")
def planted(spark):
    """Texts of invented words; toxic ones hold a word of a bad stem, in other forms in the held-out rows."""
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ten", "sor") for b in ("ra", "pel", "dun", "vi", "shom", "tik", "ula")]
    rows = []
    for i in range(900):
        toxic = int(i % 4 == 0)
        words = rng.choice(vocab, int(rng.integers(5, 120))).tolist()
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), "zwurk" + str(rng.choice(["ed", "ing", "er", "x", str(i)])))
        rows.append((i, " ".join(words), "en" if i % 3 else "de", toxic))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 10], "doc_id long, toxic int")
    return docs, labels, {r[0]: r[3] for r in rows}


def test_held_out_accuracy(planted):
    docs, labels, truth = planted
    got = toxicity.classify(docs, labels, write_table).collect()
    assert len(got) == 900
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert np.mean([r["rejected"] == bool(truth[r["doc_id"]]) for r in held]) > 0.95


def test_scores_see_the_text_only(spark, planted):
    docs, labels, _ = planted
    one = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, write_table).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.classify(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("x")), labels, write_table).collect()}
    assert one == two


def test_keep_clean_keeps_rows_whole(planted):
    docs, labels, truth = planted
    docs = docs.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    kept = toxicity.keep_clean(docs, labels, write_table)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in ids) != bool(y) for i, y in truth.items()]) > 0.95


@pytest.mark.parametrize("labels", [[], [(4, 1), (5, 0), (5, 0), (None, 1), (8, None), (100, 0), (101, 1)]])
def test_odd_rows_and_few_labels(spark, odd, empty, labels):
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(odd, labels, write_table).collect()
    same([(r["doc_id"],) for r in got], [(r["doc_id"],) for r in odd.select("doc_id").collect()])
    assert all(0 <= r["score"] <= 1 and r["threshold"] is not None for r in got)
    assert toxicity.classify(empty, labels, write_table).collect() == []


def test_thresholds_take_the_best_f1(spark):
    rows = [(i, "en", 0.9 if i % 2 else 0.3) for i in range(400)] + [(1000 + i, "de", 0.3 if i % 2 else 0.1) for i in range(400)]
    scores = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows], "doc_id long, toxic int")
    own, _ = toxicity.thresholds(scores, labels)
    got = {r["lang"]: r["threshold"] for r in own.collect()}
    assert 0.3 < got["en"] <= 0.9 and 0.1 < got["de"] <= 0.3


def test_gradients_equal_differences():
    """Every kind of weight, in double precision, against the change of the loss."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (9, 1, 2, 30, 0, 5)]
    toxic, weight = np.array([1.0, 0, 1, 0, 1, 0]), np.array([1.0, 2, 0.5, 1, 1, 3])
    d, f = toxicity.DIM, toxicity.FILTERS
    m = toxicity.Model(
        rng.normal(0, 0.3, ((2 + len(toxicity.PREFIXES)) * toxicity.BUCKETS, d)), [rng.normal(0, 0.5, (w * d, f)) for w in toxicity.WIDTHS],
        [rng.normal(0, 0.1, f) for _ in toxicity.WIDTHS], rng.normal(0, 0.5, len(toxicity.WIDTHS) * f), 0.1,
    )
    pooled = m.pooled
    rows, first = toxicity.features(texts)

    def exact(rows, first, arg=False):
        """The pooled values in double precision, text by text."""
        pool, where = np.zeros((len(first) - 1, len(toxicity.WIDTHS) * f)), np.full((len(first) - 1, len(toxicity.WIDTHS) * f), -1, np.int64)
        x = m.embed[rows].sum(axis=1)
        for t, (a, b) in enumerate(zip(first, first[1:])):
            for j, w in enumerate(toxicity.WIDTHS):
                if b - a >= w:
                    y = np.stack([np.concatenate(x[k : k + w]) @ m.filters[j] for k in range(a, b - w + 1)])
                    pool[t, j * f : (j + 1) * f] = np.maximum(y.max(axis=0) + m.bias[j], 0)
                    where[t, j * f : (j + 1) * f] = a + y.argmax(axis=0)
        return pool, where

    got, at = pooled(rows, first, arg=True)
    assert np.allclose(got, exact(rows, first)[0], atol=1e-5) and (at == exact(rows, first)[1]).all()
    m.pooled = exact

    def loss():
        z = exact(rows, first)[0] @ m.dense + m.offset
        return float((weight * (np.log1p(np.exp(z)) - toxic * z)).sum())

    g_filters, g_biases, at, total, g_dense, g_offset = m.gradients(rows, first, toxic, weight)
    checks = [(m.dense, (3,), g_dense[3]), (m.dense, (20,), g_dense[20])]
    checks += [(m.filters[j], (k, 4), g_filters[j][k, 4]) for j in range(len(toxicity.WIDTHS)) for k in (0, d * toxicity.WIDTHS[j] - 1)]
    checks += [(m.bias[j], (2,), g_biases[j][2]) for j in range(len(toxicity.WIDTHS))]
    checks += [(m.embed, (int(at[k]), 5), total[k, 5]) for k in range(0, len(at), 5)]
    for array, place, gradient in checks:
        old, step = array[place], 1e-6
        array[place] = old + step
        up = loss()
        array[place] = old - step
        down = loss()
        array[place] = old
        assert abs((up - down) / (2 * step) - gradient) < 1e-4 * max(1, abs(gradient))
    m.offset += 1e-6
    up = loss()
    m.offset -= 2e-6
    assert abs((up - loss()) / 2e-6 - g_offset) < 1e-4


def test_extra_columns_come_back_unchanged(planted):
    docs, labels, truth = planted
    extra = {c: F.concat(F.lit(c), F.col("doc_id")) for c in ("lang_", "own_", "threshold_", "toxicity_", "score", "threshold", "rest", "bin", "toxic")}
    docs = docs.withColumns(extra)
    kept = toxicity.keep_clean(docs, labels, write_table)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) > 600 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra)
    assert kept.exceptAll(docs).count() == 0


def test_an_id_with_very_many_rows_is_sampled_once(spark, planted, monkeypatch):
    docs, labels, _ = planted
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, weight: seen.append((texts, toxic, weight)))
    toxicity.train(docs, labels)
    many = docs.unionByName(docs.filter("doc_id = 1").withColumn("text", F.lit("x")).crossJoin(spark.range(3000)).drop("id"))
    toxicity.train(many, labels)
    (one, toxic1, weight1), (two, toxic2, weight2) = seen
    assert one == two and (toxic1 == toxic2).all() and np.allclose(weight1, weight2)
