"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings: two hashes of the word and one of
each of its beginnings. Filters of several widths run over a text's words, each is
max-pooled over the whole text, and a logistic layer scores the pooled values. The
model is fitted on a bounded sample of labelled rows; scores and the thresholds by
language cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, blocks, byte_class, remainder

#: bounds of the sample that the classifier is fitted on: rows of a label, bytes of their texts
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 24 << 20
#: rows with remainder 0 of crc32(doc_id) by this are held out
FOLDS = 5
DIM, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
BUCKETS = 1 << 16
#: word beginnings, bytes
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE = 6, 32, 0.05
#: small samples get more epochs, up to about so many steps
STEPS = 800
#: bins of the score histogram that thresholds are read from
BINS = 200
#: a language needs so many toxic rows for a threshold of its own
MIN_TOXIC = 20
#: words: runs of letters, digits and non-ASCII characters
WORD = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words x 4) and the first word of each text."""
    w = Words(texts, WORD, lower=True, hashes=False)
    size = np.uint64(BUCKETS)
    word, *begin = w.hashes(None, *PREFIXES)
    cols = [word % size, (word >> np.uint64(32)) % size + size]
    cols += [h % size + np.uint64(2 + k) * size for k, h in enumerate(begin)]
    return np.stack(cols, axis=1).astype(np.int32).reshape(len(w), -1), w.first


@dataclass
class Model:
    embed: np.ndarray  # (2 + prefixes) * BUCKETS x DIM
    filters: list[np.ndarray]  # per width: width * DIM x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: float

    def pooled(self, rows: np.ndarray, first: np.ndarray, arg: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max over each text of every filter (0 where a text is too short), and where it was reached."""
        docs = len(first) - 1
        pool = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(pool.shape, -1, np.int64) if arg else None
        if not len(rows):
            return pool, where
        x = self.embed[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x += self.embed[rows[:, k]]
        for j, width in enumerate(WIDTHS):
            n = len(x) - width + 1
            last = first[1:] - width + 1
            has = np.flatnonzero(last > first[:-1])
            if n <= 0 or not len(has):
                continue
            f = self.filters[j]
            y = x[:n] @ f[:DIM]
            for k in range(1, width):
                y += x[k : k + n] @ f[k * DIM : (k + 1) * DIM]
            # bounds (start, stop) of each text's windows; the reduction skips what lies between
            cut = np.stack([first[:-1][has], last[has]], axis=1).ravel()
            open_end = cut[-1] >= n
            best = np.maximum.reduceat(y, cut[:-1] if open_end else cut, axis=0)[0::2]
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            pool[has, cols] = np.maximum(best + self.bias[j], 0)
            if arg:
                for d, a, b in zip(has.tolist(), cut[0::2].tolist(), cut[1::2].tolist()):
                    where[d, cols] = a + y[a:b].argmax(axis=0)
        return pool, where

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first)[0] @ self.dense + self.offset

    def gradients(self, rows: np.ndarray, first: np.ndarray, toxic: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted sum of log losses: by filters and their biases, the embedding rows
        concerned and theirs, by the dense layer and its offset."""
        pool, where = self.pooled(rows, first, arg=True)
        p = 1 / (1 + np.exp(-np.clip(pool @ self.dense + self.offset, -30, 30)))
        g = (p - toxic) * weight
        g_pool = g[:, None] * self.dense * (pool > 0)
        g_filters, g_biases = [np.zeros_like(f) for f in self.filters], [np.zeros_like(b) for b in self.bias]
        touched, grads = [], []
        for j, width in enumerate(WIDTHS):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            d, f = np.nonzero((g_pool[:, cols] != 0) & (where[:, cols] >= 0))
            if not len(d):
                continue
            up, at = g_pool[d, j * FILTERS + f], where[d, j * FILTERS + f]
            np.add.at(g_biases[j], f, up)
            for s in range(width):
                near = rows[at + s]
                part = np.zeros((FILTERS, DIM), g_filters[j].dtype)
                np.add.at(part, f, up[:, None] * self.embed[near].sum(axis=1))
                g_filters[j][s * DIM : (s + 1) * DIM] += part.T
                touched.append(near.ravel())
                grads.append(np.repeat(up[:, None] * self.filters[j][s * DIM : (s + 1) * DIM].T[f], near.shape[1], axis=0))
        at, inverse = np.unique(np.concatenate(touched), return_inverse=True) if touched else (np.zeros(0, np.int64), None)
        total = np.zeros((len(at), DIM), self.embed.dtype)
        if touched:
            np.add.at(total, inverse, np.concatenate(grads))
        return g_filters, g_biases, at, total, pool.T @ g, float(g.sum())

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.logits(*features(texts)).astype(np.float64), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Minimise the weighted log loss by Adagrad; the gradient of a max-pooled filter reaches one window of a text."""
    rng = np.random.default_rng(seed)
    rate_of = lambda g: np.sqrt(g) + 1e-6
    init = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    m = Model(init((2 + len(PREFIXES)) * BUCKETS, DIM), [init(w * DIM, FILTERS) * 3 for w in WIDTHS], [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS], init(len(WIDTHS) * FILTERS), 0.0)
    past = {"e": np.full(len(m.embed), 1e-4, np.float32), "d": np.full_like(m.dense, 1e-4), "o": 1e-4, "f": [np.full_like(f, 1e-4) for f in m.filters], "b": [np.full_like(b, 1e-4) for b in m.bias]}
    data = [features([t])[0] for t in texts]
    toxic, weight = toxic.astype(np.float32), weight.astype(np.float32)
    epochs = max(EPOCHS, STEPS * BATCH // max(1, len(data)) if data else 0)
    for epoch in range(epochs):
        rate = RATE / (1 + EPOCHS * epoch / epochs)
        order = rng.permutation(len(data))
        for k in range(0, len(order), BATCH):
            ids = order[k : k + BATCH]
            lens = np.array([len(data[i]) for i in ids])
            first = np.r_[0, np.cumsum(lens)]
            rows = np.concatenate([data[i] for i in ids])
            g_filters, g_biases, at, total, g_dense, g_offset = m.gradients(rows, first, toxic[ids], weight[ids] / len(ids))
            for j in range(len(WIDTHS)):
                past["f"][j] += g_filters[j] ** 2
                past["b"][j] += g_biases[j] ** 2
                m.filters[j] -= rate * g_filters[j] / rate_of(past["f"][j])
                m.bias[j] -= rate * g_biases[j] / rate_of(past["b"][j])
            if len(at):
                past["e"][at] += (total**2).mean(axis=1)
                m.embed[at] -= rate * total / rate_of(past["e"][at])[:, None]
            past["d"] += g_dense**2
            past["o"] += g_offset**2
            m.dense -= rate * g_dense / rate_of(past["d"])
            m.offset -= rate * g_offset / float(rate_of(past["o"]))
    return m


def known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic, one row per labelled id (1 if any of its rows says so; null labels don't count)."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Of each label, rows are taken by a hash of doc_id, as many as SAMPLE_ROWS and
    SAMPLE_BYTES allow (whole texts); weights restore the labels' shares. Ids and
    lengths decide, so texts of other rows are never moved. Rows that repeat an id count
    as one, by their longest text (the first by code points of equally long ones).
    """
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.col("text").cast("string")).alias("size"))
    lengths = lengths.groupBy("doc_id").agg(F.max("size").alias("size"))
    rows = lengths.join(known(labels), "doc_id").filter(remainder(FOLDS) != 0)
    totals = {r["toxic"]: (r["n"], r["size"] or 0) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    share = {y: min(1.0, SAMPLE_ROWS / n, SAMPLE_BYTES / max(1, size)) for y, (n, size) in totals.items()}
    scale = 1 << 20
    part = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    wanted = F.lit(False)
    for y, s in share.items():
        wanted = wanted | ((F.col("toxic") == y) & (part < round(s * scale)))
    ids = rows.filter(wanted).select("doc_id", "toxic").distinct()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = chosen.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(-F.coalesce(F.octet_length("text"), F.lit(0)), "text")).alias("t"))
    got = sorted((r["doc_id"], r["toxic"], r["t"]["text"] or "") for r in one.collect())
    toxic = np.array([y for _, y, _ in got], np.int64)
    weight = np.array([1 / share[y] for _, y, _ in got], np.float64)
    return fit([t.encode("utf-8", "surrogatepass") for _, _, t in got], toxic, weight / weight.mean() if len(got) else weight)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The rows with the score of their whole ``text`` in a further column; null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts))], [*part.schema.names, column])

    return docs.mapInArrow(run, docs.limit(0).withColumn(column, F.lit(0.0)).schema)


def thresholds(scores: DataFrame, labels: DataFrame, score: str = "score", lang: str = "lang") -> tuple[DataFrame, Column]:
    """Threshold by language with the best F1 over all labelled rows not held out, and the one for other languages.

    Scores are counted in BINS bins; of equally good bins the middle is taken. The
    languages returned have MIN_TOXIC toxic rows at least.
    """
    rows = scores.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    rows = rows.join(known(labels), "doc_id").filter(remainder(FOLDS) != 0)
    counts = rows.groupBy("lang", "bin").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))

    def best(table: DataFrame, keys: list[str]) -> DataFrame:
        bins = table.groupBy(*keys).agg(F.collect_list(F.struct("bin", "bad", "n")).alias("bins"), F.sum("bad").alias("bad"))
        at = F.sequence(F.lit(0), F.lit(BINS - 1))
        caught = lambda b, c: F.aggregate("bins", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bin"] >= b, x[c]).otherwise(0))
        f1 = F.transform(at, lambda b: F.struct((2.0 * caught(b, "bad") / (caught(b, "n") + F.col("bad"))).alias("f1"), b.alias("bin")))
        top = bins.withColumn("f1", F.filter(f1, lambda x: x["f1"].isNotNull())).withColumn("top", F.array_max("f1")["f1"])
        good = F.transform(F.filter("f1", lambda x: x["f1"] == F.col("top")), lambda x: x["bin"])
        return top.select(*keys, "bad", ((F.array_min(good) + F.array_max(good)) / (2.0 * BINS)).alias("threshold"))

    whole = counts.groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    row = best(whole, []).filter(F.col("bad") >= MIN_TOXIC).first()
    other = F.lit(row["threshold"] if row else 0.5)
    return best(counts, ["lang"]).filter(F.col("bad") >= MIN_TOXIC).select("lang", "threshold"), other


def judged(scores: DataFrame, labels: DataFrame, score: str = "score", lang: str = "lang", threshold: str = "threshold") -> DataFrame:
    """The rows of ``scores`` with their language's threshold in a further column."""
    own, other = thresholds(scores, labels, score, lang)
    own = own.select(F.col("lang").alias("lang_"), F.col("threshold").alias("own_"))
    # sent to every task only when it is small; there is a row per language with enough labels
    own = F.broadcast(own) if own.count() <= 10_000 else own
    return scores.join(own, F.col(lang).eqNullSafe(F.col("lang_")), "left").withColumn(threshold, F.coalesce("own_", other)).drop("own_", "lang_")


def classify(docs: DataFrame, labels: DataFrame, save) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold and rejected of every row.

    ``rejected`` goes by the language's threshold; a score sees the text only. Rows stay
    one to one, repeated rows and null ids included; null counts as empty. Without
    usable labels the scores are those of the model as it starts and thresholds are 0.5.
    Further columns are not carried.
    """
    model = train(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").cast("string").alias("text"))
    scores = save(scored(texts, model).select("doc_id", "lang", "score"))
    rows = judged(scores, labels)
    return rows.select("doc_id", (remainder(FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


def keep_clean(docs: DataFrame, labels: DataFrame, save) -> DataFrame:
    """The documents, all columns kept, without those that their language's threshold rejects."""
    # every column travels under a name of its own, so that no extra column can clash
    names = docs.columns
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest")
    )
    rows = save(scored(own, train(docs, labels)))
    clean = judged(rows, labels).filter(F.col("score") < F.col("threshold"))
    return clean.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names])
