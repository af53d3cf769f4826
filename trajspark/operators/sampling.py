"""Deduplication, seeded sampling, splitting and batching.

Seeded order is ``md5(seed|key), key`` (see ``functions.keys``), so every
sample is retry-stable and reproducible by SQL. The dense index (D9) is
built without a single-partition window: a distributed sort, a reliable
checkpoint, per-partition counts (one row per partition) and offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.keys import seeded_key, seeded_order
from trajspark.session import cut_lineage

#: a sample's cutoff is refined until the rows that tie on the cutoff prefix are so few that one sort ends it
EXACT_ROWS = 10_000
#: hex digits of the md5 by which one pass counts (16**4 rows reach the driver)
COUNT_DIGITS = 4


def _null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


# D1 -------------------------------------------------------------------------
def distinct_states(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key rows with their multiplicity (partial aggregation before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))


def distinct_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Before/after counts of D1 as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_before"), F.count_distinct(F.struct(*keys)).alias("n_after"))


# D2 -------------------------------------------------------------------------
def distinct_variations(df: DataFrame, arr: str) -> DataFrame:
    """Distinct elements inside an array of structs (the structs must hold no MAP)."""
    return df.withColumn(arr, F.array_distinct(F.col(arr)))


# D3 -------------------------------------------------------------------------
def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the earlier output (null-safe anti join)."""
    d = done.select(*keys).distinct()
    return df.join(d, _null_safe_on(df, d, keys), "left_anti")


# D9 -------------------------------------------------------------------------
def with_index(df: DataFrame, order: Sequence[Column], name: str = "idx") -> tuple[DataFrame, int]:
    """Dense 0-based index in the given total order, and the row count.

    Distributed sort → reliable checkpoint (fixes partition contents across
    retries) → count per partition (≤ number of partitions rows reach the
    driver) → index = partition offset + position inside the partition.
    """
    ck = cut_lineage(df.orderBy(*order))
    pid = F.spark_partition_id()
    counts = dict(ck.groupBy(pid.alias("p")).count().collect())
    n_parts = ck.rdd.getNumPartitions()
    offsets, acc = [], 0
    for p in range(n_parts):
        offsets.append(acc)
        acc += counts.get(p, 0)
    local = F.monotonically_increasing_id() - pid.cast("long") * F.lit(1 << 33)
    # a row per partition, sent to every task
    starts = df.sparkSession.createDataFrame(list(enumerate(offsets)) or [(0, 0)], "_p int, _start long")
    t = ck.withColumn("_local", local).withColumn("_p", pid).join(F.broadcast(starts), "_p")
    return t.withColumn(name, F.col("_start") + F.col("_local")).select(*ck.columns, name), acc


# D4 / D5 ----------------------------------------------------------------------
def _first_by_md5(df: DataFrame, keys: Sequence[str], wanted, seed: int | str) -> DataFrame:
    """The first n rows in seeded md5 order, n = ``wanted(row count)``.

    Rows are counted by md5 prefix (partial aggregation); the prefix in which the n-th
    row falls is counted again by its next digits until few rows share it. All rows below
    the prefix are kept by a filter, and the rest is cut from the few that share it. So
    no task sorts or gathers a sample, whatever its size.
    """
    h = df.withColumn("_h", seeded_key(seed, keys))
    prefix, below, n = "", 0, None
    while True:
        d = len(prefix)
        inside = h.where(F.substring("_h", 1, d) == prefix) if d else h
        counts = sorted((r["p"], r["c"]) for r in inside.groupBy(F.substring("_h", d + 1, COUNT_DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
        if n is None:
            n = wanted(sum(c for _, c in counts))
        size = 0
        for p, size in counts:  # at most 16**COUNT_DIGITS
            if below + size > n:
                prefix += p
                break
            below += size
        else:
            return df  # n is the row count
        if size <= EXACT_ROWS or len(prefix) >= 32:
            break
    head = F.substring("_h", 1, len(prefix))
    rest = h.where(head == prefix).orderBy("_h", *keys).limit(n - below)
    return h.where(head < prefix).unionByName(rest).drop("_h")


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """Seeded sample of exactly n rows without replacement; n above the count is an error."""

    def wanted(total: int) -> int:
        if n > total:
            raise ValueError(f"sample of {n} requested from {total} rows")
        return n

    return _first_by_md5(df, keys, wanted, seed)


def sample_ratio(df: DataFrame, keys: Sequence[str], ratio: float, seed: int | str = 42) -> DataFrame:
    """Seeded sample of floor(ratio · N) rows; the row count comes from the same counting pass."""
    return _first_by_md5(df, keys, lambda total: int(ratio * total), seed)


# D6 -------------------------------------------------------------------------
def holdout(df: DataFrame, keys: Sequence[str], n: int, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Held-out split: n seeded test rows; train is the rest by key (no leakage)."""
    test = sample_n(df, keys, n, seed)
    train = not_done(df, test, keys)
    return train, test


def leakage_report(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: sizes and the overlap of train and test keys (must be 0)."""
    tk, sk = train.select(*keys), test.select(*keys)
    return train.agg(F.count(F.lit(1)).alias("n_train")).select(
        "n_train",
        test.agg(F.count(F.lit(1))).scalar().alias("n_test"),
        tk.intersect(sk).agg(F.count(F.lit(1))).scalar().alias("n_overlap"),
    )


# D7 -------------------------------------------------------------------------
def grow_frontier(old: DataFrame, seen: DataFrame, keys: Sequence[str], terminal: str = "is_terminal") -> DataFrame:
    """old ∪ newly seen states, non-terminal only, distinct."""
    cols = [*keys, terminal]
    return old.select(*cols).unionByName(seen.select(*cols)).where(~F.col(terminal)).distinct()


# D8 -------------------------------------------------------------------------
def shuffle(df: DataFrame, keys: Sequence[str], seed: int | str = 42, partitions: int | None = None) -> DataFrame:
    """Seeded global shuffle: range-partition on the md5 key, sort inside partitions."""
    h = seeded_key(seed, keys)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_h", h).repartitionByRange(n, "_h").sortWithinPartitions("_h", *keys).drop("_h")


# D10 ------------------------------------------------------------------------
def replicate(df: DataFrame, n: int, name: str = "replica") -> DataFrame:
    """Each row n times with a replica id (a generator, no join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


# D11 ------------------------------------------------------------------------
#: md5 digits that deal a key's rows to buckets: a key of n rows is ranked by tasks of n / 16**digits rows
SALT_DIGITS = 3


def seeded_rank(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int | str, name: str, digits: int = SALT_DIGITS
) -> DataFrame:
    """0-based rank of each row among the rows of its keys, in seeded md5 order of the ids.

    The md5 prefix, which is the leading sort key, splits every key into buckets; each
    bucket is ranked on its own and the buckets' counts supply the offsets. So no task
    holds a key. Null keys are keys like any other.
    """
    t = df.withColumn("_h", seeded_key(seed, ids)).withColumn("_salt", F.substring("_h", 1, digits))
    w = Window.partitionBy(*keys, "_salt").orderBy("_h", *ids)
    t = t.withColumn("_local", F.row_number().over(w) - 1)
    sizes = t.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_m"))
    wo = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_m").over(wo), F.lit(0))).select(
        *[F.col(k).alias(f"_o_{k}") for k in [*keys, "_salt"]], "_off"
    )
    cond = F.lit(True)
    for k in [*keys, "_salt"]:
        cond = cond & t[k].eqNullSafe(offs[f"_o_{k}"])
    t = t.join(offs, cond, "inner").withColumn(name, F.col("_off") + F.col("_local"))
    return t.drop("_h", "_salt", "_local", "_off", *[f"_o_{k}" for k in [*keys, "_salt"]])


def chunk(df: DataFrame, keys: Sequence[str], ids: Sequence[str], n: int, seed: int | str = 42, salt_digits: int = SALT_DIGITS) -> DataFrame:
    """Per-key shuffled chunks of at most n rows; the short last chunk is kept.

    Rows of a key are ranked in seeded md5 order of their ids; chunk = rank div n. The
    number of digits changes the plan only, not the rows.
    """
    t = seeded_rank(df, keys, ids, seed, "_rank", salt_digits)
    t = t.withColumn("chunk", (F.col("_rank") / n).cast("long")).withColumn("pos", (F.col("_rank") % n).cast("long"))
    return t.drop("_rank")


# D12 ------------------------------------------------------------------------
def batches(df: DataFrame, keys: Sequence[str], size: int, wrap: bool = True) -> DataFrame:
    """Global batches of ``size`` in key order; the last batch is filled by
    wrapping to the start (rows marked ``is_pad``); side alternates per batch."""
    idx, total = with_index(df, [F.col(k) for k in keys], "idx")
    out = idx.withColumn("batch", (F.col("idx") / size).cast("long")).withColumn("is_pad", F.lit(False))
    pad = (size - total % size) % size if wrap and total else 0
    if pad:
        last = (total - 1) // size
        # pad row j repeats row j modulo the row count: fewer than ``size`` rows
        times = F.floor((F.lit(pad - 1) - F.col("idx")) / total) + 1
        extra = (
            idx.where(F.col("idx") < pad)
            .withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), times)))
            .drop("_again")
            .withColumn("batch", F.lit(last).cast("long"))
            .withColumn("is_pad", F.lit(True))
        )
        out = out.unionByName(extra)
    return out.withColumn("side_first", (F.col("batch") % 2) == 0)


# D13 ------------------------------------------------------------------------
def epoch_plan(
    df: DataFrame, keys: Sequence[str], workers: int, size: int, seed: int | str = 42, drop_last: bool = True
) -> DataFrame:
    """Epoch plan: seeded shuffle, deal round-robin to W workers, minibatches of
    ``size`` per worker, drop each worker's short last minibatch (arithmetic, no extra shuffle)."""
    idx, total = with_index(df, seeded_order(seed, keys), "idx")
    w = F.col("idx") % workers
    out = idx.withColumn("worker", w.cast("int")).withColumn(
        "minibatch", (F.floor(F.col("idx") / workers) / size).cast("long")
    )
    if drop_last:
        # rows dealt to worker w: floor((N - w - 1) / W) + 1; full minibatches: that div size
        n_w = F.floor((F.lit(total) - F.col("worker") - 1) / workers) + 1
        out = out.where(F.col("minibatch") < F.floor(n_w / size))
    return out
