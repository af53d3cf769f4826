"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gives floor(r) certain copies of every
document. What is left of the target is sampled: documents are put in strata of
nearly equal size inside their source, each stratum has an inclusion probability p
and a fixed sample size, and the documents with the least Pareto rank
(u / (1 - u)) / (p / (1 - p)) are taken, u being a uniform number from the document's key.

Strata are settled from the longest documents to the shortest. What one stratum takes too much or
too little changes the p of the next, so a source's words end within about one of its
shortest documents of the target. Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import with_index

#: fixed value: a word
WORD = r"[^\x20\x09-\x0D]+"
#: equal parts of (0, 1) by which a stratum's uniform numbers are counted; only the part that holds the cutoff is ranked row by row
PARTS = 1024
#: one key's rows inside that part are numbered by so many tasks
SALTS = 64
_U52 = float(2**52)


def stratum(size: Column) -> Column:
    """Four strata an octave: bit length of the size and its two bits after the first; 0 for an empty text."""
    bits = F.bin(size)
    return F.when(size == 0, 0).otherwise(F.length(bits) * 4 + F.conv(F.substring(F.concat(bits, F.lit("00")), 2, 2), 2, 10).cast("int"))


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in (0, 1) that depends on the key only."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _U52


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds; a p of 1 ranks first, a p of 0 last."""
    return F.when(p >= 1, 0.0).when(p <= 0, float("inf")).otherwise((u / (1 - u)) / (p / (1 - p)))


def targets(sizes: DataFrame, weights: Sequence[float], most: float, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``target`` of every source (src, source, source_size): the whole size shared by weight, at most ``most`` times a source's own.

    Weights go to the sources by code point, null last, over and over. The excess of
    sources at their limit is shared anew among the others until none is above.
    """
    order = [F.col("source").isNull(), F.col("source")]
    numbered, _ = with_index(sizes, order, "place_")
    numbered = save(numbered.withColumn("weight_", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place_") % len(weights)).cast("int"))))
    share, full = 0.0, None
    while True:  # rounds of one small aggregate over the sources; the sources at their limit only become more
        above = F.col("weight_") * share > F.col("source_size") * float(most)
        got = numbered.agg(
            F.count_if(above).alias("full"),
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size"))).alias("held"),
            F.sum(F.when(~above, F.col("weight_"))).alias("weights"),
        ).first()
        if got["full"] == full or not got["weights"]:
            break
        full = got["full"] if share else None
        share = (float(got["all"]) - float(most) * float(got["held"] or 0)) / got["weights"]
        if not share:
            break
    limit = F.col("source_size") * float(most)
    return numbered.select("src", "source_size", F.least(F.col("weight_") * share, limit).alias("target"))


def _plan(parts: DataFrame, goals: DataFrame, seed: int | str) -> DataFrame:
    """Per source and stratum: certain copies, p, and where the sample ends (``cut`` part, ``need`` rows of it)."""
    w = Window.partitionBy("src", "stratum").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.select(
        "src",
        "stratum",
        F.struct(
            "part", "n", "words", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before")
        ).alias("at"),
    )
    strata = counted.groupBy("src", "stratum").agg(F.sum("at.n").alias("n"), F.sum("at.words").alias("words"), F.collect_list("at").alias("parts"))
    strata = strata.withColumn("round", uniform(seed, F.lit("stratum"), F.col("src"), F.col("stratum")))
    sources = strata.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("stratum", "n", "words", "round", "parts")), asc=False).alias("strata")).join(goals, "src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate).cast("long"))
    done = F.array().cast("array<struct<stratum:int,p:double,cut:int,need:bigint,in_cut:bigint>>")
    start = F.struct((F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).alias("rest"), F.col("source_size").alias("words"), done.alias("done"))

    def settle(state: Column, s: Column) -> Column:
        p = F.when(state["words"] > 0, F.least(F.greatest(state["rest"] / state["words"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        size = F.least(F.floor(s["n"] * p + s["round"]).cast("long"), s["n"])
        ends = F.get(F.filter(s["parts"], lambda x: (x["n_before"] < size) & (size <= x["n_before"] + x["n"])), F.lit(0))
        need = size - ends["n_before"]
        # the words of the sample: whole parts, and of the last one its mean size
        words = F.coalesce(ends["words_before"] + F.floor(need * ends["words"] / ends["n"]).cast("long"), F.lit(0))
        mine = F.struct(
            s["stratum"].alias("stratum"),
            p.alias("p"),
            F.coalesce(ends["part"], F.lit(-1)).alias("cut"),
            F.coalesce(need, F.lit(0)).alias("need"),
            F.coalesce(ends["n"], F.lit(0)).alias("in_cut"),
        )
        return F.struct(
            (state["rest"] - words).alias("rest"), (state["words"] - s["words"]).alias("words"), F.concat(state["done"], F.array(mine)).cast(done_type).alias("done")
        )

    done_type = "array<struct<stratum:int,p:double,cut:int,need:bigint,in_cut:bigint>>"
    folded = F.aggregate("strata", start, settle, lambda state: state["done"])
    return sources.select("src", "source_size", "target", "whole", F.explode(folded).alias("s")).select("src", "source_size", "target", "whole", "s.*")


def allocate(
    docs: DataFrame,
    save: Callable[[DataFrame], DataFrame],
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    seed: int | str = 12,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size (words), source_size, target and ``copies`` of every row, and the ``carry`` columns as one struct ``row``.

    A null text has no words; a null source is a source of its own, the last one. Empty
    texts get copies like others (of no words). A source without words has a target of 0
    and no copies. Rows that repeat a key are documents of their own; which of several
    identical ones is taken is open. Other columns are not carried, so their names don't
    matter. An empty table gives an empty result. ``most`` bounds the copies (rounded up).

    Only the rows whose uniform number falls in the part with the cutoff (about one in
    ``PARTS`` of a stratum) are ranked one by one, so a source may hold any share of the
    rows. Identical keys there are numbered by salt. Reruns agree: nothing depends on
    the partitions. ``save`` writes a table to the shared folder and reads it back.
    """
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words.alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    rows = rows.withColumns(
        {
            "src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")),
            "stratum": stratum(F.col("size")).cast("int"),
            "u": uniform(seed, F.col("doc_id"), F.col("size")),
        }
    )
    rows = save(rows.withColumn("part", F.least(F.floor(F.col("u") * PARTS), F.lit(PARTS - 1)).cast("int")))
    parts = save(rows.groupBy("src", "source", "stratum", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    goals = targets(parts.groupBy("src", "source").agg(F.sum("words").alias("source_size")), weights, most, save)
    plan = save(_plan(parts, goals, seed))

    planned = rows.join(plan, ["src", "stratum"])
    at_cut = (F.col("part") == F.col("cut")) & (F.col("need") < F.col("in_cut"))
    out = ["doc_id", "size", "source_size", "target", "copies", *(["row"] if carry else [])]
    plain = planned.filter(~at_cut).withColumn("copies", F.col("whole") + (F.col("part") <= F.col("cut")).cast("long"))
    return plain.select(out).unionByName(_at_cut(planned.filter(at_cut), save).select(out))


def _at_cut(rows: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the parts with cutoffs, ranked: the ``need`` least Pareto ranks of a stratum get one copy more."""
    rows = rows.withColumn("rank", pareto_rank(F.col("u"), F.col("p"))).withColumn("id", F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("null")))
    rows = save(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    keys = ["src", "stratum", "u", "id", "size", "salt"]
    counts = rows.groupBy(*keys).agg(F.first("rank").alias("rank"), F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("src", "stratum").orderBy("rank", "u", F.col("doc_id").asc_nulls_last(), "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("salt"))
    return rows.withColumn("inside", inside).join(starts, keys).withColumn("copies", F.col("whole") + (F.col("before") + F.col("inside") <= F.col("need")).cast("long"))


def mix(docs: DataFrame, save: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The mixed corpus: the documents with all their columns, each as often as it was allotted copies."""
    names = docs.columns
    got = allocate(docs, save, carry=names, **options).filter("copies > 0")
    return got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row")[n].alias(n) for n in names])


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: the same rows: ranks by window, strata settled by a recursive query
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 4 + CAST(concat('0b', substr(concat(bin(size), '00'), 2, 2)) AS INT) END AS stratum,
         (CAST(concat('0x', substr(md5(concat('12|', coalesce(CAST(doc_id AS VARCHAR), 'null'), '|', CAST(size AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM d
), r AS (
  SELECT *, least(CAST(floor(u * 1024) AS INT), 1023) AS part,
         row_number() OVER (PARTITION BY source, stratum ORDER BY u, doc_id NULLS LAST, size) AS place FROM k
), s AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source)
), f AS (
  SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), source)
), l AS (
  SELECT arg_min(CAST(total - 3 * held AS DOUBLE) / weights, k) AS share FROM f WHERE weight * (CAST(total - 3 * held AS DOUBLE) / weights) <= 3 * source_size
), g AS (
  SELECT source, source_size, least(weight * share, 3.0 * source_size) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(weight * share, 3.0 * source_size) / source_size) AS BIGINT) ELSE 0 END AS whole FROM s, l
), b AS (
  SELECT source, stratum, part, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM r GROUP BY ALL
), c AS (
  SELECT *, coalesce(sum(n) OVER o, 0) AS n_before, coalesce(sum(words) OVER o, 0) AS words_before FROM b
  WINDOW o AS (PARTITION BY source, stratum ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY stratum DESC) AS k,
         (CAST(concat('0x', substr(md5(concat('12|stratum|', coalesce(concat('s', source), 'null'), '|', CAST(stratum AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS v
  FROM (SELECT source, stratum, CAST(sum(n) AS BIGINT) AS n, CAST(sum(words) AS BIGINT) AS words FROM b GROUP BY ALL)
), z AS (
  SELECT source, 0 AS k, -1 AS stratum, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS got, target - CAST(whole * source_size AS DOUBLE) AS rest, source_size AS left_ FROM g
  UNION ALL
  SELECT source, k, stratum, size, got, rest_ - got, left_ - words
  FROM (
    SELECT y.source, y.k, y.stratum, y.size, y.words, y.rest AS rest_, y.left_,
           CAST(coalesce(c.words_before + floor((y.size - c.n_before) * c.words / CAST(c.n AS DOUBLE)), 0) AS BIGINT) AS got
    FROM (
      SELECT t.source, t.k, t.stratum, t.words, z.rest, z.left_,
             least(CAST(floor(t.n * (CASE WHEN z.left_ > 0 THEN least(greatest(z.rest / z.left_, 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END) + t.v) AS BIGINT), t.n) AS size
      FROM z JOIN t ON t.source IS NOT DISTINCT FROM z.source AND t.k = z.k + 1
    ) y LEFT JOIN c ON c.source IS NOT DISTINCT FROM y.source AND c.stratum = y.stratum AND c.n_before < y.size AND y.size <= c.n_before + c.n
  )
)
SELECT r.doc_id, r.size, g.source_size, g.target, r.size * (g.whole + CASE WHEN r.place <= z.size THEN 1 ELSE 0 END) AS taken
FROM r JOIN g ON g.source IS NOT DISTINCT FROM r.source JOIN z ON z.source IS NOT DISTINCT FROM r.source AND z.stratum = r.stratum AND z.k > 0
"""
