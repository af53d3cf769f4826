"""Line dedup by windows of line hashes. Main path: DataFrame functions only.

A text's lines that are not blank are its sequence. A window is the shortest run of
MIN_BYTES bytes at least from a line on, or up to a line. It depends on its own lines
only, so two texts that share a run of MIN_BYTES share all windows inside it, and these
cover it: each line of the run starts a window inside it, or lies in the one that ends
with the run. Windows meet by their lines; of each, all but the earliest occurrence are
deleted, so a line goes exactly if some earlier run of MIN_BYTES has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BYTES = 120


def line_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """rid, order_, pos, hash and bytes of every line; blank lines have 0 bytes."""
    body = F.trim("line_")
    return docs.select("rid", "order_", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line_")).select("rid", "order_", "pos", F.xxhash64(body).alias("hash"), F.octet_length(body).cast("long").alias("bytes"))


def repeated(lines: DataFrame, save, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(rid, pos) of every line in a run that occurred earlier, by order_, rid and place.

    A run counts if it has ``min_bytes`` bytes; no group of lines grows with a text. The
    earliest places are written as a table, so that the join with them is one of
    plain shuffles, whose hot keys adaptive execution splits.
    """
    doc = Window.partitionBy("rid")
    seq = lines.filter("bytes > 0").withColumn("end", F.sum("bytes").over(doc.orderBy("pos"))).withColumn("at", F.col("end") - F.col("bytes"))
    along, back = doc.orderBy("at"), doc.orderBy("end")
    seq = (
        seq.withColumn("from_", F.collect_list("hash").over(along.rangeBetween(0, min_bytes - 1)))
        .withColumn("head_", F.min("at").over(back.rangeBetween(1 - min_bytes, 0)))
        .withColumn("upto_", F.collect_list("hash").over(back.rangeBetween(1 - min_bytes, 0)))
        .withColumn("k", F.row_number().over(along))
        .withColumn("total", F.sum("bytes").over(doc))
    )
    # a window up to a line that is also the one from its first line on is taken once
    starts = F.when(F.col("at") + min_bytes <= F.col("total"), F.struct(F.col("k"), F.col("from_").alias("lines_")))
    ends = F.when((F.col("end") >= min_bytes) & (F.col("at") - F.col("head_") >= min_bytes), F.struct((F.col("k") - F.size("upto_") + 1).alias("k"), F.col("upto_").alias("lines_")))
    key = ["fingerprint", "content"]
    windows = seq.select("order_", "rid", F.explode(F.array_compact(F.array(starts, ends))).alias("w")).select(
        F.array_min("w.lines_").alias("fingerprint"), F.xxhash64("w.lines_").alias("content"), F.col("order_").isNull().alias("last_"), "order_", "rid", "w.k", F.size("w.lines_").alias("m")
    )
    place = F.struct("last_", "order_", "rid", "k")
    first = windows.groupBy(*key).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = windows.join(save(first), key).filter(place > F.col("f"))
    hit = later.select("rid", F.explode(F.sequence("k", F.col("k") + F.col("m") - 1)).alias("k")).distinct()
    return seq.select("rid", "k", "pos").join(hit, ["rid", "k"]).select("rid", "pos")


def _rows(docs: DataFrame, save) -> DataFrame:
    """The documents with a row number that no later step can change."""
    return save(docs.withColumn("rid", F.monotonically_increasing_id()).withColumn("order_", F.col("doc_id").cast("long")))


def _marked(rows: DataFrame, save, min_bytes: int, text: str = "text") -> DataFrame:
    """rid and, for texts that lose lines, a mark for each line (true: deleted)."""
    lines = line_rows(rows, text)
    gone = repeated(lines, save, min_bytes).withColumn("gone", F.lit(True))
    marks = lines.select("rid", "pos").join(gone, ["rid", "pos"], "left").groupBy("rid").agg(F.collect_list(F.struct("pos", F.coalesce("gone", F.lit(False)).alias("gone"))).alias("m"), F.max("gone").alias("any_"))
    return marks.filter("any_").select("rid", F.transform(F.array_sort("m"), lambda x: x["gone"]).alias("gone_"))


def _kept(text: Column, gone: Column) -> Column:
    lines = F.zip_with(F.split(text, "\n"), gone, lambda line, g: F.when(~g, line))
    return F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")


def dedup(docs: DataFrame, save, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents, all columns kept, with later repeated runs of lines taken out of ``text``.

    The order is by doc_id (null last), then the row's place in the input. Runs repeat
    across and inside texts; a run's earliest occurrence stays, so of copies the first
    stays whole and the others lose all lines (their text is then empty). Lines are
    compared without spaces around them. Blank lines are never part of a run and stay;
    null and empty texts stay as they are; texts without a repeated run are unchanged
    byte for byte. Shared runs under ``min_bytes`` bytes stay.
    """
    # every column travels under a name of its own, so that no extra column can clash
    names = docs.columns
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"))
    rows = _rows(own, save)
    marks = _marked(rows, save, min_bytes)
    out = rows.join(marks, "rid", "left").withColumn("text", F.when(F.col("gone_").isNotNull(), _kept(F.col("text"), F.col("gone_"))).otherwise(F.col("text")))
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names])


def report(docs: DataFrame, save, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that stays, for every row."""
    rows = _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), save)
    out = rows.join(_marked(rows, save, min_bytes), "rid", "left")
    text = F.coalesce("text", F.lit(""))
    lost = F.coalesce(F.size(F.filter("gone_", lambda g: g)), F.lit(0))
    kept = F.when(F.col("gone_").isNotNull(), _kept(text, F.col("gone_"))).otherwise(text)
    return out.select("doc_id", F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"), F.greatest(lost, F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: the same rows by comparing windows from and up to each line as lists of strings
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), used AS (
  SELECT doc_id, pos, trim(line, ' ') AS body, strlen(trim(line, ' ')) AS b FROM lines WHERE strlen(trim(line, ' ')) > 0
), placed AS (
  SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY pos) - b AS BIGINT) AS head, CAST(sum(b) OVER (PARTITION BY doc_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM used
), listed AS (
  SELECT *, list(body) OVER (PARTITION BY doc_id ORDER BY head RANGE BETWEEN CURRENT ROW AND {MIN_BYTES - 1} FOLLOWING) AS onward,
    list(body) OVER (PARTITION BY doc_id ORDER BY head + b RANGE BETWEEN {MIN_BYTES - 1} PRECEDING AND CURRENT ROW) AS upto,
    min(head) OVER (PARTITION BY doc_id ORDER BY head + b RANGE BETWEEN {MIN_BYTES - 1} PRECEDING AND CURRENT ROW) AS upto_head FROM placed
), windows AS (
  SELECT doc_id, k, onward AS win FROM listed WHERE head + {MIN_BYTES} <= total
  UNION ALL
  SELECT doc_id, k - len(upto) + 1, upto FROM listed WHERE head + b >= {MIN_BYTES} AND head - upto_head >= {MIN_BYTES}
), later AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS n FROM windows
), gone AS (
  SELECT DISTINCT l.doc_id, p.pos FROM (SELECT DISTINCT doc_id, unnest(range(k, k + len(win))) AS k FROM later WHERE n > 1) l JOIN placed p ON p.doc_id = l.doc_id AND p.k = l.k
)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept FROM lines l LEFT JOIN gone x ON x.doc_id = l.doc_id AND x.pos = l.pos WHERE x.pos IS NULL GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
"""
