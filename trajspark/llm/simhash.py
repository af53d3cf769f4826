"""SimHash near-dedup by Golay-code fuzzy keys.

A fingerprint is cut into three segments. A segment is decoded, as it is and with
each bit flipped, by the perfect (23, 12, 7) Golay code; the indices of the
codewords found are its keys. Segments that differ in at most two bits share a key.
Four differing bits over three segments leave either an equal segment next to one
with at most two errors, or two segments with one error each (and the third with at
most two), so keys of segment pairs meet in one of these ways; every meeting is
verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, NON_SPACE, Lists, Words, blocks, slim, spread_join

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: bits of the three segments, lowest first; a segment is padded to 23 bits with zeros
SEGMENTS = (22, 21, 21)

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit majority fingerprints: bit set if over half the shingle hashes have it; no words: 0."""
    w = Words(texts, NON_SPACE, lower=False, hashes=False)
    out = np.zeros(len(texts), np.uint64)
    if not len(w):
        return out
    # lower-case words with one space after each
    low = LOWER[w.buf]
    low[w.end] = 32
    keep = NON_SPACE[w.buf]
    keep[w.end] = True
    flat = low[keep].tobytes()
    lens = w.end - w.start
    begin = np.cumsum(lens + 1) - lens - 1
    n = w.counts
    shingles = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    first = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    a = np.arange(total) - np.repeat(first, shingles) + np.repeat(w.first[:-1], shingles)
    b = np.minimum(a + shingle, np.repeat(w.first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[x:y], SEED) for x, y in zip(begin[a].tolist(), (begin[b] + lens[b]).tolist())), np.uint64, total)
    # pieces of up to 255 shingles, so that a byte can count each bit
    docs = np.flatnonzero(shingles)
    pieces = -(-shingles[docs] // 255)
    cut = np.repeat(first[docs], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(cut), 64), np.uint8)
    for k in range(8):
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(_LANES[by_byte[:, k]], cut).view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(counts.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    majority = sums * 2 > shingles[docs][:, None]
    out[docs] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


#: fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1
_GENERATOR = 0b110001110101


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by byte (3 x 256) and the error pattern of each of the 2048 remainders."""

    def remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= _GENERATOR << (k - 11)
        return word

    by_byte = np.array([[remainder(b << (8 * k) & 0x7FFFFF) for b in range(256)] for k in range(3)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    single = [1 << i for i in range(23)]
    patterns = single + [a | b for a in single for b in single if a < b] + [a | b | c for a in single for b in single if a < b for c in single if b < c]
    for p in patterns:
        errors[remainder(p)] = p
    return by_byte, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    by_byte, errors = _golay()
    w = words.astype(np.uint32)
    rest = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
    return ((w ^ errors[rest]) >> 11).astype(np.int64)


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each segment (own key first) and which of them are new in their row."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    keys = decode(words.astype(np.uint32)[:, None] ^ flips)
    own = keys[:, :1]
    rest = np.sort(keys[:, 1:], axis=1)
    new = rest != own
    new[:, 1:] &= rest[:, 1:] != rest[:, :-1]
    return np.concatenate([own, rest], axis=1), np.concatenate([np.ones_like(own, bool), new], axis=1)


def probes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe, row of the fingerprint); probe = key * 2 + role.

    Role 0 meets role 0 and role 1 of its key; two rows of role 1 needn't meet.
    Kinds 0-5: segment i as it is with all keys of segment j. Kinds 6-8: keys of two
    segments; the pair of own keys has role 0, the others role 1.
    """
    shift, parts = 0, []
    for bits in SEGMENTS:
        value = (prints >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        parts.append((value, *segment_keys(value, bits)))
        shift += bits
    out: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, col = np.nonzero(parts[j][2])
                out.append((kind << 40 | parts[i][0][row] << 12 | parts[j][1][row, col]) << 1)
                rows.append(row)
                kind += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        row_i, col_i = np.nonzero(parts[i][2])
        many = parts[j][2].sum(axis=1)
        row_j, col_j = np.nonzero(parts[j][2])
        first = np.cumsum(many) - many
        reps = many[row_i]
        row = np.repeat(row_i, reps)
        at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + first[row]
        k_i, c_i = np.repeat(parts[i][1][row_i, col_i], reps), np.repeat(col_i, reps)
        own = (c_i == 0) & (col_j[at] == 0)
        out.append((kind << 40 | k_i << 12 | parts[j][1][row, col_j[at]]) << 1 | ~own)
        rows.append(row)
        kind += 1
    return np.concatenate(out), np.concatenate(rows)


class Forest:
    """Union by smaller number over fingerprints seen in a task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart so far."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _links(prints: np.ndarray, role: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links that connect a large group just as all its links do: rows reached already are not compared again."""
    far = np.arange(len(prints))
    far = far[np.argsort(role[far], kind="stable")]
    while len(far):
        front, far = far[:1], far[1:]
        while len(front) and len(far):
            step = []
            for k in range(0, len(front), 64):
                some = front[k : k + 64]
                near = np.bitwise_count(prints[some][:, None] ^ prints[far]) <= max_bits
                near &= (role[some][:, None] == 0) | (role[far] == 0)
                got = near.any(axis=0)
                source = some[near.argmax(axis=0)[got]]
                yield from zip(prints[source].tolist(), prints[far[got]].tolist())
                step.append(far[got])
                far = far[~got]
                if not len(far):
                    break
            front = np.concatenate(step) if step else far[:0]


def verified(key: np.ndarray, role: np.ndarray, prints: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links inside the groups of equal key; rows sorted by key, then role."""
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    large = size > 64
    for a, n in zip(head[large].tolist(), size[large].tolist()):
        yield from _links(prints[a : a + n], role[a : a + n], max_bits)
    left = np.repeat(head + size, size) - np.arange(len(key)) - 1  # rows of the group that follow
    at = np.flatnonzero((role == 0) & (left > 0) & np.repeat(~large, size))
    d = 1
    while len(at):
        near = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= max_bits]
        yield from zip(prints[near].tolist(), prints[near + d].tolist())
        d += 1
        at = at[left[at] >= d]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (u, v), u < v, of fingerprints (column ``fp``, each once) that connect all those within ``max_bits``.

    Any two fingerprints that differ in at most max_bits <= 4 bits are joined by a path
    of such pairs. A task compares a group by numpy blocks and gives up only links
    between fingerprints that its earlier links did not connect.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys find up to four differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(whole), 4096):
                prints = whole[k : k + 4096]
                probe, row = probes(prints)
                yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(prints[row].view(np.int64))], ["probe", "fp"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        probe, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def run(n: int) -> pa.RecordBatch | None:
            nonlocal probe, fp
            key = probe[:n] >> 1
            new = [(a, b) for a, b in verified(key, probe[:n] & 1, fp[:n].view(np.uint64), max_bits) if forest.join(a, b)]
            probe, fp = probe[n:], fp[n:]
            if not new:
                return None
            pairs = np.array(new, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            probe = np.concatenate([probe, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            # the last group may go on in the next batch
            done = int(np.searchsorted(probe >> 1, probe[-1] >> 1))
            if done and (out := run(done)) is not None:
                yield out
        if len(probe) and (out := run(len(probe))) is not None:
            yield out

    # each fingerprint gives over a hundred rows, so the few bytes of the fingerprints must not set the number of tasks
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp").repartition(tasks, "fp").mapInArrow(keyed, "probe long, fp long")
    dealt = rows.repartition(F.shiftright("probe", 1)).sortWithinPartitions("probe")
    return dealt.mapInArrow(check, "u long, v long")


def components(edges: DataFrame, save) -> DataFrame:
    """(node, root) of every node of the edges (u, v), root the smallest node of its component.

    Alternating stars: every node's larger neighbours are moved to its smallest
    neighbour, then its smaller ones, until nothing moves. ``save`` writes a round's
    edges to the shared folder and reads them again. Minima are combined before they
    are shuffled, so a node with very many neighbours costs a row per task.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: directed (u, v); with ``large`` each edge both ways, else from the larger to the smaller node."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        both = pairs.join(least, "u")
        if large:
            moved = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter("u != v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = mark(edges)
    while before[0]:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        edges = save(star(star(edges.unionByName(back), True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, save, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable over links of at most ``max_bits``
    differing bits (null if all ids reached are null). Null counts as empty; texts
    without words have fingerprint zero, which links like any other. Rows stay one to
    one, also for repeated rows and null ids. Further columns are not carried; an empty
    table gives an empty result.

    Equal fingerprints are one node, so copies cost no links; only distinct
    fingerprints are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Lists()

        def table(rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.int64()))], ["fp", "ids"])

        for part, texts in blocks(batches):
            for fp, doc_id in zip(fingerprints(texts, shingle).view(np.int64).tolist(), part.column(0).to_pylist()):
                ids.add(fp, doc_id)
            yield from table(ids.rows())
        yield from table(ids.rows(last=True))

    lists = save(slim(docs).mapInArrow(run, "fp long, ids array<long>"))
    distinct = lists.groupBy("fp").agg(F.min(F.array_min("ids")).alias("least"), F.sum(F.size("ids")).alias("n"))
    roots = components(links(distinct, max_bits), save).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(whole, "root").select("fp", "n", "component_id")
    return spread_join(lists, found, ["fp"]).select(F.explode("ids").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, save, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, all columns kept, with one of each group of near copies: the smallest doc_id.

    Of rows that repeat that id one stays, and of a group without any id one. Rows are
    told apart by a number that is written with them, so equal rows are rows of their own.
    """
    names = docs.columns
    rows = save(docs.select(F.col("doc_id").cast("long").alias("id_"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest")).withColumn("row_", F.monotonically_increasing_id()))
    found = near_dedup(rows.select(F.col("row_").alias("doc_id"), "text"), save, shingle, max_bits)
    groups = found.select(F.col("doc_id").alias("row_"), F.col("component_id").alias("group_"))
    # the group's first row by doc_id, null last; minima are combined before the shuffle
    place = F.struct(F.col("id_").isNull().alias("null_"), F.coalesce("id_", F.lit(0)).alias("id_"), F.col("row_"))
    first = rows.select("row_", "id_").join(groups, "row_").groupBy("group_").agg(F.min(place).alias("first")).select(F.col("first.row_").alias("row_"))
    kept = rows.join(first, "row_", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names])
