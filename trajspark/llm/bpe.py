"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Words that are frequent in the corpus are merged once and compiled into a minimal
acyclic automaton whose transitions carry numbers; the numbers along a word's path
add up to the word's place in a table of id lists. Tables and merges lie in one file
that every worker maps into memory. Words that the lexicon lacks are merged exactly,
many at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks, slim

#: a word is frequent, and put into the lexicon, if it is at least this share of all words, so at most 1 / share are
SHARE = 1 / (1 << 18)
#: longest word of the lexicon, bytes
LONGEST = 48
BLOCK = 1 << 20
#: fixed value: how byte-level BPE splits a text into words before merging
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(SPLIT)
#: distinct words that a worker keeps with their ids
SEEN = 150_000


def _latin_1() -> re.Pattern:
    """The same split for texts below code point 256, where the classes can be spelt out (it is faster)."""
    below = [chr(c) for c in range(256)]
    spelt = lambda chars: "".join(f"\\x{ord(c):02x}" for c in chars)
    letter, number = (spelt(c for c in below if unicodedata.category(c)[0] == k) for k in "LN")
    space = spelt(c for c in below if regex.fullmatch(r"\s", c))
    return re.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


_LATIN_1 = _latin_1()


def words_of(text: str) -> list[str]:
    """Words that a text without special tokens is cut into."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORDS.findall(text)
    return _LATIN_1.findall(text)


class Table:
    """Hash table of int64 keys in two arrays, looked up for whole arrays; -1 stands for no value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.mask = keys, values, len(keys) - 1

    @staticmethod
    def slot(keys: np.ndarray, mask: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        size = 1 << max(4, int(len(keys) * 3).bit_length())
        k, v = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for key, value, at in zip(keys.tolist(), values.tolist(), cls.slot(keys, size - 1).tolist()):
            while k[at] != -1:
                at = (at + 1) & (size - 1)
            k[at], v[at] = key, value
        return cls(k, v)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys, self.mask)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Minimal acyclic automaton of sorted, distinct words: transitions and final marks; state 0 is the start.

    Words are added in order; once a word leaves a path, the path's end is final and is
    replaced by a registered state with the same future.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, next state), not yet registered
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte, child = path.pop()
            future = (final[child], tuple(edges[child].items()))
            edges[state][byte] = register.setdefault(future, child)

    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else 0
        for byte in word[same:]:
            edges.append({})
            final.append(False)
            child = len(edges) - 1
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    settle(0)
    return edges, final


def compile_words(words: list[bytes]) -> tuple[Table, np.ndarray]:
    """Transition table (state << 8 | byte -> next << 32 | number) and final marks by state."""
    edges, final = automaton(words)
    live, seen = [0], {0: 0}
    for state in live:  # states that no path reaches were merged into others
        for child in edges[state].values():
            if child not in seen:
                seen[child] = len(seen)
                live.append(child)
    size: dict[int, int] = {}  # words that a state accepts
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [c for c in edges[state].values() if c not in size]
        if todo:
            stack += todo
        else:
            size[state] = final[state] + sum(size[c] for c in edges[state].values())
            stack.pop()
    keys, values = [], []
    for state in live:
        number = int(final[state])
        for byte, child in sorted(edges[state].items()):
            keys.append(seen[state] << 8 | byte)
            values.append(seen[child] << 32 | number)
            number += size[child]
    return Table.build(np.array(keys, np.int64), np.array(values, np.int64)), np.array([final[s] for s in live], np.int64)


def _places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of ranges one after another."""
    return np.arange(int(lens.sum())) + np.repeat(starts - np.cumsum(lens) + lens, lens)


def _take(offs: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the rows of a list table one after another, and the rows' lengths."""
    lens = offs[rows + 1] - offs[rows]
    return data[_places(offs[rows], lens)], lens


class _Index(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum(lens)]


class Merger:
    """Exact merges: of a word's neighbouring pairs the one with the lowest rank is merged, until none is left."""

    def __init__(self, pairs: Table, byte_ids: np.ndarray):
        self.pairs, self.byte_ids = pairs, byte_ids

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the bounds of each word's ids."""
        raw, offs = _flat(words)
        ids, word = self.byte_ids[raw], np.repeat(np.arange(len(words)), np.diff(offs))
        done_ids, done_word = [], []
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            got = np.full(len(ids), -1, np.int64)
            inner = np.flatnonzero(word[:-1] == word[1:])
            got[inner] = self.pairs.get(key[inner])
            rank = np.where(got >= 0, got >> 32, np.int64(1) << 40)
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(ids)]))
            finished = least == np.int64(1) << 40
            done_ids.append(ids[finished])
            done_word.append(word[finished])
            take = (rank == least) & ~finished
            # of overlapping equal pairs every second one is merged, from the left
            at = np.flatnonzero(take)
            if len(at):
                start = np.r_[True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            ids[at] = got[at] & 0xFFFFFFFF
            keep = ~finished
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        ids = np.concatenate([np.zeros(0, np.int64), *done_ids])
        word = np.concatenate([np.zeros(0, np.int64), *done_word])
        by = np.argsort(word, kind="stable")
        return ids[by], np.searchsorted(word[by], np.arange(len(words) + 1))


class Codec:
    """Encoder and decoder over the tables of one mapped file."""

    SECTIONS = ("edge_keys", "edge_values", "final", "list_offs", "list_ids", "pair_keys", "pair_values", "byte_ids", "token_offs", "token_bytes", "special")

    def __init__(self, path: str):
        whole = np.load(path, mmap_mode="r")
        n = len(self.SECTIONS)
        bounds = np.r_[n + 1, n + 1 + np.cumsum(whole[1 : n + 1])].tolist()
        part = {name: np.asarray(whole[a:b]) for name, a, b in zip(self.SECTIONS, bounds, bounds[1:])}
        self.edges, self.final = Table(part["edge_keys"], part["edge_values"]), part["final"]
        self.list_offs, self.list_ids = part["list_offs"], part["list_ids"]
        self.merger = Merger(Table(part["pair_keys"], part["pair_values"]), np.asarray(part["byte_ids"]))
        self.token_offs, self.token_raw = np.asarray(part["token_offs"]), np.asarray(part["token_bytes"]).astype(np.uint8)
        offs = self.token_offs.tolist()
        self.tokens = [self.token_raw[a:b].tobytes() for a, b in zip(offs, offs[1:])]
        # decimal ids, a comma after each
        shown = [b"%d," % i for i in range(len(self.tokens))]
        self.decimal_offs, self.decimal_raw = np.r_[0, np.cumsum([len(x) for x in shown])], np.frombuffer(b"".join(shown), np.uint8)
        self.special = {self.tokens[i].decode(): i for i in part["special"].tolist()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.index, self.ids, self.offs = _Index(), np.zeros(0, np.int64), np.zeros(1, np.int64)

    @classmethod
    def write(cls, path: str, **parts: np.ndarray) -> None:
        arrays = [np.asarray(parts[name], np.int64) for name in cls.SECTIONS]
        np.save(path, np.concatenate([[len(arrays)], [len(a) for a in arrays], *arrays]).astype(np.int64))

    def place(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, -1 for words it lacks."""
        raw, offs = _flat(words)
        lens = np.diff(offs)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.final):
            return np.full(len(words), -1, np.int64)
        state[lens > LONGEST] = -1
        live = np.flatnonzero((lens > 0) & (lens <= LONGEST))
        k = 0
        while len(live):
            got = self.edges.get(state[live] << 8 | raw[offs[live] + k])
            state[live] = np.where(got >= 0, got >> 32, -1)
            number[live] += np.where(got >= 0, got & 0xFFFFFFFF, 0)
            k += 1
            live = live[(got >= 0) & (lens[live] > k)]
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        return np.where(ok, number, -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has: from the lexicon, else merged."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        place = self.place(raw)
        known, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        listed, n_listed = _take(self.list_offs, self.list_ids, place[known])
        merged, bounds = self.merger.merge([raw[k] for k in new.tolist()])
        n = np.zeros(len(words), np.int64)
        n[known], n[new] = n_listed, np.diff(bounds)
        start, ids = np.cumsum(n) - n, np.empty(int(n.sum()), np.int64)
        ids[_places(start[known], n[known])] = listed
        ids[_places(start[new], n[new])] = merged
        return ids, n

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens are words of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return words_of(text)
        out = []
        for piece in self.cut.split(text):
            out += [piece] if piece in self.special else words_of(piece)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the bounds of each text's ids."""
        if len(self.index) > SEEN:
            self.forget()
        if not len(self.index):
            # special tokens are no words of the split, so they can't be taken for one
            for s, i in self.special.items():
                self.index[s]
                self.ids, self.offs = np.r_[self.ids, i], np.r_[self.offs, self.offs[-1] + 1]
        split = [self.split(t) for t in texts]
        seen = len(self.index)
        size = np.fromiter(map(len, split), np.int64, len(split))
        number = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        if len(self.index) > seen:
            ids, n = self.encode_words(list(self.index)[seen:])
            self.ids, self.offs = np.r_[self.ids, ids], np.r_[self.offs, self.offs[-1] + np.cumsum(n)]
        ids, n = _take(self.offs, self.ids, number)
        ends = np.r_[0, np.cumsum(n)]
        return ids, ends[np.r_[0, np.cumsum(size)]]

    def _written(self, offs: np.ndarray, raw: np.ndarray, ids: np.ndarray, bounds: np.ndarray, drop: int) -> list[bytes]:
        flat, n = _take(offs, raw, ids)
        flat, ends = flat.tobytes(), np.r_[0, np.cumsum(n)][bounds].tolist()
        return [flat[a : max(a, b - drop)] for a, b in zip(ends, ends[1:])]

    def decimal(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, comma-joined."""
        return self._written(self.decimal_offs, self.decimal_raw, ids, bounds, 1)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        return [t.decode("utf-8", "replace") for t in self._written(self.token_offs, self.token_raw, ids, bounds, 0)]


def vocabulary(path: str) -> dict[str, np.ndarray]:
    """Tables of a byte-level BPE tokenizer file: pairs, ids of single bytes, bytes of each id, special ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # fixed values: byte-level BPE writes printable bytes as themselves and the others as characters from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
    vocab: dict[str, int] = spec["model"]["vocab"]
    tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    tokens |= special
    byte_ids = np.zeros(256, np.int64)
    for c, b in byte_of.items():
        byte_ids[b] = vocab[c]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    values = np.array([rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)], np.int64)
    table = Table.build(keys, values)
    top = max(tokens) + 1
    raw = [tokens.get(i, b"") for i in range(top)]
    return {
        "pair_keys": table.keys,
        "pair_values": table.values,
        "byte_ids": byte_ids,
        "token_offs": np.r_[0, np.cumsum([len(t) for t in raw])],
        "token_bytes": np.frombuffer(b"".join(raw), np.uint8),
        "special": np.array(sorted(special), np.int64),
    }


def frequent_words(docs: DataFrame, save, share: float = SHARE) -> list[bytes]:
    """Words of all texts that are at least ``share`` of all words (so at most 1 / share), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in counts], pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                counts.clear()

        for _, texts in blocks(batches):
            for t in texts:
                counts.update(words_of(t.decode("utf-8", "replace")))
            if len(counts) > 150_000:
                yield from out()
        yield from out()

    counts = save(slim(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return sorted(bytes(r["word"]) for r in counts.filter((F.col("n") >= total * share) & (F.length("word") <= LONGEST)).collect())


def build(words: list[bytes], tokenizer: str, path: str) -> None:
    """Write the file that ``Codec`` maps: lexicon of ``words`` (sorted, distinct) over a tokenizer file."""
    vocab = vocabulary(tokenizer)
    merger = Merger(Table(vocab["pair_keys"], vocab["pair_values"]), vocab["byte_ids"])
    ids, offs = merger.merge(words)
    edges, final = compile_words(words) if words else (Table.build(np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64))
    Codec.write(path, edge_keys=edges.keys, edge_values=edges.values, final=final, list_offs=offs, list_ids=ids, **vocab)


_codecs: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(SparkFiles.get(name))
    return _codecs[name]


def shipped(docs: DataFrame, tokenizer: str, save, share: float = SHARE) -> str:
    """Build the lexicon of the documents and send its file to the executors; the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    build(frequent_words(docs, save, share), tokenizer, path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, tokenizer: str, save, share: float = SHARE) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row.

    Rows stay one to one, repeated rows and null ids included; null counts as empty and
    has no ids. Special tokens of the tokenizer are found in texts as its library does.
    Further columns are not carried.
    """
    name = shipped(docs, tokenizer, save, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for part, texts in blocks(batches, size=BLOCK):
            ids, bounds = codec.encode([t.decode("utf-8", "replace") for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), lists, pa.array(codec.decode(ids, bounds), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, save, share: float = SHARE) -> DataFrame:
    """As ``encode``, with digests of the ids (decimal, comma-joined) and of the decoded text in their place."""
    name = shipped(docs, tokenizer, save, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        sha = hashlib.sha256
        for part, texts in blocks(batches, size=BLOCK):
            ids, bounds = codec.encode([t.decode("utf-8", "replace") for t in texts])
            by_id = [sha(t).hexdigest() for t in codec.decimal(ids, bounds)]
            by_text = [sha(t.encode()).hexdigest() for t in codec.decode(ids, bounds)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(by_id), pa.array(by_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
