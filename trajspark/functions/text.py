"""Tokenisers: whitespace by default (JVM-side), model vocabularies pluggable.

A pluggable tokenizer runs as an Arrow-batched pandas UDF with one load per
Python worker; the whitespace default never leaves the JVM. Subword vocabularies
(a tokenizers JSON file, its path a parameter) give token ids; the file is sent to every
worker and loaded there once, and texts are encoded a few at a time, long ones in parts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

WS = "[ \t\n\r\f]+"
_TOKENIZERS: dict[str, Callable[[], Callable[[str], list[str]]]] = {}


def register_tokenizer(name: str):
    def deco(factory):
        _TOKENIZERS[name] = factory
        return factory

    return deco


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda x: x != "")


def tokens(text: Column, tokenizer: str | None = None) -> Column:
    if tokenizer is None:
        return whitespace_tokens(text)
    factory = _TOKENIZERS[tokenizer]

    @F.pandas_udf(ArrayType(StringType()))
    def _tok(s: pd.Series) -> pd.Series:
        fn = factory()
        return s.fillna("").map(fn)

    return _tok(text)


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    if tokenizer is None:
        return F.size(whitespace_tokens(text))
    factory = _TOKENIZERS[tokenizer]

    @F.pandas_udf(IntegerType())
    def _cnt(s: pd.Series) -> pd.Series:
        fn = factory()
        return s.fillna("").map(lambda x: len(fn(x))).astype("int32")

    return _cnt(text)


#: subword vocabularies by name: file name and special tokens
_SUBWORDS: dict[str, tuple[str, tuple[str, ...]]] = {}
_loaded: dict[tuple[str, tuple[str, ...]], object] = {}


def register_subwords(spark: SparkSession, name: str, path: str, special: Sequence[str] = ()) -> None:
    """A subword vocabulary under ``name``; ``special`` tokens are atomic and get the ids after the vocabulary's."""
    spark.sparkContext.addFile(path)
    _SUBWORDS[name] = (os.path.basename(path), tuple(special))


#: bytes of text that are encoded at once: the library takes some 100 bytes a token while it does
ENCODE_BYTES = 1 << 18
# Behind such a character a byte-level word always ends: before white space, or between an
# alphanumeric and a punctuation mark. Encoding the parts gives the ids of the whole.
_CUT = re.compile(r"\S(?=[ \t\n])|[0-9A-Za-z\u4e00-\u9fa5](?=[.,;:!?/+=\u3001\u3002\uff0c])")


def _subwords(file: str, special: tuple[str, ...]):
    """The vocabulary in this worker, loaded once, and whether texts may be cut at ``_CUT``."""
    if (file, special) not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        made = Tokenizer.from_file(SparkFiles.get(file))
        made.no_truncation()
        made.no_padding()
        made.add_special_tokens(list(special))
        words = made.pre_tokenizer
        plain = made.normalizer is None and isinstance(words, ByteLevel) and words.use_regex and not words.add_prefix_space
        added = made.get_added_tokens_decoder().values()
        cut = plain and not any(t.lstrip or t.rstrip or t.single_word or _CUT.search(t.content) for t in added)
        _loaded[file, special] = made, cut
    return _loaded[file, special]


def _pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about ``size`` characters that end where a word ends."""
    start = 0
    while len(text) - start > size and (m := _CUT.search(text, start + size - 1)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def _encoded(s: pa.Array, file: str, special: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Ids of each text of ``s`` in order, as arrays that follow one another; few texts, or a part of one, are encoded at once."""
    made, cut = _subwords(file, special)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in made.encode_batch(texts, add_special_tokens=False)]

    size = pc.fill_null(pc.binary_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    until = np.cumsum(size)
    i = 0
    while i < len(s):
        n = max(1, int(np.searchsorted(until, until[i] - size[i] + ENCODE_BYTES, "right")) - i)
        if size[i] > ENCODE_BYTES and cut:
            yield [encode([x])[0] for x in _pieces(s[i].as_py(), ENCODE_BYTES)]
        else:
            yield from ([x] for x in encode([x or "" for x in s.slice(i, n).to_pylist()]))
        i += n


def token_ids(text: Column, name: str) -> Column:
    """Ids of the subword vocabulary ``name`` (see ``register_subwords``); a null text has none."""
    file, special = _SUBWORDS[name]

    @F.arrow_udf(ArrayType(IntegerType()))
    def _ids(s: pa.Array) -> pa.Array:
        n, ids = [0], []
        for x in _encoded(s, file, special):
            n.append(n[-1] + sum(map(len, x)))
            ids.extend(x)
        return pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))

    return _ids(text)


def token_id_count(text: Column, name: str) -> Column:
    """Number of ids of ``token_ids``, without handing them out."""
    file, special = _SUBWORDS[name]

    @F.arrow_udf(IntegerType())
    def _n(s: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, x)) for x in _encoded(s, file, special)], pa.int32())

    return _n(text)
