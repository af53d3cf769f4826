import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trajspark.llm import bpe
from trajspark.llm.queries import QUERIES
from trajspark.session import write_table

from llm_helpers import SF001, rows_of, same

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(rows):
    tok = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, ids, tok.decode(ids, skip_special_tokens=False)))
    return out


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_the_library(spark, small):
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(d)) for i, ids, d in library(rows_of(small))]
    same(QUERIES["op7_bpe"](spark, SF001).collect(), want)


@pytest.mark.parametrize("share", [1.0, 1 / 200, 1e-9])
def test_odd_rows(odd, empty, share):
    got = bpe.encode(odd, PATH, write_table, share).collect()
    same([(r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got], [(i, len(ids), tuple(ids), d) for i, ids, d in library(rows_of(odd))])
    assert bpe.encode(empty, PATH, write_table, share).collect() == []


def test_codec_equals_the_library_on_hard_texts(tmp_path):
    rng = np.random.default_rng(2)
    chars = [chr(int(c)) for c in rng.integers(1, 0x2FFF, 3000) if not 0xD800 <= c < 0xE000] + list("  \t\n\x1c\x1d\x85\xa0 'stredlvm019aé中\U0001f600")
    texts = ["".join(rng.choice(chars, int(rng.integers(0, 60)))) for _ in range(400)] + ["a" * 3000, " " * 50 + "x", "'s't're <|endoftext|><|endoftext|> x<|endoftext", "ab" * 500, "\n\n \n a"]
    bpe.build(sorted({w.encode() for t in texts[:100] for w in bpe._WORDS.findall(t)}), PATH, str(tmp_path / "x.npy"))
    codec = bpe.Codec(str(tmp_path / "x.npy"))
    for part in (texts[:200], texts[200:], texts):
        ids, bounds = codec.encode(part)
        decoded, decimal = codec.decode(ids, bounds), codec.decimal(ids, bounds)
        for k, (t, want, back) in enumerate(library(list(zip(part, part)))):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want
            assert decimal[k].decode() == ",".join(map(str, want))
            assert decoded[k] == back == t


def test_latin_1_split_is_the_same_split():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(chr(c) for c in rng.integers(0, 256, 80)) + " it's we'll   \n\n x"
        assert bpe.words_of(text) == bpe._WORDS.findall(text)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({a + b for a in (b"walk", b"talk", b"stalk", b"w") for b in (b"", b"s", b"ed", b"ing")})
    edges, final = bpe.compile_words(words)
    # equal futures share one state: of the suffix set {"", s, ed, ing} there is one copy
    assert len(final) < 16
    state_count = len(final)
    futures = {}
    trans = {int(k): int(v) for k, v in zip(edges.keys, edges.values) if k >= 0}

    def language(s):
        if s not in futures:
            futures[s] = frozenset(([b""] if final[s] else []) + [bytes([k & 255]) + x for k, v in trans.items() if k >> 8 == s for x in language(v >> 32)])
        return futures[s]

    assert len({language(s) for s in range(state_count)}) == state_count
    assert sorted(language(0)) == words
