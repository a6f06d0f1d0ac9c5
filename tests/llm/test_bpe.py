"""The tokenization automaton against the tokenizers library and against merges applied in turn."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.compile_file(PATH))


def decoder_of(compiled):
    return bpe.Decoder(compiled.path, compiled.labels, compiled.decoder)


@pytest.fixture(scope="module")
def labels(encoder):
    return decoder_of(encoder.compiled)


def merged(word: str, merges: list[tuple[str, str]]) -> list[str]:
    """Every merge in turn, from left to right."""
    parts = list(word)
    for u, v in merges:
        done, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v):
                done.append(u + v)
                i += 2
            else:
                done.append(parts[i])
                i += 1
        parts = done
    return parts


def tokens_of(automaton: bpe.Automaton, vocab: dict[str, int], word: str) -> list[list[str]]:
    """Every path of the automaton that spells the word."""
    name = {i: t for t, i in vocab.items()}

    def lacks(state, arc):
        a, b = automaton.begin[automaton.rank[state]], automaton.begin[automaton.rank[state] + 1]
        return any(x <= automaton.rank[arc] <= y for x, y in zip(automaton.first[a:b], automaton.last[a:b], strict=True))

    def paths(rest, state):
        if not rest:
            return [[]]
        out = []
        for i, t in name.items():
            if automaton.rank[i] >= 0 and rest.startswith(t) and (state is None or not lacks(state, i)):
                out += [[t, *p] for p in paths(rest[len(t) :], i)]
        return out

    return paths(word, None)


@pytest.mark.parametrize("seed", range(30))
def test_one_path_for_each_word_and_it_is_that_of_the_merges(seed):
    rnd = random.Random(seed)
    vocab, merges = {"a": 0, "b": 1, "c": 2}, []
    while len(merges) < 9:
        u, v = rnd.choice(list(vocab)), rnd.choice(list(vocab))
        if u + v not in vocab and len(u + v) < 7:
            merges.append((u, v))
            vocab[u + v] = len(vocab)
    automaton = bpe.compile_merges(vocab, merges)
    for _ in range(60):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        assert tokens_of(automaton, vocab, word) == [merged(word, merges)]


def test_lists_without_an_order_of_gadgets_are_refused():
    with pytest.raises(ValueError):
        bpe.compile_merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe.compile_merges({"a": 0, "b": 1, "ab": 2, "bb": 3, "abb": 4}, [("a", "b"), ("b", "b"), ("ab", "b"), ("a", "bb")])


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("aabeethinrsσΣßéÉñİIĞ１½²'’ \n\t\x00\x1c\x85 　́한国日本🙂👍🏽Å019.,!-_<|>") | st.characters(codec="utf-8"), max_size=60), special=st.booleans())
def test_any_text_as_the_library(encoder, labels, text, special):
    text += "<|endoftext|>X<|startoftext|>" * special
    expected = encoder.library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == expected
    ids = pa.array([expected, []], pa.list_(pa.int32()))
    assert labels.decode(ids).to_pylist() == [encoder.library.decode(expected, skip_special_tokens=False), ""]


def test_long_words_and_full_caches(encoder):
    small = bpe.Encoder(encoder.compiled, room=3)
    for text in ("x" * 5000, "the " * 500 + "quick brown fox jumps", "ab" * 3000, "é" * 1000):
        assert small.encode(text) == encoder.library.encode(text, add_special_tokens=False).ids


def test_other_files_of_the_library():
    other = bpe.Encoder(bpe.compile_file(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("Hello  world, it's 2024!\n\n x", "aaaaaa", "日本 é<|endoftext|>z", ""):
        ids = other.library.encode(text, add_special_tokens=False).ids
        assert other.encode(text) == ids
        got = decoder_of(other.compiled).decode(pa.array([ids], pa.list_(pa.int32())))
        assert got.to_pylist() == [other.library.decode(ids, skip_special_tokens=False)]


def expected_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_op13_matches_the_library(spark, sf_docs, encoder):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_bpe(spark, SF).collect()}
    assert got == {d[0]: expected_row(encoder.library, d[1]) for d in sf_docs}


def test_odd_tables(spark, odd_docs, no_docs, encoder):
    both = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH)
    got = sorted((r["id"] is None, r["id"] or 0, r["ids"], r["decoded"]) for r in both.collect())
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    ids = [(i, encoder.library.encode(t, add_special_tokens=False).ids) for i, t in texts]
    assert got == sorted((i is None, i or 0, x, encoder.library.decode(x, skip_special_tokens=False)) for i, x in ids)
    assert bpe.encode_texts(no_docs, PATH).count() == 0
    empty = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [320], "z")], "id int, ids array<int>, `decoded.old` string")
    assert [tuple(r) for r in bpe.decode_ids(empty, PATH).orderBy("id").collect()] == [(1, None, "x", None), (2, [], "y", ""), (3, [320], "z", "a</w>")]
