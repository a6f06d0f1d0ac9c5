from __future__ import annotations

import re

import brute
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, langid, sharding, substring_dedup, token_counts
from tessera.llm import shingles as S

PATH = public_tokenizers.path("byte_bpe_50k.json")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x1cé.,", max_size=60)), max_size=8)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_shingles_are_those_of_the_words(ts):
    got = []
    for first, last, words, offsets in S.blocks([None if t is None else t.encode() for t in ts]):
        h, at = S.shingles(words, offsets)
        got += [len(S.distinct(h[at[i] : at[i + 1]])) for i in range(last - first)]
    assert got == [len(brute.shingle_set(t)) for t in ts]


def test_equal_words_hash_alike_wherever_they_stand():
    a, b = S.words(b"One two\tTHREE two")[2], S.words(b"three\n\ntwo")[2]
    assert a[1] == a[3] == b[1] and a[2] == b[0] and len({*a.tolist()}) == 3


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = b" ".join(b"w%d" % (i % 50) for i in range(4000)) + b" " + b"z" * 5000 + b"  tail \n"
    whole = S.words(text)
    monkeypatch.setattr(S, "BLOCK_BYTES", 1000)
    starts, stops, hashes = S.words(text)
    assert [text[a:b] for a, b in zip(starts, stops, strict=True)] == text.split()
    same = np.flatnonzero((stops - starts) < 1000)
    assert (hashes[same] == whole[2][same]).all() and len(whole[2]) == len(text.split())


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common, family = rng.integers(0, 2**63, 600, dtype=np.uint64), S.families(400, 5)
    x, y = np.r_[common, rng.integers(0, 2**63, 100, dtype=np.uint64)], np.r_[common, rng.integers(0, 2**63, 100, dtype=np.uint64)]
    m = [S.minima(v, np.array([0, len(v)]), family)[0] for v in (x, y)]
    assert abs((m[0] == m[1]).mean() - 0.75) < 0.08


@given(st.text(alphabet="<|\\n>im_end\n x", max_size=40), st.text(alphabet="<|\\n>\nx", max_size=10))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_marks(text, role):
    rendered, start, stop = chat.render(role, text)
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    m = chat._MESSAGE.fullmatch(rendered)
    assert chat.unescape(m[1]) == role and chat.unescape(m[2]) == text
    learned, a, b = chat.render("assistant", text)
    assert chat.unescape(learned[a:b]) == text and start == stop


def test_kneser_ney_probabilities_sum_to_one():
    words = ["banana", "bandana", "ban", "nab", "anna"] * 3 + ["cab"]
    letters = sorted({c for w in words for c in w})
    model = langid.CharModel.fit(words, 3, len(letters) + 1)
    for prefix in ("", "b", "ba", "nz", "zz"):
        total = 0.0
        for c in [*letters, None, "z"]:
            hashes, place, _ = langid._positions([prefix + (c or "")], 3)
            total += 2.0 ** -model.bits(hashes, place)[len(prefix) + 1]
        assert abs(total - 1.0 - 2.0 ** -_floor(model, prefix)) < 1e-5


def _floor(model, prefix):
    hashes, place, _ = langid._positions([prefix + "z"], 3)
    return model.bits(hashes, place)[len(prefix) + 1]


def test_pre_tokens_of_all_stable_code_points():
    from tokenizers import pre_tokenizers

    counter = token_counts.TokenCounter(PATH)
    assert counter.two_tier
    stable, pre = re.compile(f"[{token_counts.STABLE}]"), pre_tokenizers.ByteLevel(add_prefix_space=False)
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000 and stable.match(chr(c))]
        text = "".join(f"a{c}1{c}! {c} " for c in chars)
        assert [len(p) for p in counter.wide.findall(text)] == [b - a for _, (a, b) in pre.pre_tokenize_str(text)], hex(start)


@given(st.text(alphabet="ab 1'sré\n\t!<|endoftext|>\x1c　漢\U00010330", max_size=60))
@settings(max_examples=300, deadline=None)
def test_token_counts_of_any_text(text):
    counter = _counter()
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


_COUNTERS = []


def _counter():
    if not _COUNTERS:
        _COUNTERS.append(token_counts.TokenCounter(PATH, {"ab": 1, " ": 1}, room=5))
    return _COUNTERS[0]


def test_other_tokenizers_go_to_the_library():
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    text = "Hello there,  WORLD"
    assert not counter.two_tier and counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_fisher_yates_permutes():
    assert sorted(sharding.fisher_yates(100, [1, 2])) == list(range(100))
    assert list(sharding.fisher_yates(9, [1, 2])) == list(sharding.fisher_yates(9, [1, 2])) != list(range(9))


def test_spans_take_three_sentences_and_twenty_words():
    text = b"A b c. " * 3 + b"d e f g h i j k l m n. o p q. R s t u.\nlast line here and now we end it all"
    a, b, n, hi, lo = substring_dedup.spans(text)
    assert (n >= 20).all() and len({*hi.tolist()}) == len(hi)
    assert [text[x:y].count(b".") >= 3 or text[x:y].count(b"\n") for x, y in zip(a, b, strict=True)]
    assert all(x == 0 or text[x - 1 : x] in b" \n" for x in a)
