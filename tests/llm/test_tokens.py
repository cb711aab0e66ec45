import random
from pathlib import Path

import public_tokenizers
import pytest

from mosaiq.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def source():
    return Path(PATH).read_text()


@pytest.fixture(scope="module")
def library(source):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


def test_proved_strings_are_single_tokens(source, library):
    whole = tokens.prove_whole(source)
    assert len(whole) > 40_000
    rng = random.Random(1)
    for s in rng.sample(whole, 500):
        pieces = [p for p, _ in library.pre_tokenizer.pre_tokenize_str(s)]
        assert sum(len(library.model.tokenize(p)) for p in pieces) == 1 or len(pieces) > 1


def test_counts_equal_the_library(source, library):
    counter = tokens.Counter(tokens.prove_whole(source), source, tokens.proved(source)[1])
    rng = random.Random(2)
    signs = "aB é9'sstre .,!?\n\t\r\x0b\x0c\x1c\x85\xa0 　​½²_́\U0001f600ß日|<>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "x" * 5000, " " * 3000, "don't we'll I'M"]
    for t in texts:
        assert counter.tokens(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_documents_and_hard_inputs(documents, hard, empty, library):
    for df in (documents, hard):
        texts = sorted(((r.text or "") for r in df.collect()))
        found = tokens.count_tokens(df, PATH, limit=1024).collect()
        want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
        assert sorted((r.n_bytes, r.n_tokens) for r in found) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in found)
    assert tokens.count_tokens(empty, PATH, limit=1024).collect() == []


def test_the_cut_is_proved_for_nearly_all_code_points(source, library):
    other = tokens.proved(source)[1]
    assert sum(b - a + 1 for a, b in other if b <= tokens.MOST_PROVED) < 20_000 and len(other) < 200
    outside = lambda c: not any(a <= ord(c) <= b for a, b in other)
    assert all(map(outside, "aé“”’—…ждя日本語한العربية\u0915\u093f\U0001f600€"))
    rng, counter = random.Random(3), tokens.Counter(*tokens.proved(source)[:1], source, other)
    points = [k for k in range(0x250, 0x40000) if not 0xD800 <= k < 0xE000]
    for _ in range(3000):
        text = "".join(rng.choice([chr(rng.choice(points)), rng.choice(" a1'!\u3000\n")]) for _ in range(20))
        assert counter.tokens(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_other_scripts_take_the_shortcut(source, library):
    whole, other = tokens.proved(source)
    words = "the quick brown fox jumps over “lazy” dogs — it’s fine … быть или не быть 日本 語".split()
    rng = random.Random(4)
    text = " ".join(rng.choice(words) for _ in range(20_000))
    counter = tokens.Counter(whole, source, other)
    assert counter.tokens(text) == len(library.encode(text, add_special_tokens=False).ids)
    # Each distinct pre-token is merged once at most, and those that were proved never.
    distinct = set(counter.cut(text))
    assert counter.merged == len(distinct - set(whole)) < 30
    before = counter.merged
    odd = text + " \U000e0041"
    assert counter.tokens(odd) == len(library.encode(odd, add_special_tokens=False).ids) and counter.merged <= before + 2
