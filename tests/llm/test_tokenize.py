"""Encoding against the public library, and cases by hand."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.llm import tokenize

PATH = tokenize.vocabulary_path()
BPE = tokenize.load(PATH)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    ids, ends = BPE.encode_batch([text])
    return ids.tolist()


HARD = [
    "", " ", "  ", "a", "don't'll've'S 's''s 're're", "it's  the\n\n 'll  x", "\t\n x y　", "<|endoftext|>", "\x00a\x00\x00", "x" * 3000, "'", "''", " 's", "!'s", "a's's'tt", "\r\n \r\n",
    "日本語のテスト。" * 40, "١٢٣ ½ ⅷ x²", "नमस्ते दुनिया", "👩‍👩‍👧 é é", "  \x85 \x1c\x1f", "a" + " " * 70 + "b", "'re", "'re're'", "1's", "I'M 'M",
]


@pytest.mark.parametrize("text", HARD)
def test_like_the_library(library, text):
    assert ids_of(text) == library.encode_ordinary(text)
    assert BPE.decode(ids_of(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abct's !.\n\t  é1½日ड'रे'llvemd"), max_size=40), max_size=8))
def test_batches_like_the_library(texts):
    import public_tokenizers as P
    import tiktoken

    if not hasattr(test_batches_like_the_library, "lib"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
        test_batches_like_the_library.lib = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, ends = BPE.encode_batch(texts)
    begin = 0
    for t, e in zip(texts, ends.tolist()):
        assert ids[begin:e].tolist() == test_batches_like_the_library.lib.encode_ordinary(t)
        begin = e


def test_scan_like_a_loop():
    random.seed(3)
    for n in (0, 1, 63, 64, 65, 1000):
        s = np.array([random.randrange(7) for _ in range(n)], np.uint8)
        state, want = 0, []
        for x in s:
            want.append(state)
            state = int(tokenize._STEP[x, state])
        assert tokenize.scan_states(s).tolist() == want


def test_portions_cut_safely(library):
    random.seed(4)
    texts = ["".join(random.choice("ab' \n.é") for _ in range(random.randint(0, 400))) for _ in range(30)] + [None, ""]
    got = [[] for _ in texts]
    for strings, owners in tokenize.portions(texts, 50):
        ids, ends = BPE.encode_batch(strings)
        begin = 0
        for k, e in zip(owners, ends.tolist()):
            got[k] += ids[begin:e].tolist()
            begin = e
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_full_cache_and_shared_prints():
    small = tokenize.ByteBpe(PATH, cache_items=3)
    for _ in range(2):
        for t in ("one two three four five six", "seven eight", "one two"):
            assert small.encode_batch([t])[0].tolist() == ids_of(t)
    ids, ends, starts = small.encode_batch(["ab cd", "x  y"], with_starts=True)
    assert starts.tolist()[:1] == [0] and len(starts) == len(ids) and starts.max() <= 5


def test_documents(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (3, "a b", "x"), (4, " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in tokenize.encode_documents(df).collect())
    assert got == sorted([(1, tuple(ids_of("a b"))), (2, ()), (3, ()), (3, tuple(ids_of("a b"))), (4, tuple(ids_of(" \n")))])
    assert tokenize.encode_documents(df.limit(0)).count() == 0
    assert [r["n"] for r in df.select(tokenize.token_count(df["text"]).alias("n")).collect()] == [len(ids_of(r[1] or "")) for r in rows]
