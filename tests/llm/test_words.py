"""Word hashes and the piece cache on words that fool polynomial hashes, and on very long ones."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tutelage.llm import minhash, tokens, words
from tutelage.llm.setup import TOKENIZER, prepare
from tutelage.llm.tokens import PieceTokenizer


def balanced_pair(doublings=10):
    """Two words whose difference vanishes in every polynomial modulo a power of two."""
    one, two = "a", "b"
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


def hashes(texts, seed=0):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return words.hash_words(data, np.concatenate([[0], ends[:-1]]), ends, seed)


def test_words_of_any_length_have_their_own_hash():
    rng = np.random.default_rng(3)
    texts = sorted({"".join(rng.choice(list("ab"), n)) for n in [*range(1, 20), 63, 64, 65, 200] for _ in range(400)}
                   | {"a" * n for n in range(1, 400)} | set(balanced_pair()) | set(balanced_pair(6)) | set(balanced_pair(3)))
    own = hashes(texts)
    assert len(set(own.tolist())) == len(texts)
    assert not set(own.tolist()) & set(hashes(texts, 1).tolist())
    # the place of a word does not matter
    order = rng.permutation(len(texts))
    assert (hashes([texts[i] for i in order]) == own[order]).all()


def test_no_two_of_many_long_words_share_a_hash():
    rng = np.random.default_rng(4)
    letters = rng.integers(97, 99, (100_000, 48)).astype(np.uint8)
    kinds = np.unique(letters, axis=0)
    ends = np.arange(1, len(kinds) + 1) * 48
    assert len(np.unique(words.hash_words(kinds.ravel(), ends - 48, ends))) == len(kinds)


@pytest.mark.parametrize("first_hash", [None, 5])
def test_ids_of_colliding_pieces(monkeypatch, first_hash):
    """Also where all first hashes are equal: the second one tells pieces apart."""
    if first_hash is not None:
        plain = words.hash_words
        monkeypatch.setattr(tokens, "hash_words", lambda d, s, e, seed=0: (
            plain(d, s, e, seed) if seed else np.full(len(s), first_hash, np.uint64)))
    one, two = balanced_pair()
    texts = [one, two, f"{one} {two}", "a bc a", "bc", None, "x" * 5000]
    coder = PieceTokenizer(TOKENIZER)
    ids, first = coder.encode(pa.array(texts))
    library = Tokenizer.from_file(TOKENIZER)
    for i, text in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_words_that_fool_polynomials_are_no_near_duplicates(spark):
    prepare(spark)
    one, two = balanced_pair()
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x"), (4, f"{two} x"), (5, one.upper())],
                                 "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2, percent=80).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_one_large_object_a_worker():
    from tutelage.llm.worker import kept

    first = kept("a", list)
    assert kept("a", list) is first
    kept("b", list)
    assert kept("a", list) is not first
