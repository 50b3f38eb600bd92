"""Joins of chunks: real ids are compared, windows grow where they must, texts are encoded whole where nothing agrees."""

import random
from types import SimpleNamespace

import numpy as np

from feedloom.llm import chunk_bpe, common

WORD, BYTE = (common.public_tokenizer(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


class Chained:
    """A toy tokenizer: a word that starts with j is one token with the word behind it, so ids depend on words far before."""

    def __init__(self):
        self.vocab = {}

    def get_added_tokens_decoder(self):
        return {}

    def encode(self, text, add_special_tokens=False):
        words, ids, at = text.split(), [], 0
        while at < len(words):
            n = 2 if words[at].startswith("j") and at + 1 < len(words) else 1
            ids.append(self.vocab.setdefault(tuple(words[at : at + n]), len(self.vocab)))
            at += n
        return SimpleNamespace(ids=ids)

    def encode_batch_fast(self, texts, add_special_tokens=False):
        return [self.encode(t) for t in texts]


def prose(rng, n, first="abdefghij"):
    return " ".join(rng.choice(first) + "".join(rng.choice("aeiou") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_windows_grow_until_ids_agree():
    rng = random.Random(1)
    tok = Chained()
    encoder = chunk_bpe.ChunkEncoder("", tok=tok)
    texts = [prose(rng, 900, "abjjjj") for _ in range(20)] + [prose(rng, 900) for _ in range(20)]
    got = encoder.encode_many(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t).ids for t in texts]
    assert encoder.joins > 60 and encoder.grown > 20 and encoder.whole < len(texts)


def test_real_tokenizers_agree_and_reuse(monkeypatch):
    rng = random.Random(2)
    shared = prose(rng, 3000)
    texts = [prose(rng, 300) + " " + shared + "\n" + prose(rng, 300) for _ in range(15)] + ["x" * 3000 + " " + "y" * 3000, "a  b \n\n c " * 800, "é ́" * 900, "don't 'twas " * 400]
    for path, by_words in ((WORD, False), (WORD, True), (BYTE, False)):
        encoder = chunk_bpe.ChunkEncoder(path, by_words)
        for part in (texts[:8], texts[8:]):
            got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(part)]
            assert got == [encoder.tok.encode(t, add_special_tokens=False).ids for t in part]
        assert encoder.reused > 100 and encoder.joins > 150 and encoder.whole <= 4


def test_a_chunk_whose_ids_are_wrong_is_not_joined():
    """The join compares with what the chunk has, not with a second look at the same words."""
    rng = random.Random(3)
    text = prose(rng, 2000)
    encoder = chunk_bpe.ChunkEncoder(WORD, by_words=True)
    chunks = chunk_bpe.chunks_of(text)
    encoder.store = {c: np.arange(5, dtype="<u4").tobytes() for c in chunks}
    assert np.frombuffer(encoder.encode_many([text])[0], "<u4").tolist() == encoder.tok.encode(text, add_special_tokens=False).ids
    assert encoder.whole == 1
