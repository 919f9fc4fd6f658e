"""The packing's encoder keeps the words it met last, within its bound, when it forgets others."""

import pytest

pytest.importorskip("tidemark.llm.packing")
from tidemark.llm import packing


def test_frequent_words_are_encoded_once_though_others_are_forgotten(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHE", 8)
    encoder, learned, most = packing.Encoder(path), [], 0
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learned.extend(words), learn(words)))
    texts = [f"common words stay {'abcdefghijklmnopqrstuvwxyz'[i % 26]}xq{'abcdefghijkl'[i % 12]}" for i in range(60)]
    texts.insert(30, "a <|endoftext|> b")
    got = []
    for t in texts:
        got += encoder.encode([t])
        most = max(most, len(encoder.known) + len(encoder.before))
    assert learned.count("common") == learned.count("stay") == 1 and most <= 16
    import numpy as np

    assert got == [np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
