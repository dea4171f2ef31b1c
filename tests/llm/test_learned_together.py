"""New pre-tokens reach the model of op10 joined, not one by one, and keep their ids."""

import numpy as np

from assay.llm import tokenbin


def test_pre_tokens_are_learned_together(monkeypatch):
    import public_tokenizers as P
    path = P.path(tokenbin.VOCABULARY)
    hf, _, known = tokenbin.tokenizer(path)
    calls, tokenize = [], known.tokenize
    monkeypatch.setattr(known, "tokenize", lambda x: calls.append(x) or tokenize(x))
    monkeypatch.setattr(known, "known", {})
    monkeypatch.setattr(known, "old", {})
    texts = [" ".join(f"zq{i * j}x é{i}" for i in range(200)) for j in range(1, 9)] + ["", "\0 \0\0 a\0b", "tok<|endoftext|> x", "x" * 200]
    for most in (tokenbin.REMEMBERED, 300):  # the second forgets between the texts
        monkeypatch.setattr(tokenbin, "REMEMBERED", most)
        for at_once in (tokenbin.AT_ONCE, 100):
            monkeypatch.setattr(tokenbin, "AT_ONCE", at_once)
            got = [np.frombuffer(ids, "<u4").tolist() for ids in tokenbin.encode_all(texts, path)]
            assert got == [hf.encode(text, add_special_tokens=False).ids for text in texts]
            if len(calls) and most > 300 and at_once > 100:
                assert len(calls) < 40  # some 1,900 pre-tokens
    assert "x" * 200 not in known.known and len(known.known) < 300 + 1900
