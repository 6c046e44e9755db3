"""Blocks of op4's encoder: few for a batch, and of any size with the same ids."""

import random

import public_tokenizers
import pyarrow as pa

from netloom.llm import token_files


def test_blocks(monkeypatch):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghéz") for _ in range(r.randrange(1, 9))) + r.choice(["", "", ",", ".", "'s"]) for _ in range(3000)]
    texts = [" ".join(r.choices(vocab, k=r.randrange(1, 400))) for _ in range(40)] + [None, "", "two  spaces", "a\nb c"]
    tok = token_files.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    want = [tok._tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (50, 3000, token_files.TOGETHER):
        monkeypatch.setattr(token_files, "TOGETHER", size)
        ids, n = tok.encode_all(pa.array(texts))
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    # 10 MB are one block, whose distinct words are told apart once.
    calls, plain = [], tok._plain
    monkeypatch.setattr(tok, "_plain", lambda *a: calls.append(1) or plain(*a))
    part = " ".join(r.choices(vocab, k=4000))
    tok.encode_all(pa.array([part] * (10_000_000 // len(part.encode()))))
    assert len(calls) == 1
