import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keyfold.llm import packing as P
from keyfold.llm.queries import tokenizer_path

TEXTS = [(1, "Hello, world! it's 12 o'clock"), (2, None), (3, ""), (4, "word " * 9000), (5, "É à ñ <|endoftext|> done. ..."), (6, "x" * 20_000), (1, "Hello, world! it's 12 o'clock"), (7, "a b c　d")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_pieces_and_sequences(documents, tokenizer):
    rows = P.pack_documents(documents(*TEXTS), tokenizer_path(), with_ids=True).collect()
    want = []
    for i, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 4096) + 1


def test_every_capacity_binds():
    lengths = np.array([10, 10, 10, 9, 5, 5, 1, 1, 1, 1])
    for rule in ("norm", "dot"):
        s, o = P.best_fit(lengths, np.array([20.0, 3, 250.0]), np.array([1.0, 1.0, 1.0]), rule)
        for k in set(s):
            mine = lengths[s == k]
            assert mine.sum() <= 20 and len(mine) <= 3 and (mine**2).sum() <= 250
    with pytest.raises(ValueError):
        P.best_fit(np.array([30]), np.array([20.0, 3, 1e9]), np.ones(3))


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4097, 5000)
    s, _ = P.best_fit(lengths, np.array([4096.0, 4096, 4096.0**2]), np.array([1.0, 0.05, 0.05]))
    assert len(set(s)) <= 1.02 * lengths.sum() / 4096 + 1


def test_empty(documents):
    assert P.pack_documents(documents((1, "a")).limit(0), tokenizer_path()).count() == 0


def test_words_share_entries_with_any_tail_of_marks(tokenizer):
    coder = P.WordEncoder(tokenizer_path())
    texts = ["alpha beta gamma.", "alpha. beta, gamma! Alpha", "", "beta. alpha, alpha! gamma, beta! gamma."]
    odd = ["don't. 'tis, 12. 3.5, é. à, naïve! <b>. x<|endoftext|>. ... .a ,b. a.b. a.. b?! c# d$ e% f& 中. ٣, ﬁ. K. é. á, _. -. z-.", "a.\tb,　c. d!\nE.\x1fF, \x00g."]
    rng = np.random.default_rng(3)
    odd += ["".join(rng.choice(list("aZé9'<.,;:!?*#$%&- \ń中"), 400)) for _ in range(20)]
    for some, entries in ((texts, 6), (odd, None)):  # three stems and three marks
        data = [t.encode() for t in some]
        ids, counts = coder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert entries is None or len(coder.keys) == entries
