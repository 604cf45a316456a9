import hashlib
import random
from collections import Counter

import numpy as np

from keyfold.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=60, length=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared, out = [text(length * 2) for _ in range(4)], []
    for i in range(n):
        t = text(rng.choice([0, 10, 39, 40, 150, 600]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += s[a : a + rng.randrange(10, 2 * length)] + text(rng.choice([0, 1, 30]))
        out.append((i, t))
    return out + [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "ab" * 90), (n + 4, out[5][1]), (n + 4, out[5][1]), (None, text(90))]


def result(df, length):
    return sorted((tuple(r) for r in S.remove_repeats(df, length=length).collect()), key=str)


def test_removal_matches_brute_force(documents):
    for seed in (1, 2):
        rows = rows_of(seed)
        assert result(documents(*rows), 40) == brute(rows, 40)


def test_hot_leaders_are_searched_across_shards(documents, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    rows = rows_of(3)
    assert result(documents(*rows), 40) == brute(rows, 40)


def test_kept_bytes_and_empty(documents):
    shared = "x" + "0123456789" * 5
    df = documents((1, "left " + shared + " right"), (2, shared))
    kept = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(df, length=40, with_bytes=True).collect()}
    assert kept == {1: b"left  right", 2: b""}
    assert S.remove_repeats(df.limit(0), length=40).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(5)
    text = np.array([rng.randrange(1, 4) for _ in range(300)] + [0], np.int64)
    order, rank = S.suffix_array(text)
    want = sorted(range(len(text)), key=lambda i: tuple(text[i:]))
    assert order.tolist() == want and (order[rank] == np.arange(len(text))).all()
    lcp = S.kasai(text, order, rank, np.array([0, 150]), np.array([150, 151]), 20)
    for r in range(1, len(text)):
        a, b = want[r - 1], want[r]
        n = 0
        while n < 20 and a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert lcp[b] == n


def test_windows_of_long_texts_have_one_leader_each(monkeypatch):
    data = np.frombuffer(("".join(random.Random(6).choice("abcd") for _ in range(3000))).encode(), np.uint8)
    whole = S.leaders(data, np.array([0, 3000]), 40, 8)
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    parts = S.leaders(data, np.array([0, 3000]), 40, 8)
    spread = lambda x: [int(fp) for a, b, fp in zip(x[1], x[2], x[3], strict=True) for _ in range(a, b + 1)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == 2961


def by_common_prefixes(segments, length):
    text = np.array([c for s in segments for c in [*(b + 1 for b in s), 0]], np.int64)
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, rank = S.suffix_array(text)
    lcp = S.kasai(text, order, rank, starts, sizes - length + 1, length)
    after = lambda i: rank[i] + 1 < len(text) and lcp[order[rank[i] + 1]] >= length
    return [[bool(lcp[i] >= length or after(i)) for i in range(a, a + n - length + 1)] for a, n in zip(starts, sizes, strict=True)]


def test_sorting_stops_at_the_length_of_a_window(monkeypatch):
    rng = random.Random(7)
    parts = [bytes(rng.choice(b"abc") for _ in range(60)) for _ in range(5)]
    segments = list(dict.fromkeys(rng.choice(parts)[rng.randrange(9) :] + rng.choice(parts)[: rng.randrange(40)] for _ in range(40)))
    segments += [b"a" * 200, b"ab" * 90, b"a" * 45]
    rounds = []
    number = S._number
    monkeypatch.setattr(S, "_number", lambda *x: rounds.append(1) or number(*x))
    for length in (5, 7, 40, 41, 45):
        want = by_common_prefixes(segments, length)
        rounds.clear()
        assert [x.tolist() for x in S.repeated_starts(segments, length)] == want
        assert len(rounds) <= 4  # 7, 14, 28 and at most 45 bytes; the order of all of them takes more
