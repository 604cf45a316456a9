import hashlib
from collections import Counter

from keyfold.llm import mixing as M


def fill(sizes, weights, share=1.5, rate=2.0):
    """Targets by raising one source at a time to its bound until none is above."""
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(free.values()) if free else 0
        over = [s for s in free if level * weights[s] > rate * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **{s: level * w for s, w in free.items()}}
        fixed |= {s: rate * sizes[s] for s in over}


def make(n):
    rows = []
    for i in range(n):
        source = [None, "b", "a", "c", "é", "Z"][i % 6] if i % 3 else "b"
        rows.append((i, " ".join(["w"] * (i % 13)) if i % 11 else None, source))
    return rows


def test_targets_and_takes(documents):
    rows = make(2000)
    df = documents(*rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    planned = M.planned(df).collect()
    taken = Counter()
    for r in planned:
        assert abs(r.kf_target - want[r.source]) < 1e-6 and r.kf_source_size == sizes[r.source]
        assert 0 <= r.kf_copies <= 2
        rate = r.kf_target / r.kf_source_size
        u = int(hashlib.md5(f"{M.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        assert r.kf_copies == int(rate) + (u < rate - int(rate))
        taken[r.source] += r.kf_size * r.kf_copies
    for s in sizes:
        assert abs(taken[s] - want[s]) < 0.15 * want[s] + 60
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_mix_repeats_rows_and_keeps_columns(documents):
    df = documents(*make(300))
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    want = {r.doc_id: r.kf_copies for r in M.planned(df).collect() if r.kf_copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    assert Counter(r.doc_id for r in mixed.repartition(7).collect()) == want


def test_edges(documents):
    assert M.mix(documents((1, "a")).limit(0)).count() == 0
    assert M.mix(documents((1, None), (2, " "))).count() == 0
    assert [r.kf_copies for r in M.planned(documents((1, "a b", None))).collect()] in ([1], [2])
