import hashlib
import random
import re

import numpy as np

from keyfold.llm import exact_dedup as E

ROWS = [(5, "a b"), (3, "a\t\nb"), (9, "a  b "), (1, None), (2, ""), (4, " "), (6, "\n\n"), (7, "x" * 50_000), (8, "x" * 50_000), (8, "x" * 50_000), (None, "lone"), (None, "a b")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_match_brute_force(documents):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_groups(documents(*ROWS)).collect() if r.doc_id is not None)
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if norm(u) == norm(t)]
        keep = min(j for j in same if j is not None) if any(j is not None for j in same) else None
        if i is not None:
            want.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want)


def test_keep_first_keeps_one_row_and_all_columns(documents):
    df = documents(*ROWS)
    kept = E.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "9", "1", "4", "7", "None"])


def test_empty_table(documents, spark):
    empty = documents(*ROWS).limit(0)
    assert E.exact_groups(empty).count() == 0 and E.keep_first(empty).count() == 0


def test_filters_merge_without_loss():
    rng = random.Random(3)
    parts = [[rng.randrange(1 << 20) for _ in range(n)] for n in (1, 50, 400, 0, 400)]
    filters, every = [], []
    for p in parts:
        if p:
            keys, counts = np.unique(np.array(p, np.uint64), return_counts=True)
            filters.append(E.CountingQuotientFilter.unpack(E.CountingQuotientFilter.build(keys, counts, 20).pack()))
            every += p
    keys, counts = E.CountingQuotientFilter.merge(filters).entries()
    want = np.unique(np.array(every, np.uint64), return_counts=True)
    assert (keys == want[0]).all() and (counts == want[1]).all()
