import random
import re

import numpy as np

from keyfold.llm import ngram_join as N
from keyfold.llm.bytesops import column, flat
from keyfold.llm.graph import components
from keyfold.llm.scratch import Scratch


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    """Originals, chains of edits, copies, documents that share a passage or a line, short and empty texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage, out = [word() for _ in range(60)], []
    for _ in range(40):
        w = [word() for _ in range(rng.choice([5, 6, 9, 30, 120, 400]))]
        if rng.random() < 0.6:
            w += passage[: rng.choice([10, 30, 60])]
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    out += ["", None, " ", "a b", "A  B", "a b c d", "a b c d e", "z" * 5000, " ".join(passage)] + [out[0]] * 3
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_match_brute_force(documents):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_components(documents(*rows)).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in N.keep_one(documents(*rows)).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_hub_of_near_copies_with_stragglers(documents):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: i % 20] + [f"x{i}"] + base[i % 20 + 1 :])) for i in range(60)] + [(100 + k, " ".join(base[:150] + [f"y{k}{j}" for j in range(50)])) for k in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_components(documents(*rows)).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v")]
    got = N.link_components(documents(*rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "2"), ("None", "None")]
    assert N.link_components(documents(*rows).limit(0)).count() == 0


def test_shingle_hashes_are_one_to_one():
    import pyarrow as pa

    rows = [t for _, t in corpus()]
    data, offs = flat(column(pa.record_batch({"t": pa.array(rows)}), "t"))
    value, row = N.shingles(data, offs)
    assert [len(p) for p in N.distinct_sets(value, row, len(rows))] == [len(shingle_set(t)) for t in rows]
    assert len(np.unique(value)) == len({s for t in rows for s in shingle_set(t)})


def test_long_chains_contract(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_places_of_any_width_come_back():
    for places in ([], [0], [0, 0, 3, 258, 258], [5, 261, 70_000], list(range(0, 5000, 7))):
        assert N.unpack_places(N.pack_places(np.array(places, np.int64))).tolist() == places


def test_counts_of_shared_shingles(documents):
    rows = corpus() + [(k, f"tiny{k % 50}") for k in range(1000, 3000)]
    sets = [(i, shingle_set(t)) for i, t in rows]
    met = {}
    for _, s in sets:
        for x in s:
            met[x] = met.get(x, 0) + 1
    want = sorted((i, len(s), sum(met[x] > 1 for x in s)) for i, s in sets)
    got = N.counted(documents(*rows).repartition(3).select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.n, r.m) for r in got) == want
