import numpy as np
import pytest

from keyfold.llm import rptree as R

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, rep string"


def vectors(n=900, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(scale=0.05 if i % 2 else 0.0, size=dim)
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), None, None))
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), rows[0][1][:5]]
    rows += [(n + k, v, 0, None, None) for k, v in enumerate(bad)]
    return rows + [(n + 50, rows[0][1], None, None, None), (n + 60, [1e30 * x for x in rows[3][1]], rows[3][2], None, None), (None, rows[0][1], 0, None, None)]


def brute(rows):
    sound = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    at, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for k, a in enumerate(sound):
        for b in sound[k + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    at[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in at}


@pytest.mark.parametrize("sizes", [(20_000, 256), (120, 40)])
def test_links_match_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(R, "GROUP", sizes[0])
    monkeypatch.setattr(R, "LEAF", sizes[1])
    rows = vectors()
    links, component = brute(rows)
    got = R.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.9 * sum(links.values()) > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(r.component_id == component[r.vec_id] for r in got) >= 0.95 * len(rows)


def test_hot_class_of_equal_vectors_and_empty(spark):
    rows = [(i, [1.0, 2.0], 0, None, None) for i in range(300)] + [(300, [2.0, 4.0], 0, None, None)]
    got = R.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_links == 300 and r.component_id == 0 for r in got) and sum(r.kept for r in got) == 1
    assert R.near_vectors(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2048, 500])
def test_dense_groups_of_different_vectors_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(R, "TILE", tile, raising=False)
    rng, dim = np.random.default_rng(5), 32
    parts = [rng.normal(size=(600, dim))]
    for size, noise in ((2600, 0.27), (1500, 0.08), (40, 0.2)):  # borderline, tight and small groups
        centre = rng.normal(size=dim)
        centre /= np.sqrt(centre @ centre)
        parts.append(centre + noise / np.sqrt(dim) * rng.normal(size=(size, dim)))
    x = np.concatenate(parts).astype(np.float32)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    rows = [(i, v.tolist(), 0, None, None) for i, v in enumerate(x)]
    rows += [(len(x) + i, x[700].tolist(), 0, None, None) for i in range(3)]  # a class of four
    want = want + 3 * (unit @ unit[700] >= 0.93)
    got = {r.vec_id: r.n_links for r in R.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
