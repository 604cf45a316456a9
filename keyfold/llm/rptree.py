"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Equal vectors of one label form a class with a weight; classes are what the trees hold. Groups of one label and
dimension that are larger than ``GROUP`` classes are first split by tops of trees fitted on a bounded sample
(``SAMPLE`` vectors or 32 for each GROUP of classes, never more than ``SAMPLE_BYTES``); every class is then routed through them. What arrives in one part is split on in numpy:
random direction, median of the projections, and classes whose projection lies within ``SPILL`` quantiles of the
median go to both sides, until a leaf has at most ``LEAF`` classes. Leaves compare all their members in double precision (or see
from their centre that any two link) and give links that become components by star contraction.

The forest only has to connect a component; its links are then counted exactly, every member against every other, so groups of
any density lose none. Components of at most ``TILE`` classes are compared whole. Larger ones are dealt into tiles with a centre and
a radius: two tiles whose centres and radii put all their pairs within the angle of ``least`` add each other's weight unseen, all
others are compared by matrix products, a task for each two tiles. No list of pairs exists. What can be lost are links between
vectors that no chain of links found by the ten trees connects.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
nothing; vectors of different length do not link; rows that repeat an id are vectors of their own with that id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import mix64
from .graph import components
from .scratch import Scratch

LEAST, TREES, LEAF, SPILL, GROUP, SAMPLE, SAMPLE_BYTES = 0.93, 10, 256, 0.06, 20_000, 20_000, 64 << 20
TILE, TILES, TILE_VALUES = 2048, 16, 4_000_000


def _direction(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed & ((1 << 63) - 1)).normal(size=dim)


def _child(seed: int, side: int) -> int:
    return int(mix64(np.array([(seed * 2 + side) & ((1 << 64) - 1)], np.uint64))[0])


def split(values: np.ndarray) -> tuple[float, float, float] | None:
    """(lower edge, median, upper edge) of the overlap, or None where the projections are all the same."""
    low, mid, high = np.quantile(values, [0.5 - SPILL, 0.5, 0.5 + SPILL])
    if values.min() == values.max() or (values <= high).all() or (values >= low).all():
        return None
    return float(low), float(mid), float(high)


def leaves(x: np.ndarray, seed: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(leaf key, rows) of a tree that splits until at most ``most`` rows are left; rows in an overlap occur in both."""
    out, todo = [], [(seed, np.arange(len(x)))]
    while todo:
        key, rows = todo.pop()
        cut = None
        if len(rows) > most:
            for again in range(4):
                values = x[rows] @ _direction(key + again, x.shape[1])
                if cut := split(values):
                    break
        if cut is None:
            out.append((key, rows))
        else:
            todo += [(_child(key, 0), rows[values <= cut[2]]), (_child(key, 1), rows[values >= cut[0]])]
    return out


def fit_tops(samples: dict, share: float) -> dict:
    """For each group, the tops of its trees: {(label, dim): [{node: (low, high)}]}; directions follow from the nodes' keys."""
    tops = {}
    for (label, dim), x in samples.items():
        tops[label, dim] = []
        for tree in range(TREES):
            nodes, todo = {}, [(_child(tree + 1, 7), np.arange(len(x)))]
            while todo:
                key, rows = todo.pop()
                if len(rows) / share <= GROUP or len(rows) < 16:
                    continue
                values = x[rows] @ _direction(key, dim)
                if cut := split(values):
                    nodes[key] = (cut[0], cut[2])
                    todo += [(_child(key, 0), rows[values <= cut[2]]), (_child(key, 1), rows[values >= cut[0]])]
            tops[label, dim].append(nodes)
    return tops


def _route(tops: dict):
    def run(batches):
        for batch in batches:
            reps, labels = batch.column("rep").to_numpy(), batch.column("label").to_pylist()
            vectors = [np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in batch.column("vector")]
            out = []
            for rep, label, v in zip(reps, labels, vectors, strict=True):
                unit = v / np.sqrt(v @ v)
                for tree in range(TREES):
                    todo, trees = [_child(tree + 1, 7)], tops.get((label, len(v)))
                    while todo:
                        key = todo.pop()
                        edge = trees[tree].get(key) if trees else None
                        if edge is None:
                            out.append((rep, tree, key))
                        else:
                            value = unit @ _direction(key, len(v))
                            todo += [_child(key, side) for side, inside in enumerate((value <= edge[1], value >= edge[0])) if inside]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            keys = np.array(cols[2], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(keys)], ["rep", "tree", "part"])

    return run


def _matrix(table: pa.Table) -> np.ndarray:
    x = np.stack([np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in table.column("vector")])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _joined(x: np.ndarray, least: float) -> np.ndarray:
    """For each row of ``x`` the smallest row that links reach among them."""
    centre = x.mean(0)
    size = np.sqrt(centre @ centre)
    if size > 0 and np.arccos(np.clip((x @ centre).min() / size, -1, 1)) <= np.arccos(least) / 2 - 1e-6:
        return np.zeros(len(x), np.int64)  # so close to their centre that any two of them link
    label, step = np.arange(len(x)), 1024
    while True:
        best = label.copy()
        for lo in range(0, len(x), step):
            linked = x[lo : lo + step] @ x.T >= least
            best[lo : lo + step] = np.minimum(label[lo : lo + step], np.where(linked, label[None], len(x)).min(1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _grow(least: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links (rep, hub) found in the leaves of one part of one tree."""
        reps, x = table.column("rep").to_numpy(), _matrix(table)
        seed = int.from_bytes(hashlib.sha256(repr([k.as_py() for k in key]).encode()).digest()[:8], "big")
        order = np.argsort(reps, kind="stable")
        reps, x = reps[order], x[order]
        found = [(reps[rows], reps[rows][_joined(x[rows], least)]) for _, rows in leaves(x, seed, LEAF)]
        rep, hub = (np.concatenate(c) for c in zip(*found, strict=True))
        pairs = np.unique(np.stack([rep, hub], 1)[rep != hub], axis=0)
        return pa.table({"rep": pairs[:, 0], "hub": pairs[:, 1]})

    return run


def _across(x: np.ndarray, y: np.ndarray, x_weight: np.ndarray, y_weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the rows of ``y`` that each row of ``x`` links to, and the other way round."""
    to_x, to_y, step = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), 1024
    for i in range(0, len(x), step):
        for j in range(0, len(y), step):
            linked = x[i : i + step] @ y[j : j + step].T >= least
            to_x[i : i + step] += np.where(linked, y_weight[None, j : j + step], 0).sum(1)
            to_y[j : j + step] += np.where(linked, x_weight[i : i + step, None], 0).sum(0)
    return to_x, to_y


def _inside(x: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Weight of the other rows that each row links to."""
    own = (x * x).sum(1) >= least
    return _across(x, x, weight, weight, least)[0] - np.where(own, weight, 0)


def _whole(least: float):
    """Links of all components of a bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        order = np.argsort(component, kind="stable")
        reps, weight, x = table.column("rep").to_numpy()[order], table.column("weight").to_numpy()[order], _matrix(table)[order]
        ends = np.append(np.flatnonzero(np.diff(component[order])) + 1, len(order))
        n = np.zeros(len(order), np.int64)
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
            n[lo:hi] = _inside(x[lo:hi], weight[lo:hi], least)
        return pa.table({"rep": reps, "n": n})

    return run


PACKED = pa.schema({"component": pa.int64(), "tile": pa.int32(), "reps": pa.list_(pa.int64()), "weights": pa.list_(pa.int64()), "units": pa.list_(pa.float64()), "centre": pa.list_(pa.float64()), "radius": pa.float64(), "total": pa.int64()})


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row of a tile's unit vectors, its centre and the largest angle to it."""
    reps, weight, x = table.column("rep").to_numpy(), table.column("weight").to_numpy(), _matrix(table)
    centre = x.mean(0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 0 else x[0]
    radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
    row = {"component": key[0].as_py(), "tile": key[1].as_py(), "reps": reps, "weights": weight, "units": x.ravel(), "centre": centre, "radius": radius, "total": int(weight.sum())}
    return pa.Table.from_pylist([row], PACKED)


def _cross(least: float):
    """Links between two tiles, or within one."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = []
        for k in range(table.num_rows):
            reps, weight, units = (np.asarray(table.column(c)[k].values) for c in ("reps", "weights", "units"))
            found.append((reps, weight, units.reshape(len(reps), -1)))
        if len(found) == 1:
            reps, weight, x = found[0]
            return pa.table({"rep": reps, "n": _inside(x, weight, least)})
        (a, a_weight, x), (b, b_weight, y) = found
        return pa.table({"rep": np.concatenate([a, b]), "n": np.concatenate(_across(x, y, a_weight, b_weight, least))})

    return run


def _tiled(members: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """rep and n of the members of components of more than ``TILE`` classes; rows of one rep add up."""
    per = F.greatest(F.lit(TILE), F.least(F.ceil(F.col("k") / TILES), (F.lit(TILE_VALUES) / F.size("vector")).cast("long")))
    dealt = members.withColumn("tile", F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / per)).cast("int"))
    schema = "component long, tile int, reps array<long>, weights array<long>, units array<double>, centre array<double>, radius double, total long"
    tiles = scratch.write(dealt.select("component", "tile", "rep", "weight", "vector").groupBy("component", "tile").applyInArrow(_pack, schema), "tiles")
    side = lambda name: tiles.select("component", F.col("tile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("centre", "radius", "total")])
    dot = F.aggregate(F.zip_with("lo_centre", "hi_centre", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    angle = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    limit = float(np.arccos(least))
    pairs = side("lo").join(side("hi"), "component").where("lo <= hi").withColumn("angle", angle)
    # a margin for rounding: what is this close to the bound is compared
    pairs = pairs.withColumn("sure", F.col("angle") + F.col("lo_radius") + F.col("hi_radius") <= limit - 1e-6)
    pairs = pairs.where(F.col("angle") - F.col("lo_radius") - F.col("hi_radius") <= limit + 1e-6).select("component", "lo", "hi", "lo_total", "hi_total", "sure")
    pairs = scratch.write(pairs, "tile_pairs")
    sure, open_ = pairs.where("sure"), pairs.where("not sure")
    given = sure.select("component", F.col("lo").alias("tile"), F.col("hi_total").alias("more"), (F.col("lo") == F.col("hi")).cast("int").alias("own"))
    given = given.unionByName(sure.where("lo < hi").select("component", F.col("hi").alias("tile"), F.col("lo_total").alias("more"), F.lit(0).alias("own")))
    given = given.groupBy("component", "tile").agg(F.sum("more").alias("more"), F.max("own").alias("own"))
    unseen = tiles.select("component", "tile", F.arrays_zip("reps", "weights").alias("all")).join(given, ["component", "tile"]).select("more", "own", F.inline("all"))
    unseen = unseen.select(F.col("reps").alias("rep"), (F.col("more") - F.col("own") * F.col("weights")).alias("n"))
    ends = open_.select("component", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("tile"))
    met = ends.join(tiles.select("component", "tile", "reps", "weights", "units"), ["component", "tile"]).drop("tile")
    return unseen.unionByName(met.groupBy("component", "lo", "hi").applyInArrow(_cross(least), "rep long, n long"))


def counted(classes: DataFrame, linked: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """rep and n, the weight of all other classes of its component that a class links to."""
    sizes = scratch.write(linked.groupBy("component").agg(F.count(F.lit(1)).alias("k")), "sizes")
    small, large = sizes.agg(F.sum(F.when(F.col("k") <= TILE, F.col("k")).otherwise(0)), F.max("k")).first()
    members = classes.select("rep", "weight", "vector").join(linked.select(F.col("node").alias("rep"), "component").join(sizes, "component"), "rep")
    bucket = F.pmod(F.xxhash64("component"), F.lit(1 + (small or 0) // TILE))
    whole = members.where(F.col("k") <= TILE).select(bucket.alias("bucket"), F.size("vector").alias("dim"), "component", "rep", "weight", "vector")
    out = whole.groupBy("bucket", "dim").applyInArrow(_whole(least), "rep long, n long")
    if large and large > TILE:
        out = out.unionByName(_tiled(members.where(F.col("k") > TILE), least, scratch))
    return out.groupBy("rep").agg(F.sum("n").alias("n"))


def _named(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes`` with a number ``rep`` of each that no other has; ids may repeat."""
    for seed in range(9):
        named = scratch.write(classes.withColumn("rep", F.xxhash64("label", "vector", F.lit(seed))), f"classes{seed}")
        if named.groupBy("rep").count().where("count > 1").isEmpty():
            return named
    raise RuntimeError("no seed numbers the classes without a clash")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "rptree")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & (norm > 0) & (norm < float("inf"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = _named(classes, scratch)

    large = classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP)
    total = large.agg(F.sum("k")).first()[0]
    tops: dict = {}
    if total:
        widest = large.agg(F.max("dim")).first()[0]
        share = min(1.0, min(max(SAMPLE, 32 * total / GROUP), SAMPLE_BYTES / (8 * widest)) / total)
        picked = classes.join(large.select("label"), "label", "left_semi").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))
        samples: dict = {}
        for r in picked.select("label", "vector").toLocalIterator():
            v = np.array(r["vector"])
            samples.setdefault((r["label"], len(v)), []).append(v / np.sqrt(v @ v))
        tops = fit_tops({k: np.stack(v) for k, v in samples.items()}, share)
    routed = classes.mapInArrow(_route(tops), "rep long, tree int, part long")
    dim = classes.select("rep", "label", F.size("vector").alias("dim"), "vector")
    grown = routed.join(dim, "rep").groupBy("tree", "part", "label", "dim").applyInArrow(_grow(least), "rep long, hub long")
    compared = scratch.write(grown.distinct(), "compared")
    scratch.release()
    linked = components(compared.select(F.col("rep").alias("u"), F.col("hub").alias("v")), scratch, "links")
    counts = counted(classes, linked, least, scratch)
    about = classes.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.withColumn("found", F.coalesce("component", "rep")).select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "found", "least")
    about = scratch.write(about, "about")
    ends = about.groupBy("found").agg(F.min("least").alias("component_id"))
    sure = rows.where("sound").join(about.join(ends, "found"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sure.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
