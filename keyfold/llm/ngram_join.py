"""Jaccard self-join of word 5-gram sets with adaptive multi-match prefixes.

1. Counting: every distinct shingle of every document goes once, packed to four bytes, to the task of its hash range,
   which answers how many shingles of a document some other row has too. Partitions combine shingles that repeat among
   their own rows first. Two documents of n and m shingles that link share at least ``overlap(n, m)``, so a document
   that shares fewer than ``least`` per cent of its own has no link and is done.
2. Of the rest, rows with equal sets (128-bit digests) are one node. Shingles are ordered by exact document frequency
   among the nodes, rare ones first; those of one node alone come before all others. If two sets share ``o`` shingles,
   then for every l <= o both have l common ones among their first n - o + l. A posting therefore has a greatest partner
   size, from its place, its node's size and the node's shared shingles, and only postings within each other's reach meet.
3. Near copies first: every component (at first a node) is verified against the hub of another that shares the most
   prefix shingles with it, and what links becomes one component; up to ``HUB_ROUNDS`` times.
4. Each node lengthens its prefix to the l of least estimated cost: posting entries of other components within reach plus
   candidates expected (entries / l), each weighted with what a verification costs. All pairs of different components that share l
   prefix shingles are verified, so no pair inside a component is listed and no link is missed.
5. Components by star contraction; rows with equal sets follow their node, ids that repeat join theirs.

Memory follows the block size and the shingles of one hash range; posting lists are joined as rows, never gathered.
Shingles are compared by 64-bit hashes (the first count by 32 bits and the range, which can only keep more documents),
whole sets by digests of 128.

Defined results: null or wordless texts have no shingle, link with nothing and are their own component; fewer than
five words make one shingle; rows that repeat an id give one row each, ids being what is linked; a null id is its own
component (null) and lends no link; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import blocks, column, mix64, prefix_hash, span_hash, tidy, words
from .graph import components
from .scratch import Scratch, few

WORDS, LEAST, LEVELS = 5, 75, 4
VERIFY_COST, HUB_ROUNDS = 20.0, 3
#: Shingles that one range is meant for, bytes of text that one shingle is reckoned to take, most ranges, and shingles of a
#: chunk, so that a chunk has some hundreds for each range.
RANGE_SHINGLES, SHINGLE_BYTES, MOST_RANGES, CHUNK_SHINGLES = 1 << 19, 6, 1 << 16, 1 << 19
_STEP = np.random.default_rng(5).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of every row, repeats included."""
    starts, ends, row = words(data, offs)
    h = span_hash(prefix_hash(data, lower=True), starts, ends)
    n = np.bincount(row, minlength=len(offs) - 1)
    m = max(0, len(h) - k + 1)
    inside = row[:m] == row[k - 1 :] if m else np.zeros(0, bool)
    value = np.zeros(m, np.uint64)
    for j in range(k):
        value += h[j : j + m] * _STEP[j]
    value, at = mix64(value[inside]), row[:m][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.cumsum(n) - n
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            extra[has] += h[first[short][has] + j] * _STEP[j]
        extra = mix64(extra + n[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        value, at = np.concatenate([value, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, at


def distinct_sets(value: np.ndarray, row: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """The sorted distinct values of each row."""
    cuts = np.searchsorted(row, np.arange(rows + 1))
    for i in range(rows):
        part = np.sort(value[cuts[i] : cuts[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        yield part

def overlap(n: int, m: int, least: int = LEAST) -> int:
    """Fewest shingles that sets of n and m have in common if they link."""
    return -(-least * (n + m) // (100 + least))


def _sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, distinct shingles of each row) of blocks of texts."""
    for lo, hi, data, offs in blocks(texts):
        value, row = shingles(data, offs)
        yield lo, list(distinct_sets(value, row, hi - lo))


def pack_places(places: np.ndarray) -> bytes:
    """Ascending whole numbers, as steps of one byte where all are that small."""
    steps = np.diff(places, prepend=0)
    return b"s" + steps.astype(np.uint8).tobytes() if not len(steps) or steps.max() < 256 else b"w" + places.astype(np.uint32).tobytes()


def unpack_places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8, offset=1), dtype=np.int64) if raw[:1] == b"s" else np.frombuffer(raw[1:], np.uint32).astype(np.int64)


class _Chunk:
    """Documents whose shingles are sent to the ranges together."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, shingles: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sets.append(shingles)
        self.size += len(shingles)

    def rows(self, range_bits: int, where: tuple[int, int]) -> pa.RecordBatch:
        """A row for each range: what repeats among these documents, and by document what does not."""
        n = np.array([len(x) for x in self.sets], np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        key = np.concatenate(self.sets) >> np.uint64(32 - range_bits)
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        repeats = times[at] > 1
        local = np.bincount(owner[repeats], minlength=len(n))
        digests = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in self.sets)
        shared, (single, owner) = np.unique(key[repeats]), (key[~repeats], owner[~repeats])
        part = (single >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # by range, then by document
        single, owner, part = single[order], owner[order], part[order]
        edges = np.arange((1 << range_bits) + 1)
        cuts, shared_cuts = np.searchsorted(part, edges), np.searchsorted((shared >> np.uint64(32)).astype(np.int64), edges)
        used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(shared_cuts) > 0))
        used = used if len(used) else np.zeros(1, np.int64)
        low = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
        valid = np.array([i is not None for i in self.ids], np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        head = np.concatenate([[len(used), len(n)], ids, valid, n, local, np.frombuffer(digests, np.int64)]).astype(np.int64).tobytes()
        name = xxhash.xxh3_64_intdigest(head, seed=where[0] << 32 | where[1])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array(np.full(len(used), name, np.uint64).view(np.int64)),
                pa.array([low(shared[shared_cuts[r] : shared_cuts[r + 1]]) for r in used], pa.binary()),
                pa.array([low(single[cuts[r] : cuts[r + 1]]) for r in used], pa.binary()),
                pa.array([pack_places(owner[cuts[r] : cuts[r + 1]]) for r in used], pa.binary()),
                pa.array([head] + [None] * (len(used) - 1), pa.binary()),
            ],
            ["part", "chunk", "shared", "single", "owners", "head"],
        )


def _packed(doc_id: str, text: str, range_bits: int, chunk_shingles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sent, task = _Chunk(), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(doc_id).cast(pa.int64()).to_pylist()
            for lo, parts in _sets(column(batch, text)):
                for k, part in enumerate(parts):
                    chunk.add(ids[lo + k], part)
                    if chunk.size >= chunk_shingles or len(chunk.ids) >= chunk_shingles >> 4:
                        yield chunk.rows(range_bits, (task, sent))
                        chunk, sent = _Chunk(), sent + 1
        if chunk.ids:
            yield chunk.rows(range_bits, (task, sent))

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of one range, the documents of the range's shingles that another row has too."""
    chunks, shared, single, owners, heads = [], [], [], [], []
    for batch in batches:
        chunks += batch.column("chunk").to_pylist()
        heads += batch.column("head").to_pylist()
        owners += batch.column("owners").to_pylist()
        for name, out in (("shared", shared), ("single", single)):
            out += [np.frombuffer(x.as_buffer(), np.uint32).copy() for x in batch.column(name)]
    sizes = np.array([len(x) for x in single])
    tokens = np.concatenate(single)
    order = np.argsort(tokens, kind="stable")
    ascending = tokens[order]
    same = ascending[1:] == ascending[:-1]
    met = np.zeros(len(tokens), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    known = np.unique(np.concatenate(shared))
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        met |= known[at] == tokens
    ends = np.cumsum(sizes)
    found = [pack_places(unpack_places(own)[met[end - size : end]]) for size, end, own in zip(sizes, ends, owners, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(found, pa.binary()), pa.array(heads, pa.binary())], ["chunk", "found", "head"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of one chunk, with what all ranges found added up."""
    total, head, rows = np.zeros(0, np.int64), None, 0
    for batch in batches:
        for found, h in zip(batch.column("found").to_pylist(), batch.column("head"), strict=True):
            more = np.bincount(unpack_places(found), minlength=len(total))
            more[: len(total)] += total
            total, head, rows = more, h.as_py() if h.is_valid else head, rows + 1
    if head is None or int.from_bytes(head[:8], "little") != rows:
        raise RuntimeError("the input gave other rows when a lost task ran again; write it as a table first")
    n = int.from_bytes(head[8:16], "little")
    ids, valid, size, local, digests = np.split(np.frombuffer(head, np.int64, offset=16), [n, 2 * n, 3 * n, 4 * n])
    digests, total = digests.reshape(-1, 2), np.pad(total, (0, n - len(total)))
    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(size), pa.array(total + local), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["doc_id", "n", "m", "h1", "h2"])


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n, m, h1, h2) of every row: distinct shingles, those that another row has too, digest of the set."""
    bytes_of_text = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    range_bits = max(4, min(MOST_RANGES, bytes_of_text // SHINGLE_BYTES // RANGE_SHINGLES).bit_length())
    chunk = max(CHUNK_SHINGLES, 64 << range_bits)
    sent = docs.mapInArrow(tidy(_packed("doc_id", "text", range_bits, chunk)), "part int, chunk long, shared binary, single binary, owners binary, head binary")
    answered = sent.groupBy("part").applyInArrow(_answered, "chunk long, found binary, head binary")
    return answered.groupBy("chunk").applyInArrow(_summed, "doc_id long, n long, m long, h1 long, h2 long")


def _hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, parts in _sets(column(batch, "text")):
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in parts), np.int64).reshape(-1, 2)
            edges = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), items], ["h1", "h2", "items"])


def _named(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes`` with a number ``node`` of each that no other has."""
    for seed in range(9):
        named = scratch.write(classes.withColumn("node", F.xxhash64("h1", "h2", F.lit(seed))), f"classes{seed}")
        if named.groupBy("node").count().where("count > 1").isEmpty():
            return named
    raise RuntimeError("no seed numbers the sets without a clash")


def _at_least(part: Column, whole: Column, least: int) -> Column:
    return part * 100 >= whole * least


def _reach(l: Column, least: int, side: str = "") -> Column:
    """The greatest size of a set that can share l prefix shingles with this posting's, this being one of them: both hold at
    least least * (n + size) / (100 + least) in common, which must fit into the node's shared shingles and what follows."""
    n, m, place = (F.col(x + side) for x in ("n", "m", "place"))
    most = F.least(m, n + l - 1 - place)
    return F.floor((100 + least) * most / least) - n


def _postings(sets: DataFrame, least: int) -> DataFrame:
    """(token, node, n, m, place, need) of prefixes, extended by LEVELS - 1; shingles that one set alone has are left out."""
    tokens = sets.select("node", F.col("size").alias("n"), F.explode("items").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    by_node = Window.partitionBy("node")
    placed = tokens.join(often, "token").withColumn("place", F.row_number().over(by_node.orderBy("k", "token"))).withColumn("m", F.count(F.lit(1)).over(by_node))
    placed = placed.where(_at_least(F.col("m"), F.col("n"), least)).withColumn("need", F.ceil(F.col("n") * least / 100))
    return placed.where(F.col("place") <= F.col("m") - F.col("need") + LEVELS).select("token", "node", "n", "m", (F.col("n") - F.col("m") + F.col("place") - 1).alias("place"), "need")


def _weights(live: DataFrame) -> DataFrame:
    """(node, weight): the posting entries of others behind a node's longest prefix."""
    counts = live.groupBy("token").agg((F.count(F.lit(1)) - 1).alias("others"))
    return live.join(counts, "token").groupBy("node").agg(F.sum("others").alias("weight"))


def _extensions(placed: DataFrame, least: int) -> DataFrame:
    """(node, l): the prefix extension of least estimated cost. A posting counts at l if its reach then holds a set of the list's
    mean size, and a node's entries at l are the counting postings of other components in the lists where its own counts."""
    levels = range(1, LEVELS + 1)
    placed = placed.join(placed.groupBy("token").agg(F.avg("n").alias("usual")), "token")
    placed = placed.select("token", "component", "node", "need", *[(_reach(F.lit(l), least) >= F.col("usual")).cast("int").alias(f"live{l}") for l in levels])
    own = placed.groupBy("token", "component").agg(*[F.sum(f"live{l}").alias(f"own{l}") for l in levels])
    every = own.groupBy("token").agg(*[F.sum(f"own{l}").alias(f"every{l}") for l in levels])
    met = placed.join(own, ["token", "component"]).join(every, "token")
    costs = met.groupBy("node").agg(F.max("need").alias("need"), *[F.sum(F.col(f"live{l}") * (F.col(f"every{l}") - F.col(f"own{l}"))).alias(f"entries{l}") for l in levels])
    cost = [F.when(F.col("need") >= l, F.col(f"entries{l}") * F.lit(1 + VERIFY_COST / l)).otherwise(F.lit(float("inf"))) for l in levels]
    return costs.select("node", F.array_position(F.array(*cost), F.array_min(F.array(*cost))).cast("int").alias("l"))


def _with_components(posted: DataFrame, near: DataFrame | None) -> DataFrame:
    if near is None:
        return posted.withColumn("component", F.col("node"))
    return posted.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _within(l: Column, least: int) -> Column:
    """Whether postings of u and v are in each other's reach."""
    u, v = F.col("n_u"), F.col("n_v")
    return _at_least(u, v, least) & _at_least(v, u, least) & (v <= _reach(l, least, "_u")) & (u <= _reach(l, least, "_v"))


def _side(placed: DataFrame, side: str, **names: str) -> DataFrame:
    kept = {"n": f"n_{side}", "m": f"m_{side}", "place": f"place_{side}", "node": side, **names}
    return placed.select("token", *[F.col(a).alias(b) for a, b in kept.items()])


def _hub_pairs(placed: DataFrame, least: int) -> DataFrame:
    """(u, v): for every component, its node that shares the most prefix shingles with a hub of another component.
    The hub of a posting list is its node with the most posting entries behind its prefix: that which most others resemble."""
    rank = F.struct("weight", -F.col("node"))
    hubs = placed.groupBy("token").agg(F.max_by(F.struct("node", "n", "m", "place", "component"), rank).alias("hub")).select("token", "hub.*")
    met = _side(placed, "v", component="component", need="need").join(_side(hubs, "u", component="other"), "token").where((F.col("other") != F.col("component")) & _within(F.lit(LEVELS), least))
    met = met.groupBy("u", "v", "component").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need")).where(F.col("k") >= F.least(F.lit(LEVELS), "need"))
    best = met.groupBy("component").agg(F.max_by(F.struct("u", "v"), F.struct("k", -F.col("u"), -F.col("v"))).alias("best"))
    return best.select("best.u", "best.v")


def _far_pairs(placed: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(u, v) of different components whose prefixes, lengthened to u's l, share l shingles within each other's reach."""
    mixed = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    placed = scratch.write(placed.join(mixed, "token"), "mixed")
    placed = scratch.write(placed.join(_extensions(placed, least), "node"), "placed")
    spots = placed.join(placed.groupBy("token").agg(F.max("l").alias("most")), "token").groupBy("token", "component")
    spots = spots.agg(F.count(F.lit(1)).alias("nodes"), F.min("n").alias("s0"), F.max("n").alias("s1"), F.max(_reach(F.col("l"), least)).alias("own"), F.max(_reach(F.col("most"), least)).alias("reach"))
    a, b = (spots.select("token", *[F.col(x).alias(f"{x}_{k}") for x in ("component", "nodes", "s0", "s1", "own", "reach")]) for k in "uv")
    close = _at_least(F.col("s1_u"), F.col("s0_v"), least) & _at_least(F.col("s1_v"), F.col("s0_u"), least) & (F.col("own_u") >= F.col("s0_v")) & (F.col("reach_v") >= F.col("s0_u"))
    meet = a.join(b, "token").where((F.col("component_u") < F.col("component_v")) & close)
    # the component with fewer nodes in the list is joined first, so that of a large one only nodes within reach become rows
    turned = F.col("turned")
    meet = meet.select("token", "component_u", "component_v", (F.col("nodes_v") < F.col("nodes_u")).alias("turned"))
    meet = meet.select("token", "turned", F.when(turned, F.col("component_v")).otherwise(F.col("component_u")).alias("component_u"), F.when(turned, F.col("component_u")).otherwise(F.col("component_v")).alias("component_v"))
    u, v = (_side(placed, k, component=f"component_{k}", l=f"l_{k}") for k in "uv")
    l = F.when(turned, F.col("l_v")).otherwise(F.col("l_u"))  # that of the lesser component, for all lists of a pair
    pairs = meet.join(u, ["token", "component_u"]).join(v, ["token", "component_v"]).where(_within(l, least))
    pairs = pairs.select("turned", F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"), l.alias("l"))
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.first("l").alias("l")).where("k >= l").select("u", "v")


def _linked(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v) that reach the similarity, by intersecting their whole sets."""
    u, v = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "uv")
    common = F.size(F.array_intersect("items_u", "items_v"))
    return pairs.join(u, "u").join(v, "v").where(common * 100 >= (F.size("items_u") + F.size("items_v") - common) * least).select("u", "v")


def _links(sets: DataFrame, scratch: Scratch, least: int) -> DataFrame | None:
    """Links (u, v) between nodes that join what similarity joins; None without postings."""
    live = _postings(sets, least)
    live = scratch.write(live.join(live.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "token", "left_semi"), "live")
    scratch.release()
    live = scratch.write(live.join(_weights(live), "node"), "posted")
    scratch.drop("live")
    links, near = None, None
    for k in range(HUB_ROUNDS):
        stars = scratch.write(_hub_pairs(_with_components(live, near), least), f"stars{k}")
        found = scratch.write(_linked(stars, sets, least), f"found{k}")
        scratch.release()
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        near = scratch.write(components(links, scratch, f"near{k}"), f"near{k}")
        links = near.select(F.col("node").alias("u"), F.col("component").alias("v"))
    pairs = scratch.write(_far_pairs(_with_components(live, near), scratch, least), "pairs")
    more = scratch.write(_linked(pairs, sets, least), "more")
    return more if links is None else links.unionByName(more)


def link_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    scratch = Scratch(df.sparkSession, "ngram-join")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.write(counted(docs), "counted")
    scratch.release()

    # nodes: distinct sets that share enough shingles with others; equal sets share all
    hopeful = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull() & _at_least(F.col("m"), F.col("n"), least))
    classes = _named(hopeful.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("size")), scratch)
    members = scratch.write(hopeful.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node").distinct(), "members")
    chosen = docs.join(few(classes.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = chosen.mapInArrow(tidy(_hashed_sets), "h1 long, h2 long, items array<long>").groupBy("h1", "h2").agg(F.first("items").alias("items"))
    sets = scratch.write(sets.join(classes.select("h1", "h2", "node", "size"), ["h1", "h2"]).select("node", "size", "items"), "sets")
    scratch.release()

    links = _links(sets, scratch, least)
    torn = members.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("u", "v")
    several = members.join(torn.select("u").distinct(), F.col("node") == F.col("u"), "left_semi").join(members.withColumnRenamed("node", "v"), "doc_id").select(F.col("node").alias("u"), "v").where("u <> v")
    joined = components(links.unionByName(several), scratch, "final")
    placed = classes.select("node", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_ids = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    owned = members.join(placed.select("node", "component"), "node").join(least_ids, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    result = scratch.write(rows.select("doc_id", F.col("n").alias("n_shingles")).join(owned, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")), "result")
    scratch.keep("result")
    return result


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` without rows whose id is not the smallest of their component. Nulls, empty texts and an empty table are as for
    ``link_components``; rows that repeat the id that stays all stay, and columns may have any names."""
    scratch = Scratch(df.sparkSession, "ngram-keep")
    gone = link_components(df, doc_id, text, least).where("doc_id <> component_id").select(F.col("doc_id").alias("kf_gone")).distinct()
    names = [f"c{i}" for i in range(len(df.columns))]
    kept = df.toDF(*names).join(few(scratch.write(gone, "gone")), F.col(names[df.columns.index(doc_id)]).cast("long") == F.col("kf_gone"), "left_anti")
    return kept.toDF(*df.columns)
