"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Strings are judged on the
input; matches never cross documents. A string (a window of LENGTH bytes) is led by the least hash among its ``GRAM``-byte grams,
the leftmost of equal ones, so equal windows have equal leaders at equal places:

1. Leaders of all windows are counted; only leaders that occur twice can lead a repeated window.
2. Documents that have one are stored, and each run of windows under one such leader is cut out as a segment (the
   bytes of its windows). Segments with equal bytes collapse to one with a count; a count above one repeats all its windows.
3. Shards hold all distinct segments of a leader. Each shard builds a suffix array by Larsson-Sadakane refinement
   (prefix doubling from 7 bytes that resorts unsorted groups only) over LENGTH bytes exactly; windows that are then still
   in one group share LENGTH bytes and are repeated.
4. A leader with more than ``HOT`` distinct segments is spread over several shards. These also give the sorted hashes of
   their windows in as many hash ranges as there are shards, and binary search among the lists of one range finds
   windows that two shards share.
5. The windows found go back to all members of their segments and each stored document drops their union.

Blocks, shards and lists have bounded sizes; a text longer than a block is worked on in overlapping parts. Leaders and windows are
compared by 64-bit hashes, segments and neighbours in suffix arrays by their bytes.

Defined results: a null text is an empty text; texts shorter than LENGTH keep all bytes; rows that repeat are documents of their own,
so their texts of LENGTH bytes or more go entirely; a null id is an id like others; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import BLOCK_BYTES, blocks, column, prefix_hash, span_hash, tidy
from .scratch import Scratch

LENGTH, GRAM, HOT, SHARD_BYTES, MOST_RANGES = 400, 64, 2000, 2 << 20, 1 << 12


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Places of the least key in each run of ``width``: minima from block starts and to block ends meet in every run."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    from_start = np.minimum.accumulate(full, 1).reshape(-1)
    to_end = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(to_end[:n], from_start[width - 1 : width - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def _leaders_of_part(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    keys = (grams & ~np.uint64((1 << 21) - 1)) | at.astype(np.uint64)
    leader = sliding_argmin(keys, length - gram + 1)
    size = np.maximum(0, np.diff(offs) - length + 1)
    row = np.repeat(np.arange(len(size)), size)
    window = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + offs[row]
    lead = leader[window]
    new = np.ones(len(window), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return row[first], window[first] - offs[row[first]], window[last] - offs[row[first]], grams[lead[first]]


def leaders(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, last window, hash of the leader) of every run of windows under one leader."""
    if len(offs) != 2 or len(data) <= BLOCK_BYTES:
        return _leaders_of_part(data, offs, length, gram)
    parts = []
    for lo in range(0, len(data) - length + 1, BLOCK_BYTES):  # one long text: runs may be cut at part edges
        row, s0, s1, fp = _leaders_of_part(data[lo : lo + BLOCK_BYTES + length - 1], np.array([0, min(len(data) - lo, BLOCK_BYTES + length - 1)]), length, gram)
        parts.append((row, s0 + lo, s1 + lo, fp))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _leading(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(column(batch, "text")):
                row, _, _, fp = leaders(data, offs, length, gram)
                order = np.lexsort((fp, row))
                row, fp = row[order], fp[order]
                first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])])) if len(fp) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(fp)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row[first])), pa.array(fp[first].view(np.int64)), pa.array(n)], ["doc_id", "fp", "n"])

    return run


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live = batch.column("fps")
            for lo, hi, data, offs in blocks(column(batch, "text")):
                row, s0, s1, fp = leaders(data, offs, length, gram)
                uid = batch.column("uid").slice(lo, hi - lo).to_numpy()
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                keep = np.concatenate([np.isin(fp[cuts[i] : cuts[i + 1]].view(np.int64), live[lo + i].values.to_numpy()) for i in range(hi - lo)])
                row, s0, s1, fp = row[keep], s0[keep], s1[keep], fp[keep]
                raw = data.tobytes()
                parts = [raw[a : b + length] for a, b in zip(offs[row] + s0, offs[row] + s1, strict=True)]
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in parts), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[row], fp.view(np.int64), s0, h[:, 0], h[:, 1])] + [pa.array(parts, pa.binary())], ["uid", "fp", "s0", "h1", "h2", "segment"])

    return run


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of a sequence of integers from 0 to 511. The order is complete: Kasai's bound needs that."""
    order, _ = _refined(text, len(text))
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    return order, rank


def _refined(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first ``depth`` symbols, places of those that share all of them with another); 0 in
    the text and what lies behind its end are alike where a suffix is shorter than ``depth``."""
    n, first = len(text), min(7, depth)
    wide = np.zeros(n + first, np.int64)
    wide[:n] = text
    packed = np.zeros(n, np.int64)
    for k in range(first):
        packed = (packed << 9) | wide[k : n + k]
    order = np.argsort(packed)
    group, h = np.zeros(n + 1, np.int64), first
    unsorted = _number(packed[order], order, np.arange(n), group)
    while len(unsorted) and h < depth:
        step = min(h, depth - h)  # two suffixes that share h symbols, also those step further on, share h + step
        at = order[unsorted]
        ahead = np.minimum(at + step, n)  # group[n] is 0 and stands for the end
        key = group[at] * (n + 2) + group[ahead]
        inner = np.argsort(key)
        order[unsorted] = at[inner]
        unsorted, h = _number(key[inner], at[inner], unsorted, group), h + step
    return order, unsorted


def _number(keys: np.ndarray, suffixes: np.ndarray, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers groups of equal keys by their last place (plus one) and gives the places still in larger groups."""
    last = np.ones(len(keys), bool)
    last[:-1] = keys[1:] != keys[:-1]
    ends = np.flatnonzero(last)
    size = np.diff(np.append(-1, ends))
    group[suffixes] = np.repeat(places[ends] + 1, size)
    return places[np.repeat(size > 1, size)]


def kasai(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, counts: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes (up to ``cap``) of suffixes with their predecessors, for the first ``counts`` suffixes of each
    segment; tests hold ``repeated_starts`` against them. Moving one suffix on loses at most one symbol of the prefix; all
    segments move together."""
    lcp = np.zeros(len(text), np.int64)
    n = len(text)
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(counts[0]) if len(counts) else 0):
        m = int(np.searchsorted(-counts, -t, "left"))  # segments with more than t suffixes
        i = starts[:m] + t
        r = rank[i]
        j = np.where(r > 0, order[r - 1], n)
        hh = np.where(r > 0, np.maximum(h[:m] - 1, 0), 0)
        live = np.flatnonzero((r > 0) & (hh < cap))
        while len(live):
            a, b = i[live] + hh[live], j[live] + hh[live]
            inside = (a < n) & (b < n)
            same = np.zeros(len(live), bool)
            same[inside] = text[a[inside]] == text[b[inside]]
            live = live[same]
            hh[live] += 1
            live = live[hh[live] < cap]
        h[:m] = hh
        lcp[i] = hh
    return lcp


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of the distinct segments, which of its windows occurs at another place of the shard too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(segments), np.int64)  # 0 ends a segment and lies in no window
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    order, unsorted = _refined(text, length)
    shared = np.zeros(len(text), bool)
    shared[order[unsorted]] = True  # a suffix that shares a whole window is a window itself
    return [shared[a : a + k] for a, k in zip(starts, sizes - length + 1, strict=True)]


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


_FOUND = "fp long, h1 long, h2 long, lo array<int>, hi array<int>"


def _found(table: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    some = [i for i, f in enumerate(flags) if f.any()]
    ranges = [_ranges(flags[i]) for i in some]
    picked = table.select(["fp", "h1", "h2"]).take(pa.array(some, pa.int64()))
    return picked.append_column("lo", pa.array([r[0] for r in ranges], pa.list_(pa.int32()))).append_column("hi", pa.array([r[1] for r in ranges], pa.list_(pa.int32())))


def _search_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        segments = table.column("segment").to_pylist()
        flags = repeated_starts(segments, length)
        for i, k in enumerate(table.column("k").to_pylist()):
            if k > 1:
                flags[i][:] = True
        return _found(table, flags)

    return run


def _window_hashes(segment: bytes, length: int) -> np.ndarray:
    data = np.frombuffer(segment, np.uint8)
    at = np.arange(len(data) - length + 1)
    return span_hash(prefix_hash(data), at, at + length)


def _shard_lists(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Sorted hashes of a hot shard's windows, one list per range of hashes; as many ranges as the leader has shards."""
        every = np.unique(np.concatenate([_window_hashes(s, length) for s in table.column("segment").to_pylist()]))
        ranges = min(MOST_RANGES, table.column("parts")[0].as_py())
        edges = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
        cuts = np.append(np.searchsorted(every, edges), len(every))
        fp, part = table.column("fp")[0].as_py(), table.column("part")[0].as_py()
        lists = [every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"fp": pa.array([fp] * ranges, pa.int64()), "part": pa.array([part] * ranges, pa.int64()), "span": pa.array(range(ranges), pa.int32()), "hashes": pa.array(lists, pa.binary())})

    return run


def _merge_lists(table: pa.Table) -> pa.Table:
    """For each shard's list, its hashes that another list of the same range holds, by binary search."""
    lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    every = np.sort(np.concatenate(lists))
    shared = [x[np.searchsorted(every, x, "right") - np.searchsorted(every, x, "left") > 1].tobytes() for x in lists]
    return pa.table({"fp": table.column("fp"), "part": table.column("part"), "shared": pa.array(shared, pa.binary())})


def _apply_shared(length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("shared")] + [np.zeros(0, np.uint64)])
        return _found(left, [np.isin(_window_hashes(s, length), hits) for s in left.column("segment").to_pylist()])

    return run


def _kept_parts(raw: bytes, spans: np.ndarray) -> tuple[list[bytes], int]:
    """(what the union of spans leaves, number of maximal runs in it); adjoining spans are one run."""
    out, at, runs = [], 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")] if len(spans) else spans
    reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans
    for k in range(len(spans)):
        if k == 0 or spans[k, 0] > reach[k - 1]:
            out.append(raw[at : spans[k, 0]])
            runs += 1
        at = int(reach[k])
    out.append(raw[at:])
    return out, runs


def _removed(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.large_binary())
            rows = []
            for i in range(batch.num_rows):
                raw, spans = texts[i].as_py(), np.zeros((0, 2), np.int64)
                if batch.column("cut")[i].is_valid:
                    cut = batch.column("cut")[i].values
                    spans = np.stack([cut.field(0).to_numpy(), cut.field(1).to_numpy()], 1)
                parts, runs = _kept_parts(raw, spans)
                rest = b"".join(parts)
                rows.append((len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest if with_bytes else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row."""
    scratch = Scratch(df.sparkSession, "suffix-dedup")
    gram = min(GRAM, max(1, length // 2))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = df.schema[doc_id].dataType.simpleString()
    led = docs.where(F.octet_length("text") >= length).mapInArrow(tidy(_leading(length, gram)), f"doc_id {kind}, fp long, n long")
    twice = led.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    lists = scratch.write(led.join(twice, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "lists")
    renamed = lists.select(F.col("doc_id").alias("kf_id"), "fps")
    held = docs.join(renamed, docs["doc_id"].eqNullSafe(renamed["kf_id"])).drop("kf_id").withColumn("uid", F.monotonically_increasing_id())
    held = scratch.write(held, "held")
    segments = scratch.write(held.select("uid", "text", "fps").mapInArrow(tidy(_segments(length, gram)), "uid long, fp long, s0 long, h1 long, h2 long, segment binary"), "segments")
    distinct = segments.groupBy("fp", "h1", "h2", "segment").agg(F.count(F.lit(1)).alias("k"))  # equal in their bytes
    distinct = scratch.write(distinct, "distinct")
    sizes = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.max("k").alias("k"), F.sum(F.length("segment")).alias("bytes")).where("kinds > 1 or k > 1")
    sizes = scratch.write(sizes, "sizes")
    shards = max(1, -(-int(sizes.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    dealt = distinct.join(sizes.drop("k", "bytes"), "fp").withColumn("parts", F.ceil(F.col("kinds") / HOT)).withColumn("part", F.pmod("h1", "parts"))
    alone = dealt.where("kinds = 1").select("fp", "h1", "h2", F.array(F.lit(0)).alias("lo"), F.array(F.length("segment") - length).alias("hi"))
    usual = dealt.where(F.col("kinds").between(2, HOT)).withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)))
    found = usual.select("shard", "fp", "h1", "h2", "k", "segment").groupBy("shard").applyInArrow(_search_shard(length), _FOUND)
    hot = scratch.write(dealt.where(F.col("kinds") > HOT).select("fp", "part", "parts", "h1", "h2", "k", "segment"), "hot")
    found = found.unionByName(hot.groupBy("fp", "part").applyInArrow(_search_shard(length), _FOUND))
    merged = hot.select("fp", "part", "parts", "segment").groupBy("fp", "part").applyInArrow(_shard_lists(length), "fp long, part long, span int, hashes binary")
    shared = merged.groupBy("fp", "span").applyInArrow(_merge_lists, "fp long, part long, shared binary")
    across = hot.groupBy("fp", "part").cogroup(shared.groupBy("fp", "part")).applyInArrow(_apply_shared(length), _FOUND)
    found = scratch.write(found.unionByName(across).unionByName(alone), "found")
    spans = segments.select("uid", "fp", "s0", "h1", "h2").join(found, ["fp", "h1", "h2"]).select("uid", F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((x["lo"] + F.col("s0")).alias("a"), (x["hi"] + F.col("s0") + length).alias("b"))).alias("cut"))
    spans = spans.groupBy("uid").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = held.select("uid", "doc_id", "text").join(spans, "uid", "left").select("doc_id", "text", "cut").mapInArrow(tidy(_removed(with_bytes)), f"doc_id {kind}, {out}")
    size, nothing = F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    body = F.col("text").cast("binary")
    plain = docs.select("doc_id", size, nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), *[body.alias("kept")] * with_bytes)
    plain = plain.join(renamed.drop("fps"), F.col("doc_id").eqNullSafe(F.col("kf_id")), "left_anti")
    return plain.unionByName(changed if with_bytes else changed.drop("kept"))
