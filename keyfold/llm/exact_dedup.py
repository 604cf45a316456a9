"""Exact deduplication with counting quotient filters.

Every input partition builds one counting quotient filter over 64-bit fingerprints of its normalised texts.
A filter is cut into blocks by the leading fingerprint bits; the blocks of all partitions meet per block and
merge losslessly, because a filter's quotients and sorted remainders give back its fingerprints in order.
Fingerprints with a count above one send their documents to a comparison of the whole texts.

Defined results: a null text is an empty text; texts without a partner form groups of one; a null id counts as
larger than any id; rows that repeat id and text are one group and all carry ``kept`` (``keep_first`` returns one
of them); an empty table gives an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import column, tidy
from .scratch import Scratch, few

ROWS_PER_BLOCK = 1 << 20
MIN_BLOCK_BITS = 5


def normalise(text: bytes) -> bytes:
    """Every run of [\\x20\\x09-\\x0D] becomes one space."""
    body = b" ".join(text.split())
    if not text:
        return body
    if not body:
        return b" "
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


class CountingQuotientFilter:
    """Fingerprints below 2**bits: ``occupied`` marks used quotients, ``run_ends`` the last entry of each run."""

    def __init__(self, bits: int, quotient_bits: int, occupied, run_ends, remainders, counts):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.run_ends, self.remainders, self.counts = occupied, run_ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct ascending fingerprints and their counts."""
        q = min(bits - 1, max(3, int(len(fingerprints)).bit_length()))
        shift = np.uint64(bits - q)
        quotients = (fingerprints >> shift).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_ends = np.ones(len(fingerprints), bool)
        run_ends[:-1] = quotients[1:] != quotients[:-1]
        return cls(bits, q, occupied, run_ends, fingerprints & ((np.uint64(1) << shift) - np.uint64(1)), counts.astype(np.uint32))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, count), ascending: the k-th run belongs to the k-th occupied quotient."""
        run = np.cumsum(self.run_ends) - self.run_ends
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(self.bits - self.quotient_bits)) | self.remainders, self.counts

    def pack(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.remainders)], np.int64)
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_ends), self.remainders, self.counts))

    @classmethod
    def unpack(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, n = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        at, size = 24, -(-(1 << q) // 8)
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=1 << q).astype(bool)
        at, size = at + size, -(-n // 8)
        run_ends = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n).astype(bool)
        at += size
        return cls(bits, q, occupied, run_ends, np.frombuffer(raw, np.uint64, n, at), np.frombuffer(raw, np.uint32, n, at + 8 * n))

    @staticmethod
    def merge(parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        entries = [p.entries() for p in parts]
        keys, counts = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        total = np.minimum(np.add.reduceat(counts.astype(np.int64), at), 0xFFFFFFFF) if len(at) else counts
        return CountingQuotientFilter.build(keys[at], total, parts[0].bits)


def _filters(column_name: str, block_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            texts = column(batch, column_name).cast(pa.large_binary())
            seen.append(np.fromiter((xxhash.xxh3_64_intdigest(normalise(t.as_py())) for t in texts), np.uint64, len(texts)))
        if not seen:
            return
        keys, counts = np.unique(np.concatenate(seen), return_counts=True)
        rest = 64 - block_bits
        where = (keys >> np.uint64(rest)).astype(np.int64)
        cuts = np.searchsorted(where, np.arange((1 << block_bits) + 1))
        low = keys & ((np.uint64(1) << np.uint64(rest)) - np.uint64(1))
        found = [(b, CountingQuotientFilter.build(low[i:j], counts[i:j], rest).pack()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["block", "filter"])

    return run


def _repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of one block with a count above one; filters merge as they arrive."""
    merged, block = None, key[0].as_py()
    for batch in batches:
        parts = [CountingQuotientFilter.unpack(x.as_py()) for x in batch.column("filter")]
        merged = CountingQuotientFilter.merge(([merged] if merged else []) + parts)
    keys, counts = merged.entries()
    full = keys[counts > 1] | (np.uint64(block) << np.uint64(merged.bits))
    yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64))], ["fp"])


def _described(text: str, keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = column(batch, text).cast(pa.large_binary())
            step = 1024
            for lo in range(0, batch.num_rows, step):
                body = [normalise(t.as_py()) for t in raw.slice(lo, step)]
                fp = np.fromiter((xxhash.xxh3_64_intdigest(b) for b in body), np.uint64, len(body)).view(np.int64)
                cols = [batch.column(k).slice(lo, step) for k in keep]
                cols += [pa.array(fp), pa.array([hashlib.sha256(b).digest() for b in body], pa.binary())]
                names = [f"k{i}" for i in range(len(keep))] + ["fp", "sha"]
                if with_text:
                    cols, names = [*cols, pa.array(body, pa.binary())], [*names, "norm"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def describe(df: DataFrame, text: str, keep: list[str], with_text: bool = False) -> DataFrame:
    """Columns ``keep`` (as k0, k1, …) with fingerprint, SHA-256 and, if asked for, bytes of the normalised text."""
    used = df.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)] + ["fp long", "sha binary"] + ["norm binary"] * with_text)
    return used.mapInArrow(tidy(_described(text, keep, with_text)), schema)


def repeated_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``fp`` of every fingerprint that more than one row has."""
    blocks = max(1, df.count() // ROWS_PER_BLOCK)
    bits = max(MIN_BLOCK_BITS, int(blocks).bit_length())
    parts = df.select(text).mapInArrow(tidy(_filters(text, bits)), "block int, filter binary")
    return parts.groupBy("block").applyInArrow(_repeated, "fp long")


def verified_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(fp, sha, keep_id, group_size, keepers) of every group of two or more rows whose normalised bytes are equal;
    ``keepers`` counts the rows with the id that stays."""
    scratch = scratch or Scratch(df.sparkSession, "exact-dedup")
    again = scratch.write(repeated_fingerprints(df, text), "repeated")
    members = describe(df, text, [doc_id], with_text=True).join(few(again), "fp")
    rows = members.groupBy("fp", "sha", "norm", "k0").agg(F.count(F.lit(1)).alias("n"))
    keepers = F.coalesce(F.min_by("n", "k0"), F.sum("n"))
    groups = rows.groupBy("fp", "sha", "norm").agg(F.min("k0").alias("keep_id"), F.sum("n").alias("group_size"), keepers.alias("keepers"))
    groups = scratch.write(groups.where("group_size > 1").drop("norm"), "groups")
    scratch.drop("repeated")
    scratch.release()
    return groups


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = verified_groups(df, doc_id, text)
    joined = describe(df, text, [doc_id]).join(few(groups), ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("k0")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("k0").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("k0").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts: that with the smallest id. Rows without a partner, nulls and
    empty texts are as for ``exact_groups``; columns may have any names. Texts move only if the groups are too many to broadcast."""
    groups = verified_groups(df, doc_id, text)
    names = [f"c{i}" for i in range(len(df.columns))]
    inner, id_col, text_col = df.toDF(*names), F.col(names[df.columns.index(doc_id)]), names[df.columns.index(text)]
    spaced = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    marked = inner.withColumn("sha", F.unhex(F.sha2(F.encode(spaced, "utf-8"), 256))).join(few(groups.drop("fp")), "sha", "left")
    stays = F.col("group_size").isNull() | id_col.eqNullSafe(F.col("keep_id"))
    kept = marked.where(stays & F.coalesce(F.col("keepers") == 1, F.lit(True))).select(*names)
    if not groups.where("keepers > 1").isEmpty():  # an id that stays and repeats with its text: one of its rows
        kept = kept.unionByName(marked.where(stays & (F.col("keepers") > 1)).dropDuplicates(["sha"]).select(*names))
    return kept.toDF(*df.columns)
