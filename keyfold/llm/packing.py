"""Best-fit packing of tokenised documents into sequences, with vector capacities.

A sequence has three capacities: tokens, documents and attention cost (sum of squared piece lengths). Within a
group of pieces, in descending order of length, each piece goes to the open sequence that holds it under every
constraint and leaves the smallest weighted residual norm (or has the largest weighted dot product of demand and
residual); where none does, a new sequence opens. Groups are dealt by a hash of row positions, of some thousands of pieces
each, so they pack independently in bounded memory and lose at most part of one sequence each.

Tokenising: where a tokenizer's file says that it lower-cases and drops white space (``by_words``), a text's ids are the
ids of its words in order; a worker keeps the ids of words it has met (bounded; a tail of marks apart) and encodes only new
ones, in one thread. Other tokenizers read whole texts.

Defined results: a null text is an empty text and still gives one piece holding the end id; a document longer than
the limit is cut into full pieces and a rest; rows that repeat are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import blocks, column, prefix_hash, span_hash, tidy, words
from .scratch import Scratch

MAX_TOKENS, END_ID, PIECES_PER_GROUP, CACHED_WORDS = 4096, 1, 8192, 1 << 19
_TAIL = ".,;:!?*#$%&"
_IS_TAIL, _IS_LETTER, _KEEPS_WHOLE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_TAIL[[*_TAIL.encode()]] = _IS_LETTER[[*range(65, 91), *range(97, 123)]] = _KEEPS_WHOLE[[*b"'<"]] = True
_encoders: dict[str, WordEncoder | TextEncoder] = {}


def word_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of parts that are pre-tokens of their own: a word that ends in a letter and a tail of marks is two, so
    that one entry serves it with any tail; other words are one part."""
    places = np.where(_IS_TAIL[data], -1, np.arange(len(data)))
    stem = np.maximum(np.maximum.accumulate(places)[ends - 1] + 1, starts) if len(ends) else ends
    whole = np.concatenate([[0], np.cumsum(_KEEPS_WHOLE[data])])
    split = (stem < ends) & (stem > starts) & _IS_LETTER[data[np.maximum(stem, 1) - 1]] & (whole[ends] == whole[starts])
    word = np.repeat(np.arange(len(starts)), 1 + split)
    second = np.flatnonzero(np.append(False, word[1:] == word[:-1]))
    begin, end = starts[word], ends[word]
    begin[second] = end[second - 1] = stem[split]
    return begin, end, row[word]


class WordEncoder:
    """Token ids of words (their parts) by their hashes: sorted keys, and each key's span in one flat array of ids; some 35 bytes a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.counts, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # by slot: words that another block had too

    def forget(self) -> None:
        """Drops the words that only one block had; all of them if the others fill half of the bound."""
        keep = self.again[self.slots]
        if 2 * keep.sum() > CACHED_WORDS:
            return self.reset()
        old = self.slots[keep]
        counts = self.counts[old].astype(np.int64)
        ends = np.cumsum(counts)
        self.ids = self.ids[np.repeat(self.starts[old].astype(np.int64) - (ends - counts), counts) + np.arange(int(counts.sum()))]
        self.keys, self.slots, self.again = self.keys[keep], np.arange(len(old), dtype=np.uint32), np.zeros(len(old), bool)
        self.starts, self.counts = (ends - counts).astype(np.uint32), counts.astype(np.uint32)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, how many each row has)."""
        starts, ends, row = word_parts(data, *words(data, offs))
        raw = data.tobytes()
        hashes = span_hash(prefix_hash(data, lower=b"<|" not in raw), starts, ends)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        self.again[self.slots[at[known]]] = True
        fresh = np.flatnonzero(~known)
        if len(fresh):
            spans = zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)
            codes = [code.ids for code in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in spans], add_special_tokens=False)]
            counts = np.fromiter(map(len, codes), np.uint32, len(codes))
            self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(counts) - counts).astype(np.uint32)])
            place = at[fresh]  # both sides are sorted
            self.keys = np.insert(self.keys, place, keys[fresh])
            self.slots = np.insert(self.slots, place, len(self.counts) + np.arange(len(codes)))
            self.counts = np.concatenate([self.counts, counts])
            self.again = np.concatenate([self.again, np.zeros(len(codes), bool)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(codes), np.uint32, int(counts.sum()))])
        slot = self.slots[np.searchsorted(self.keys, keys)][back]
        count = self.counts[slot].astype(np.int64)
        total = np.cumsum(count)
        take = np.repeat(self.starts[slot] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        return self.ids[take], np.bincount(row, weights=count, minlength=len(offs) - 1).astype(np.int64)


class TextEncoder:
    """Token ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        ids = [np.array(code.ids, np.uint32) for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


def by_words(path: str) -> bool:
    """Whether a tokenizer's file says that ids of a text are those of its lower-cased words: it lower-cases, keeps only
    what a pattern matches that never matches white space, and has no added token with white space in it."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    normal, before = known.get("normalizer") or {}, known.get("pre_tokenizer") or {}
    steps, splits = (x.get(many) or [x] for x, many in ((normal, "normalizers"), (before, "pretokenizers")))
    first, allowed = splits[0], {"NFC", "NFKC", "Replace", "Lowercase"}
    if not any(s.get("type") == "Lowercase" for s in steps) or any(s.get("type") not in allowed for s in steps):
        return False
    if any(s["type"] == "Replace" and (s["pattern"].get("Regex"), s["content"]) != (r"\s+", " ") for s in steps):
        return False
    pattern = (first.get("pattern") or {}).get("Regex")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or not pattern:
        return False
    spaces = " \t\n\v\f\r"
    if regex.findall(pattern, "ab" + _TAIL) != ["ab", _TAIL]:
        return False
    return not regex.search(pattern, spaces) and not any(c in t["content"] for t in known.get("added_tokens", []) for c in spaces)


def encoder(path: str) -> WordEncoder | TextEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = (WordEncoder if by_words(path) else TextEncoder)(path)
    return _encoders[path]


def _pieces(text: str, doc_id: str, path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for lo, hi, data, offs in blocks(column(batch, text)):
                ids, counts = coder.encode(data, offs)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                begin = np.cumsum(counts) - counts
                n = -(-counts // limit)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * limit
                length = np.minimum(limit, counts[doc] - start)
                where = begin[doc] + start
                crc = np.fromiter((zlib.crc32(ids[a : a + k].data) for a, k in zip(where, length, strict=True)), np.int64, len(doc))
                cols = [batch.column(doc_id).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    edges = np.append(where, len(ids)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return run


def token_pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(doc_id, text).mapInArrow(tidy(_pieces(text, doc_id, tokenizer, limit, end_id, with_ids)), schema)


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, token offset) of each piece; ``capacity`` is (tokens, documents, attention cost)."""
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1).astype(float)
    if (demand > capacity).any():
        raise ValueError("a piece exceeds a sequence's capacity")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((64, 3))
    name = np.empty(64, np.int64)
    opened = used = 0
    order = np.argsort(-lengths, kind="stable")
    smallest = demand.min(0) if len(lengths) else None
    for i in order:
        d = demand[i]
        r = room[:opened]
        best = -1
        fits = np.flatnonzero((r[:, 0] >= d[0]) & (r[:, 1] >= d[1]) & (r[:, 2] >= d[2]))
        if len(fits):
            left = (r[fits] - d) / capacity if rule == "norm" else r[fits] / capacity * (d / capacity)
            score = (left * left) @ weights if rule == "norm" else -(left @ weights)
            best = int(fits[np.argmin(score)])
        if best < 0:
            if opened == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            best, opened = opened, opened + 1
            room[best], name[best] = capacity, used
            used += 1
        sequence[i], offset[i] = name[best], capacity[0] - room[best, 0]
        room[best] -= d
        if (room[best] < smallest).any():  # full: the last open one takes its place
            opened -= 1
            room[best], name[best] = room[opened], name[opened]
    return sequence, offset


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_documents: int | None = None, max_cost: float | None = None, weights=(1.0, 0.05, 0.05), rule: str = "norm", scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` (with ``length``) and the sequence_id and offset of each. Without other bounds a sequence holds
    up to ``max_tokens`` documents and a cost of ``max_tokens`` squared, which tokens alone always respect."""
    capacity = np.array([max_tokens, max_documents or max_tokens, max_cost or float(max_tokens) ** 2], float)
    weight = np.array(weights, float)
    scratch = scratch or Scratch(pieces.sparkSession, "packing")
    stored = scratch.write(pieces, "pieces")
    groups = max(1, -(-stored.count() // PIECES_PER_GROUP))
    dealt = stored.withColumn("kf_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        sequence, offset = best_fit(table.column("length").to_numpy().astype(np.int64), capacity, weight, rule)
        group = table.column("kf_group")[0].as_py()
        return table.drop_columns(["kf_group"]).append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("kf_group").applyInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, with_ids: bool = False, **how) -> DataFrame:
    return pack(token_pieces(df, tokenizer, doc_id, text, max_tokens, with_ids=with_ids), max_tokens, **how)
