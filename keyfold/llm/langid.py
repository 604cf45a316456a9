"""Language identification with a byte convolutional network trained in numpy.

All 256 byte values map to an embedding; filters of widths 2, 3 and 4 run over fixed windows of bytes, each filter keeps its maximum, and a softmax layer reads the maxima. A document's probabilities are the means over
all windows of its whole text, weighted by the bytes in each. For prediction, embedding and filters are folded into
tables indexed by single classes and pairs of classes, which gives the same sums with fewer steps.

Training reads at most ``per_language`` excerpts of each language (a documented bound), chosen by a hash of the id
among rows with text and language that the caller's condition admits; nothing but text and label enters.

Defined results: null text or text without a letter gives ``und`` with score 0; without a labelled row every text
gives ``und``; rows that repeat repeat their result; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import blocks, column, tidy
from .scratch import small_batches

WINDOW, EMBED, FILTERS, WIDTHS, PER_LANGUAGE, MOST_EXCERPTS, EXCERPT, STEPS, SEED = 256, 8, 16, (2, 3, 4), 1200, 1 << 16, 300, 640, 7
UNDETERMINED = "und"
CLASSES = 256


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by window, row of each window, bytes in each window); byte 0 fills the last window of a row."""
    n = -(-np.diff(offs) // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    start = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    size = np.minimum(WINDOW, offs[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8), row, size


class ByteCnn:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["embed"][x]
        pooled, memory = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], 2)
            z = cols @ p[f"w{w}"] + p[f"b{w}"]
            best = z.argmax(1)
            top = np.take_along_axis(z, best[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            memory.append((cols, best, top))
        h = np.concatenate(pooled, 1)
        logits = h @ p["out"] + p["bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": h.T @ q, "bias": q.sum(0), "embed": np.zeros_like(p["embed"])}
        dh = q @ p["out"].T
        for j, w in enumerate(WIDTHS):
            cols, best, top = memory[j]
            d = dh[:, j * FILTERS : (j + 1) * FILTERS] * (top > 0)
            picked = cols[np.arange(n)[:, None], best]  # window, filter, w * EMBED
            g[f"w{w}"] = np.einsum("nfk,nf->kf", picked, d)
            g[f"b{w}"] = d.sum(0)
            back = (d[:, :, None] * p[f"w{w}"].T).reshape(n, FILTERS, w, EMBED)
            for k in range(w):
                np.add.at(g["embed"], x[np.arange(n)[:, None], best + k], back[:, :, k])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.004) -> ByteCnn:
        rng, t = np.random.default_rng(SEED + 1), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        while t < steps:
            order = rng.permutation(len(x))
            for lo in range(0, min(len(x), (steps - t) * batch), batch):
                g, t = self.loss_gradient(x[order[lo : lo + batch]], y[order[lo : lo + batch]]), t + 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """For each width, tables of pairs of bytes (and of single bytes for an odd rest) whose sum is the filter."""
        out = []
        for w in WIDTHS:
            single = [self.p["embed"] @ self.p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(CLASSES * CLASSES, FILTERS) for k in range(0, w - 1, 2)]
            out.append((pairs + single[w - 1 :] * (w % 2), self.p[f"b{w}"]))
        return out

    def probabilities(self, x: np.ndarray, tables=None, step: int = 16) -> np.ndarray:
        tables, out = tables or self.tables(), []
        for lo in range(0, len(x), step):
            c = np.ascontiguousarray(x[lo : lo + step].T, np.intp)  # positions first: the maximum runs over whole rows
            pair, pooled = c[:-1] * CLASSES + c[1:], []
            for w, (parts, bias) in zip(WIDTHS, tables, strict=True):
                n = WINDOW - w + 1
                z = parts[0].take(pair[:n], 0)
                for k, part in enumerate(parts[1:], 1):
                    z += part.take(pair[2 * k : 2 * k + n] if 2 * k + 1 < w else c[2 * k : 2 * k + n], 0)
                pooled.append(np.maximum(z.max(0) + bias, 0))
            logits = np.concatenate(pooled, 1) @ self.p["out"] + self.p["bias"]
            q = np.exp(logits - logits.max(1, keepdims=True))
            out.append(q / q.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def fit(df: DataFrame, text: str, lang: str, doc_id: str, admitted: Column, per_language: int = PER_LANGUAGE) -> ByteCnn | None:
    """A network for every language among the admitted rows, or None without any."""
    rows = df.where(admitted & F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r["k"]: r["n"] for r in rows.groupBy(F.col(lang).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    per_language = max(1, min(per_language, MOST_EXCERPTS // len(languages)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, (1.2 * per_language + 8) / counts[k]))])
    key = F.xxhash64(F.col(doc_id).cast("string"), F.lit(SEED))
    u = F.pmod(key, F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.pmod(F.shiftright(key, 20), F.greatest(F.length(text) - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.where(u < F.element_at(share, F.col(lang))).select(F.col(lang).alias("k"), key.alias("h"), F.substring(F.col(text), place, F.lit(EXCERPT)).alias("t"))
    found: dict[str, list] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["h"], r["t"])):
        if len(found.setdefault(r["k"], [])) < per_language:
            found[r["k"]].append(r["t"].encode()[:WINDOW])
    texts = [t for k in languages for t in found.get(k, [])]
    y = np.array([i for i, k in enumerate(languages) for _ in found.get(k, [])])
    if not texts:
        return None
    offs = np.cumsum([0, *map(len, texts)])
    x, row, _ = windows(np.frombuffer(b"".join(texts), np.uint8), offs)
    return ByteCnn(languages).train(x, y[row])


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _predict(model: ByteCnn | None, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            for lo, hi, data, offs in blocks(column(batch, text)):
                seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                letters = seen[offs[1:]] > seen[offs[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(offs) > 0)):
                    letters[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
                label, score = np.full(hi - lo, UNDETERMINED, object), np.zeros(hi - lo)
                if model:
                    x, row, size = windows(data, offs)
                    q = model.probabilities(x, tables) * size[:, None]
                    total = np.stack([np.bincount(row, q[:, k], hi - lo) for k in range(q.shape[1])], 1)
                    best = total.argmax(1)
                    label = np.where(letters, np.array(model.languages, object)[best], UNDETERMINED)
                    score = np.where(letters, np.clip(total.max(1) / np.maximum(1, np.diff(offs)), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in keep], pa.array(label, pa.string()), pa.array(score)], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: ByteCnn | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (as k0, k1, …), lang_pred and score of every row."""
    small_batches(df.sparkSession)
    kinds = [f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)]
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(_predict(model, list(keep), text)), ", ".join([*kinds, "lang_pred string", "score double"]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    model = fit(df, text, lang, doc_id, ~held_out(doc_id))
    out = predict(df, model, text, (doc_id,)).withColumnRenamed("k0", "doc_id")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.35, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` without rows that are undetermined or scored below ``least``."""
    model = fit(df, text, lang, doc_id, ~held_out(doc_id))
    names = df.columns
    out = predict(df, model, text, tuple(names))
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
