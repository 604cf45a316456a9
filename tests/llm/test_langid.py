import random
import zlib

import numpy as np

from keyfold.llm import langid as G

PARTS = {"en": ["th", "er", "ing", "and", "ou", "wh"], "de": ["sch", "ung", "ein", "zu", "ä", "ß"], "es": ["ción", "ñ", "ar", "os", "que", "í"]}


def corpus(n=420):
    rng = random.Random(8)
    out = []
    for i in range(n):
        lang = ["en", "de", "es"][i % 3]
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([20, 60, 300])))
        out.append((i, text, "s", lang))
    return out


def test_held_out_accuracy_and_columns(documents):
    odd = [(1000, None, "s", "en"), (1001, "", "s", "en"), (1002, "123 ... \n", "s", "de"), (1003, "日本語", "s", None), (1004, "schungein " * 20_000, "s", None), (None, "and the thing", "s", "en")]
    rows = corpus() + odd
    got = {r.doc_id: r for r in G.identify(documents(*rows)).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i if i is not None else "").encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].lang_pred in ("en", "de", "es", "und")
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und" and got[1004].lang_pred == "de"
    held = [r for r in corpus() if got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[3] for r in held]) > 0.97


def test_filter_keeps_columns_and_drops_undetermined(documents):
    df = documents(*corpus(), (1000, None), (1001, "..."))
    kept = G.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(420))


def test_without_labels_or_rows(documents):
    assert {r.lang_pred for r in G.identify(documents((1, "abc", "s", None))).collect()} == {"und"}
    assert G.identify(documents((1, "abc")).limit(0)).count() == 0


def test_tables_give_the_sums_of_the_network():
    model = G.ByteCnn(["a", "b"])
    x = np.random.default_rng(3).integers(0, G.CLASSES, (5, G.WINDOW)).astype(np.uint8)
    e = model.p["embed"][x]
    pooled = []
    for w in G.WIDTHS:
        z = sum(e[:, k : G.WINDOW - w + 1 + k] @ model.p[f"w{w}"][k * G.EMBED : (k + 1) * G.EMBED] for k in range(w)) + model.p[f"b{w}"]
        pooled.append(np.maximum(z.max(1), 0))
    logits = np.concatenate(pooled, 1) @ model.p["out"] + model.p["bias"]
    q = np.exp(logits - logits.max(1, keepdims=True))
    assert np.allclose(model.probabilities(x), q / q.sum(1, keepdims=True), atol=1e-4)
