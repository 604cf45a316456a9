import random

import numpy as np

from keyfold.llm import licenses as L
from keyfold.llm import secrets as S
from keyfold.llm.forest import Forest


def brute_licenses(text):
    import re

    lines = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^a-z0-9\n]+", " ", text.lower())).split("\n")
    units = list(enumerate(lines)) + ([(-1, " ".join(lines))] if len(lines) > 1 else [])
    out = set()
    for i, unit in units:
        grams = set(L.bigram_set(unit.split()))
        best = max(((2 * len(grams & set(g)) / (len(grams) + len(g)), -k, name) for k, (name, g, _, _) in enumerate(L._templates(L.LEAST))), default=None) if grams else None
        if best and best[0] >= L.LEAST:
            out.add((i, best[2], round(best[0], 9), -1))
    words = L.template_words(text)
    for name, grams, m, step in L.long_templates(L.LEAST):
        rated = [(2 * len(set(grams) & mine) / (len(grams) + len(mine)), -s) for s in sorted({*range(0, len(words) - m + 1, step), max(0, len(words) - m)}) for mine in [set(L.bigram_set(words[s : s + m]))]]
        dice, s = max(rated)
        if len(words) > m and dice >= L.LEAST:
            out.add((-2, name, round(dice, 9), -s))
    return out


def test_licenses_match_brute_force(documents):
    full = L.TEMPLATES["MIT-text"]
    wrapped = "\n".join(full[i : i + 60] for i in range(0, len(full), 60))
    texts = {1: "Prose.\nReleased under the MIT License.\nMore prose here", 2: wrapped, 3: None, 4: "", 5: "RELEASED!! UNDER!! THE!! MIT!! LICENSE", 6: "word " * 30_000, 7: "released under the mitt license", 8: "All rights reserved.\n\n\n(c)", 9: "mit " * 6, 10: "\n" + L.TEMPLATES["Apache-2.0-header"] + " extra words"}
    code = "\n".join(f"line {i} of the program does {i * 7} things" for i in range(100))
    texts |= {11: f"{code}\n{wrapped}\n{code}", 12: f"{code}\n# " + L.TEMPLATES["BSD-3-Clause-text"].replace("; ", ";\n# ") + code, 13: code + " software notice copyright permission", 14: f"{code} {full} {code} {full}"}
    got = {}
    for r in L.scan(documents(*texts.items())).collect():
        got.setdefault(r.doc_id, set()).add((r.line, r.license, r.dice, r.first_word))
    assert got == {i: found for i, t in texts.items() if t and (found := brute_licenses(t))}
    assert any(name == "MIT-text" for _, name, _, _ in got[2])
    assert [{name for line, name, _, _ in got.get(i, ()) if line == -2} for i in (11, 12, 13, 14)] == [{"MIT-text"}, {"BSD-2-Clause-text", "BSD-3-Clause-text"}, set(), {"MIT-text"}]


def test_every_match_has_a_telling_word():
    for _, grams, _, _ in L.long_templates(L.LEAST):
        words = set(L.telling_words(grams, L.LEAST))
        without = [g for g in grams if not words & {*g.split(" ")}]
        assert 2 * len(without) < L.LEAST * (len(without) + len(grams))


def test_no_match_has_fewer_words():
    rng = random.Random(7)
    for _, grams, _, _ in L.long_templates(L.LEAST):
        fewest, need = L.fewest_words(grams, L.LEAST), int(len(grams) * 0.6 + 0.999)
        for _ in range(200):
            word = rng.choice(rng.choice(grams).split(" "))
            near = sorted(grams, key=lambda g: (word not in g.split(" "), rng.random()))[:need]
            assert len({w for g in near for w in g.split(" ")}) >= fewest


def test_units_without_telling_words_are_dropped_and_no_match_is(spark):
    rng = random.Random(8)
    every = [grams for _, grams, _, _ in L._templates(L.LEAST)]
    told = lambda units, templates: [r.p for r in spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, w array<string>").orderBy("i").select(L.possible("w", templates, L.LEAST).alias("p")).collect()]
    matches = []
    for _, grams, _, _ in L._templates(L.LEAST):
        need = next(k for k in range(1, len(grams) + 1) if 2 * k >= L.LEAST * (k + len(grams)))
        for _ in range(20):  # as few bigrams as a match can have, those that hold one of its words last
            word = rng.choice(rng.choice(grams).split(" "))
            near = sorted(grams, key=lambda g: (word in g.split(" "), rng.random()))[:need]
            matches.append([w for g in near for w in g.split(" ")])
    assert all(told(matches, every))
    assert not any(told([["the", "cat", "sat", "by", "the", "river", "and", "you", "did", "not"], [""], ["under", "cc"]], every))
    assert told([["licensed", "under", "cc", "by", "4", "0"]], [next(g for n, g, _, _ in L._templates(L.LEAST) if n == "CC-BY-4.0")]) == [True]


def test_no_licence_in_an_empty_table(documents):
    assert L.scan(documents((1, "x")).limit(0)).count() == 0


def test_size_bounds_lose_nothing():
    for size in range(1, 60):
        low, high = L.bounds(size, 0.75)
        assert all((low <= n <= high) == (2 * min(n, size) / (n + size) >= 0.75) for n in range(1, 300))


def test_forest_conditions_equal_its_predictions(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 3)
    forest = Forest.train(["a", "b", "c"], x, ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").select(forest.column().alias("p")).collect()
    assert np.allclose([r.p for r in rows], forest.predict(x))
    assert np.mean((forest.predict(x) >= 0.5) == ((x[:, 0] > 0.2) ^ (x[:, 1] > 0))) > 0.95


def test_secrets(documents, spark):
    forest = S.train(spark)
    held = [(i, t, str(y)) for i, (t, y) in enumerate(S.labelled_findings(seed=77, each=15))]
    first = {}
    for r in S.scan(documents(*held), forest=forest).orderBy("doc_id", "start").collect():
        first.setdefault(r.doc_id, r.is_secret)
    right = [first[i] == (y == "1") for i, _, y in held if i in first]
    assert len(right) >= 0.95 * len(held) and np.mean(right) >= 0.95

    key = "".join(random.Random(1).choices("0123456789abcdef", k=40))
    texts = {1: f'prose token = "{key}" more token = "{key}"', 2: None, 3: "", 4: "plain words only", 5: "see /usr/share/doc/readme/index.html", 6: "w " * 20_000 + f'secret: "{key}"'}
    got = {(r.doc_id, r.start, r.length): r.is_secret for r in S.scan(documents(*texts.items()), forest=forest).collect()}
    assert got[1, texts[1].index(key), 40] and got[1, texts[1].rindex(key), 40] and got[6, 40_009, 40]
    assert {k[0] for k in got} == {1, 5, 6} and not any(v for k, v in got.items() if k[0] == 5)
    findings = S.scan(documents(*texts.items()), forest=forest)
    clean = {r.doc_id: r.text for r in S.redact(documents(*texts.items()), findings).collect()}
    assert key not in clean[1] + clean[6] and clean[5] == texts[5] and clean[2] is None
    assert S.scan(documents((1, "x")).limit(0), forest=forest).count() == 0
