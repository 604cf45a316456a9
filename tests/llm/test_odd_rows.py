"""Null ids and repeated rows, for the operators whose other tests leave them out."""

from collections import Counter

from keyfold.llm import exact_dedup as E
from keyfold.llm import langid as G
from keyfold.llm import licenses as L
from keyfold.llm import ngram_join as N
from keyfold.llm import packing as P
from keyfold.llm import rptree as R
from keyfold.llm import secrets as S
from keyfold.llm import warc as W
from keyfold.llm.queries import tokenizer_path

BIG = "payload " * 200


def test_licences_and_secrets_of_repeated_rows(documents, spark):
    key = "0123456789abcdef" * 2
    rows = [(1, f'Released under the MIT License.\ntoken = "{key}"\nand more words that follow on')] * 3 + [(None, "Released under the MIT License.")]
    assert Counter((r.doc_id, r.line) for r in L.scan(documents(*rows)).collect()) == Counter({(1, 0): 3, (None, 0): 1})
    found = S.scan(documents(*rows, (None, f'token = "{key}"')), forest=S.train(spark)).collect()
    assert Counter((r.doc_id, r.length) for r in found) == Counter({(1, 32): 3, (None, 32): 1})


def test_candidates_of_a_text_with_very_many(documents, spark):
    value = "a1B2c3D4e5F6g7H8i9J0k"
    text = " ".join(f"{value}{k:05d}" for k in range(3000))
    starts = sorted(r.start for r in S.candidates(documents((1, text)), ["doc_id"], "text").collect())
    assert starts == [k * (len(value) + 6) for k in range(3000)]


def test_languages_of_repeated_rows(documents):
    rows = [(i % 5, text, "s", lang) for i in range(40) for text, lang in (("the and thing when", "en"), ("schön und größe heiß", "de"))]
    got = G.identify(documents(*rows, (None, "the thing", "s", None))).collect()
    assert len(got) == 81 and len({(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 2


def test_other_scripts_are_told_apart(documents):
    words = {"ru": "привет мир как дела сегодня хорошо день", "el": "καλημέρα κόσμε πώς είσαι σήμερα καλά ημέρα", "ja": "こんにちは世界今日は元気ですか良い日", "ar": "مرحبا بالعالم كيف حالك اليوم جيد"}
    rows = [(i, " ".join([w[i % 3 :]] * (1 + i % 4)), "s", lang) for lang, w in words.items() for i in range(60)]
    got = G.identify(documents(*[(100 * k + r[0], *r[1:]) for k, r in enumerate(rows)]))
    want = {100 * k + r[0]: r[3] for k, r in enumerate(rows)}
    held = [(r.lang_pred, want[r.doc_id]) for r in got.where("held_out").collect()]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_packing_of_null_ids_and_repeated_rows(documents):
    got = P.pack_documents(documents((None, "a b"), (None, "a b"), (4, "c"), (4, "c")), tokenizer_path()).collect()
    assert Counter(r.doc_id for r in got) == Counter({None: 2, 4: 2}) and {r.length for r in got} == {2, 3}


def test_another_tokenizer_reads_whole_texts(documents):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert not P.by_words(path) and P.by_words(tokenizer_path())
    text = "Hello  World\n\n  x = 1;\tÉté"
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    row = P.token_pieces(documents((1, text)), path).collect()[0]
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_best_fit_under_binding_capacities(documents):
    rows = [(i, "w " * (5 + i % 40)) for i in range(300)]
    got = P.pack_documents(documents(*rows), tokenizer_path(), max_tokens=100, max_documents=3, max_cost=2500.0).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert len(got) == 300 and all(sum(b) <= 100 and len(b) <= 3 and sum(n * n for n in b) <= 2500 for b in bins.values())
    assert any(len(b) == 3 for b in bins.values()) and any(sum(n * n for n in b) > 2000 for b in bins.values())


def test_pages_without_ids_and_repeated_pages(spark):
    pages = spark.createDataFrame([(None, "u", BIG), (3, "u", BIG), (3, "u", BIG), (2, "v", BIG), (2, "v", "other " * 300), (None, None, None)], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in W.archive_round_trip(pages).collect())
    assert got == Counter({(3, "response", None): 2, (2, "revisit", 3): 1, (2, "response", None): 1, (None, "revisit", 3): 1, (None, "response", None): 1})


def test_vectors_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (2, [0.0, 2.0], 0), (None, [1.0, 0.0], 0)]
    got = R.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter({(1, 1): 3, (2, 1): 1, (None, 0): 1})


def test_equal_texts_without_ids(documents):
    rows = [(None, "a b"), (None, "a  b"), (7, "c"), (None, "c")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_groups(documents(*rows)).collect())
    assert got == Counter({(None, None, 2, True): 2, (7, 7, 2, True): 1, (None, 7, 2, False): 1})
    assert Counter(r.doc_id for r in E.keep_first(documents(*rows)).collect()) == Counter({None: 1, 7: 1})


def test_an_id_with_two_texts_joins_what_they_link_to(documents):
    one, two = ([f"{w}{i}" for i in range(40)] for w in "pq")
    near = lambda words, k: " ".join([*words[:k], "x", *words[k + 1 :]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, near(one, 0)), (9, near(two, 39)), (8, " ".join(two)), (1, "alone here")]
    got = {r.doc_id: r.component_id for r in N.link_components(documents(*rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 8: 3, 1: 1}
