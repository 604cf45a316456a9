import hashlib
import uuid

from keyfold.llm import warc as W
from keyfold.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, file string, kf_digest string"
BIG = "<p>" + "é" * 600 + "</p>"
PAGES = [(1, "http://a/1", BIG), (5, "http://a/5\r\nX: y", BIG), (3, None, BIG), (2, "http://b", None), (4, "http://c", ""), (6, "http://d", "small"), (7, "http://e", "small"), (8, "http://f", "y" * 2_000_000), (9, "http://g", "\r\n\r\nWARC/1.1\r\n" * 100)]


def pages(spark):
    return spark.createDataFrame([(*p, None, None) for p in PAGES], SCHEMA)


def test_round_trip(spark):
    got = {tuple(r) for r in W.archive_round_trip(pages(spark)).collect()}
    want = set()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        top = max(j for j, _, h in PAGES if (h or "") == (html or ""))
        revisit = len(raw) >= 1000 and top != i
        want.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == want


def test_selected_records_carry_their_payload(spark):
    scratch = Scratch(spark, "test-warc")
    folder = f"{scratch.path}/archives-{uuid.uuid4().hex}"
    index = scratch.write(W.write_archives(pages(spark), folder), "index")
    rows = W.read_archives(index.where("page_id in (6, 8, 9)"), folder, with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in rows} == {i: h for i, _, h in PAGES if i in (6, 8, 9)}


def test_ranges_join_neighbours_only():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 10 + W.GAP_BYTES + 11, 5), ("b", 0, 3), ("b", 3, W.RANGE_BYTES)]
    assert [(f, b, e, i) for f, b, e, i in W._ranges(rows)] == [("a", 0, 20, [0, 1]), ("a", W.GAP_BYTES + 21, W.GAP_BYTES + 26, [2]), ("b", 0, 3, [3]), ("b", 3, 3 + W.RANGE_BYTES, [4])]


def test_empty(spark):
    assert W.archive_round_trip(pages(spark).limit(0)).count() == 0
