import re

import numpy as np
import pyarrow as pa

from keyfold.llm import bytesops as B

TEXTS = ["", "one", "  two  words ", "a\tb\nc\x0bd", "é à\x0cñ", "x" * 3000, None, "end"]


def test_words_are_runs_of_other_bytes():
    column = B.column(pa.record_batch({"t": pa.array(TEXTS)}), "t")
    data, offs = B.flat(column)
    starts, ends, row = B.words(data, offs)
    found = [(int(r), data[a:b].tobytes()) for a, b, r in zip(starts, ends, row, strict=True)]
    want = [(i, w) for i, t in enumerate(TEXTS) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert found == want


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc xyz abc ABC", np.uint8)
    for lower in (False, True):
        p = B.prefix_hash(data, lower)
        h = B.span_hash(p, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15]))
        assert h[0] == h[2] != h[1] and (h[3] == h[0]) is np.bool_(lower)


def test_blocks_cover_all_rows_and_slices():
    column = B.column(pa.record_batch({"t": pa.array(TEXTS * 3)}), "t").slice(2, 17)
    got = []
    for lo, hi, data, offs in B.blocks(column, 100):
        got += [data[offs[i] : offs[i + 1]].tobytes().decode() for i in range(hi - lo)]
    assert got == column.to_pylist()
