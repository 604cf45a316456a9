"""The prefix scans read every event, whatever its id."""

from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from keyfold.queries import QUERIES

STEPS = {"sum": lambda v: [round(x, 2) for x in accumulate(v)], "count": lambda v: list(range(1, len(v) + 1)), "min": lambda v: list(accumulate(v, min)), "max": lambda v: list(accumulate(v, max))}


@pytest.mark.parametrize("op", sorted(STEPS))
def test_prefix_scans_whole_table(spark, tmp_path, op):
    n = 5000
    kinds, values = [("purchase", "view", "click")[i % 3] for i in range(n)], [((i * 7919) % 1000 - 300) / 4 for i in range(n)]
    pq.write_table(pa.table({"event_id": list(range(n)), "event_type": kinds, "value": values}), tmp_path / "events.parquet")
    got = QUERIES[f"prefix_{op}"](spark, str(tmp_path)).collect()
    assert list(got[0]["value"]) == STEPS[op]([v for k, v in zip(kinds, values, strict=True) if k == "purchase"])
