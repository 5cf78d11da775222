"""Workers take Arrow batches in slices of a bounded size."""

import pandas as pd
import pyarrow as pa

from quarry.operators import slices
from quarry.operators.slices import series_slices
from quarry.operators.slices import slices as cut


def test_slices_hold_all_rows_in_order_and_are_bounded():
    texts = ["a" * 30, None, "", "b" * 500, "c" * 40, "d" * 40, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], ["text", "i"])
    parts = list(cut(batch, "text", 100))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 100 for p in parts) and len(parts) > 2
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 5, None, [2] * 9, [], [3] * 2])], ["x"])
    assert [p.column("x").to_pylist() for p in cut(lists, "x", 6)] == [[[1] * 5, None], [[2] * 9], [[], [3] * 2]]
    series = pd.Series(texts)
    got = list(series_slices(iter([series, series.iloc[:0]]), 100))
    assert [x for s in got for x in s] == texts and len(got) == len(parts)


def test_term_lists_do_not_hold_a_whole_batch(spark):
    from quarry.operators import lexical
    df = spark.createDataFrame([(i, "alpha beta " * (1 + i % 3)) for i in range(50)], "doc_id long, text string").coalesce(1)
    big = slices.TEXT_BYTES
    rows = lexical.term_lists(df, "doc_id", "text", [], 2).orderBy("doc_id").collect()
    assert big <= 1 << 20 and [r["n_words"] for r in rows] == [2 * (1 + i % 3) for i in range(50)]
    assert rows[0]["terms"] == ["alpha", "beta", "alpha beta"]
