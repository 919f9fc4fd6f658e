"""Rows of counts as they are shuffled."""

import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm.mixing")
from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_counts_are_shuffled_in_three_columns_and_come_back_whole(spark, monkeypatch):
    made = [(-5, mixing.WORD_ROW, 0), (7, 0, 1), ((4 << 32) | 99, 255, (1 << 53) + 1), (1, 13, 1 << 40)]
    rows = spark.createDataFrame(made, "ctx long, next short, n long").select("ctx", mixing.packed())
    ctx, nxt, n = mixing.unpacked(pa.Table.from_batches(rows.toArrow().to_batches()))
    assert list(zip(ctx.view("int64").tolist(), nxt.tolist(), n.tolist(), strict=True)) == made
    looked = {}

    def kept(df, name, *rest, put=mixing.written):
        looked[name] = df.columns
        return put(df, name, *rest)

    monkeypatch.setattr(mixing, "written", kept)
    assert mixing.score(spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string"), F.lit(False)).count() == 2
    assert looked["looked"] == ["block", "ctx", "m"]
