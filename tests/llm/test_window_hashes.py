"""The first pass of the decontamination computes hashes alone, the same as the second."""

import pytest

pytest.importorskip("tidemark.llm.decontaminate")
from pyspark.sql import functions as F

from tidemark.llm import decontaminate


def test_first_pass_has_the_second_ones_hashes_and_no_slots(spark):
    texts = ["(Ann) paid 12 dollars, “not 3.5%” of it to Bob Lee on the day; so she said... to him and to us all", "Über … 42km abé. --- x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    light, full = (decontaminate._sequences(df, "id", "text", "out", slots) for slots in (False, True))
    assert light.schema["x"].dataType.simpleString() == "array<bigint>"
    want = full.select("out", F.transform("x", lambda y: y["k"]).alias("x"), "r")
    assert sorted(map(str, light.collect())) == sorted(map(str, want.collect()))
    words = spark.createDataFrame([(1, "(a) “b” c... ¿d? é! --- 5% x-y")], "id long, text string")
    got = decontaminate._sequences(words, "id", "text", "out", False).select("r").first()["r"]
    bare = spark.createDataFrame([(w,) for w in ["a", "b", "c", "d", "é", "5%", "x-y"]], "w string").select(F.xxhash64("w"))
    assert got == [r[0] for r in bare.collect()]
