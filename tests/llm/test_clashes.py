"""Inputs with more columns than asked for, named like the operators' own working columns."""

from pyspark.sql import functions as F

from tests.conftest import got
from tests.llm.test_llm import NAMES, PASSAGE, operators
from wakeline.llm import leaks, names, packing, subjects

EXTRA = "kind line a b short given country office key partner form rep root words hashes template slots salt rest whole rank before doc item n docs word prev".split()


def wide(df):
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA if c not in df.columns])


def test_extra_columns(spark):
    ops = operators(spark, NAMES)
    assert got(names.same_operator(wide(ops))) == got(names.same_operator(ops))
    docs = spark.createDataFrame([(1, PASSAGE), (2, "orbit comet")], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, passage string")
    assert got(leaks.leaked(wide(docs), wide(items))) == [(1, 1)]
    labels = spark.createDataFrame([(1, "s"), (2, "t")], "doc_id long, subject string")
    assert got(subjects.subjects_of(wide(docs), wide(labels))) == got(subjects.subjects_of(docs, labels))
    counts, boxes = spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), spark.createDataFrame([("a", 10)], "container_kind string, capacity_tokens int")
    assert got(packing.pack(wide(counts), wide(boxes))) == got(packing.pack(counts, boxes))
