"""The queries of the problems on names and texts, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.io import table
from wakeline.llm import destinations, leaks, names, packing, subjects


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_operator(table(spark, folder, "operators"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return names.classes(table(spark, folder, "operators"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return destinations.bound_for(table(spark, folder, "raw_messages"), table(spark, folder, "ports"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, folder, "documents")), table(spark, folder, "containers"))


def p8_unused(spark: SparkSession, folder: str) -> DataFrame:
    return packing.unused(p8_packed(spark, folder), table(spark, folder, "containers"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.reparameterised(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects_of(table(spark, folder, "documents"), table(spark, folder, "subject_labels"))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(p10_found(spark, folder), table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_classes, p7_found, p8_packed, p8_unused, p9_found, p9_reparameterised, p10_found, p10_composition)
}
ORACLES: dict[str, str] = {
    "p9_found": """WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '[\\p{L}\\p{N}]+'), lambda w: lower(w)) AS w FROM documents),
i AS (SELECT item_id, list_transform(regexp_extract_all(passage, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS s FROM d WHERE len(w) >= 12),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS s FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
}
