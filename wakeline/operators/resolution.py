"""Typed operator names folded into known operators.

The rule is: an equal name or alias (case ignored) is the operator; else the most
similar canonical at 0.5 or more takes the name as an alias; else the name becomes an
operator of its own, and with a similarity of at least 0.3 the pair is put up for review.
Read one after another, names fold into operators that earlier names created. Here all
names are decided at once: names without a known operator are grouped by the same bound,
by connected components, and the first of a group (in input order) is created. That
merges transitively, which a reading in sequence may not; it makes the result free of
the order within a group and keeps the work distributed.

Defined results: null and blank names are left out; repeated names are decided once;
equal similarities go to the lower operator id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.graph import components
from wakeline.operators.similar_text import similar
from wakeline.workspace import cut, shuffled


def resolve_operators(names: DataFrame, operators: DataFrame, *, match: float = 0.5, review: float = 0.3) -> DataFrame:
    """(name, decision, operator_id, canonical, similarity) for each distinct name of
    ``names`` (name, seq): decision is 'exact', 'fold', 'create' or 'join'."""
    first = names.where("trim(name) <> ''").groupBy("name").agg(F.min("seq").alias("seq"))
    forms = operators.select("id", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    known = forms.groupBy(F.lower("form").alias("low")).agg(F.min("id").alias("operator_id"))
    exact = first.withColumn("low", F.lower("name")).join(shuffled(known), "low").select("name", "operator_id")
    rest = cut(first.join(exact, "name", "left_anti"))
    near = similar(rest, operators.select("id", "canonical"), left_key="name", left_text="name", right_key="id", right_text="canonical", at_least=match)
    fold = cut(near.groupBy("name").agg(F.max(F.struct("similarity", (-F.col("id")).alias("neg"))).alias("b")).select("name", F.col("b.similarity").alias("similarity"), (-F.col("b.neg")).alias("operator_id")))
    fresh = cut(rest.join(fold, "name", "left_anti"))
    other = fresh.select(F.col("seq").alias("y"), F.col("name").alias("name_y"))
    alike = similar(fresh, other, left_key="seq", left_text="name", right_key="y", right_text="name_y", at_least=match)
    grouped = components(fresh.select(F.col("seq").alias("id")), alike.where("seq < y").select(F.col("seq").alias("x"), "y"))
    created = fresh.join(grouped.withColumnRenamed("id", "seq"), "seq").join(fresh.select(F.col("seq").alias("root"), F.col("name").alias("canonical")), "root")
    canonical = operators.select(F.col("id").alias("operator_id"), "canonical")
    none = F.lit(None).cast("double")
    return (
        exact.join(canonical, "operator_id").select("name", F.lit("exact").alias("decision"), "operator_id", "canonical", none.alias("similarity"))
        .unionByName(fold.join(canonical, "operator_id").select("name", F.lit("fold").alias("decision"), "operator_id", "canonical", "similarity"))
        .unionByName(created.select("name", F.when(F.col("seq") == F.col("root"), "create").otherwise("join").alias("decision"), F.lit(None).cast("int").alias("operator_id"), "canonical", none.alias("similarity")))
    )


def review_queue(names: DataFrame, operators: DataFrame, *, match: float = 0.5, review: float = 0.3) -> DataFrame:
    """(input, candidate_id, similarity): created names with a known operator in the doubtful range."""
    made = resolve_operators(names, operators, match=match, review=review).where("decision = 'create'").select(F.col("name").alias("input"))
    near = similar(made, operators.select("id", "canonical"), left_key="input", left_text="input", right_key="id", right_text="canonical", at_least=review)
    w = Window.partitionBy("input").orderBy(F.desc("similarity"), "id")
    return near.withColumn("r", F.row_number().over(w)).where("r = 1").select("input", F.col("id").alias("candidate_id"), "similarity")


def with_aliases(operators: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Operators with folded names appended as aliases unless they are there, case ignored."""
    added = resolutions.where("decision = 'fold'").groupBy(F.col("operator_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("new"))
    have = F.coalesce("aliases", F.array().cast("array<string>"))
    fresh = F.filter("new", lambda n: ~F.exists("have", lambda a: F.lower(a) == F.lower(n)))
    return operators.join(added, "id", "left").withColumn("have", have).withColumn("aliases", F.when(F.col("new").isNull(), F.col("have")).otherwise(F.concat("have", fresh))).drop("new", "have")
