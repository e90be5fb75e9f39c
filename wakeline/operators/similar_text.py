"""Joins of short texts by trigram similarity, without comparing all pairs.

Two sets with a Jaccard similarity of at least t share one of the rarest
|A| - ceil(t |A|) + 1 trigrams of either. Only those are joined, so common trigrams,
which would be hot keys, never meet; the candidates are then compared exactly.

Defined results: null texts and texts without a letter or digit match nothing; equal
texts match with 1; repeated rows each match; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import text as T
from wakeline.workspace import shuffled


def similar(left: DataFrame, right: DataFrame, *, left_key: str, left_text: str, right_key: str, right_text: str, at_least: float) -> DataFrame:
    """(left_key, right_key, similarity) of all pairs whose similarity is at least the bound."""
    sides = {}
    for name, df, key, text in (("l", left, left_key, left_text), ("r", right, right_key, right_text)):
        sides[name] = df.select(F.col(key).alias(f"{name}_key"), T.trigrams(F.lower(F.col(text))).alias("grams")).where("size(grams) > 0")
    grams = sides["l"].select(F.explode("grams").alias("g")).unionByName(sides["r"].select(F.explode("grams").alias("g")))
    spread = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def prefix(name: str) -> DataFrame:
        rows = sides[name].select(f"{name}_key", "grams", F.explode("grams").alias("g")).join(shuffled(spread), "g")
        ordered = rows.groupBy(f"{name}_key", "grams").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
        keep = F.size("grams") - F.ceil(F.lit(at_least) * F.size("grams")).cast("int") + 1
        return ordered.select(f"{name}_key", F.col("grams").alias(f"{name}_grams"), F.explode(F.slice("o", F.lit(1), F.greatest(keep, F.lit(1)))).alias("p")).select(f"{name}_key", f"{name}_grams", "p.g")

    score = T.overlap(F.col("l_grams"), F.col("r_grams"))
    met = prefix("l").join(shuffled(prefix("r")), "g")
    sizes = (F.size("l_grams") >= at_least * F.size("r_grams")) & (F.size("r_grams") >= at_least * F.size("l_grams"))
    found = met.where(sizes).select("l_key", "r_key", score.alias("similarity")).where(F.col("similarity") >= at_least)
    return found.groupBy("l_key", "r_key").agg(F.max("similarity").alias("similarity")).select(F.col("l_key").alias(left_key), F.col("r_key").alias(right_key), "similarity")


def watch_list_matches(vessels: DataFrame, watch_list: DataFrame, *, as_of: str, program: str = "OFAC", threshold: float = 0.7) -> DataFrame:
    """(mmsi, program, reference, match_score, matched_at) of vessels on a watch list.

    The score is the similarity of the names, or 1 where the call signs are equal and not
    empty; only scores above the threshold (strict) are kept. The two ways are joined apart
    and the best score of a pair is taken. Call signs are compared as written."""
    by_name = similar(vessels, watch_list, left_key="mmsi", left_text="name", right_key="ent_num", right_text="sdn_name", at_least=threshold)
    by_sign = vessels.where("call_sign <> ''").select("mmsi", "call_sign").join(watch_list.select("ent_num", "call_sign"), "call_sign").select("mmsi", "ent_num", F.lit(1.0).alias("similarity"))
    best = by_name.select("mmsi", "ent_num", "similarity").unionByName(by_sign).groupBy("mmsi", "ent_num").agg(F.max("similarity").alias("score"))
    return best.where(F.col("score") > threshold).select("mmsi", F.lit(program).alias("program"), F.col("ent_num").cast("string").alias("reference"), F.col("score").cast("float").alias("match_score"), F.lit(as_of).cast("timestamp").alias("matched_at"))
