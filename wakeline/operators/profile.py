"""Hourly rollups, trajectory vectors, similar movers, anomalies and ranked search.

Defined results: rows without a mover or time are left out; vectors without length have
no distance (null) and rank last; ties go to the lower key; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import text as T
from wakeline.functions import vector as V
from wakeline.operators.timeline import latest, since


def voyage_hourly(positions: DataFrame) -> DataFrame:
    """(bucket, mmsi, position_count, avg_sog, max_sog, track): the track in order of time."""
    point = F.struct(F.col("reported_at").alias("t"), "lon", "lat")
    rows = positions.where("mmsi is not null and reported_at is not null")
    return rows.groupBy(F.date_trunc("hour", "reported_at").alias("bucket"), "mmsi").agg(
        F.count(F.lit(1)).alias("position_count"), F.avg("sog").alias("avg_sog"), F.max("sog").alias("max_sog"), F.array_sort(F.collect_list(point)).alias("track")
    )  # a group is one mover's hour


def trajectory_embeddings(positions: DataFrame, *, as_of: str, lookback: str | None = "7d", min_positions: int = 50, dim: int = V.DIM) -> DataFrame:
    """(mmsi, window_start, window_end, method, embedding, position_count): hashed grid cells
    as a unit vector, of vessels with enough fixes."""
    t = F.lit(as_of).cast("timestamp")
    rows = since(positions, "reported_at", as_of, lookback).where((F.col("reported_at") <= t) & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    counts = rows.groupBy("mmsi", V.grid_bucket(F.col("lon"), F.col("lat"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("mmsi").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sum("n").alias("position_count")).where(F.col("position_count") >= min_positions)
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return by.select("mmsi", F.date_trunc("day", t).alias("window_start"), t.alias("window_end"), F.lit("gridcell_v1").alias("method"), V.unit(vector).alias("embedding"), "position_count")


def anomaly_scores(embeddings: DataFrame, *, as_of: str, method: str = "gridcell_v1") -> DataFrame:
    """(mmsi, computed_at, score, method, mean_distance_to_history, history_windows, reasons): how far
    the latest vector of a mover lies from its earlier ones, at most 1."""
    rows = embeddings.where(F.col("method") == method).select("mmsi", "window_start", "embedding")
    now = latest(rows, ["mmsi"], ["window_start"]).select("mmsi", F.col("window_start").alias("now_at"), F.col("embedding").alias("now"))
    past = rows.join(now, "mmsi").where("window_start < now_at")
    mean = past.groupBy("mmsi").agg(F.avg(V.cosine_distance(F.col("embedding"), F.col("now"))).alias("d"), F.count(F.lit(1)).alias("history_windows"))
    return mean.select("mmsi", F.lit(as_of).cast("timestamp").alias("computed_at"), F.least("d", F.lit(1.0)).cast("float").alias("score"), F.lit("selfhist_v1").alias("method"), F.round(F.col("d").cast("decimal(20,10)"), 4).cast("double").alias("mean_distance_to_history"), "history_windows").withColumn("reasons", F.to_json(F.struct("mean_distance_to_history", "history_windows")))


def similar_vessels(embeddings: DataFrame, vessels: DataFrame, mmsi: int, *, method: str = "gridcell_v1", limit: int = 10) -> DataFrame:
    """(mmsi, name, similarity) of the movers nearest to one; none if it has no vector."""
    rows = latest(embeddings.where(F.col("method") == method).select("mmsi", "window_start", "embedding"), ["mmsi"], ["window_start"])
    target = rows.where(F.col("mmsi") == mmsi).select(F.col("embedding").alias("target"))  # one row
    scored = rows.where(F.col("mmsi") != mmsi).join(F.broadcast(target)).select("mmsi", (1 - V.cosine_distance(F.col("embedding"), F.col("target"))).alias("similarity"))
    return scored.join(vessels.select("mmsi", "name"), "mmsi").orderBy(F.desc_nulls_last("similarity"), "mmsi").limit(limit).select("mmsi", "name", "similarity")


def nearest(queries: DataFrame, base: DataFrame, *, key: str, vector: str, k: int = 10, block: int = 1024) -> DataFrame:
    """(query, key, similarity, rank): the exact k nearest of every query by cosine.

    Queries and base are cut into blocks; each pair of blocks is one matrix product on an
    executor, which keeps the k best per query, so a task holds two blocks however many
    vectors there are."""

    def blocks(df: DataFrame, name: str, n: int) -> DataFrame:
        part = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(n)))
        return part.groupBy("b").agg(F.collect_list("k").alias(f"{name}_k"), F.collect_list("v").alias(f"{name}_v"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q, x = np.stack(row.q_v).astype(float), np.stack(row.x_v).astype(float)
                q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (q, x))
                s, xk = np.round(q @ x.T, 9), np.asarray(row.x_k)
                for i, qk in enumerate(row.q_k):
                    order = np.lexsort((xk, -s[i]))
                    order = order[xk[order] != qk][:k]
                    yield pd.DataFrame({"query": qk, "key": xk[order], "similarity": s[i][order]})

    count = lambda df: max(1, -(-df.count() // block))
    mine, others = count(queries), count(base)
    asked = blocks(queries, "q", mine).drop("b").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    found = asked.join(blocks(base, "x", others), "b").drop("b").mapInPandas(best, "query long, key long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Weights of name, call sign and flag in ranked search.
WEIGHTS = {"name": 1.0, "call_sign": 0.4, "flag_country": 0.2}


def query_terms(text: str) -> list[str]:
    """Lower-case terms of a query; only letters, digits and non-ASCII characters are kept."""
    kept = ["".join(c for c in w if c.isalnum() or ord(c) > 127) for w in text.lower().split()]
    return [w for w in kept if w]


def _cover_rank(lexemes: list[str], weights: list[float], terms: list[str]) -> float:
    """Cover density: every shortest stretch with all terms adds the harmonic mean of its
    weights, less for other words in between."""
    hits = [(p, i, weights[p]) for p, lex in enumerate(lexemes) for i, t in enumerate(terms) if lex.startswith(t)]
    if len({i for _, i, _ in hits}) < len(terms):
        return 0.0
    total, start = 0.0, 0
    places = sorted({p for p, _, _ in hits})
    while True:
        end = next((q for q in places if q >= start and {i for p, i, _ in hits if start <= p <= q} == set(range(len(terms)))), None)
        if end is None:
            return total
        begin = next(p for p in reversed(places) if p <= end and {i for x, i, _ in hits if p <= x <= end} == set(range(len(terms))))
        inside = [w for p, _, w in hits if begin <= p <= end]
        noise = (end - begin) - (len({p for p, _, _ in hits if begin <= p <= end}) - 1)
        total += len(inside) / sum(1 / w for w in inside) / (1 + noise)
        start = begin + 1


def vessel_search(vessels: DataFrame, query: str, *, limit: int = 50) -> DataFrame:
    """(mmsi, name, call_sign, flag_country, rank) of vessels that match every term by prefix.

    A name outranks a call sign, that a flag. An empty query finds nothing. One term is
    ranked by column arithmetic; several need the positions and are ranked in batches."""
    terms = query_terms(query)

    def lexemes(column: str, weight: float) -> Column:
        return F.transform(T.words(F.coalesce(F.col(column), F.lit(""))), lambda w: F.struct(w.alias("lexeme"), F.lit(weight).alias("weight")))

    def has(term: str) -> Column:
        return F.exists("doc", lambda d: d["lexeme"].startswith(term))

    parts = [lexemes(c, x) for c, x in WEIGHTS.items()]
    docs = vessels.select("mmsi", "name", "call_sign", "flag_country", F.concat(*parts).alias("doc"))
    if not terms:
        return docs.where("false").select("mmsi", "name", "call_sign", "flag_country", F.lit(0.0).alias("rank"))
    hit = docs
    for t in terms:
        hit = hit.where(has(t))
    if len(terms) == 1:
        rank = F.aggregate("doc", F.lit(0.0), lambda s, d: s + F.when(d["lexeme"].startswith(terms[0]), d["weight"]).otherwise(0.0))
    else:
        rank = F.pandas_udf(lambda lex, wt: pd.Series([_cover_rank(list(a), list(b), terms) for a, b in zip(lex, wt)], dtype=float), "double")(F.col("doc.lexeme"), F.col("doc.weight"))
    return hit.select("mmsi", "name", "call_sign", "flag_country", rank.alias("rank")).orderBy(F.desc("rank"), "mmsi").limit(limit)
