"""Destinations of static messages resolved to ports by code, similarity or abbreviation.

Distinct texts only are resolved, set-wise: tokens are joined to location codes (0.95),
to port names by trigram similarity of at least 0.4, and to names of which an
abbreviation is a subsequence (0.75); the best answer of at least 0.3 wins, earlier
probes first. Abbreviations meet names by their first three letters: every name is entered
under each three letters that follow each other in it, gaps allowed.

Defined results: texts that mean no port stay with a null port and confidence 0; null
ports' names or codes match nothing; ties go to the shorter name, then the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import text as T
from wakeline.operators.ingest import STATIC_TYPE, decode_messages
from wakeline.operators.similar_text import similar
from wakeline.operators.timeline import since
from wakeline.workspace import cut

#: Words that are no part of a place, and texts that mean none.
STOP = "TO VIA FOR AT THE AND OFF NEXT ORDER ORDERS PILOT ANCH ANCHORAGE".split()
JUNK = ["", "AT SEA", "ATSEA", "AT ANCHOR", "FOR ORDERS", "ORDERS", "UNKNOWN", "N/A", "NA", "NIL", "NONE", "TBN", "-"]


def token_candidates(texts: DataFrame) -> DataFrame:
    """(destination, pos, token): words of at least three letters that may name a place, in
    order, and the whole without gaps."""
    norm = F.upper(F.trim("destination"))
    parts = F.filter(F.split(F.col("norm"), "[^A-Z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))
    whole = F.regexp_replace("norm", "[^A-Z0-9]", "")
    rows = texts.withColumn("norm", norm).where(~F.col("norm").isin(*JUNK))
    return rows.select("destination", F.posexplode(F.array_distinct(F.concat(parts, F.array(whole)))).alias("pos", "token")).where("token <> ''")


def _entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names under every three of their letters and digits in order."""
    for pdf in batches:
        rows = []
        for i, name in zip(pdf["port_id"], pdf["name"]):
            letters = [c for c in name.upper() if c.isascii() and c.isalnum()]
            one: set[str] = set()
            two: set[str] = set()
            three: set[str] = set()
            for c in letters:
                three |= {p + c for p in two}
                two |= {p + c for p in one}
                one.add(c)
            rows += [(i, name, k) for k in three]
        yield pd.DataFrame(rows, columns=["port_id", "name", "key"])


def resolve_destinations(texts: DataFrame, ports: DataFrame) -> DataFrame:
    """(destination, port_id, confidence) of distinct texts."""
    texts = texts.select("destination").where("destination is not null").distinct()
    tokens = token_candidates(texts)
    distinct = tokens.select("token").distinct()
    codes = ports.where("un_locode is not null").groupBy(F.upper("un_locode").alias("token")).agg(F.min("id").alias("port_id"))
    by_code = tokens.where("length(token) = 5").join(codes, "token").select("destination", "pos", "port_id", F.lit(0.95).alias("confidence"), F.lit(0).alias("probe"))
    alike = similar(distinct, ports.select("id", "name"), left_key="token", left_text="token", right_key="id", right_text="name", at_least=0.4)
    w = Window.partitionBy("token").orderBy(F.desc("similarity"), F.length("name"), "id")
    best = alike.join(ports.select("id", "name"), "id").withColumn("r", F.row_number().over(w)).where("r = 1")
    by_name = tokens.join(best, "token").select("destination", "pos", F.col("id").alias("port_id"), F.col("similarity").alias("confidence"), F.lit(1).alias("probe"))
    vowels = F.length("token") - F.length(F.translate("token", "AEIOU", ""))
    short = distinct.where(F.length("token").between(3, 6) & (vowels <= 1)).withColumn("pattern", T.subsequence_pattern(F.col("token")))
    names = ports.select(F.col("id").alias("port_id"), "name").where("name is not null")
    met = short.withColumn("key", F.substring("token", 1, 3)).join(names.mapInPandas(_entered, "port_id int, name string, key string"), "key")
    found = met.where(F.expr("name rlike pattern")).groupBy("token").agg(F.min(F.struct(F.length("name"), "port_id")).alias("m")).select("token", F.col("m.port_id").alias("port_id"))
    by_short = tokens.join(found, "token").select("destination", "pos", "port_id", F.lit(0.75).alias("confidence"), F.lit(2).alias("probe"))
    all_ = by_code.unionByName(by_name).unionByName(by_short).where("confidence >= 0.3")
    order = F.struct("confidence", (-F.col("pos")).alias("p"), (-F.col("probe")).alias("q"))
    won = all_.groupBy("destination").agg(F.max_by(F.struct("port_id", "confidence"), order).alias("w"))
    return texts.join(won, "destination", "left").select("destination", F.col("w.port_id").alias("port_id"), F.coalesce(F.col("w.confidence"), F.lit(0.0)).cast("float").alias("confidence"))


def destination_hints(messages: DataFrame, ports: DataFrame, *, as_of: str, lookback: str | None = "24h") -> DataFrame:
    """(mmsi, destination, port_id, confidence) of the destinations that vessels reported."""
    recent = since(messages, "received_at", as_of, lookback).where((F.col("received_at") <= F.lit(as_of).cast("timestamp")) & (F.col("message_type") == STATIC_TYPE))
    said = decode_messages(recent).select("mmsi", F.trim("destination").alias("destination")).where("destination <> ''").distinct()
    said = cut(said)  # messages are decoded once
    return said.join(resolve_destinations(said, ports), "destination").select("mmsi", "destination", "port_id", "confidence")
