"""Free-typed destinations mapped to the entries of a reference list of ports.

1. A text is read for its grammar: where the voyage comes from or passes, expected times,
   berths and country hints are set aside; what is left are tokens of the port meant, with
   figures that stand for letters undone. The tokens run together are a token as well, so
   that split, spaced and run-together names meet.
2. The reference list gives the vocabulary: the tokens of its names, whole names run
   together, location codes and consonant abbreviations. Each distinct token is joined to
   it by edit distance: an equi-join on what is left after letters are left out (a
   symmetric-delete index), and the exact distance after it. Codes and abbreviations must
   be equal.
3. Entries that share a repaired token with a text are ranked by soft TF-IDF: the cosine of
   the text's and the entry's tokens weighted by rarity, each pair of tokens counting by
   its likeness. A token that stands for the whole entry counts as all of its tokens. The
   best entry of at least ``LEAST`` is meant, else none.
4. Entries that remain equal are told apart by a country hint, else by nearness to where the
   vessel sails, else the lowest id is taken.

Distinct tokens and texts are joined once, spread over the executors; no size of the
reference list is refused.

Defined results: texts without a letter or digit give no row; null payloads and bodies
without a destination neither; what means no entry gives -1; copies each give a row; an
empty reference list gives -1 throughout; ports with null names or codes are matched by
what they have; of entries with one code the lowest id has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import envelope as E
from wakeline.functions.geo import haversine_m
from wakeline.llm.typos import deletes, distance, plain
from wakeline.workspace import cut

#: Soft TF-IDF from which an entry is meant.
LEAST = 0.72
#: Resolved texts up to this number are broadcast (under 100 bytes each).
BROADCAST_TEXTS = 100_000
SALTS = 16

#: Figures typed for letters, and words that are not part of a name.
FIGURES = str.maketrans({"0": "O", "1": "I", "3": "E", "4": "A", "5": "S", "7": "T", "8": "B"})
SERVICE = {"ANCH", "ANCHORAGE", "PILOT", "PILOTS", "STATION", "PS", "ROADS", "ROAD", "OPL", "BERTH", "TERMINAL", "QUAY", "PIER", "INNER", "OUTER", "ORDERS", "AREA"}
COMMON = {"PORT", "HAVEN", "NEW", "WEST", "EAST", "NORTH", "SOUTH", "OLD", "SAN", "SAINT"}
NO_PORT = {"AT SEA", "FOR ORDERS", "SEA TRIALS", "TBA", "TBN", "TBC", "N A", "NA", "NIL", "NONE", "UNKNOWN", "TEST", "OPEN SEA", "AWAITING ORDERS", "RETURN TO BASE", "COASTAL TRADE", "ARMED GUARDS ONBOARD", "HOME", "SEA", "FISHING", "FISHING GROUNDS"}


def destination(payload: Column) -> Column:
    """The Destination field of the inner message; only rows that name it are parsed."""
    env = E.parsed(payload)
    body = F.try_variant_get(env["Message"][env["MessageType"]], "$.Destination", "string")
    return F.when(payload.contains("Destination"), body)


def skeleton(name: str) -> str:
    return re.sub(r"[AEIOU]", "", name)


def read(text: str, countries: set[str]) -> tuple[list[str], str | None, str | None] | None:
    """The words that name the port, a country hint and a location code that the text may
    spell; None where no port is meant."""
    s = re.sub(r"[@\s]+", " ", plain(text)).strip()
    if re.sub(r"[^A-Z]+", " ", s).strip() in NO_PORT:
        return None
    if re.fullmatch(r"(?:[A-Z0-9][ .-]){3,}[A-Z0-9]\.?", s):
        name = re.sub(r"[ .-]", "", s)  # a spaced name
        return [name], None, name
    s = re.split(r"=+>|>+|->|\s-\s?-?>?\s", s)[-1].strip() or s
    pair = re.fullmatch(r"([A-Z]{5})\s*-\s*([A-Z]{5})", s)
    if pair and pair[1][:2] in countries and pair[2][:2] in countries:
        s = pair[2]
    s = re.sub(r"\bE\.?T\.?A\b.*$", "", s)
    if re.search(r"\bTO\s+\S", s):
        s = re.split(r"\bTO\s+", s)[-1]
    s = re.sub(r"(?<=\S)\s+(?:VIA|V|EX|FROM|FM)\b\.?\s+\S.*$", "", s)
    s = re.sub(r"^(?:VIA|EX|FROM|FM)\s+\S.*$", "", s)
    s = re.sub(r"^(?:FOR|OFF|PORT OF|TOWARDS)\s+", "", s)
    hint = code = None
    m = re.search(r"[\s,(/]+([A-Z]{2})\)?$", s) or re.search(r"^([A-Z]{2})[\s/:-]+(?=\S)", s)
    if m and m[1] in countries:
        hint = m[1]
        rest = (s[: m.start()] if m.start() else s[m.end() :]).strip()
        if m.start() == 0 and re.fullmatch(r"[A-Z]{3}(?:\s+.*)?", rest):
            code = hint + rest[:3]
            if len(rest) == 3:
                return [], hint, code
        s = rest
    words = re.findall(r"[A-Z0-9]+", s)
    while len(words) > 1 and (words[-1] in SERVICE or words[-1].isdigit() or re.fullmatch(r"B\d+", words[-1])):
        words.pop()
    return (words, hint, code or "".join(words)) if words else None


TOKENS = "text string, hint string, words array<string>, whole string, outside boolean, kind string, token string"


def tokens(texts: DataFrame, countries: set[str]) -> DataFrame:
    """Every token of every text with its kind: t a word, w all words run together, c what may
    be a location code, s what may be an abbreviation. ``outside`` marks what looks like a
    location code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                got = read(text, countries)
                if got is None:
                    continue
                words, hint, code = got
                raw = "".join(words)
                if any(c.isdigit() for c in raw) and any(c.isalpha() for c in raw):
                    words = [w.translate(FIGURES) for w in words]
                whole = "".join(words)
                outside = bool(re.fullmatch(r"[A-Z]{5}", raw)) and raw[:2] in countries
                found = {("c", code)} | ({("w", whole)} if whole else set()) | {("t", w) for w in words}
                if 3 <= len(whole) <= 8 and not re.search(r"[AEIOU]", whole):
                    found.add(("s", whole))
                out += [(text, hint, words, whole, outside, kind, token) for kind, token in sorted(found)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TOKENS.split(", ")])

    return texts.select("text").distinct().mapInPandas(run, TOKENS)


FORMS = "kind string, form string, entry int, quality double, tokens array<string>"


def forms(ports: DataFrame) -> DataFrame:
    """The vocabulary: every form of every entry, by kind, with the likeness of a match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for entry, name, code in zip(pdf["id"], pdf["name"], pdf["un_locode"]):
                if isinstance(code, str) and code:
                    out.append(("c", plain(code), entry, 1.01, None))
                words = re.findall(r"[A-Z0-9]+", plain(name)) if isinstance(name, str) else []
                if not words:
                    continue
                whole = "".join(words)
                out.append(("w", whole, entry, 1.0, words))
                out += [("t", w, entry, 1.0, None) for w in sorted(set(words))]
                core = "".join(w for w in words if w not in COMMON) or whole
                short: dict[str, float] = {}
                for form in (skeleton(whole), skeleton(core)):
                    for n in {4, 5, 6, len(form)}:
                        if 3 <= n <= len(form):
                            short[form[:n]] = max(short.get(form[:n], 0.0), 0.99 if n == 5 or n == len(form) else 0.98)
                out += [("s", form, entry, quality, None) for form, quality in sorted(short.items())]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FORMS.split(", ")])

    return ports.where("id is not null").select(F.col("id").cast("int").alias("id"), "name", "un_locode").mapInPandas(run, FORMS)


def _allowed(kind: str, token: str, form: str) -> int:
    """Edits that a token may be from a form."""
    if kind == "w":
        return 2 if len(form) >= 7 else 1
    if kind == "t":
        return 2 if len(token) >= 7 else 1 if len(token) >= 4 else 0
    return 0


def repaired(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, token, form, edits): distinct tokens joined to the vocabulary by edit distance."""

    def keys(column: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for kind, word in zip(pdf["kind"], pdf[column]):
                    depth = 0 if kind in "cs" or kind == "t" and len(word) < 4 else 1 if len(word) < 6 else 2
                    rows += [(kind, word, d) for d in deletes(word, depth)]
                yield pd.DataFrame(rows, columns=["kind", column, "key"])

        return run

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, token, form in zip(pdf["kind"], pdf["token"], pdf["form"]):
                most = _allowed(kind, token, form)
                d = distance(token, form, most)
                if d <= most:
                    out.append((kind, token, form, d))
            yield pd.DataFrame(out, columns=["kind", "token", "form", "edits"])

    left = typed.select("kind", "token").distinct().mapInPandas(keys("token"), "kind string, token string, key string")
    right = known.select("kind", "form").distinct().mapInPandas(keys("form"), "kind string, form string, key string")
    met = left.join(right, ["kind", "key"]).select("kind", "token", "form").distinct().mapInPandas(near, "kind string, token string, form string, edits int")
    # a word that is in the vocabulary is right
    least = F.min("edits").over(Window.partitionBy("kind", "token"))  # words within the allowed edits of one token
    return met.withColumn("least", least).where("kind <> 't' or least > 0 or edits = 0").drop("least")


def ranked(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(text, hint, entry, score): entries that share a repaired token with a text, by soft TF-IDF."""
    names = known.where("kind = 'w'").select("entry", "tokens")
    n = names.count()
    share = known.where("kind = 't'").groupBy("form").agg(F.count_distinct("entry").alias("held"))
    common = F.col("form").isin(*sorted(COMMON))
    most = F.log(F.lit(1.0 + max(n, 1)))
    rarity = F.log(1.0 + max(n, 1) / F.col("held"))
    idf = cut(share.select("form", F.when(common, F.least(rarity, 0.4 * most)).otherwise(rarity).alias("idf"), common.alias("common")))
    links = cut(repaired(typed, known))
    # texts with what their words may be; entries with the weights of their tokens
    may = links.where("kind = 't'").join(idf, "form").groupBy("token").agg(F.collect_list(F.struct("form", (1 - F.col("edits") / F.greatest(F.length("form"), F.lit(1))).alias("like"), "idf")).alias("may"))
    words = typed.select("text", F.posexplode("words").alias("pos", "token")).distinct().join(may, "token", "left")
    weight = F.coalesce(F.array_max(F.transform("may", lambda x: x["idf"])), most)
    texts = words.groupBy("text").agg(F.collect_list(F.struct(F.coalesce("may", F.array().cast("array<struct<form:string,like:double,idf:double>>")).alias("may"), weight.alias("weight"))).alias("said"))
    entries = names.select("entry", F.explode(F.array_distinct("tokens")).alias("form")).join(idf, "form").groupBy("entry").agg(F.collect_list("form").alias("tokens"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    # a common word alone names no port, so it brings no entry in
    met = typed.join(links, ["kind", "token"]).join(known.select("kind", "form", "entry", "quality"), ["kind", "form"]).join(idf.where("common").select(F.col("form"), F.lit("t").alias("kind")), ["kind", "form"], "left_anti")
    met = met.where("not outside or kind <> 't' and edits <= 1")
    whole = F.when(F.col("kind") != "t", F.col("quality") * (1 - 0.7 * F.col("edits") / F.length("form")))
    pairs = met.groupBy("text", "hint", "entry").agg(F.max(whole).alias("whole"), F.max(F.when(F.col("kind") == "t", 1)).alias("by_word"))
    dot = F.aggregate("said", F.lit(0.0), lambda a, w: a + w["weight"] * F.coalesce(F.array_max(F.transform(F.filter(w["may"], lambda x: F.array_contains("tokens", x["form"])), lambda x: x["idf"] * x["like"])), F.lit(0.0)))
    length = F.sqrt(F.aggregate("said", F.lit(0.0), lambda a, w: a + w["weight"] * w["weight"]))
    both = pairs.join(texts, "text", "left").join(entries, "entry", "left")
    soft = F.when(F.col("by_word").isNotNull(), dot / (length * F.col("norm")))
    return both.select("text", "hint", "entry", F.round(F.greatest("whole", soft), 9).alias("score")).where(F.col("score") >= LEAST)


def resolved(texts: DataFrame, ports: DataFrame) -> DataFrame:
    """(text, ids) of distinct texts: the entries they may mean, none for an empty array."""
    countries = {r[0] for r in ports.where(F.length("country") == 2).select(F.upper("country")).distinct().collect()}  # two letters: at most 676
    known = cut(forms(ports))
    codes = Window.partitionBy("form").orderBy("entry")
    known = known.where("kind <> 'c'").unionByName(known.where("kind = 'c'").withColumn("r", F.row_number().over(codes)).where("r = 1").drop("r"))
    typed = cut(tokens(texts, countries))
    top = ranked(typed, known).join(ports.select(F.col("id").cast("int").alias("entry"), F.upper("country").alias("country")), "entry")
    best = top.withColumn("most", F.max("score").over(Window.partitionBy("text"))).where(F.col("score") == F.col("most"))
    hinted = F.array_sort(F.collect_set(F.when(F.col("country") == F.col("hint"), F.col("entry"))))
    ids = best.groupBy("text").agg(hinted.alias("hinted"), F.array_sort(F.collect_set("entry")).alias("all"))
    chosen = ids.select("text", F.when(F.size("hinted") > 0, F.col("hinted")).otherwise(F.col("all")).alias("ids"))
    return cut(texts.select("text").distinct().join(chosen, "text", "left").select("text", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")))


def _whereabouts(positions: DataFrame, mmsis: DataFrame) -> DataFrame:
    """(mmsi, at_lon, at_lat): the middle of where each of the vessels sails."""
    seen = positions.where("abs(lat) <= 90 and abs(lon) <= 180").join(mmsis, "mmsi", "left_semi")
    x, y = F.avg(F.cos(F.radians("lon"))), F.avg(F.sin(F.radians("lon")))
    return seen.groupBy("mmsi").agg(F.degrees(F.atan2(y, x)).alias("at_lon"), F.avg("lat").alias("at_lat"))


def bound_for(messages: DataFrame, ports: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(id, port_id) of every message with a destination; -1 where no entry is meant."""
    rows = (
        messages.where(F.col("payload").contains("Destination"))
        .select("id", "mmsi", destination(F.col("payload")).alias("text"))
        .where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    )
    rows = cut(rows)  # payloads are parsed once
    known = resolved(rows.select("text"), ports)
    if known.count() <= BROADCAST_TEXTS:
        met = rows.join(F.broadcast(known), "text")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.withColumn("salt", salt).join(spread, ["text", "salt"])
    plainly = met.where("size(ids) <= 1").select("id", F.coalesce(F.try_element_at("ids", F.lit(1)), F.lit(-1)).alias("port_id"))
    several = met.where("size(ids) > 1").select("id", "mmsi", F.explode("ids").alias("port_id"))
    places = ports.select(F.col("id").alias("port_id"), F.col("lon").alias("port_lon"), F.col("lat").alias("port_lat"))
    several = several.join(places, "port_id")
    if positions is not None:
        several = several.join(_whereabouts(positions, several.select("mmsi").distinct()), "mmsi", "left")
        away = haversine_m(F.col("at_lon"), F.col("at_lat"), F.col("port_lon"), F.col("port_lat"))
    else:
        away = F.lit(None).cast("double")
    nearest = several.groupBy("id").agg(F.min_by("port_id", F.struct(F.coalesce(away, F.lit(1e9)), F.col("port_id"))).alias("port_id"))
    return plainly.unionByName(nearest)
