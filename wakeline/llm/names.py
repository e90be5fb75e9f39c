"""Variant spellings of companies and persons that mean the same operator.

A name is read into what it consists of: a company into its line of business and its
proper names, a person into surname and given name; titles, legal forms and joining
words are set aside. Two readings mean the same if their tokens can be aligned, in any
order, with at most ``MOST_EDITS`` edits each, where a run-together name stands for its
parts, and an initial, an abbreviation or a nickname for the full token. Lines of
business must agree, and known countries must not differ.

1. Equal readings collapse to one representative, so a name with a third of all rows is
   one row from here on.
2. Candidates meet by an equi-join on token keys: the token and all it leaves after up to
   ``MOST_EDITS`` letters are left out (a symmetric-delete index), and for abbreviations
   its first one to five letters. So all pairs meet that the rule accepts. Keys with more than ``HOT`` rows are
   split by all keys under which the partner token, or the given name, can be accepted, so
   no group of candidates is a hot key and the split loses no pair.
3. Candidate pairs are judged on the executors. Full readings link directly; a reading
   with an initial, abbreviation or nickname joins a group only if a single group fits
   it best.
4. Groups are the connected components of the links, found by label propagation with
   pointer jumping over checkpointed tables.

Names of companies need a known line of business or legal form to be read as such; given
names outside the list stand for themselves, before the surname or after a comma.

Defined results: null and empty names mean nothing and pair with nothing; rows with equal
ids count once; unreadable metadata is no evidence; empty in, empty out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.typos import deletes, distance, plain
from wakeline.operators.graph import components
from wakeline.workspace import cut, shuffled

MOST_EDITS = 2
#: Keys with more representatives than this are split by the partner token.
HOT = 200
#: Rows whose keys are made at once.
UNIT = 1_000
SALTS = 8

#: Legal forms and joining words, titles, lines of business and how they are
#: shortened, and nicknames with the given names that they stand for.
LEGAL = "LTD LIMITED PTE CO COMPANY INC INCORPORATED CORP CORPORATION LLC PLC AS ASA AB APS OY OYJ GMBH AG KG SPA SRL SA SAS NV BV OF AND THE".split()
TITLES = "MR MS MRS MISS DR CAPT CAPTAIN SIR".split()
LINES = {
    "LINES": "LINE LN LNS",
    "FERRIES": "FERRY FERR",
    "TOWAGE": "TOWING TOW",
    "SHIPPING": "SHPG SHIPG SHIPP",
    "NAVIGATION": "NAV NAVIG",
    "TANKERS": "TANKER TNKRS TANK",
    "OFFSHORE": "OFFSH",
    "MARITIME": "MARIT MAR",
    "MARINE SERVICES": "MARINE SVCS, MARINE SERV, MAR SERV, MAR SVCS, MAR SERVICES",
    "BULK CARRIERS": "BULKERS, BULK CARR, BULK",
    "SHIP MANAGEMENT": "SHIPMGMT, SHIP MGT, SHIP MGMT, SHIPMANAGEMENT",
    "AGENCY": "AGENCIES AGENTS",
    "CARRIERS": "CARRIER CARR",
    "CHARTERING": "CHARTERERS CHARTERS CHARTER",
    "CONSTRUCTION": "CONSTR CONSTRUCTIONS",
    "CRUISES": "CRUISE CRUISING",
    "DREDGING": "DREDGERS DREDGE",
    "ENERGY": "ENERGIES",
    "ENGINEERING": "ENGINEERS ENGG ENGR",
    "ENTERPRISES": "ENTERPRISE ENTPR",
    "FISHERIES": "FISHERY FISHING FISH",
    "GROUP": "GRP GROUPE GRUPPE",
    "HOLDINGS": "HOLDING HLDG HLDGS",
    "INDUSTRIES": "INDUSTRY INDS",
    "INSURANCE": "INSUR INSURERS",
    "INVESTMENTS": "INVESTMENT INVEST",
    "LOGISTICS": "LOGISTIC LOGIST",
    "MANAGEMENT": "MGMT MGT MANAGERS",
    "PARTNERS": "PARTNER PTNRS",
    "PETROLEUM": "PETROL",
    "SALVAGE": "SALVORS SALV",
    "SERVICES": "SERVICE SERV SVCS",
    "SHIPYARD": "SHIPYARDS YARD",
    "STEVEDORING": "STEVEDORES STEVEDORE",
    "TECHNOLOGIES": "TECHNOLOGY TECHN",
    "TERMINALS": "TERMINAL",
    "TRADING": "TRADERS TRADE TRDG",
    "TRANSPORT": "TRANSPORTS TRANSPORTATION TRANSP",
    "TRAVEL": "TRAVELS",
    "YACHTS": "YACHT YACHTING",
}
NICKNAMES = {
    "ABIGAIL": "ABBY GAIL",
    "ADELHEID": "HEIDI ADELE",
    "ALBERT": "AL BERT BERTIE",
    "ALEXANDER": "ALEX SASHA SANDY XANDER",
    "ALEXANDRA": "ALEX SASHA SANDRA LEXI",
    "ALFRED": "ALF FRED FREDDIE",
    "ANDREAS": "ANDI DREAS",
    "ANDREW": "ANDY DREW",
    "ANTHONY": "TONY ANT",
    "ANTONIA": "TONI NIA TONIA",
    "ANTONIO": "TONI TONIO TONINO",
    "ARTHUR": "ART ARTIE",
    "BARBARA": "BARB BABS BARBIE",
    "BARTHOLOMEW": "BART BARRY BARTY",
    "BENJAMIN": "BEN BENNY BENJI",
    "BERNARD": "BERNIE BERN",
    "CATHERINE": "CATHY KATE CATE KITTY",
    "CHARLES": "CHARLIE CHUCK CHAS",
    "CHRISTIAN": "CHRIS",
    "CHRISTINA": "CHRIS TINA CHRISTY",
    "CHRISTOPHER": "CHRIS KIT TOPHER",
    "CLEMENS": "CLEM",
    "CORNELIS": "KEES COR NELIS",
    "DANIEL": "DAN DANNY",
    "DAVID": "DAVE DAVY",
    "DEBORAH": "DEB DEBBIE",
    "DIMITRIOS": "JIM MITSOS DIMITRIS TAKIS",
    "DOMINIC": "DOM NICK",
    "DONALD": "DON DONNY",
    "DOROTHY": "DOT DOTTIE DOLLY",
    "EDWARD": "ED EDDIE NED TED TEDDY",
    "ELEANOR": "ELLIE NELL NELLIE NORA",
    "ELIZABETH": "LIZ BETTY BETH LIZZIE ELIZA LISA",
    "EMMANUEL": "MANNY MANOLIS",
    "EUGENE": "GENE",
    "FRANCES": "FRAN FANNY FRANNIE",
    "FRANCIS": "FRANK",
    "FRANCISCO": "PACO FRAN PANCHO CISCO CURRO",
    "FREDERICK": "FRED FREDDY FRITZ",
    "FREDERIK": "FRED FREEK FREDDY RIK",
    "FRIEDRICH": "FRITZ FRIEDEL",
    "GABRIEL": "GABE GABI",
    "GEORGE": "GEORDIE",
    "GEORGIOS": "YORGOS GIORGOS YORGO",
    "GERALD": "GERRY JERRY",
    "GIOVANNI": "GIANNI NINO VANNI",
    "GIUSEPPE": "BEPPE PINO PEPPE GIUSE",
    "GREGORY": "GREG",
    "GUILLERMO": "MEMO GUILLE",
    "HAROLD": "HARRY HAL",
    "HENDRIK": "HENK RIK HEIN",
    "HENRIETTA": "ETTA HETTY HATTIE HENNY",
    "HENRY": "HARRY HANK HAL",
    "IGNACIO": "NACHO",
    "ISABELLA": "BELLA IZZY ISA",
    "IVAN": "VANYA",
    "JACOB": "JAKE JAAP COBUS",
    "JAMES": "JIM JIMMY JAMIE",
    "JEFFREY": "JEFF",
    "JENNIFER": "JEN JENNY",
    "JESSICA": "JESS JESSIE",
    "JOHANNES": "HANNES HANS JAN JO JOHN",
    "JONATHAN": "JON JONNY",
    "JOSEFINA": "PEPA FINA JO JOSIE",
    "JOSEPH": "JOE JOEY",
    "JOSHUA": "JOSH",
    "KATHARINA": "KATHI KAT KATE KATJA KATHE",
    "KENNETH": "KEN KENNY",
    "KONSTANTINOS": "KOSTAS DINOS COSTA",
    "LAWRENCE": "LARRY LAURIE",
    "LEONARD": "LEN LENNY LEO",
    "LOUISE": "LULU LOU",
    "MARGARET": "PEGGY MAGGIE MEG MARGE",
    "MARTINA": "TINA",
    "MATTHEW": "MATT MATTY",
    "MATTHIAS": "MATZE HIAS",
    "MAXIMILIAN": "MAX MAXI",
    "MICHAEL": "MIKE MICK MICKEY MICHA",
    "MIKHAIL": "MISHA",
    "NATHANIEL": "NATE NAT",
    "NICHOLAS": "NICK NICKY",
    "NIKOLAOS": "NIKOS NIKO NICK KLAUS",
    "PATRICIA": "PAT PATTY TRISH",
    "PATRICK": "PAT PADDY",
    "PETER": "PETE",
    "PHILIP": "PHIL PIP",
    "RAYMOND": "RAY",
    "REBECCA": "BECKY BECCA",
    "RICHARD": "DICK RICK RICH RICHIE",
    "ROBERT": "BOB ROB BOBBY ROBBIE BERT",
    "RONALD": "RON RONNIE",
    "SAMUEL": "SAM SAMMY",
    "SERGEY": "SERYOZHA",
    "STEPHEN": "STEVE STEVIE",
    "SUSAN": "SUE SUSIE SUZY",
    "THEODORE": "THEO TED TEDDY",
    "THERESA": "TERRY TESS RESI",
    "THOMAS": "TOM TOMMY",
    "TIMOTHY": "TIM TIMMY",
    "VICTORIA": "VICKY TORI",
    "VINCENT": "VINCE VINNIE",
    "VLADIMIR": "VOLODYA VOVA",
    "WALTER": "WALT WALLY",
    "WILHELM": "WILLI WILLEM WIM",
    "WILLIAM": "WILL BILL BILLY LIAM WILLY",
    "ZACHARY": "ZACH ZACK",
}

READ = "id int, kind string, line string, a string, b string, short boolean, given array<string>, country string, office string"
_SPELLED = {form.strip(): line for line, forms in LINES.items() for form in [line, *(forms.split(",") if "," in forms else forms.split())]}
_LEGAL, _TITLES = frozenset(LEGAL), frozenset(TITLES)
_GIVEN = {n: {full for full, short in NICKNAMES.items() if n == full or n in short.split()} for full, short in NICKNAMES.items() for n in [full, *short.split()]}


def _given_of(token: str) -> set[str]:
    """Given names that a token may stand for, typos allowed; the token itself if unknown."""
    if token in _GIVEN:
        return _GIVEN[token]
    near = {f for f in NICKNAMES if len(token) > 4 and distance(token, f, 1 if len(f) < 7 else 2) <= (1 if len(f) < 7 else 2)}
    return near


def read(name: str | None) -> dict | None:
    """What a name consists of; None if nothing is left of it."""
    s = re.sub(r"\(\s*[A-Z]{2}\s*\)", " ", plain(name or ""))
    s = re.sub(r"\bM/?S\s+(?=\S)|\bMR/MS\b", " ", s).replace("OFF-SHORE", "OFFSHORE")
    s = re.sub(r"\b((?:[A-Z]\.){2,})", lambda m: m[1].replace(".", "") + " ", s)
    words = re.findall(r"[^\W_]+\.?", s)
    bare = [w.rstrip(".") for w in words]
    line, used = None, set()
    for size in (2, 1):
        for i in range(len(bare) - size + 1):
            spelled = _SPELLED.get(" ".join(bare[i : i + size]))
            if spelled and not line:
                line, used = spelled, set(range(i, i + size))
    rest = [words[i] for i in range(len(words)) if i not in used and bare[i] not in _LEGAL and bare[i] not in _TITLES]
    if not rest:
        return None
    legal = any(b in _LEGAL - {"AND", "OF", "THE"} for b in bare)
    if line or legal:
        short = [w.endswith(".") for w in rest]
        rest = [w.rstrip(".") for w in rest]
        full = sorted((w, k) for w, k in zip(rest, short))
        a = full[0][0]
        b = "".join(w for w, _ in full[1:]) if len(full) > 1 else ""
        return {"kind": "company", "line": line or "", "a": a, "b": b, "short": any(short), "given": None}
    given = [i for i, w in enumerate(rest) if _given_of(w.rstrip(".")) or len(w.rstrip(".")) == 1]
    comma = re.match(r"\s*(?:[^\W_]+\.?\s+)*?([^\W_]+)\s*,", s)
    # without a known given name the surname stands before a comma, else last
    i = given[0] if given and len(rest) > 1 else len(rest) - 1 if comma and len(rest) > 1 and rest[0] == comma[1] else 0
    first = rest[i].rstrip(".")
    surname = "".join(w.rstrip(".") for j, w in enumerate(rest) if j != i) if len(rest) > 1 else first
    if len(rest) == 1:
        return {"kind": "person", "line": "", "a": surname, "b": "", "short": True, "given": []}
    full = first in NICKNAMES or (len(first) > 1 and first not in _GIVEN)
    means = sorted(_given_of(first)) or ([first] if len(first) > 1 else [])
    return {"kind": "person", "line": "", "a": surname, "b": first if not means or not full else means[0], "short": not full, "given": means}


def _token_keys(token: str) -> list[tuple[str, str]]:
    """(key, side): two tokens that ``_fits`` accepts share a key, either both on side '=',
    by what is left after deletes, or a cut token (S) with a long one that begins so (L)."""
    out = [("d" + d, "=") for d in sorted(deletes(token, MOST_EDITS))]
    if len(token) <= 5:
        out.append(("p" + token, "S"))
    return out + [("p" + token[:i], "L") for i in range(min(1, len(token)), min(5, len(token) - 3) + 1)]


def _given_keys(given: str) -> list[tuple[str, str]]:
    """(key, side) of a person's given names, or of '=' and the initial, as ``same`` compares them."""
    if given[:1] == "=":
        return [("i" + given[1:], "S"), ("?", "=")]
    means = given.split(",")
    return [("g" + g, "=") for g in means] + [("i" + i, "L") for i in sorted({g[:1] for g in means})]


def keys_of(r) -> list[tuple[str, str, str]]:
    """(key, side, partner): where the reading can be met, and what is left to split hot keys by."""
    head = f"{r.kind}|{r.line}|"
    if r.kind == "person":
        given = ",".join(r.given) if r.given is not None and len(r.given) else "=" + (r.b or "")
        return [(f"{head}d{d}", "=", given) for d in deletes(r.a, MOST_EDITS)]
    if r.b:
        return [(head + k, side, other) for own, other in ((r.a, r.b), (r.b, r.a)) for k, side in _token_keys(own)]
    # run together: of its two parts one has at most half of the edits
    parts = {p for i in range(len(r.a) + 1) for p in ((r.a[:i], r.a[i:]), (r.a[i:], r.a[:i]))}
    out = {(f"{head}d{d}", "=", rest) for part, rest in parts for d in deletes(part, MOST_EDITS // 2)}
    return sorted(out | {(f"{head}d{d}", "=", "") for d in deletes(r.a, MOST_EDITS)})


def _fits(a: str, b: str) -> int:
    """Edits between two tokens, nothing if one is cut short to the beginning of the other."""
    if min(len(a), len(b)) <= 5 and abs(len(a) - len(b)) >= 3:
        short, long = sorted((a, b), key=len)
        return 0 if long.startswith(short) else 1 + MOST_EDITS
    return distance(a, b, MOST_EDITS)


def same(x, y) -> str | None:
    """'full' or 'short' if two readings mean the same, by the evidence; None if not."""
    if x.kind != y.kind or x.line != y.line or (x.country and y.country and x.country != y.country):
        return None
    if x.kind == "person":
        if distance(x.a, y.a, MOST_EDITS) > MOST_EDITS:
            return None
        gx, gy = set(x.given if x.given is not None else ()), set(y.given if y.given is not None else ())
        if gx and gy:
            fit = bool(gx & gy)
        else:  # an initial
            fit = any(g[:1] == i for g in (gx | gy or {x.b}) for i in ([x.b] if not gx else []) + ([y.b] if not gy else []))
        return ("short" if x.short or y.short else "full") if fit else None
    if not x.b or not y.b:
        one, two = (x, y) if not x.b else (y, x)
        forms = [two.a + two.b, two.b + two.a] if two.b else [two.a]
        return "full" if min(distance(one.a, f, MOST_EDITS) for f in forms) <= MOST_EDITS else None
    best = min((_fits(x.a, p), _fits(x.b, q)) if _fits(x.a, p) + _fits(x.b, q) <= 2 * MOST_EDITS else (9, 9) for p, q in ((y.a, y.b), (y.b, y.a)))
    if max(best) > MOST_EDITS:
        return None
    return "short" if x.short != y.short else "full"


def readings(operators: DataFrame, *, key: str = "id", name: str = "canonical", metadata: str = "metadata") -> DataFrame:
    """Every row's reading, with country and office where its metadata tells them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, n, m in zip(pdf["id"], pdf["name"], pdf["metadata"]):
                r = read(n)
                if r is None:
                    continue
                try:
                    known = json.loads(m) if m else {}
                except ValueError:
                    known = {}
                known = known if isinstance(known, dict) else {}
                out.append({"id": k, **r, "country": known.get("country"), "office": plain(str(known["office"])) if known.get("office") else None})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])

    rows = operators.select(F.col(key).cast("int").alias("id"), F.col(name).alias("name"), F.col(metadata).alias("metadata"))
    return rows.where("id is not null and name is not null").dropDuplicates(["id"]).mapInPandas(run, READ)


def _candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of representatives that share a key on matching sides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), UNIT):
                rows = [(r.id, *k) for r in pdf[at : at + UNIT].itertuples(index=False) for k in keys_of(r)]
                yield pd.DataFrame(rows, columns=["id", "key", "side", "partner"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), UNIT):
                some = pdf[at : at + UNIT]
                rows = {
                    (i, f"{k}|{d}", own + side)
                    for i, k, own, p in zip(some["id"], some["key"], some["side"], some["partner"])
                    for d, side in (_given_keys if k.startswith("person|") else _token_keys)(p)
                }
                yield pd.DataFrame(sorted(rows), columns=["id", "key", "side"])

    keyed = cut(reps.mapInPandas(run, "id int, key string, side string, partner string"))
    on = lambda side: F.count_distinct(F.when(F.col("side") == side, F.col("id")))
    crowd = keyed.groupBy("key").agg(on("=").alias("n"), on("S").alias("s"), on("L").alias("l"))
    sized = keyed.join(shuffled(crowd.where("n > 1 or s > 0 and l > 0").withColumn("pairs", F.col("n") * F.col("n") + F.col("s") * F.col("l"))), "key")
    plainly = sized.where(f"pairs <= {HOT * HOT}").select("id", "key", "side").distinct()
    split = sized.where(f"pairs > {HOT * HOT}").select("id", "key", "side", "partner").mapInPandas(refine, "id int, key string, side string")
    place = F.xxhash64("key")  # keys that clash only bring candidates more
    met = plainly.unionByName(split)
    other = met.select(F.col("id").alias("y"), place.alias("place"), F.translate("side", "SL", "LS").alias("side"))
    return met.select(F.col("id").alias("x"), place.alias("place"), "side").join(shuffled(other), ["place", "side"]).where("x < y").select("x", "y").distinct()


def _judged(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, link, score): the pairs that mean the same, with how far their metadata agree."""
    fields = [f.split()[0] for f in READ.split(", ")]
    side = lambda s: reps.select(*[F.col(f).alias(s if f == "id" else f"{s}_{f}") for f in fields])
    both = pairs.join(shuffled(side("x")), "x").join(shuffled(side("y")), "y")

    class Side:
        __slots__ = [f for f in fields if f != "id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x, y = Side(), Side()
                for s, o in (("x", x), ("y", y)):
                    for f in Side.__slots__:
                        setattr(o, f, getattr(row, f"{s}_{f}"))
                link = same(x, y)
                if link:
                    agree = sum(1 for f in ("country", "office") if getattr(x, f) and getattr(x, f) == getattr(y, f))
                    clash = 1 if x.office and y.office and x.office != y.office else 0
                    out.append((row.x, row.y, link, bool(x.short), bool(y.short), agree - 2 * clash))
            yield pd.DataFrame(out, columns=["x", "y", "link", "x_short", "y_short", "score"])

    return both.mapInPandas(run, "x int, y int, link string, x_short boolean, y_short boolean, score int")


def groups(operators: DataFrame) -> DataFrame:
    """(id, root, country): rows of one root mean the same operator."""
    rows = cut(readings(operators))
    same_reading = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "line", "a", "b", "short", "given", "country", "office")]
    rows = rows.withColumn("form", F.sha1(F.concat_ws("\x1f", *same_reading)))
    reps = cut(rows.groupBy("form").agg(F.min("id").alias("rep")))
    members = rows.join(shuffled(reps), "form").select("id", "rep", "country")
    reps = cut(rows.join(shuffled(reps.select(F.col("rep").alias("id"))), "id", "left_semi").drop("form"))
    judged = cut(_judged(reps, _candidates(reps)))
    full = components(reps, judged.where("link = 'full'"))
    # a shortened reading joins the one group that fits it best, if there is one
    short = judged.where("link = 'short'")
    sides = short.where("x_short <> y_short").select(F.when(F.col("x_short"), F.col("x")).otherwise(F.col("y")).alias("id"), F.when(F.col("x_short"), F.col("y")).otherwise(F.col("x")).alias("other"), "score")
    offers = cut(sides.join(full.select(F.col("id").alias("other"), F.col("root").alias("group")), "other").groupBy("id", "group").agg(F.max("score").alias("score")))
    best = offers.groupBy("id").agg(F.max("score").alias("score"))
    only = offers.join(best, ["id", "score"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("group")).where("n = 1")
    # shortened readings without any full one among themselves
    lone = short.where("x_short and y_short").join(offers.select(F.col("id").alias("x")), "x", "left_anti").join(offers.select(F.col("id").alias("y")), "y", "left_anti")
    links = judged.where("link = 'full'").select("x", "y").unionByName(only.select(F.col("id").alias("x"), F.col("group").alias("y"))).unionByName(lone.select("x", "y"))
    root = components(reps, links.where("x <> y"))
    return members.join(root.select(F.col("id").alias("rep"), "root"), "rep").select("id", "root", "country")


def classes(operators: DataFrame) -> DataFrame:
    """(id, root, links): the class of every row that means something, and how many rows it is
    linked with: all of its class but those of another known country. No pairs are made."""
    found = cut(groups(operators))
    sizes = found.groupBy("root", "country").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("root").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("country").isNotNull(), F.col("n"))).alias("told"))
    own = sizes.where("country is not null").select("root", "country", F.col("n").alias("own"))
    other = F.when(F.col("country").isNotNull(), F.col("told") - F.col("own")).otherwise(0)
    return found.join(whole, "root").join(own, ["root", "country"], "left").select("id", "root", (F.col("all") - other - 1).alias("links"))


def same_operator(operators: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows that mean the same operator. Salted, as a
    class may hold a third of all rows."""
    found = cut(groups(operators))
    a = found.select(F.col("id").alias("id_a"), "root", F.col("country").alias("country_a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    b = found.select(F.col("id").alias("id_b"), "root", F.col("country").alias("country_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return a.join(b, ["root", "salt"]).where("id_a < id_b and not coalesce(country_a <> country_b, false)").select("id_a", "id_b")
