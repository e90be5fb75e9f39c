"""Reading the JSON envelope of a message and bringing its body to one canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVELOPE = "MessageType string, MetaData struct<time_utc:string>, Message map<string,variant>"

#: A JSON string, a number, or any other character.
_TOKEN = r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[^"]'
_EXPONENT = r"[:\[,]\s*-?\d+(?:\.\d+)?[eE][+-]?\d"
_MOMENT = r"^\s*(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d(?:\.\d+)?)\s*(?:Z|([+-]\d\d):?(\d\d))?(?:\s+[A-Z]+)?\s*$"


def plain_numbers(json: Column) -> Column:
    """JSON text with numbers in exponent form written out; other text is not touched.

    The variant reader keeps decimals exact but turns exponents into doubles, which
    print differently, so ``1.5e1`` and ``15`` would not meet without this."""
    spelled = F.transform(
        F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.when(
            t.rlike(r"^-?\d+(?:\.\d+)?[eE]"), F.coalesce(t.try_cast("decimal(38,18)").cast("string"), t)
        ).otherwise(t),
    )
    return F.when(json.rlike(_EXPONENT), F.array_join(spelled, "")).otherwise(json)


def parsed(payload: Column) -> Column:
    """The envelope as a struct; null fields where the text is not an envelope."""
    return F.from_json(plain_numbers(payload), ENVELOPE)


def body_text(envelope: Column, payload: Column) -> Column:
    """The inner message as canonical JSON: keys sorted, no spacing, numbers by value.

    Text that is no envelope stands for itself, and an envelope without the body
    that its type names counts as an empty body."""
    inner = F.to_json(envelope["Message"][envelope["MessageType"]])
    return F.when(envelope["MessageType"].isNull(), payload).otherwise(F.coalesce(inner, F.lit("")))


def moment(text: Column) -> Column:
    """Microseconds since the epoch of a written report time, null where unreadable.

    Reads ``yyyy-MM-dd HH:mm:ss[.f] +hhmm ZONE`` and the ISO form; a missing zone is UTC."""
    offset = F.concat(
        F.coalesce(F.nullif(F.regexp_extract(text, _MOMENT, 3), F.lit("")), F.lit("+00")), F.lit(":"),
        F.coalesce(F.nullif(F.regexp_extract(text, _MOMENT, 4), F.lit("")), F.lit("00")),
    )
    iso = F.concat(F.regexp_extract(text, _MOMENT, 1), F.lit("T"), F.regexp_extract(text, _MOMENT, 2), offset)
    return F.when(text.rlike(_MOMENT), F.unix_micros(iso.try_cast("timestamp")))


def below_micro(text: Column) -> Column:
    """The digits after the sixth of the fraction, without trailing zeros."""
    return F.coalesce(F.regexp_extract(text, r"\.\d{6}(\d*?)0*(?:\D|$)", 1), F.lit(""))
