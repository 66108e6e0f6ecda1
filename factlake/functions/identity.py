"""Identities of findings: normalised payloads, hashes, collision suffixes, request keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import group, test

#: Anchors of the rules whose identity has more than rule, file and symbol (fixed values):
#: key, where it is read, and the pattern of its value.
ANCHORS = {
    "WEBHOOK.IDEMPOTENT": ("provider", "context", r"^(stripe|github|slack|svix|generic):"),
    "TRANSACTION.POST_COMMIT.SIDE_EFFECTS": ("sideEffectType", "message", r"contains (\w+) side effect"),
    "AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE": ("mutationType", "context", r"mutationType[:\s]+(\w+)"),
    "AUTHZ.KEYS.REVOCATION.IMMEDIATE": ("entity", "context", r"entity[:\s]+(\w+)"),
}


def normalize_path(path: Column) -> Column:
    """Trimmed, forward slashes, no leading ``./`` or ``/``, lower case."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"^\./", "")
    return F.lower(F.regexp_replace(p, r"^/", ""))


def canonical_payload(fields: dict[str, Column]) -> Column:
    """``key:value`` in key order joined by ``|``; null fields are left out."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), v) for k, v in sorted(fields.items())])


def hash_payload(payload: Column) -> Column:
    return F.substring(F.sha2(payload, 256), 1, 12)


def identity_payload(invariant: Column, file: Column, symbol: Column, context: Column, message: Column) -> Column:
    """The canonical payload of a finding: one literal key list for each rule that has an anchor."""
    empty = F.lit("")
    base = {
        "invariantId": F.lower(invariant),
        "file": normalize_path(F.coalesce(file, empty)),
        "symbol": F.lower(F.coalesce(symbol, empty)),
    }
    out = canonical_payload(base)
    for rule, (key, where, pattern) in ANCHORS.items():
        text = F.coalesce(context if where == "context" else message, empty)
        value = F.lower(F.coalesce(group(text, pattern, 1), empty))
        out = F.when(invariant == rule, canonical_payload(base | {key: value})).otherwise(out)
    return out


def finding_id(invariant: Column, file: Column, symbol: Column, context: Column | None = None, message: Column | None = None) -> Column:
    """The rule and the first 12 hex digits of the SHA-256 of the canonical payload."""
    none = F.lit(None).cast("string")
    payload = identity_payload(invariant, file, symbol, none if context is None else context, none if message is None else message)
    return F.concat(invariant, F.lit(":"), hash_payload(payload))


def place_key(invariant: Column, file: Column, line: Column) -> Column:
    """invariant:file:line, with defaults for what is missing."""
    return F.concat_ws(":", invariant, F.coalesce(file, F.lit("unknown")), F.coalesce(line.cast("string"), F.lit("0")))


def with_collision_suffix(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The second row of an id gets ``:a``, the third ``:b`` and so on (code point 96 + n).

    From the surrogates on, where no character stands alone, the code is written as a number. A null id stays null.
    """
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1
    code = 96 + F.col("_n")
    # Not char(), which takes codes modulo 256.
    sign = F.when(code < 0xD800, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(code.cast("string"))
    return df.withColumn("_n", n).withColumn(
        id_col, F.when(F.col("_n") == 0, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit(":"), sign))
    ).drop("_n")


def has_collisions(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that occur more than once."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def rolling_hash36(text: Column) -> Column:
    """Signed 32-bit hash h * 31 + code unit, absolute value, in base 36. Text is read by UTF-16 units."""
    hex_units = F.hex(F.encode(text, "UTF-16BE"))
    n = F.length(text)
    units = F.transform(
        F.sequence(F.lit(0), (F.length(hex_units) / 4).cast("int") - 1),
        lambda i: F.conv(F.substring(hex_units, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"),
    )
    h = F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: (acc * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.when(n == 0, F.lit("0")).otherwise(F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def strip_hash(identifier: Column) -> Column:
    """The rule of a finding id: what stands before the last colon."""
    return F.regexp_replace(identifier, r":[^:]*\z", "")


#: Keys whose values are masked, and beginnings of values that are (fixed values).
SECRET_KEYS = r"api[_-]?key|secret|password|token|credential|auth"
SECRET_PREFIXES = ("sk_", "pk_", "Bearer ", "Basic ")


def redact(key: Column, value: Column) -> Column:
    """Masks values of secret keys; values that look secret keep four characters at each end if long."""
    looks = F.lit(False)
    for p in SECRET_PREFIXES:
        looks = looks | F.startswith(value, F.lit(p))
    partly = F.when(F.length(value) <= 8, F.lit("[REDACTED]")).otherwise(
        F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4)))
    )
    return F.when(test(key, SECRET_KEYS), F.lit("[REDACTED]")).when(F.coalesce(looks, F.lit(False)), partly).otherwise(value)
