"""Readers of artifact, pattern, baseline, waiver and review documents, with explicit schemas."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import first_match

BASELINE = "finding_id string, invariant_id string, file string, symbol string, created_at timestamp, last_seen_at timestamp, notes string"
WAIVERS = "finding_id string, invariant_id string, file string, symbol string, reason_key string, reason string, owner string, expires_at timestamp, created_at timestamp"
GOLDEN = "id string, repo string, commit_hash string, invariant_id string, severity string, message string, file string, line int, verdict string"
#: Readers accept this major version; a missing version counts as 1.0.0.
MAJOR = 1


def schema_state(version: Column) -> Column:
    """valid, invalid (no semantic version) or unsupported (another major)."""
    v = F.coalesce(version, F.lit("1.0.0"))
    major = F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)", 1)
    return first_match([(major == "", "invalid"), (F.try_to_number(major, F.lit("999999")) == MAJOR, "valid")], "unsupported")


def read_whole(spark: SparkSession, path: str) -> str | None:
    """A document's text, or None if there is none."""
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_artifact(spark: SparkSession, path: str) -> dict:
    """An artifact document; version, profile and services must be there."""
    text = read_whole(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    data = json.loads(text)
    missing = [k for k in ("version", "profile", "services") if k not in data]
    if missing:
        raise ValueError(f"not an artifact: {', '.join(missing)} missing")
    return data


def parse_patterns(text: str) -> list[dict]:
    """``[...]`` or ``{"patterns": [...]}``; without the key there are none."""
    data = json.loads(text)
    return data if isinstance(data, list) else data.get("patterns") or []


def _entries(text: str | None) -> list[dict]:
    try:
        entries = (json.loads(text) if text else {}).get("entries") or {}
    except ValueError:
        return []
    return list(entries.values()) if isinstance(entries, dict) else []


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline document; missing, corrupt or old-shaped documents are empty."""
    rows = [(e.get("findingId"), e.get("invariantId"), e.get("file"), e.get("symbol"), e.get("createdAt"), e.get("lastSeenAt"), e.get("notes")) for e in _entries(read_whole(spark, path))]
    raw = spark.createDataFrame(rows, BASELINE.replace("timestamp", "string"))
    return raw.withColumns({c: F.try_to_timestamp(c) for c in ("created_at", "last_seen_at")})


def load_waivers(spark: SparkSession, path: str) -> DataFrame:
    rows = [(e.get("findingId"), e.get("invariantId"), e.get("file"), e.get("symbol"), e.get("reasonKey"), e.get("reason"), e.get("owner"), e.get("expiresAt"), e.get("createdAt")) for e in _entries(read_whole(spark, path))]
    raw = spark.createDataFrame(rows, WAIVERS.replace("timestamp", "string"))
    return raw.withColumns({c: F.try_to_timestamp(c) for c in ("expires_at", "created_at")})


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    data = json.loads(read_whole(spark, path) or "{}")
    rows = [(f.get("id"), f.get("repo"), f.get("commitHash"), f.get("invariantId"), f.get("severity"), f.get("message"), f.get("file"), f.get("line"), f.get("verdict")) for f in data.get("findings", [])]
    return spark.createDataFrame(rows, GOLDEN)


def latest_two(names: list[str], pattern: str = r"-(\d+)-review\.json$") -> tuple[str, str] | None:
    """The two names with the largest time stamps, older first."""
    found = sorted((int(m[1]), n) for n in names if (m := re.search(pattern, n)))
    return (found[-2][1], found[-1][1]) if len(found) >= 2 else None


def cache_covers(cached: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Detected frameworks that a pattern cache doesn't hold: none means that it is usable."""
    return frameworks.select(F.lower("framework").alias("framework")).distinct().join(cached.select(F.lower("framework").alias("framework")).distinct(), "framework", "left_anti")
