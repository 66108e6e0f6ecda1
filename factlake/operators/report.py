"""Reports: SARIF, tagged JSON rows, telemetry, upload projections, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.identity import strip_hash
from ..functions.matching import first_match

# Relations that the line-wise export holds, with their tags.
EXPORTED = {"services": "service", "authz_calls": "authzCall", "cache_operations": "cacheOperation", "transaction_scopes": "transactionScope", "webhook_handlers": "webhookHandler", "job_handlers": "jobHandler", "tests": "test"}


def level(severity: Column) -> Column:
    return first_match([(severity == k, v[0]) for k, v in T.SARIF_LEVEL.items()], "note")


def score(severity: Column) -> Column:
    return first_match([(severity == k, v[1]) for k, v in T.SARIF_LEVEL.items()], "4.0")


def sarif_rules(findings: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """rule_index, id, name, description, level, score: the first finding (ord) of a rule defines it."""
    first = findings.groupBy("invariant_id").agg(F.min_by(F.struct("severity", "message", "ord"), "ord").alias("f"))
    # One row a rule.
    r = first.withColumn("rule_index", F.row_number().over(Window.orderBy("f.ord")) - 1)
    if catalogue is not None:
        r = r.join(catalogue.select(F.col("id").alias("invariant_id"), "name", "description", "required_proof"), "invariant_id", "left")
    else:
        r = r.withColumns({c: F.lit(None).cast("string") for c in ("name", "description", "required_proof")})
    full = F.when(F.col("description").isNotNull(), F.concat("description", F.lit("\n\nRequired proof: "), "required_proof"))
    return r.select("rule_index", F.col("invariant_id").alias("id"), F.coalesce("name", "invariant_id").alias("name"), F.coalesce("description", "f.message").alias("short_description"), full.alias("full_description"),
                    level(F.col("f.severity")).alias("level"), score(F.col("f.severity")).alias("score"))


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a finding: rule_id, rule_index, level, message, file, line, fingerprint, severity, waived."""
    j = findings.join(rules.select(F.col("id").alias("invariant_id"), "rule_index"), "invariant_id", "left")
    return j.select(F.col("invariant_id").alias("rule_id"), F.coalesce("rule_index", F.lit(0)).alias("rule_index"), level(F.col("severity")).alias("level"), "message", "file", "line", F.col("finding_id").alias("fingerprint"), "severity", F.coalesce("waived", F.lit(False)).alias("waived"), "ord")


def sarif_document(findings: DataFrame, catalogue: DataFrame | None, version: str, ended_at: str, tool: str, shards: int = 1) -> DataFrame:
    """document: the SARIF 2.1.0 log of a run. shards: rows it is split into by file, each a log of its own with all rules.

    A log is one JSON value and is put together in one task; many findings need many shards.
    """
    rules = sarif_rules(findings, catalogue)
    results = sarif_results(findings, rules).withColumn("shard", F.pmod(F.xxhash64("file"), F.lit(shards)) if shards > 1 else F.lit(0).cast("long"))
    text = lambda c: F.struct(c.alias("text"))
    rule = F.struct(F.col("id"), F.col("name"), text(F.col("short_description")).alias("shortDescription"), F.when(F.col("full_description").isNotNull(), text(F.col("full_description"))).alias("fullDescription"),
                    F.struct(F.col("level")).alias("defaultConfiguration"), F.struct(F.array(F.lit("security"), F.lit("production-invariant")).alias("tags"), F.lit("high").alias("precision"), F.col("score").alias("security-severity")).alias("properties"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.lit(1).alias("startColumn")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.col("level"), text(F.col("message")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("findingId")).alias("fingerprints"), F.struct("severity", "waived").alias("properties"))
    in_order = lambda df, key, value, *by: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]).alias("v"))
    a, b = in_order(rules, "rule_index", rule), in_order(results, "ord", result, "shard")
    every = findings.sparkSession.range(shards).select(F.col("id").alias("shard"))
    b = every.join(b, "shard", "left").select(F.coalesce("v", F.array().cast(b.schema["v"].dataType)).alias("v"))
    log = F.struct(
        F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"),
        F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"),
                         F.array(F.struct(F.lit(True).alias("executionSuccessful"), F.lit(ended_at).alias("endTimeUtc"))).alias("invocations"))).alias("runs"),
    )
    return a.withColumnRenamed("v", "rules").crossJoin(b.withColumnRenamed("v", "results")).select(F.to_json(log).alias("document"))  # one row by a row for each shard


def tagged_rows(relations: dict[str, DataFrame], meta: dict[str, str] | None = None) -> DataFrame:
    """All exported relations as one table tagged by ``_type``; nested columns as they are, absent ones null."""
    out = None
    for name, tag in EXPORTED.items():
        if name in relations:
            df = relations[name].withColumn("_type", F.lit(tag))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if meta and out is not None:
        head = out.sparkSession.range(1).select(F.lit("_meta").alias("_type"), *[F.lit(v).alias(k) for k, v in meta.items()])
        out = head.unionByName(out, allowMissingColumns=True)
    return out


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def save_entries(entries: DataFrame, path: str, kind: str) -> None:
    """Entries by id as one sorted table in a new folder; the caller swaps the folders."""
    entries.withColumn("kind", F.lit(kind)).repartitionByRange("finding_id").sortWithinPartitions("finding_id").write.mode("errorifexists").parquet(path)


def submission(findings: DataFrame) -> DataFrame:
    """Findings as they are uploaded: the first evidence flattened, fields renamed."""
    return findings.select(F.col("invariant_id").alias("invariantId"), "severity", "message", F.col("file").alias("filePath"), F.col("line").alias("lineNumber"), F.col("symbol").alias("functionName"), F.col("context").alias("evidence"))


def artifact_stats(relations: dict[str, DataFrame]) -> DataFrame:
    """relation, n_rows, n_bytes of the rows as JSON in UTF-8."""
    out = None
    for name, df in relations.items():
        row = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes")).select(F.lit(name).alias("relation"), "n_rows", "n_bytes")
        out = row if out is None else out.unionByName(row)
    return out


def telemetry(findings: DataFrame, categorized: DataFrame | None = None) -> DataFrame:
    """One row: counts by rule and priority, and of the categories."""
    by_rule = findings.groupBy("invariant_id").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("invariant_id", "n")))).alias("by_invariant"))
    c = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    out = findings.agg(c("P0"), c("P1"), c("P2"), F.count("*").alias("total")).crossJoin(by_rule)  # one row by one row
    if categorized is not None:
        k = lambda v: F.count_if(F.col("category") == v).alias(f"n_{v}")
        out = out.crossJoin(categorized.agg(k("new"), k("baselined"), k("waived")))
    return out


def feedback_row(invariant: Column, verdict: Column, reason: Column, at: Column) -> list[Column]:
    """A validated feedback record: aliases tp and fp, the hash stripped from an id."""
    v = first_match([(F.lower(verdict).isin("tp", "true_positive"), "true_positive"), (F.lower(verdict).isin("fp", "false_positive"), "false_positive")])
    return [F.when(invariant.rlike(":"), strip_hash(invariant)).otherwise(invariant).alias("invariant_id"), v.alias("verdict"), reason.alias("reason"), at.alias("timestamp")]


def append_feedback(records: DataFrame, path: str) -> None:
    records.filter("verdict IS NOT NULL").write.mode("append").parquet(path)
