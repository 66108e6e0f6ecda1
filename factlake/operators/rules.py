"""Rules that can be read directly off fact columns (our own design where the catalogue has only text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _finding(df: DataFrame, rule: str, severity: str, message, symbol, context=None) -> DataFrame:
    as_col = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) and not v.startswith("$") else F.col(v[1:]) if isinstance(v, str) else v
    return df.select(F.lit(rule).alias("invariant_id"), F.lit(severity).alias("severity"), as_col(message).alias("message"), "file", "line", as_col(symbol).alias("symbol"), as_col(context).alias("context"))


SINK_RULES = {
    "sql_query": "DATAFLOW.UNTRUSTED.SQL_QUERY", "command_exec": "DATAFLOW.UNTRUSTED.COMMAND_EXEC", "file_read": "DATAFLOW.UNTRUSTED.FILE_ACCESS", "file_write": "DATAFLOW.UNTRUSTED.FILE_ACCESS",
    "html_response": "DATAFLOW.UNTRUSTED.RESPONSE", "dom_sink": "XSS.DOM.SINK", "redirect": "REDIRECT.OPEN", "header_set": "HEADER.INJECTION", "nosql_query": "NOSQL.INJECTION", "eval": "EVAL.USER_INPUT",
}


def derived_findings(f: dict[str, DataFrame]) -> DataFrame:
    """Findings of all rules whose relations are given."""
    parts: list[DataFrame] = []
    if "webhook_handlers" in f:
        w = f["webhook_handlers"]
        parts.append(_finding(w.filter("NOT has_idempotency_check"), "WEBHOOK.IDEMPOTENT", "P0", "Webhook handler has no idempotency check", "$handler_name", F.concat(F.col("provider"), F.lit(":"))))
        parts.append(_finding(w.filter("coalesce(signature_verification.method, 'none') = 'none'"), "WEBHOOK.SIGNATURE.VERIFIED", "P0", "Webhook handler does not verify signatures", "$handler_name", "$provider"))
    if "transaction_scopes" in f:
        s = f["transaction_scopes"].filter("contains_side_effects").withColumn("kind", F.col("side_effects")[0]["type"])
        parts.append(_finding(s, "TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "P0", F.concat(F.lit("Transaction contains "), F.col("kind"), F.lit(" side effect")), "$function_name", F.array_join(F.transform("side_effects", lambda x: x["type"]), ", ")))
    if "job_handlers" in f:
        parts.append(_finding(f["job_handlers"].filter("NOT has_idempotency_check"), "JOBS.RETRY_SAFE", "P1", "Job handler has no idempotency check", "$name", "$framework"))
    if "membership_mutations" in f:
        m = f["membership_mutations"].filter("NOT has_cache_invalidation AND confidence <> 'low'")
        ctx = F.concat(F.lit("mutationType: "), F.col("mutation_type"), F.lit("; entity: "), F.col("entity"))
        parts.append(_finding(m.filter("entity <> 'apiKey'"), "AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE", "P0", "Membership change does not invalidate caches", "$function_name", ctx))
        parts.append(_finding(m.filter("entity = 'apiKey'"), "AUTHZ.KEYS.REVOCATION.IMMEDIATE", "P0", "Key revocation does not invalidate caches", "$function_name", ctx))
    if "tenant_tables" in f:
        parts.append(_finding(f["tenant_tables"].filter("NOT has_rls_policy AND NOT has_query_filtering"), "AUTHZ.RLS.MULTI_TENANT", "P0", "Tenant table has neither a policy nor filtered queries", "$table", "$tenant_column"))
    if "tenant_queries" in f:
        parts.append(_finding(f["tenant_queries"].filter("NOT has_tenant_filter"), "AUTHZ.TENANT.ISOLATION", "P0", "Query has no tenant filter", "$containing_function", "$table"))
    if "flows" in f:
        fl = f["flows"].filter("NOT is_sanitized AND NOT is_validated").withColumn("rule", F.try_element_at(F.create_map(*[F.lit(x) for kv in SINK_RULES.items() for x in kv]), F.col("sink.type"))).filter("rule IS NOT NULL")
        parts.append(fl.select(F.col("rule").alias("invariant_id"), F.when(F.col("is_admin_protected"), "P1").otherwise("P0").alias("severity"), F.concat(F.lit("Untrusted "), F.col("source.type"), F.lit(" reaches "), F.col("sink.type")).alias("message"), "file", F.col("sink.line").alias("line"), F.col("sink.function_context").alias("symbol"), F.array_join("flow_path", " -> ").alias("context")))
    if "tests" in f:
        t = f["tests"].select("file", "name", F.explode("anti_patterns").alias("a")).select("file", F.col("a.line").alias("line"), "name", F.col("a.type").alias("kind"), F.col("a.description").alias("said"))
        parts.append(_finding(t, "TESTS.NO_FALSE_CONFIDENCE", "P1", "$said", "$name", "$kind"))
    if "services" in f and "authz_calls" in f:
        parts.append(_finding(f["services"].join(f["authz_calls"].select("file").distinct(), "file", "left_anti"), "AUTHZ.SERVICE_LAYER.ENFORCED", "P0", "Service file has no authorization call", "$name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
