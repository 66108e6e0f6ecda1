"""What stands around a scan: configuration, guards, projections for upload, and the scan itself."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files as inv
from ..sources.lexer import SCHEMA, lex
from . import facts, findings, graph, patterns, routes, rules, taint

CONFIG_NAMES = ("factlake.config.json", "factlake.config.yaml", "factlake.config.yml", ".factlakerc.json")


def load_config(root: str, defaults: dict) -> dict:
    """The first configuration file of a folder merged over the defaults."""
    for name in CONFIG_NAMES:
        p = Path(root) / name
        if p.exists():
            text = p.read_text()
            if p.suffix == ".json":
                return inv.merge_config(defaults, json.loads(text))
            import yaml

            return inv.merge_config(defaults, yaml.safe_load(text) or {})
    return dict(defaults)


def allowed_target(path: str, roots: list[str]) -> str:
    """The real path, if it lies below one of the roots; refused without roots."""
    real = os.path.realpath(path)
    if any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots)):
        return real
    raise PermissionError(f"{path} is outside the allowed roots")


def ci_context(env: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """Branch, commit and pull request as named by the environment."""
    e = os.environ if env is None else env
    first = lambda *names: next((e[n] for n in names if e.get(n)), None)
    return {"branch": first("GITHUB_HEAD_REF", "GITHUB_REF_NAME", "CI_COMMIT_REF_NAME", "CIRCLE_BRANCH", "BRANCH_NAME"), "sha": first("GITHUB_SHA", "CI_COMMIT_SHA", "CIRCLE_SHA1", "GIT_COMMIT"), "pull_request": first("PR_NUMBER", "CI_MERGE_REQUEST_IID", "CHANGE_ID")}


def artifact_schema() -> str:
    """The node relation's schema as JSON."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA).json()


def sorted_rows(df: DataFrame) -> DataFrame:
    """By file in locale order, then line; ties keep the extraction order."""
    return df.orderBy(F.collate("file", "UNICODE"), "line", "ord")


def placed_rows(df: DataFrame) -> DataFrame:
    """Adds place (from 1) in the order of ``sorted_rows``: places inside a file, after the sizes of the files before it."""
    each = df.groupBy("file").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.collate("file", "UNICODE"), "file").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))  # a row for each file
    inside = Window.partitionBy("file").orderBy("line", "ord")
    return df.withColumn("place", F.row_number().over(inside).cast("long")).join(before, "file").withColumn("place", F.col("place") + F.col("before")).drop("before")


def evidence_rows(findings_df: DataFrame, with_context: bool = False) -> DataFrame:
    return findings_df if with_context else findings_df.drop("context")


def calibration_request(findings_df: DataFrame) -> DataFrame:
    """key, invariant_id, severity, function_name, signals of each finding; the function falls back to the symbol."""
    name = F.coalesce(F.col("function_name"), F.col("symbol")) if "function_name" in findings_df.columns else F.col("symbol")
    signals = F.col("signals") if "signals" in findings_df.columns else F.lit(None).cast("array<string>")
    return findings_df.select("key", "invariant_id", "severity", name.alias("function_name"), signals.alias("signals"))


def upload_payload(relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations that are uploaded: flows only of the data flow, policies only of tenant isolation."""
    keep = ("services", "authz_calls", "cache_operations", "transaction_scopes", "webhook_handlers", "job_handlers", "membership_mutations", "tests", "routes", "flows", "policies")
    return {k: v for k, v in relations.items() if k in keep}


def collect(files: DataFrame, persist: bool = True) -> dict[str, DataFrame]:
    """All fact relations of an inventory (file, text), lazily; nodes are kept if asked for."""
    nodes = lex(files)
    nodes = nodes.persist() if persist else nodes
    bindings = graph.resolve_modules(graph.import_bindings(nodes), files)
    edges = graph.call_edges(nodes, bindings)
    schema, sql = facts.prisma_schema(files), facts.migrations(files)
    queries = facts.tenant_queries(nodes)
    sources, sinks, transforms = taint.sources(nodes), taint.sinks(nodes), taint.transforms(nodes)
    return {
        "files": files, "nodes": nodes, "services": facts.services(files, nodes), "authz_calls": facts.authz_calls(files, nodes), "cache_operations": facts.cache_operations(nodes),
        "transaction_scopes": facts.transaction_scopes(nodes), "webhook_handlers": facts.webhook_handlers(files, nodes), "job_handlers": facts.job_handlers(files, nodes),
        "membership_mutations": facts.membership_mutations(nodes), "tests": facts.test_cases(nodes), "routes": routes.routes(files, nodes), "bindings": bindings, "call_edges": edges,
        "called_by": graph.called_by(graph.call_functions(nodes), edges), "df_sources": sources, "df_sinks": sinks, "df_transforms": transforms, "flows": taint.connect(sources, sinks, transforms),
        "tenant_tables": facts.with_tenant_flags(facts.tenant_tables(schema), facts.protected_tables(sql), queries), "policies": facts.sql_policies(sql), "tenant_queries": queries, "directives": facts.directives(files),
    }


FACT_FILES = ("services", "routes", "webhook_handlers", "transaction_scopes", "job_handlers", "membership_mutations", "tests", "authz_calls", "cache_operations")


def scan(spark: SparkSession, files: DataFrame, pattern_list: list[dict] | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Findings of derived rules and patterns, merged by place, with their ids."""
    f = collect(files)
    derived = rules.derived_findings(f)
    matched = patterns.apply_patterns(pattern_list or [], files, f["nodes"], {k: f[k] for k in (*FACT_FILES, "directives")}, packages)
    local = patterns.matches_to_findings(matched, pattern_list or []).select(*derived.columns)
    return findings.with_ids(findings.merge_unseen(derived, local, ["invariant_id", "file", "line"], ["message", "symbol"]))
