"""Finding algebra: merge, summaries, baseline and waivers, correlation, calibration, accuracy.

Findings are rows (invariant_id, severity, message, file, line, symbol, context, ...). State is kept
in keyed tables that are read, changed and written anew; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.identity import finding_id, place_key
from ..functions.matching import first_match, group


# -- merge and summaries -----------------------------------------------------------------


def merge_unseen(base: DataFrame, more: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """base plus the rows of more whose key is unseen, one for each key (the first by order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = more.join(base.select(*keys).distinct(), keys, "left_anti").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return base.unionByName(fresh)


def by_priority(findings: DataFrame) -> DataFrame:
    """One row: P0, P1, P2 counts and total."""
    c = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.agg(c("P0"), c("P1"), c("P2"), F.count_if(F.col("severity").isin("P0", "P1", "P2")).alias("total"))


def by_invariant(findings: DataFrame) -> DataFrame:
    return findings.groupBy("invariant_id").agg(F.count("*").alias("n"), F.max_by("severity", F.coalesce(severity_number(F.col("severity")), F.lit(0))).alias("worst"))


def top_findings(findings: DataFrame, severity: str | None, limit: int, order: list) -> tuple[DataFrame, Column]:
    """The first findings of a severity (limit within 1..500), and whether there are more."""
    n = max(1, min(500, limit))
    df = findings if severity is None else findings.filter(F.col("severity") == severity)
    return df.orderBy(*order).limit(n), F.lit(n)


def shown_findings(findings: DataFrame, every: bool = False) -> DataFrame:
    """What a run shows: all findings, or by default only the first P0 (by ord); without one the P1, never a P2."""
    if every:
        return findings
    urgent = findings.filter("severity = 'P0'").orderBy("ord").limit(1)
    has = urgent.agg((F.count("*") > 0).alias("_has"))
    rest = findings.filter("severity = 'P1'").crossJoin(F.broadcast(has)).filter("NOT _has").drop("_has")  # by one row
    return urgent.unionByName(rest)


# -- baseline and waivers ----------------------------------------------------------------


def categorize(findings: DataFrame, baseline: DataFrame, waivers: DataFrame, now: Column, fail: tuple[str, ...] = ("P0", "P1")) -> DataFrame:
    """Adds is_baselined, is_waived (a waiver not yet expired), category and should_fail. findings: finding_id, severity, ..."""
    b = baseline.select("finding_id").distinct().withColumn("_b", F.lit(True))
    w = waivers.filter(F.col("expires_at") >= now).select("finding_id").distinct().withColumn("_w", F.lit(True))
    out = findings.join(b, "finding_id", "left").join(w, "finding_id", "left")
    is_b, is_w = F.coalesce("_b", F.lit(False)), F.coalesce("_w", F.lit(False))
    return out.withColumn("is_baselined", is_b).withColumn("is_waived", is_w).withColumn(
        "category", first_match([(is_w, "waived"), (is_b, "baselined")], "new")
    ).withColumn("should_fail", F.col("severity").isin(*fail) & ~is_b & ~is_w).drop("_b", "_w")


def category_counts(categorized: DataFrame) -> DataFrame:
    """One row: total, new, baselined, waived, will_fail, exit_code, summary."""
    c = lambda k: F.count_if(F.col("category") == k).alias(k)
    n = categorized.agg(F.count("*").alias("total"), c("new"), c("baselined"), c("waived"), F.count_if("should_fail").alias("will_fail"))
    part = lambda col, text: F.when(F.col(col) > 0, F.concat(F.col(col).cast("string"), F.lit(text)))
    said = F.concat(F.concat_ws(", ", F.when(F.col("will_fail") == 0, F.lit("All findings are baselined or waived")), part("will_fail", " new finding(s) require attention"), part("baselined", " baselined"), part("waived", " waived")), F.lit("."))
    return n.withColumn("exit_code", (F.col("will_fail") > 0).cast("int")).withColumn("summary", F.when(F.col("total") == 0, "No findings detected.").otherwise(said))


def upsert_baseline(baseline: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """Entries of both sides: new ones are created now, known ones are seen now. Adds is_new."""
    f = findings.groupBy("finding_id").agg(F.min(F.struct("invariant_id", "file", "symbol")).alias("f"))
    j = baseline.join(f, "finding_id", "full_outer")
    seen = F.col("f").isNotNull()
    return j.select(
        "finding_id", F.coalesce("invariant_id", "f.invariant_id").alias("invariant_id"), F.coalesce("file", "f.file").alias("file"), F.coalesce("symbol", "f.symbol").alias("symbol"),
        F.coalesce("created_at", now).alias("created_at"), F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.col("created_at").isNull().alias("is_new"),
    )


def prune_baseline(baseline: DataFrame, now: Column, days: int) -> DataFrame:
    return baseline.filter(F.col("last_seen_at") >= now - F.make_interval(days=F.lit(days)))


def upsert_waivers(waivers: DataFrame, more: DataFrame, now: Column, days: int) -> DataFrame:
    """More (finding_id, invariant_id, file, symbol, reason_key, reason, owner) replaces waivers of its ids; expires after days."""
    new = more.withColumn("expires_at", now + F.make_interval(days=F.lit(days))).withColumn("created_at", now)
    return waivers.join(new.select("finding_id"), "finding_id", "left_anti").unionByName(new.select(*waivers.columns))


def prune_waivers(waivers: DataFrame, now: Column) -> DataFrame:
    return waivers.filter(F.col("expires_at") >= now)


def expiring_waivers(waivers: DataFrame, now: Column, days: int) -> DataFrame:
    """Waivers that end within days: soonest first, with the days left rounded up."""
    left = F.ceil((F.unix_micros("expires_at") - F.unix_micros(now)) / F.lit(86_400_000_000))
    return waivers.filter((F.col("expires_at") > now) & (F.col("expires_at") <= now + F.make_interval(days=F.lit(days)))).withColumn("days_left", left).orderBy("expires_at")


def waive_by_id(findings: DataFrame, identifier: str) -> DataFrame:
    """Findings of an id, by its rule and hash (a collision suffix is ignored)."""
    return findings.filter(F.substring_index("finding_id", ":", 2) == ":".join(identifier.split(":")[:2]))


def waive_by_invariant(findings: DataFrame, invariant: str) -> DataFrame:
    return findings.filter(F.col("invariant_id") == invariant)


def parse_expiration(text: Column) -> Column:
    """Days of ``Nd``; anything else is null."""
    return group(text, r"^(\d+)d$", 1, "").cast("int")


def waiver_reason_counts(waived: DataFrame) -> DataFrame:
    """reason, n: by valid key (else the reason itself if it is one, else ``other``)."""
    r = F.coalesce("reason_key", "reason")
    return waived.groupBy(F.when(r.isin(T.WAIVER_REASONS), r).otherwise("other").alias("reason")).agg(F.count("*").alias("n"))


def listing(entries: DataFrame, each: int = 5) -> DataFrame:
    """The first entries of every rule and how many more there are."""
    w = Window.partitionBy("invariant_id")
    return entries.withColumn("at", F.row_number().over(w.orderBy("finding_id"))).withColumn("remaining", F.greatest(F.count("*").over(w) - each, F.lit(0))).filter(F.col("at") <= each)


# -- correlation -------------------------------------------------------------------------


def severity_number(s: Column) -> Column:
    return first_match([(s == k, v) for k, v in T.SEVERITY_NUMBER.items()], 0)


def severity_name(n: Column) -> Column:
    return first_match([(n >= 3, "P0"), (n >= 2, "P1")], "P2")


def adjusted_severity(severity: Column, multiplier: Column) -> Column:
    return severity_name(F.least(F.lit(3), F.ceil(severity_number(severity) * multiplier).cast("int")))


def rules_table(spark, rules=T.COMPOUNDING) -> DataFrame:
    rows = [(i, list(pair), m, d, s, t, e, im, tw) for i, (pair, m, d, s, t, e, im, tw) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_invariants array<string>, multiplier double, effect string, effect_signals array<string>, title string, exploitability string, impact string, time_window string")


def correlate(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Groups of at least two findings of one place (file and symbol) with their compounding rule.

    findings: invariant_id, severity, message, file, line, symbol, ord (input order). Of the rules with both invariants present the
    first in table order counts, and keeps the findings it names; without one a generic group keeps all.
    """
    rules = rules_table(findings.sparkSession) if rules is None else rules
    row = F.struct((-severity_number(F.col("severity"))).alias("rank"), "ord", "invariant_id", "severity", "message", "line")
    groups = (
        findings.filter("file IS NOT NULL").groupBy("file", F.coalesce("symbol", F.lit("unknown")).alias("symbol"))
        .agg(F.array_sort(F.collect_list(row)).alias("all"), F.count("*").alias("n")).filter("n >= 2")
    )
    # The rule table has a handful of rows.
    hits = groups.select("file", "symbol", F.transform("all", lambda f: f["invariant_id"]).alias("ids")).join(
        F.broadcast(rules), F.size(F.array_intersect("ids", "rule_invariants")) >= 2
    ).groupBy("file", "symbol").agg(F.min_by(F.struct(*rules.columns), "rule_no").alias("rule"))
    g = groups.join(hits, ["file", "symbol"], "left")
    kept = F.when(F.col("rule").isNotNull(), F.filter("all", lambda f: F.array_contains(F.col("rule.rule_invariants"), f["invariant_id"]))).otherwise(F.col("all"))
    g = g.withColumn("members", kept).withColumn("k", F.size("members"))
    primary = F.get("members", 0)
    multiplier = F.coalesce(F.col("rule.multiplier"), 1.0 + (F.col("k") - 1) * 0.2)
    said = F.map_from_arrays(F.array(*map(F.lit, T.ATTACK_STEPS)), F.array(*map(F.lit, T.ATTACK_STEPS.values())))
    steps = F.transform("members", lambda f, i: F.struct((i + 1).alias("step"), F.coalesce(F.try_element_at(said, f["invariant_id"]), f["message"]).alias("description"), f["invariant_id"].alias("invariant_id"), F.col("file").alias("file"), f["line"].alias("line")))
    return g.select(
        "file", "symbol", F.col("k").alias("finding_count"), primary["invariant_id"].alias("primary_invariant"), primary["severity"].alias("primary_severity"), primary["line"].alias("primary_line"),
        F.transform(F.slice("members", 2, F.greatest(F.col("k") - 1, F.lit(1))), lambda f: f["invariant_id"]).alias("related"),
        F.transform("members", lambda f: F.concat_ws(":", f["invariant_id"], F.col("file"), f["line"].cast("string"))).alias("member_keys"),
        F.col("rule.rule_no").alias("rule_no"), multiplier.alias("multiplier"),
        F.coalesce(F.col("rule.effect"), F.concat(F.lit("Multiple security issues in the same location ("), F.col("k").cast("string"), F.lit(" findings)"))).alias("effect"),
        F.coalesce(F.col("rule.effect_signals"), F.transform("members", lambda f: f["invariant_id"])).alias("signals"),
        F.when(F.col("rule").isNotNull(), adjusted_severity(primary["severity"], multiplier)).otherwise(primary["severity"]).alias("adjusted_severity"),
        F.when(F.col("rule.title").isNotNull(), F.struct(F.col("rule.title").alias("title"), F.col("rule.exploitability").alias("exploitability"), F.col("rule.impact").alias("impact"), F.col("rule.time_window").alias("time_window"), steps.alias("steps"))).alias("attack_path"),
    )


def correlation_stats(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: total_findings, correlated_findings, correlation_groups, severity_escalations, percent."""
    up = severity_number(F.col("adjusted_severity")) > severity_number(F.col("primary_severity"))
    # Groups of one place share no findings, so distinct keys add up.
    g = groups.agg(F.sum(F.size(F.array_distinct("member_keys"))).alias("correlated_findings"), F.count("*").alias("correlation_groups"), F.count_if(up).alias("severity_escalations"))
    t = findings.agg(F.count("*").alias("total_findings"))
    return t.crossJoin(g).withColumn("correlated_findings", F.coalesce("correlated_findings", F.lit(0))).withColumn(  # one row by one row
        "percent", F.round(100 * F.try_divide("correlated_findings", "total_findings")).cast("long")
    )


def observations(groups: DataFrame, framework: Column) -> DataFrame:
    """What a correlation reports: distinct rules of a group with its effect."""
    return groups.select(F.array_distinct(F.concat(F.array("primary_invariant"), "related")).alias("invariants"), "multiplier", "adjusted_severity", "finding_count", framework.alias("framework"), F.col("attack_path").isNotNull().alias("has_attack_path"))


# -- calibration -------------------------------------------------------------------------


def apply_calibration(findings: DataFrame, responses: DataFrame, min_confidence: float) -> DataFrame:
    """findings (key, severity, ...) left join responses (key, confidence, recommended_severity, suppress).

    Applied when confident enough and not suppressed; the severity changes only when another is recommended.
    """
    j = findings.join(responses, "key", "left")
    applied = (F.col("confidence") >= min_confidence) & ~F.col("suppress")
    pct = lambda c: F.concat(F.round(c * 100).cast("long").cast("string"), F.lit("%"))
    reason = F.concat(F.lit("API confidence "), pct(F.col("confidence")), F.when(applied, F.lit(" >= threshold ")).otherwise(F.lit(" < threshold ")), pct(F.lit(min_confidence)))
    return j.withColumn("calibrated", F.col("confidence").isNotNull()).withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn("reason", F.when(F.col("calibrated"), reason)).withColumn(
        "original_severity", F.col("severity")
    ).withColumn("severity", F.when(F.col("applied"), F.coalesce("recommended_severity", "severity")).otherwise(F.col("severity")))


def fresh_responses(cache: DataFrame, now: Column, ttl_ms: int) -> DataFrame:
    """Cached responses younger than the time to live."""
    return cache.filter((F.unix_millis(now) - F.unix_millis("cached_at")) < ttl_ms)


def calibration_stats(calibrated: DataFrame) -> DataFrame:
    return calibrated.agg(F.count("*").alias("total"), F.count_if("calibrated").alias("calibrated"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("unchanged"))


def severity_changes(calibrated: DataFrame) -> DataFrame:
    return calibrated.filter("applied AND original_severity <> severity").groupBy(F.col("original_severity").alias("from_severity"), F.col("severity").alias("to_severity")).agg(F.count("*").alias("n"))


def with_context(findings: DataFrame, routes: DataFrame, services: DataFrame, tests: DataFrame) -> DataFrame:
    """Adds finding_count of the rule, framework, service_count, has_tests."""
    one = framework_mode(routes).crossJoin(services.agg(F.count("*").alias("service_count"))).crossJoin(tests.agg((F.count("*") > 0).alias("has_tests")))  # single rows
    return findings.withColumn("finding_count", F.count("*").over(Window.partitionBy("invariant_id"))).crossJoin(F.broadcast(one))


def framework_mode(routes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The most frequent known framework, ties to the first seen (by ord): one row, or one for each of the keys."""
    keys = keys or []
    c = routes.filter("framework <> 'unknown'").groupBy(*keys, "framework").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return c.groupBy(*keys).agg(F.min_by("framework", F.struct((-F.col("n")).alias("n"), "first")).alias("framework"))


def relative_severity(count: Column, average: Column) -> Column:
    ratio = F.try_divide(count.cast("double"), average)
    return F.when(average == 0, F.when(count > 0, "above_average").otherwise("average")).otherwise(first_match([(ratio < 0.5, "below_average"), (ratio < 1.5, "average"), (ratio < 3, "above_average")], "critical"))


def skipped_patterns(stats: DataFrame, framework: str | None = None, threshold: float = 0.3) -> DataFrame:
    ok = F.col("accuracy").isNotNull() & (F.col("confidence") == "high") & (F.col("accuracy") < threshold)
    return stats.filter(ok & ((F.col("framework") == framework) | F.col("framework").isNull()) if framework else ok).select("pattern_id")


def should_skip(patterns: DataFrame, stats: DataFrame, framework: str | None, threshold: float = 0.3) -> DataFrame:
    """pattern_id, skip: by the first statistic (ord) of the pattern for this framework or for all."""
    s = stats.filter(F.col("framework").eqNullSafe(F.lit(framework)) | F.col("framework").isNull())
    first = s.groupBy("pattern_id").agg(F.min_by(F.struct("accuracy", "confidence"), "ord").alias("s"))
    return patterns.join(first, "pattern_id", "left").select("pattern_id", F.coalesce((F.col("s.confidence") == "high") & (F.col("s.accuracy") < threshold), F.lit(False)).alias("skip"))


def verified_correlations(stats: DataFrame) -> DataFrame:
    return stats.filter("is_verified")


def calibration_summary(baselines: DataFrame, counts: Column) -> DataFrame:
    """Lines for each framework whose baseline isn't of low confidence."""
    kind = relative_severity(counts, F.col("avg_findings"))
    label = first_match([(kind == "below_average", "Below average"), (kind == "above_average", "Above average"), (kind == "critical", "Significantly above average")], "Typical")
    return baselines.filter("confidence <> 'low'").select("framework", F.concat(F.col("framework"), F.lit(": "), counts.cast("string"), F.lit(" findings ("), F.format_string("%.1f", "avg_findings"), F.lit(" avg) - "), label).alias("said"))


def framework_baseline(baselines: DataFrame, framework: str) -> DataFrame:
    """The first baseline (by ord) of a framework: one row or none."""
    return baselines.filter(F.col("framework") == framework).orderBy("ord").limit(1)


# -- accuracy ----------------------------------------------------------------------------


def accuracy(tp: Column, fp: Column) -> Column:
    """Percent of true among decided verdicts, 0 if none."""
    return F.when(tp + fp > 0, 100.0 * tp / (tp + fp)).otherwise(F.lit(0.0))


def accuracy_stats(golden: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, tp, fp, accuracy; uncertain verdicts count only in the total."""
    tp, fp = F.count_if(F.col("verdict") == "true_positive"), F.count_if(F.col("verdict") == "false_positive")
    return golden.groupBy(*keys).agg(F.count("*").alias("total"), tp.alias("tp"), fp.alias("fp"), accuracy(tp, fp).alias("accuracy"))


def accuracy_diff(before: DataFrame, after: DataFrame, limit: float = 5.0) -> DataFrame:
    """invariant_id, before_accuracy, after_accuracy, delta, before_count, after_count, verdict: regressions first."""
    side = lambda df, p: accuracy_stats(df, ["invariant_id"]).select("invariant_id", F.col("accuracy").alias(f"{p}_accuracy"), F.col("total").alias(f"{p}_count"))
    j = side(before, "before").join(side(after, "after"), "invariant_id", "full_outer").na.fill(0)
    delta = F.col("after_accuracy") - F.col("before_accuracy")
    return j.withColumn("delta", delta).withColumn("verdict", first_match([(delta < -limit, "regressed"), (delta > limit, "improved")], "same")).orderBy("delta", "invariant_id")


def golden_changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, removed) findings by invariant, file and line."""
    keys = ["invariant_id", "file", "line"]
    return after.join(before.select(*keys).distinct(), keys, "left_anti"), before.join(after.select(*keys).distinct(), keys, "left_anti")


def shown_changes(changes: DataFrame, most: int = 20) -> DataFrame:
    """The first rows (by ord) of new or removed findings; the display is what is limited."""
    return changes.orderBy("ord").limit(most)


def format_delta(before: Column, after: Column) -> Column:
    """``=`` without a change, else the difference with sign and one decimal."""
    text = F.format_string("%.1f", F.round(after - before, 1))
    return first_match([(after == before, "="), (after > before, F.concat(F.lit("+"), text))], text)


def exit_code(diff: DataFrame) -> DataFrame:
    return diff.agg(F.coalesce(F.max((F.col("verdict") == "regressed").cast("int")), F.lit(0)).alias("exit_code"))


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_id", finding_id(F.col("invariant_id"), F.col("file"), F.col("symbol"), F.col("context"), F.col("message")))


def with_place(findings: DataFrame) -> DataFrame:
    return findings.withColumn("place", place_key(F.col("invariant_id"), F.col("file"), F.col("line")))
