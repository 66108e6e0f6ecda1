"""Declarative patterns over source lines and facts.

A pattern is a dict (see ``PATTERNS``): applicability, detection and finding. It is compiled to one
plan: candidate files (globs, changed files, dependencies, vetoes), then fact conditions (OR-ed,
not limited to the globs), then code patterns on lines with and / not / nearby / invert / context.
Each regular expression runs once per line; nearby windows are frames over lines of a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import all_of, first_match, glob_any, matches, matches_all, matches_any, matches_none

# Folders that globs never enter, and the default source glob.
IGNORED = ["**/node_modules/**", "**/.git/**", "**/.next/**", "**/dist/**", "**/build/**", "**/out/**", "**/.turbo/**", "**/coverage/**", "**/.cache/**"]
SOURCE_GLOBS = ["**/*.{ts,tsx,js,jsx,mjs,cjs}"]

MATCH = "pattern_id string, file string, line int, symbol string, evidence array<string>"


def lines_of(files: DataFrame) -> DataFrame:
    """files (file, text) -> (file, line, text), split at line feeds with an optional carriage return."""
    return files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def as_list(v) -> list[str]:
    return [] if not v else [x for x in v if x] if isinstance(v, (list, tuple)) else [v]


def nearby(ls: DataFrame, req: dict) -> tuple[DataFrame, Column]:
    """Lines plus flag columns over the frame of +-within lines, and the condition."""
    n = int(req["within"])
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-n, n)
    conds: list[Column] = []
    some, every, none = (as_list(req.get(k)) for k in ("any", "all", "not"))
    if some:
        ls = ls.withColumn("_any", F.max(matches_any(F.col("text"), some)).over(w))
        conds.append(F.col("_any"))
    for i, p in enumerate(every):
        ls = ls.withColumn(f"_all{i}", F.max(matches(F.col("text"), p)).over(w))
        conds.append(F.col(f"_all{i}"))
    if none:
        ls = ls.withColumn("_not", F.max(matches_any(F.col("text"), none)).over(w))
        conds.append(~F.col("_not"))
    return ls, all_of(conds)


def function_ranges(nodes: DataFrame) -> DataFrame:
    """Named functions, methods and functions held by variables or properties: file, name, start_line, end_line, ord."""
    from .facts import named_functions

    return named_functions(nodes).select("file", F.col("fname").alias("name"), "start_line", "end_line", "ord")


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (file, line, ...) plus fn: the range with the smallest span around the line, ties to the first; or null.

    Ranges are looked up once for each different line, so points need no identity of their own.
    """
    r = ranges.select(F.col("file").alias("_f"), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "ord", "name", "start_line", "end_line").alias("_r"))
    at = points.select(F.col("file").alias("_file"), F.col("line").alias("_line")).distinct()
    hit = at.join(r, (F.col("_file") == F.col("_f")) & (F.col("_line") >= F.col("_r.start_line")) & (F.col("_line") <= F.col("_r.end_line")))
    best = hit.groupBy("_file", "_line").agg(F.min("_r").alias("fn"))
    return points.join(best, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")), "left").drop("_file", "_line")


def evidence(code: dict, missing: bool) -> Column:
    """Explanatory strings of a code pattern."""
    out = [f"{'Missing' if missing else 'Matched'} code pattern: {code['pattern']}"]
    for key, label in (("and", "Requires"), ("not", "Excludes")):
        if as_list(code.get(key)):
            out.append(f"{label}: {', '.join(as_list(code[key]))}")
    near = code.get("requiresNearby") or {}
    for key, label in (("any", "any"), ("all", "all"), ("not", "none")):
        if as_list(near.get(key)):
            out.append(f"Nearby (±{near['within']}): {label} {', '.join(as_list(near[key]))}")
    return F.array(*map(F.lit, out))


def valid_lines(ls: DataFrame, code: dict, ranges: DataFrame) -> DataFrame:
    """file, line, fn of lines that match a code pattern in all its conditions."""
    t = F.col("text")
    cond = matches(t, code["pattern"]) & matches_all(t, as_list(code.get("and"))) & matches_none(t, as_list(code.get("not")))
    if code.get("requiresNearby"):
        ls, near = nearby(ls, code["requiresNearby"])
        cond = cond & near
    hits = enclosing(ls.filter(cond).select("file", "line"), ranges)
    ctx = code.get("context") or {}
    if ctx.get("atFileLevel"):
        hits = hits.filter("fn IS NULL")
    if ctx.get("atFunctionLevel"):
        hits = hits.filter("fn IS NOT NULL")
    if as_list(ctx.get("inFunctions")):
        hits = hits.filter(F.col("fn.name").isin(as_list(ctx["inFunctions"])))
    return hits


def match_code(pattern_id: str, code: dict, ls: DataFrame, ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Matches of one code pattern over candidate files; inverted ones per function or per file."""
    hits = valid_lines(ls, code, ranges)
    ctx = code.get("context") or {}
    pid = F.lit(pattern_id).alias("pattern_id")
    if not code.get("invert"):
        return hits.select(pid, "file", F.col("line").cast("int"), F.col("fn.name").alias("symbol"), evidence(code, False).alias("evidence"))
    if ctx.get("atFunctionLevel") or as_list(ctx.get("inFunctions")):
        wanted = ranges.join(files.select("file").distinct(), "file", "left_semi")
        if as_list(ctx.get("inFunctions")):
            wanted = wanted.filter(F.col("name").isin(as_list(ctx["inFunctions"])))
        h = hits.select(F.col("file").alias("hf"), F.col("line").alias("hl"), F.col("fn.name").alias("hn"))
        left = wanted.join(h, (F.col("file") == F.col("hf")) & (F.col("name") == F.col("hn")) & (F.col("hl") >= F.col("start_line")) & (F.col("hl") <= F.col("end_line")), "left_anti")
        return left.select(pid, "file", F.col("start_line").cast("int").alias("line"), F.col("name").alias("symbol"), evidence(code, True).alias("evidence"))
    none = files.select("file").distinct().join(hits.select("file"), "file", "left_anti")
    return none.select(pid, "file", F.lit(1).alias("line"), F.lit(None).cast("string").alias("symbol"), evidence(code, True).alias("evidence"))


# -- fact conditions ---------------------------------------------------------------------


def missing_auth(services: DataFrame, authz: DataFrame) -> DataFrame:
    """Services without an authorization call in their file."""
    return services.join(authz.select("file").distinct(), "file", "left_anti")


def match_service(pid: str, cond: dict, services: DataFrame, authz: DataFrame, directives: DataFrame) -> DataFrame | None:
    said, df = [], services
    if cond.get("hasDirective"):
        df = df.join(directives.filter(F.col("directive") == cond["hasDirective"]).select("file").distinct(), "file", "left_semi")
        said.append(f'Has directive: "{cond["hasDirective"]}"')
    if cond.get("missingAuthCall") is True:
        df = missing_auth(df, authz)
        said.append("No authentication calls found")
    return df.select(F.lit(pid).alias("pattern_id"), "file", "line", F.col("name").alias("symbol"), F.array(*map(F.lit, said)).alias("evidence")) if said else None


def match_transaction(pid: str, cond: dict, scopes: DataFrame) -> DataFrame | None:
    """Scopes with side effects of the allowed types; a condition on the ORM never matches."""
    if cond.get("orm") or cond.get("containsSideEffects") is not True:
        return None
    kinds = cond.get("sideEffectTypes")
    inside = F.transform("side_effects", lambda s: s["type"])
    inside = F.filter(inside, lambda k: k.isin(kinds)) if kinds is not None else inside
    return scopes.filter(F.col("contains_side_effects") & (F.size(inside) > 0)).select(
        F.lit(pid).alias("pattern_id"), "file", "line", F.col("function_name").alias("symbol"), F.array(F.concat(F.lit("Side effects inside transaction: "), F.array_join(inside, ", "))).alias("evidence")
    )


def match_webhook(pid: str, cond: dict, hooks: DataFrame) -> DataFrame | None:
    said: list[Column] = []
    df = hooks
    if cond.get("provider"):
        df = df.filter(F.lower("provider") == cond["provider"].lower())
        said.append(F.concat(F.lit("Provider: "), F.col("provider")))
    if cond.get("missingSignatureVerification") is True:
        df = df.filter(F.coalesce(F.col("signature_verification.method"), F.lit("none")) == "none")
        said.append(F.lit("Missing signature verification"))
    if cond.get("missingIdempotency") is True:
        df = df.filter(~F.coalesce("has_idempotency_check", F.lit(False)))
        said.append(F.lit("Missing idempotency check"))
    return df.select(F.lit(pid).alias("pattern_id"), "file", "line", F.col("handler_name").alias("symbol"), F.array(*said).alias("evidence")) if said else None


# -- candidates --------------------------------------------------------------------------


def candidates(files: DataFrame, facts: dict[str, DataFrame], pattern: dict, changed: Sequence[str] | None = None) -> DataFrame:
    """Files of the pattern's globs, else of any fact, else all sources; then the changed ones."""
    globs = (pattern.get("applicability") or {}).get("filePatterns") or []
    ok = files.filter(~glob_any(F.col("file"), IGNORED))
    if globs:
        out = ok.filter(glob_any(F.col("file"), globs))
    elif facts:
        named = fact_files(facts)
        out = files.join(named, "file", "left_semi") if not named.isEmpty() else ok.filter(glob_any(F.col("file"), SOURCE_GLOBS))
    else:
        out = ok.filter(glob_any(F.col("file"), SOURCE_GLOBS))
    return out.filter(F.col("file").isin(list(changed))) if changed else out


def fact_files(facts: dict[str, DataFrame]) -> DataFrame:
    """Distinct files over the fact relations."""
    out = None
    for df in facts.values():
        out = df.select("file") if out is None else out.unionByName(df.select("file"))
    return out.distinct()


def intersect_or_all(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Intersection in which an empty side constrains nothing."""
    if primary.isEmpty():
        return secondary
    return primary if secondary.isEmpty() else primary.join(secondary.select("file"), "file", "left_semi")


def nearest_ancestor(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """file, folder: the longest folder that is a path prefix ('' is the root)."""
    up = paths.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("file", "/")) - 1), lambda i: F.array_join(F.slice(F.split("file", "/"), F.lit(1), i), "/"))).alias("folder"))
    return up.join(folders.select("folder").distinct(), "folder").groupBy("file").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def has_dependencies(cands: DataFrame, packages: DataFrame | None, required: list[str]) -> bool:
    """Whether the nearest packages of the candidate files, or else the root one, hold all required names.

    packages: folder, deps (array of names). The answer is one row, whatever the number of files.
    """
    if not required:
        return True
    if packages is None:
        return False
    near = nearest_ancestor(cands.select("file").distinct(), packages)
    deps = near.join(packages, "folder").select(F.explode("deps").alias("d")).filter(F.col("d").isin(required)).distinct()
    got = {r["d"] for r in deps.collect()}  # at most as many as are required
    if not got and near.join(packages.filter(F.size("deps") > 0), "folder", "left_semi").isEmpty():
        got = {r["d"] for r in packages.filter("folder = ''").select(F.explode("deps").alias("d")).filter(F.col("d").isin(required)).distinct().collect()}
    return set(required) <= got


def vetoed(cands: DataFrame, exclude: list[str]) -> bool:
    """Whether any candidate file matches any exclude pattern: then the whole pattern is off."""
    return bool(exclude) and not cands.filter((F.coalesce("text", F.lit("")) != "") & matches_any(F.col("text"), exclude)).isEmpty()


def for_frameworks(patterns: list[dict], frameworks: list[str]) -> list[dict]:
    """Patterns that name any of the frameworks."""
    have = set(frameworks)
    return [p for p in patterns if have & {f.lower() for f in p["applicability"].get("frameworks", [])}]


def bundled_for(patterns: list[dict], frameworks: list[str]) -> list[dict]:
    """Patterns without frameworks, or with any of them."""
    have = {f.lower() for f in frameworks}
    return [p for p in patterns if not p["applicability"].get("frameworks") or have & {f.lower() for f in p["applicability"]["frameworks"]}]


def development_for(patterns: list[dict], frameworks: list[str]) -> list[dict]:
    """All patterns when no framework is named."""
    return for_frameworks(patterns, frameworks) if frameworks else list(patterns)


def pattern_stats(patterns: list[dict]) -> dict[str, int]:
    """Patterns by framework."""
    out: dict[str, int] = {}
    for p in patterns:
        for f in p["applicability"].get("frameworks", []):
            out[f] = out.get(f, 0) + 1
    return out


def match_pattern(pattern: dict, files: DataFrame, nodes: DataFrame, facts: dict[str, DataFrame], packages: DataFrame | None = None, changed: Sequence[str] | None = None) -> DataFrame:
    return apply_patterns([pattern], files, nodes, facts, packages, changed)


def _numbers(conds: list[tuple[int, Column]]) -> Column:
    """The numbers whose conditions hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in conds])) if conds else F.array().cast("array<int>")


class _Files:
    """Files with what decides for all patterns at once which of them each one looks at."""

    def __init__(self, patterns: list[dict], files: DataFrame, facts: dict[str, DataFrame], changed: Sequence[str] | None):
        self.patterns, file = patterns, F.col("file")
        self.inside = [as_list((c.get("context") or {}).get("inFiles")) for p in patterns for c in p["detection"].get("codePatterns") or []]
        globs = [(p.get("applicability") or {}).get("filePatterns") or [] for p in patterns]
        rows = files.withColumn("_ok", ~glob_any(file, IGNORED))
        by_facts = bool(facts) and not all(globs) and not fact_files(facts).isEmpty()
        if by_facts:
            rows = rows.join(fact_files(facts).withColumn("_fact", F.lit(True)), "file", "left")
        rest = F.coalesce(F.col("_fact"), F.lit(False)) if by_facts else F.col("_ok") & glob_any(file, SOURCE_GLOBS)
        picked = file.isin(list(changed)) if changed else F.lit(True)
        base = [(F.col("_ok") & glob_any(file, g) if g else rest) & picked for g in globs]
        self.rows = rows.withColumn("_base", _numbers(list(enumerate(base))))
        self.base = [F.array_contains("_base", i) for i in range(len(patterns))]
        exclude = [(p.get("applicability") or {}).get("excludePatterns") or [] for p in patterns]
        veto = [b & (F.coalesce("text", F.lit("")) != "") & matches_any(F.col("text"), e) if e else F.lit(False) for b, e in zip(self.base, exclude, strict=True)]
        within = [F.col("_ok") & glob_any(file, g) if g else F.lit(False) for g in self.inside]
        some = lambda conds: F.array(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in conds]) if conds else F.array().cast("array<boolean>")
        seen = self.rows.agg(some(self.base).alias("base"), some(veto).alias("veto"), some(within).alias("within")).first()
        self.has_base, self.vetoed, self.has_within, self.within = seen["base"], seen["veto"], seen["within"], within
        self.required = [bool(g or changed) for g in globs]

    def met(self, packages: DataFrame | None) -> list[bool]:
        """For each pattern, whether the packages nearest to its files, or else the root one, hold all it requires."""
        wanted = [(p.get("applicability") or {}).get("requiredDependencies") or [] for p in self.patterns]
        if packages is None or not any(wanted):
            return [not w for w in wanted]
        near = nearest_ancestor(self.rows.select("file").distinct(), packages)
        have = self.rows.select("file", "_base").join(near, "file").join(packages, "folder")
        # Of the names only those that are required come to the driver.
        found = have.agg(F.array(*[
            F.struct(F.array_distinct(F.flatten(F.collect_set(F.when(b, F.array_intersect("deps", F.array(*map(F.lit, w or [""]))))))).alias("got"), F.coalesce(F.bool_or(b & (F.size("deps") > 0)), F.lit(False)).alias("any"))
            for b, w in zip(self.base, wanted, strict=True)
        ]).alias("v")).first()["v"]
        every = sorted({d for w in wanted for d in w})
        root = {r["d"] for r in packages.filter("folder = ''").select(F.explode("deps").alias("d")).filter(F.col("d").isin(every)).distinct().collect()}
        return [set(w) <= (set(f["got"] or []) or (set() if f["any"] else root)) for f, w in zip(found, wanted, strict=True)]


def _artifact_matches(pattern: dict, facts: dict[str, DataFrame]) -> list[DataFrame]:
    parts, pid = [], pattern["id"]
    for c in pattern["detection"].get("artifactConditions") or []:
        cond = c.get("conditions") or {}
        got = None
        if c["type"] == "service" and "services" in facts:
            got = match_service(pid, cond, facts["services"], facts["authz_calls"], facts["directives"])
        elif c["type"] == "transactionScope" and "transaction_scopes" in facts:
            got = match_transaction(pid, cond, facts["transaction_scopes"])
        elif c["type"] == "webhookHandler" and "webhook_handlers" in facts:
            got = match_webhook(pid, cond, facts["webhook_handlers"])
        if got is not None:
            parts.append(got)
    return parts


def apply_patterns(patterns: list[dict], files: DataFrame, nodes: DataFrame, facts: dict[str, DataFrame], packages: DataFrame | None = None, changed: Sequence[str] | None = None) -> DataFrame:
    """Matches of all patterns. Files, packages and lines are each read once for all of them, whatever their number.

    Which patterns are on at all is told by one aggregate over the files and one over their packages.
    """
    out = files.sparkSession.createDataFrame([], MATCH)
    live = [p for p in patterns if p.get("detection")]
    if not live:
        return out
    f = _Files(live, files, facts, changed)
    on = [m and not v and (b or not need) for m, v, b, need in zip(f.met(packages), f.vetoed, f.has_base, f.required, strict=True)]
    codes: list[tuple[str, dict, Column]] = []
    k = 0
    for i, p in enumerate(live):
        for part in _artifact_matches(p, facts) if on[i] else []:
            out = out.unionByName(part)
        for code in p["detection"].get("codePatterns") or []:
            cands = f.base[i]
            if f.inside[k] and f.has_within[k]:  # an empty side constrains nothing
                cands = cands & f.within[k] if f.has_base[i] else f.within[k]
            if on[i]:
                codes.append((p["id"], code, cands))
            k += 1
    return out.unionByName(_code_matches(codes, f.rows, function_ranges(nodes))) if codes else out


def _code_matches(codes: list[tuple[str, dict, Column]], files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Matches of code patterns (pattern id, code, condition on files), all in one pass over the lines."""
    number = F.col("_code")
    context = [c.get("context") or {} for _, c, _ in codes]
    of = files.withColumn("_codes", _numbers([(i, c) for i, (_, _, c) in enumerate(codes)])).filter(F.size("_codes") > 0)
    ls = of.select("file", "_codes", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("i", "text")).select("file", "_codes", (F.col("i") + 1).alias("line"), "text")
    t, conds = F.col("text"), []
    for i, (_, code, _) in enumerate(codes):
        cond = F.array_contains("_codes", i) & matches(t, code["pattern"]) & matches_all(t, as_list(code.get("and"))) & matches_none(t, as_list(code.get("not")))
        if code.get("requiresNearby"):
            ls, near = nearby(ls, code["requiresNearby"])
            # The next pattern's flags have the same names.
            ls = ls.withColumn(f"_near{i}", near).drop("_any", "_not", *[c for c in ls.columns if c.startswith("_all")])
            cond = cond & F.col(f"_near{i}")
        conds.append((i, cond))
    hits = enclosing(ls.select("file", "line", F.explode(_numbers(conds)).alias("_code")), ranges)
    fits = []
    for i, ctx in enumerate(context):
        cond = F.lit(True)
        if ctx.get("atFileLevel"):
            cond = cond & F.col("fn").isNull()
        if ctx.get("atFunctionLevel"):
            cond = cond & F.col("fn").isNotNull()
        if as_list(ctx.get("inFunctions")):
            cond = cond & F.coalesce(F.col("fn.name").isin(as_list(ctx["inFunctions"])), F.lit(False))
        fits.append((number == i, cond))
    hits = hits.filter(first_match(fits, F.lit(False)))
    inverted = [i for i, (_, c, _) in enumerate(codes) if c.get("invert")]
    by_function = [i for i in inverted if context[i].get("atFunctionLevel") or as_list(context[i].get("inFunctions"))]
    by_file = [i for i in inverted if i not in by_function]
    pid = F.element_at(F.array(*[F.lit(p) for p, _, _ in codes]), number + 1).alias("pattern_id")
    said = F.element_at(F.array(*[evidence(c, bool(c.get("invert"))) for _, c, _ in codes]), number + 1).alias("evidence")
    out = hits.filter(~number.isin(inverted)).select(pid, "file", F.col("line").cast("int"), F.col("fn.name").alias("symbol"), said)
    looked = of.select("file", F.explode("_codes").alias("_code")).distinct()
    if by_function:
        wanted = ranges.join(looked.filter(number.isin(by_function)), "file")
        named = [(number == i, F.col("name").isin(as_list(context[i]["inFunctions"]))) for i in by_function if as_list(context[i].get("inFunctions"))]
        wanted = wanted.filter(first_match(named, F.lit(True))) if named else wanted
        h = hits.select(number.alias("hc"), F.col("file").alias("hf"), F.col("line").alias("hl"), F.col("fn.name").alias("hn"))
        left = wanted.join(h, (number == F.col("hc")) & (F.col("file") == F.col("hf")) & (F.col("name") == F.col("hn")) & (F.col("hl") >= F.col("start_line")) & (F.col("hl") <= F.col("end_line")), "left_anti")
        out = out.unionByName(left.select(pid, "file", F.col("start_line").cast("int").alias("line"), F.col("name").alias("symbol"), said))
    if by_file:
        none = looked.filter(number.isin(by_file)).join(hits.select("_code", "file").distinct(), ["_code", "file"], "left_anti")
        out = out.unionByName(none.select(pid, "file", F.lit(1).alias("line"), F.lit(None).cast("string").alias("symbol"), said))
    return out


def matches_to_findings(matched: DataFrame, patterns: list[dict], source: str | None = None) -> DataFrame:
    """Findings with the evidence joined; rule, severity and texts come from the pattern table."""
    spark = matched.sparkSession
    rows = [(p["id"], p["invariantId"], p["finding"]["severity"], p["finding"]["message"], p["finding"].get("requiredProof"), p["finding"].get("suggestedTest"), p.get("name") or p["id"]) for p in patterns]
    table = spark.createDataFrame(rows, "pattern_id string, invariant_id string, severity string, message string, required_proof string, suggested_test string, pattern_name string")
    return matched.join(F.broadcast(table), "pattern_id").select(  # one row per pattern definition
        "invariant_id", "severity", "message", "file", "line", "symbol", F.array_join("evidence", "; ").alias("context"), "required_proof", "suggested_test",
        F.concat(F.lit("Matched pattern: "), F.col("pattern_name")).alias("summary"), F.col("evidence").alias("signals"), F.lit("medium").alias("confidence"), F.lit(source).cast("string").alias("source"),
    )


def _pattern(pid, invariant, name, frameworks, deps, globs, detection, severity, message, proof, check):
    return {"id": pid, "version": "1.0.0", "invariantId": invariant, "name": name, "applicability": {"frameworks": frameworks, "requiredDependencies": deps, "filePatterns": globs},
            "detection": detection, "finding": {"severity": severity, "message": message, "requiredProof": proof, "suggestedTest": check}}


_SIDE = lambda kinds: {"artifactConditions": [{"type": "transactionScope", "conditions": {"containsSideEffects": True, "sideEffectTypes": kinds}}]}
_HOOK = lambda **c: {"type": "webhookHandler", "conditions": {"provider": "stripe", **c}}
# The eight development patterns.
PATTERNS = [
    _pattern("nextjs.server-action.unprotected", "AUTHZ.SERVICE_LAYER.ENFORCED", "Unprotected Next.js Server Action", ["nextjs"], ["next"], ["**/app/**/actions.ts", "**/app/**/actions/*.ts", "**/actions/**/*.ts"],
             {"artifactConditions": [{"type": "service", "conditions": {"hasDirective": "use server", "missingAuthCall": True}}]}, "P0", "Server action missing authentication check",
             "Add getServerSession() or auth() check before any mutations", "POST to server action without session should return 401/redirect"),
    _pattern("nextjs.api-route.unprotected", "AUTHZ.SERVICE_LAYER.ENFORCED", "Unprotected Next.js API Route", ["nextjs"], ["next"], ["**/app/api/**/route.ts", "**/pages/api/**/*.ts"],
             {"codePatterns": [{"pattern": "/export\\s+(async\\s+)?function\\s+(POST|PUT|DELETE|PATCH)/", "not": ["getServerSession", "auth()", "requireAuth", "authorize"], "context": {"atFileLevel": True}}]},
             "P0", "API route handler missing authentication check", "Add session/auth check at the start of the handler", "Request without Authorization header should return 401"),
    _pattern("stripe.webhook.no-signature", "WEBHOOK.SIGNATURE.VERIFIED", "Stripe Webhook Missing Signature Verification", ["stripe"], ["stripe"], ["**/webhook*/**/*.ts", "**/api/webhook*/**/*.ts", "**/stripe/**/*.ts"],
             {"artifactConditions": [_HOOK(missingSignatureVerification=True)], "codePatterns": [{"pattern": "stripe-signature", "not": ["constructEvent", "verifyWebhook"], "context": {"atFileLevel": True}, "invert": True}]},
             "P0", "Stripe webhook handler missing signature verification", "Use stripe.webhooks.constructEvent(body, sig, webhookSecret) to verify signatures", "Request with invalid stripe-signature header should return 400"),
    _pattern("stripe.webhook.no-idempotency", "WEBHOOK.IDEMPOTENT", "Stripe Webhook Missing Idempotency", ["stripe"], ["stripe"], ["**/webhook*/**/*.ts", "**/api/webhook*/**/*.ts"],
             {"artifactConditions": [_HOOK(missingIdempotency=True)]}, "P0", "Stripe webhook handler missing idempotency check", "Store processed event IDs and check before processing", "Sending the same event twice should only process once"),
    _pattern("prisma.transaction.email-inside", "TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "Email Sent Inside Prisma Transaction", ["prisma"], ["@prisma/client"], ["**/*.ts"], _SIDE(["email"]), "P0",
             "Email side effect inside database transaction", "Move email sending outside the transaction, after commit succeeds", "Simulate transaction rollback and verify no email was sent"),
    _pattern("prisma.transaction.webhook-inside", "TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "External API Call Inside Prisma Transaction", ["prisma"], ["@prisma/client"], ["**/*.ts"], _SIDE(["external_api", "webhook"]), "P0",
             "External API call inside database transaction", "Move external API calls outside the transaction, after commit", "Simulate transaction rollback and verify no external call was made"),
    _pattern("express.route.no-auth-middleware", "AUTHZ.SERVICE_LAYER.ENFORCED", "Express Route Missing Auth Middleware", ["express"], ["express"], ["**/routes/**/*.ts", "**/router/**/*.ts", "**/api/**/*.ts"],
             {"codePatterns": [{"pattern": "/router\\.(post|put|delete|patch)\\s*\\(/", "not": ["requireAuth", "isAuthenticated", "authenticate", "authMiddleware", "passport"],
                                "requiresNearby": {"within": 5, "not": ["requireAuth", "isAuthenticated", "authenticate", "authMiddleware"]}}]},
             "P1", "Express route missing authentication middleware", "Add authentication middleware before route handler", "Request without auth token should return 401"),
    _pattern("bullmq.job.no-idempotency", "JOBS.RETRY_SAFE", "BullMQ Job Handler Missing Idempotency", ["bullmq"], ["bullmq"], ["**/jobs/**/*.ts", "**/workers/**/*.ts", "**/queues/**/*.ts"],
             {"codePatterns": [{"pattern": "/new\\s+Worker\\s*\\(/", "not": ["idempotencyKey", "processedJobs", "alreadyProcessed", "jobId"], "context": {"atFileLevel": True}}]},
             "P1", "BullMQ worker may not be idempotent for retries", "Track processed job IDs or use idempotency keys", "Running the same job twice should produce the same result"),
]
