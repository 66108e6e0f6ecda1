"""Fact relations from ``files`` (file, text) and ``nodes`` (see sources.lexer), as plain DataFrame queries.

Everything about one file comes from that file's rows: extraction filters and projects ``nodes``;
containment joins are equi-joins on ``file`` with offset ranges as residuals. Facts keep ``ord``,
the pre-order of the node they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.matching import (
    any_of, classify, first_match, group, js_regex, line_of, matched_text, present, test, test_any,
)

BRIEF = 100


def cut(text: Column, n: int) -> Column:
    """Text of at most n characters, then ``...`` if there was more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def test_pairs(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Any of (pattern, flags)."""
    return any_of(test_any(col, [p for p, f in pairs if f == flags], flags) for flags in {f for _, f in pairs})


def calls(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'CallExpression'")


def strip_comments(text: Column) -> Column:
    """Line comments first, then block comments; ``//`` inside strings is cut too."""
    return F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"/\*[\s\S]*?\*/", "")


def inside(inner: DataFrame, outer: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of inner (aliased i) within rows of outer (aliased o) of the same file."""
    i, o = inner.alias("i"), outer.alias("o")
    more = (F.col("i.ord") > F.col("o.ord")) if strict else F.lit(True)
    return i.join(o, (F.col("i.file") == F.col("o.file")) & (F.col("i.start_off") >= F.col("o.start_off")) & (F.col("i.end_off") <= F.col("o.end_off")) & more)


# -- services ----------------------------------------------------------------------------


def is_frontend_file(path: Column, text: Column) -> Column:
    return test_pairs(path, T.NON_SERVICE_PATHS) | test_any(text, T.FRONTEND_TEXT[:3], "m") | test_any(text, T.FRONTEND_TEXT[3:], "")


def service_name(path: Column) -> Column:
    """Path without extension and leading common directories; ``index`` takes its directory's name."""
    parts = F.split(path, "/")
    n = F.size(parts)
    base = F.regexp_replace(F.element_at(parts, -1), r"\.(ts|tsx|js|jsx)$", "")
    lead = F.aggregate(
        F.slice(parts, 1, F.greatest(n - 1, F.lit(0))),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda s, p: F.struct(
            F.when(s["on"] & p.isin(T.SERVICE_SKIP_DIRS), s["k"] + 1).otherwise(s["k"]).alias("k"),
            (s["on"] & p.isin(T.SERVICE_SKIP_DIRS)).alias("on"),
        ),
    )["k"]
    rest = F.slice(parts, lead + 1, F.greatest(n - 1 - lead, F.lit(0)))
    named = F.when(F.size(rest) > 0, F.concat_ws("/", rest, base)).otherwise(base)
    return F.when(base == "index", F.when(n >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit("unknown"))).otherwise(named)


def services(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for a file with exported callables or public class methods: file, name, exported_functions, line."""
    back = files.filter(~is_frontend_file(F.concat(F.lit("/"), F.col("file")), F.coalesce("text", F.lit("")))).select("file")
    parent = nodes.select("file", F.col("ord").alias("parent_ord"), F.col("kind").alias("up"), F.col("exported").alias("up_exported"))
    value = nodes.filter("kind IN ('ArrowFunction', 'FunctionExpression', 'CallExpression')").select("file", F.col("parent_ord").alias("ord"), F.lit(True).alias("callable")).distinct()
    declared = nodes.filter("kind = 'FunctionDeclaration' AND exported AND name IS NOT NULL").select("file", "ord", "name")
    variables = nodes.filter("kind = 'VariableDeclaration' AND exported").join(value, ["file", "ord"]).select("file", "ord", "name")
    methods = (
        nodes.filter("kind = 'MethodDeclaration' AND name NOT LIKE '\\_%'").join(parent, ["file", "parent_ord"])
        .filter("up = 'ClassDeclaration' AND up_exported").select("file", "ord", "name")
    )
    names = declared.unionByName(variables).unionByName(methods).join(back, "file", "left_semi")
    return (
        names.groupBy("file")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("exported_functions"))
        .select("file", service_name(F.col("file")).alias("name"), "exported_functions", F.lit(1).alias("line"))
    )


# -- authorization -----------------------------------------------------------------------


def is_authz_name(name: Column, functions: list[str] = T.AUTHZ_FUNCTIONS) -> Column:
    lower = F.lower(name)
    part = any_of(F.contains(lower, F.lit(p)) for p in T.AUTHZ_PARTS) | any_of(F.contains(name, F.lit(p)) for p in T.AUTHZ_FRAMEWORK_PARTS)
    return F.coalesce(name.isin(functions) | part, F.lit(False))


def split_arguments(text: Column) -> Column:
    """Comma-separated parts of the first parenthesised group, commas in nested brackets kept; trimmed."""
    inner = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    step = lambda s, c: F.struct(
        (s["d"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("d"),
        F.when((c == ",") & (s["d"] == 0), F.concat(s["out"], F.array(F.trim(s["cur"])))).otherwise(s["out"]).alias("out"),
        F.when((c == ",") & (s["d"] == 0), F.lit("")).otherwise(F.concat(s["cur"], c)).alias("cur"),
    )
    zero = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(
        F.split(inner, ""), zero, step, lambda s: F.when(F.trim(s["cur"]) != "", F.concat(s["out"], F.array(F.trim(s["cur"])))).otherwise(s["out"])
    )


def authz_calls(files: DataFrame, nodes: DataFrame, functions: list[str] = T.AUTHZ_FUNCTIONS) -> DataFrame:
    """Calls, decorators and middleware, concatenated with duplicates."""
    none = F.array().cast("array<string>")
    direct = calls(nodes).filter(is_authz_name(F.col("name"), functions)).select(
        "file", F.col("start_line").alias("line"), F.col("name").alias("function_name"), F.col("fn_prop").alias("caller_function"),
        F.transform("args", lambda a: cut(a, BRIEF)).alias("arguments"), "ord",
    )
    decorated = nodes.filter("kind = 'Decorator'").filter(any_of(F.contains("text", F.lit(d)) for d in T.AUTHZ_DECORATORS)).select(
        "file", F.col("start_line").alias("line"), F.concat(F.lit("@"), F.col("name")).alias("function_name"), F.col("fn_prop").alias("caller_function"),
        split_arguments(F.col("text")).alias("arguments"), "ord",
    )
    in_text = None
    for k, p in enumerate(T.AUTHZ_MIDDLEWARE):
        found = files.select("file", "text", F.explode(F.regexp_extract_all("text", F.lit(js_regex(p, "i")), F.lit(0))).alias("hit")).select(
            "file", line_of(F.col("text"), F.col("hit")).alias("line"),
            F.coalesce(F.trim(group(F.col("hit"), r"\.use\s*\(\s*([^,)]+)", 1, "")), F.lit("middleware")).alias("function_name"),
            F.lit("middleware").alias("caller_function"), none.alias("arguments"), F.lit(k).alias("ord"),
        )
        in_text = found if in_text is None else in_text.unionByName(found)
    verb = group(F.col("text"), r"\.(get|post|put|delete|patch|all)\s*\(", 1)
    routed = (
        calls(nodes).withColumn("verb", verb).filter("verb IS NOT NULL").select("file", "start_line", "verb", "ord", F.explode("args").alias("arg"))
        .filter(any_of(F.contains(F.lower("arg"), F.lit(p)) for p in T.AUTHZ_ARGUMENT_PARTS))
        .select("file", F.col("start_line").alias("line"), F.substring_index("arg", "(", 1).alias("function_name"), F.col("verb").alias("caller_function"), none.alias("arguments"), "ord")
    )
    return direct.unionByName(decorated).unionByName(in_text).unionByName(routed)


# -- cache -------------------------------------------------------------------------------


def cache_operation(text: Column) -> Column:
    return first_match([(test_pairs(text, T.CACHE_DELETE), "delete"), (test_pairs(text, T.CACHE_SET), "set"), (test_pairs(text, T.CACHE_GET), "get")])


def cache_key(args: Column, text: Column) -> Column:
    first = F.get(args, 0)
    key = cut(first, 50)
    marked = test_any(first, T.CACHE_AUTH_KEYS) | test_any(text, T.CACHE_AUTH_KEYS)
    return F.when(first.isNotNull(), F.when(marked, F.concat(F.lit("[auth] "), key)).otherwise(key))


def cache_operations(nodes: DataFrame) -> DataFrame:
    return (
        calls(nodes).withColumn("type", cache_operation(F.col("text"))).filter("type IS NOT NULL")
        .select("file", F.col("start_line").alias("line"), "type", cache_key(F.col("args"), F.col("text")).alias("key"), F.col("fn").alias("caller_function"), "ord")
    )


# -- transactions ------------------------------------------------------------------------


def side_effect(text: Column) -> Column:
    """Type of the first matching pattern; null for safe and ORM calls."""
    return F.when(~test_any(text, T.SAFE_CALLS) & ~test_any(text, T.ORM_CALLS), classify(text, T.SIDE_EFFECTS))


def transaction_scopes(nodes: DataFrame) -> DataFrame:
    """Scopes with their side effects and the first call of each function inside."""
    block = nodes.select("file", F.col("ord").alias("arg_fn_ord"), F.col("start_off").alias("bs"), F.col("end_off").alias("be"), F.col("end_line").alias("bl"))
    scopes = (
        calls(nodes).filter(test_any(F.col("text"), T.TRANSACTION_CALLS, ""))
        .join(block, ["file", "arg_fn_ord"], "left")
        .select("file", F.col("ord").alias("scope"), F.col("start_line").alias("line"), F.coalesce("bl", "end_line").alias("end_line"), F.col("fn").alias("function_name"),
                F.coalesce("bs", "start_off").alias("start_off"), F.coalesce("be", "end_off").alias("end_off"), F.coalesce("arg_fn_ord", "ord").alias("ord"))
    )
    inner = inside(calls(nodes).select("file", "ord", "start_off", "end_off", "start_line", "text", "name", "callee", "callee_object"), scopes)
    effects = (
        inner.select(F.col("o.file").alias("file"), "scope", F.col("i.ord").alias("ord"), F.col("i.start_line").alias("line"), F.col("i.text").alias("text"))
        .withColumn("type", side_effect(F.col("text"))).filter("type IS NOT NULL")
        .groupBy("file", "scope")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "type", "file", "line", cut(F.col("text"), BRIEF).alias("description")))),
            lambda x: F.struct(x["type"].alias("type"), x["file"].alias("file"), x["line"].alias("line"), x["description"].alias("description")),
        ).alias("side_effects"))
    )
    full = F.when(F.col("i.callee_object").isNotNull(), F.col("i.callee")).otherwise(F.col("i.name"))
    named = (
        inner.filter(F.col("i.name").isNotNull() & ~test_any(full, T.SCOPE_CALL_SKIPS, "") & ~test_any(F.col("i.name"), T.SCOPE_CALL_SKIPS, ""))
        .groupBy(F.col("o.file").alias("file"), "scope", F.col("i.name").alias("name"))
        .agg(F.min(F.struct(F.col("i.ord").alias("ord"), F.col("i.start_line").alias("line"))).alias("first"))
        .groupBy("file", "scope")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("first.ord").alias("ord"), "name", F.col("first.line").alias("line")))),
            lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line")),
        ).alias("function_calls"))
    )
    empty = F.array().cast("array<struct<type:string,file:string,line:int,description:string>>")
    return (
        scopes.join(effects, ["file", "scope"], "left").join(named, ["file", "scope"], "left")
        .select("file", "line", "end_line", "function_name", F.col("side_effects").isNotNull().alias("contains_side_effects"),
                F.coalesce("side_effects", empty).alias("side_effects"), "function_calls", F.col("scope").alias("ord"))
    )


# -- membership --------------------------------------------------------------------------


def mutation_confidence(kind: Column, signals: Column) -> Column:
    has = lambda p: F.exists(signals, lambda s: F.startswith(s, F.lit(p)))
    param, db, cache = has("param:"), has("db:"), has("cache:")
    strong = kind.isin("remove", "delete", "revoke", "downgrade")
    return first_match([(strong & param & db, "high"), (db & (cache | param), "high"), (param | db, "medium")], "low")


def named_functions(nodes: DataFrame) -> DataFrame:
    """Functions with a name of their own or of the variable or property that takes them: + fname."""
    up = nodes.select("file", F.col("ord").alias("parent_ord"), F.col("name").alias("up_name"), F.col("kind").alias("up_kind"), F.col("exported").alias("up_exported"))
    own = nodes.filter("kind IN ('FunctionDeclaration', 'MethodDeclaration')").withColumn("fname", F.col("name")).withColumn("up_kind", F.lit(None).cast("string")).withColumn("up_exported", F.col("exported"))
    held = (
        nodes.filter("kind IN ('ArrowFunction', 'FunctionExpression')").join(up, ["file", "parent_ord"])
        .filter("up_kind IN ('VariableDeclaration', 'PropertyAssignment')").withColumn("fname", F.col("up_name")).drop("up_name")
    )
    return own.unionByName(held.select(*own.columns)).filter("fname IS NOT NULL")


def membership_mutations(nodes: DataFrame) -> DataFrame:
    fns = named_functions(nodes).filter("up_kind IS NULL OR up_kind = 'VariableDeclaration'")
    name, text = F.col("fname"), F.col("text")
    code = strip_comments(text)
    kind = classify(name, [(p, t) for p, t, _ in T.MUTATIONS])
    entity = classify(name, [(p, e) for p, _, e in T.MUTATIONS])
    source = classify(name, [(p, p) for p, _, _ in T.MUTATIONS])
    hit = F.coalesce(*[F.when(test(F.col("code"), p, f), F.regexp_extract(F.col("code"), js_regex(p, f), 0)) for p, f in T.INVALIDATIONS])
    quoted = lambda k: js_regex(f"['\"`][^'\"`]*{k}[^'\"`]*['\"`]", "i")
    keys = F.flatten(F.array(*[F.slice(F.regexp_extract_all(F.col("code"), F.lit(quoted(k)), F.lit(0)), 1, 3) for k in T.AUTH_CACHE_KEYS]))
    key_signals = present(*[F.when(F.col("code").rlike(quoted(k)), F.lit(f"cache:key:{k}")) for k in T.AUTH_CACHE_KEYS])
    hit_signal = F.when(F.col("hit").isNotNull(), F.array(F.concat(F.lit("cache:invalidation:"), F.col("hit")))).otherwise(F.array().cast("array<string>"))
    cache_signals = F.concat(hit_signal, key_signals)
    signals = F.concat(
        F.array(F.concat(F.lit("name:"), name), F.concat(F.lit("pattern:"), F.col("pattern"))),
        present(*[F.when(test(text, s), F.lit(f"param:{s}")) for s in T.PARAMETER_SIGNALS]),
        present(*[F.when(test(F.col("code"), p), F.lit(s)) for p, s in T.DATABASE_SIGNALS]),
        F.when(F.size(cache_signals) == 0, F.array(F.lit("cache:none"))).otherwise(cache_signals),
    )
    return (
        fns.withColumn("mutation_type", kind).filter("mutation_type IS NOT NULL").withColumn("entity", entity).withColumn("pattern", source)
        .withColumn("code", code).withColumn("hit", hit).withColumn("signals", signals)
        .select("file", F.col("start_line").alias("line"), F.col("fname").alias("function_name"), "mutation_type", "entity",
                F.col("hit").isNotNull().alias("has_cache_invalidation"), F.col("hit").alias("invalidation_location"),
                F.when(F.col("hit").isNotNull() & (F.size(keys) > 0), keys).alias("related_cache_keys"), "signals",
                mutation_confidence(F.col("mutation_type"), F.col("signals")).alias("confidence"), "ord")
    )


# -- jobs --------------------------------------------------------------------------------


def job_framework(text: Column) -> Column:
    return classify(text, T.JOB_IMPORTS, "")


def job_handlers(files: DataFrame, nodes: DataFrame) -> DataFrame:
    path, text = F.concat(F.lit("/"), F.col("file")), F.coalesce("text", F.lit(""))
    gate = files.filter(~test_any(path, T.NON_JOB_PATHS) & (test_any(path, T.JOB_PATHS) | job_framework(text).isNotNull() | test_pairs(text, T.CUSTOM_JOBS))).select("file")
    n = nodes.join(gate, "file", "left_semi")
    t = F.col("text")
    quoted = lambda key: group(t, rf"{key}\s*:\s*['\"`]([^'\"`]+)['\"`]", 1, "")
    up = n.select("file", F.col("ord").alias("parent_ord"), F.when(F.col("kind") == "VariableDeclaration", F.col("name")).alias("variable"))
    ex = n.filter("kind IN ('CallExpression', 'NewExpression')").join(up, ["file", "parent_ord"], "left")
    framework = first_match([
        (test_any(t, [r"^schemaTask\s*\(", r"^task\s*\(\s*\{"], ""), "trigger"), (test(t, r"^new\s+Worker\s*\(", ""), "bullmq"),
        (test_any(t, [r"^createFunction\s*\(", r"^inngest\.createFunction\s*\("], ""), "inngest"), (test_pairs(t, T.CUSTOM_JOBS), "custom"),
    ])
    name = first_match([
        (F.col("framework") == "trigger", F.coalesce(quoted("id"), quoted("name"), F.col("variable"), F.lit("unnamed_task"))),
        (F.col("framework") == "bullmq", F.coalesce(group(t, r"new\s+Worker\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, ""), F.lit("unnamed_worker"))),
        (F.col("framework") == "inngest", F.coalesce(quoted("id"), quoted("name"), F.lit("unnamed_function"))),
    ], F.coalesce(F.col("variable"), group(t, r"(\w+)\s*\(", 1, ""), F.lit("unnamed_job")))
    safe = test_any(t, T.JOB_IDEMPOTENCY).alias("has_idempotency_check")
    expressions = ex.withColumn("framework", framework).filter("framework IS NOT NULL").select("file", F.col("start_line").alias("line"), name.alias("name"), safe, "framework", "ord")
    first_of = lambda arr, p: F.get(F.filter(arr, lambda d: test(d, p, "")), 0)
    classes = n.filter("kind = 'ClassDeclaration'").withColumn("dec", first_of(F.col("decorators"), r"@Processor\s*\(")).filter("dec IS NOT NULL").withColumn(
        "queue", F.coalesce(group(F.col("dec"), r"@Processor\s*\(\s*['\"`]?([^'\"`),]+)['\"`]?\s*\)", 1, ""), F.lit("unknown"))
    ).select("file", "ord", "start_off", "end_off", "queue")
    methods = n.filter("kind = 'MethodDeclaration'").withColumn("dec", first_of(F.col("decorators"), r"@Process\s*\(")).filter("dec IS NOT NULL")
    nest = inside(methods, classes).select(
        F.col("i.file").alias("file"), F.col("i.start_line").alias("line"),
        F.concat(F.col("queue"), F.lit(":"), F.coalesce(group(F.col("dec"), r"@Process\s*\(\s*['\"`]?([^'\"`),]+)['\"`]?\s*\)", 1, ""), F.col("i.name"))).alias("name"),
        test_any(F.col("i.text"), T.JOB_IDEMPOTENCY).alias("has_idempotency_check"), F.lit("bullmq").alias("framework"), F.col("i.ord").alias("ord"),
    )
    custom = n.filter("kind = 'FunctionDeclaration' AND exported AND name IS NOT NULL").filter(test_pairs(F.concat(F.col("name"), F.lit("(")), T.CUSTOM_JOBS)).select(
        "file", F.col("start_line").alias("line"), "name", safe, F.lit("custom").alias("framework"), "ord"
    )
    return expressions.unionByName(nest).unionByName(custom)


# -- webhooks ----------------------------------------------------------------------------


def detect_provider(context: Column, text: Column) -> Column:
    c = F.lower(F.concat(F.coalesce(context, F.lit("")), F.coalesce(text, F.lit(""))))
    has = lambda w: F.contains(c, F.lit(w))
    return first_match([(any_of(map(has, yes)) & ~any_of(map(has, no)), p) for p, yes, no in T.PROVIDERS], "generic")


def _first_found(text: Column, rows: list[tuple[str, str, str]], names: tuple[str, str], *wanted: Column) -> Column:
    """Of (key, pattern, name) the name and matched text of the first that matches under the first key with any match.

    A loop over a constant array: far less generated code than a branch for each pattern.
    """
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(js_regex(p, "i")).alias("run"), F.lit(n).alias("n")) for k, p, n in rows])
    hit = F.filter(table, lambda r: r["k"].isin(*wanted) & F.coalesce(F.call_function("rlike", text, r["run"]), F.lit(False)))
    under = lambda key: F.get(F.filter(hit, lambda r: r["k"] == key), 0)
    first = F.coalesce(*map(under, wanted))
    return F.when(first.isNotNull(), F.struct(first["n"].alias(names[0]), F.call_function("regexp_extract", text, first["run"], F.lit(0)).alias(names[1]))).otherwise(
        F.struct(F.lit("none").alias(names[0]), F.lit(None).cast("string").alias(names[1]))
    )


def _method(provider: Column, text: Column, table: dict) -> Column:
    """struct(method, location): the provider's list, then the generic one, else ``none``."""
    rows = [(name, p, m) for name, pairs in table.items() for p, m in pairs]
    return _first_found(text, rows, ("method", "location"), provider, F.lit("generic"))


def event_id_extraction(provider: Column, text: Column) -> Column:
    return _method(provider, text, T.EVENT_ID_METHODS)


def signature_verification(provider: Column, text: Column) -> Column:
    return _method(provider, text, T.SIGNATURE_METHODS)


def persistence_marker(text: Column) -> Column:
    rows = [(p, "database") for p in T.PERSIST_DATABASE] + [(p, "cache") for p in T.PERSIST_CACHE] + [(p, "database") for p in T.PERSIST_WRAPPERS]
    return _first_found(text, [("all", p, k) for p, k in rows], ("type", "location"), F.lit("all"))


def has_webhook_idempotency(text: Column) -> Column:
    return test_any(text, T.WEBHOOK_IDEMPOTENCY) | test_any(text, T.EVENT_STORAGE)


def event_types(text: Column) -> Column:
    """All case literals, then all literals compared with event.type; distinct, in order."""
    grab = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.array_distinct(F.concat(grab(r"case\s+['\"`]([^'\"`]+)['\"`]"), grab(r"event\.type\s*===?\s*['\"`]([^'\"`]+)['\"`]")))


def event_type_idempotency(text: Column) -> Column:
    """(event_type, has_idempotency) of every case block, then of if blocks for types without a case."""
    code = strip_comments(text)
    whole = r"case\s+['\"`][^'\"`]+['\"`]\s*:[\s\S]*?(?=case\s+['\"`]|default\s*:|\z)"
    blocks = F.regexp_extract_all(code, F.lit("(?i)" + whole), F.lit(0))
    one = lambda b, p: F.struct(F.regexp_extract(b, p, 1).alias("event_type"), has_webhook_idempotency(F.regexp_extract(b, p, 2)).alias("has_idempotency"))
    cases = F.transform(blocks, lambda b: one(b, r"(?i)case\s+['\"`]([^'\"`]+)['\"`]\s*:\s*([\s\S]*)"))
    ifs = F.regexp_extract_all(code, F.lit(r"(?i)if\s*\(\s*event\.type\s*===?\s*['\"`][^'\"`]+['\"`]\s*\)\s*\{[\s\S]*?\}"), F.lit(0))
    others = F.transform(ifs, lambda b: one(b, r"(?i)if\s*\(\s*event\.type\s*===?\s*['\"`]([^'\"`]+)['\"`]\s*\)\s*\{([\s\S]*?)\}"))
    return F.concat(cases, F.filter(others, lambda o: ~F.exists(cases, lambda c: c["event_type"] == o["event_type"])))


def is_management_file(code: Column) -> Column:
    n = sum((F.when(test(code, p), 1).otherwise(0) for p in T.WEBHOOK_MANAGEMENT), F.lit(0))
    return ~test_any(code, T.WEBHOOK_RECEIVERS) & (n >= 2)


def is_webhook_handler(name: Column, params: Column, exported: Column) -> Column:
    signature = F.exists(F.coalesce(params, F.array().cast("array<string>")), lambda p: any_of(F.contains(F.lower(p), F.lit(h)) for h in T.HANDLER_PARAMETERS))
    return signature | exported | (~test(name, r"^process") & test_pairs(name, T.STRONG_HANDLER_NAMES))


def webhook_files(files: DataFrame) -> DataFrame:
    path, code = F.concat(F.lit("/"), F.col("file")), strip_comments(F.coalesce("text", F.lit("")))
    return files.filter(~test_any(path, T.NON_WEBHOOK_PATHS)).filter(~is_management_file(code)).filter(
        test_any(path, T.WEBHOOK_ROUTES) | test_any(code, T.WEBHOOK_ROUTES) | test_pairs(code, T.HANDLER_NAMES)
    ).select("file")


def webhook_handlers(files: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.join(webhook_files(files), "file", "left_semi")
    code = strip_comments(F.col("text"))
    handlers = (
        named_functions(n).filter("kind <> 'FunctionExpression'")
        .filter(test_pairs(F.col("fname"), T.HANDLER_NAMES) & ~test_pairs(F.col("fname"), T.NON_HANDLER_NAMES))
        .filter(is_webhook_handler(F.col("fname"), F.col("params"), F.coalesce(F.when(F.col("kind") == "MethodDeclaration", F.lit(False)).otherwise(F.col("up_exported")), F.lit(False))))
        .withColumn("code", code).withColumn("provider", detect_provider(F.col("file"), F.col("code"))).withColumn("types", event_types(F.col("text")))
    )
    idem = has_webhook_idempotency(F.col("code"))
    full = handlers.select(
        "file", F.col("start_line").alias("line"), "provider", F.when(F.size("types") > 0, F.col("types")).alias("event_types"), idem.alias("has_idempotency_check"),
        F.when(idem, matched_text(F.col("code"), T.WEBHOOK_IDEMPOTENCY)).alias("idempotency_key_location"),
        event_id_extraction(F.col("provider"), F.col("code")).alias("event_id_extraction"), signature_verification(F.col("provider"), F.col("code")).alias("signature_verification"),
        persistence_marker(F.col("code")).alias("persistence_marker"), F.col("fname").alias("handler_name"),
        F.when(F.size("types") > 1, event_type_idempotency(F.col("text"))).alias("event_type_idempotency"), "ord",
    )
    path = group(F.col("text"), r"\.(post|get|put|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 2, "")
    routed = (
        calls(n).withColumn("route", path).filter(test_any(F.col("route"), T.WEBHOOK_ROUTES)).withColumn("code", code)
        .withColumn("provider", detect_provider(F.col("route"), F.col("code")))
        .select("file", F.col("start_line").alias("line"), "provider", test_any(F.col("code"), T.WEBHOOK_IDEMPOTENCY).alias("has_idempotency_check"),
                signature_verification(F.col("provider"), F.col("code")).alias("signature_verification"), "ord")
    )
    return full.unionByName(routed, allowMissingColumns=True)


# -- tenant isolation --------------------------------------------------------------------


def tenant_tables(schemas: DataFrame) -> DataFrame:
    """Models with a tenant column, from schema lines carried forward to their model."""
    ls = schemas.select("file", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("no", (F.col("i") + 1).cast("int"))
    start = group(F.col("line"), r"^model\s+(\w+)\s*\{", 1, "")
    w = Window.partitionBy("file").orderBy("no")
    ls = ls.withColumn("begins", start).withColumn("ends", F.trim("line") == "}")
    # A closing line belongs to its model and ends it for the lines that follow.
    mark = F.when(F.col("begins").isNotNull(), F.struct(F.col("begins").alias("table"), F.col("no").alias("at"))).when(F.lag("ends").over(w), F.struct(F.lit(None).cast("string").alias("table"), F.lit(None).cast("int").alias("at")))
    ls = ls.withColumn("mark", mark).withColumn("model", F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("model.table IS NOT NULL")
    column = F.coalesce(*[group(F.col("line"), rf"({p})\s+String", 1) for p, _ in T.TENANT_COLUMNS])
    kind = first_match([(test(F.col("line"), rf"({p})\s+String"), k) for p, k in T.TENANT_COLUMNS])
    related = group(F.col("line"), r"(\w+)\s+(Organization|Tenant|Team|Workspace|Account|Company)\s+@relation", 2)
    return (
        ls.withColumn("column", column).withColumn("kind", kind).withColumn("related", related)
        .groupBy("file", F.col("model.at").alias("line"), F.col("model.table").alias("table"))
        .agg(
            F.max_by("column", F.when(F.col("column").isNotNull(), F.col("no"))).alias("tenant_column"), F.max_by("kind", F.when(F.col("column").isNotNull(), F.col("no"))).alias("tenant_pattern"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("related").isNotNull(), F.struct("no", "related")))), lambda x: x["related"]).alias("related_tables"),
        )
        .filter("tenant_column IS NOT NULL")
    )


def sql_policies(migrations: DataFrame) -> DataFrame:
    """CREATE POLICY statements of migrations."""
    p = r"(?i)CREATE\s+POLICY\s+[\"']?(\w+)[\"']?\s+ON\s+[\"']?(\w+)[\"']?([^;]+)"
    s = migrations.select("file", "text", F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("k", "hit"))
    body = F.regexp_extract("hit", p, 3)
    using, check = test(body, r"USING\s*\("), test(body, r"WITH\s+CHECK\s*\(")
    session = first_match([
        (test(body, r"current_setting\s*\(\s*['\"]([^'\"]+)['\"]"), F.concat(F.lit("current_setting('"), group(body, r"current_setting\s*\(\s*['\"]([^'\"]+)['\"]", 1), F.lit("')"))),
        (test(body, r"auth\.uid\(\)"), "auth.uid()"), (test(body, r"auth\.jwt\(\)"), "auth.jwt()"),
    ])
    ops = F.when(test(body, r"FOR\s+ALL"), F.array(F.lit("ALL"))).otherwise(present(*[F.when(test(body, rf"FOR\s+{o}"), F.lit(o)) for o in ("SELECT", "INSERT", "UPDATE", "DELETE")]))
    return s.select(
        "file", line_of(F.col("text"), F.col("hit")).alias("line"), F.regexp_extract("hit", p, 2).alias("table"), F.regexp_extract("hit", p, 1).alias("policy_name"),
        first_match([(using & check, "both"), (using, "using")], "with_check").alias("policy_type"), matched_text(body, [c for c, _ in T.TENANT_COLUMNS]).alias("tenant_column"),
        test_any(body, [r"current_setting\s*\(", r"auth\.uid\(\)", r"auth\.jwt\(\)"]).alias("uses_session_context"), session.alias("session_context_pattern"),
        F.when(F.size(ops) > 0, ops).alias("operations"), F.col("k").alias("ord"),
    )


def protected_tables(migrations: DataFrame) -> DataFrame:
    """Lower-cased names of tables with row-level security enabled or a policy."""
    p = r"(?i)ALTER\s+TABLE\s+[\"']?(\w+)[\"']?\s+ENABLE\s+ROW\s+LEVEL\s+SECURITY"
    enabled = migrations.select(F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("key")).select(F.lower("key").alias("key"))
    return enabled.unionByName(sql_policies(migrations).select(F.lower("table").alias("key"))).distinct()


def map_operation(op: Column) -> Column:
    o = F.lower(op)
    return first_match([
        (F.contains(o, F.lit("find")) | o.isin("select", "aggregate", "count", "groupby"), "select"), (o.isin("create", "createmany", "insert", "upsert"), "insert"),
        (F.contains(o, F.lit("update")), "update"), (F.contains(o, F.lit("delete")), "delete"),
    ], "select")


def tenant_queries(nodes: DataFrame) -> DataFrame:
    t = F.col("text")
    client = r"(prisma|db|tx|client)\s*\.\s*(\w+)\s*\.\s*(findMany|findUnique|findFirst|create|createMany|update|updateMany|delete|deleteMany|upsert|aggregate|groupBy|count)"
    column = test_any(t, [p for p, _ in T.TENANT_COLUMNS])
    key = test_any(t, [r"where\s*:\s*\{\s*id\s*[,:}]", r"where\s*\(\s*\{\s*id\s*[,:}]", r"\.eq\s*\(\s*['\"`]id['\"`]"])
    c = calls(nodes)
    expression = F.coalesce(*[group(t, rf"({p})\s*[:=]\s*[^,}}]+", 0) for p, _ in T.TENANT_COLUMNS])
    model = (
        c.withColumn("table", group(t, client, 2)).filter("table IS NOT NULL").filter(~test(F.col("table"), r"^(\$|_|raw|queryRaw|executeRaw)", ""))
        .select("file", F.col("start_line").alias("line"), "table", map_operation(group(t, client, 3)).alias("operation"), (column | key).alias("has_tenant_filter"),
                F.when(column | key, expression).alias("tenant_filter_expression"), F.col("fn").alias("containing_function"), F.lit("prisma").alias("framework"), "ord")
    )
    supa = r"supabase\s*\.from\s*\(\s*['\"`](\w+)['\"`]\s*\)\s*\.(\w+)"
    skey = test_any(t, [r"\.eq\s*\(\s*['\"`]id['\"`]", r"\.match\s*\(\s*\{\s*id\s*:"])
    other = c.withColumn("table", group(t, supa, 1)).filter("table IS NOT NULL").select(
        "file", F.col("start_line").alias("line"), "table", map_operation(group(t, supa, 2)).alias("operation"), (column | skey).alias("has_tenant_filter"), F.lit("supabase").alias("framework"), "ord"
    )
    return model.unionByName(other, allowMissingColumns=True)


def with_tenant_flags(tables: DataFrame, protected: DataFrame, queries: DataFrame) -> DataFrame:
    """has_rls_policy and has_query_filtering, on the first table of a case-insensitive name."""
    first = F.row_number().over(Window.partitionBy(F.lower("table")).orderBy("file", "line")) == 1
    filtered = queries.filter("has_tenant_filter").select(F.lower("table").alias("key")).distinct().withColumn("filtered", F.lit(True))
    return (
        tables.withColumn("key", F.lower("table")).withColumn("first", first)
        .join(protected.withColumn("policy", F.lit(True)), "key", "left").join(filtered, "key", "left")
        .withColumn("has_rls_policy", F.col("first") & F.coalesce("policy", F.lit(False)))
        .withColumn("has_query_filtering", F.col("first") & F.coalesce("filtered", F.lit(False)))
        .drop("key", "first", "policy", "filtered")
    )


def database_framework(files: DataFrame) -> DataFrame:
    """framework of the first file in path order that names one."""
    t = F.coalesce("text", F.lit(""))
    has = lambda w: F.contains(t, F.lit(w))
    fw = first_match([
        ((has("@supabase/supabase-js") | has("createClient")) & has("supabase"), "supabase"), (has("drizzle-orm"), "drizzle"), (has("typeorm"), "typeorm"), (has("sequelize"), "sequelize"),
    ])
    schema = F.max(F.col("file") == "prisma/schema.prisma")
    return files.withColumn("fw", fw).agg(
        F.coalesce(F.when(schema, F.lit("prisma")), F.min_by("fw", F.when(F.col("fw").isNotNull(), F.col("file"))), F.lit("unknown")).alias("framework"),
        F.coalesce(F.bool_or(has("@supabase/supabase-js") | (has("createClient") & has("supabase"))), F.lit(False)).alias("uses_supabase"),
        F.coalesce(F.bool_or(test_any(t, [r"withRLSContext", r"rlsContext", r"setTenantContext", r"SET\s+LOCAL\s+app\.", r"current_setting.*app\.", r"set.*tenant.*context"])), F.lit(False)).alias("has_rls_context_helper"),
    )


def prisma_schema(files: DataFrame) -> DataFrame:
    """The schema file: four usual places in order, else the first below any prisma folder."""
    usual = ["prisma/schema.prisma", "schema.prisma", "packages/db/prisma/schema.prisma", "apps/web/prisma/schema.prisma"]
    order = first_match([(F.col("file") == p, i) for i, p in enumerate(usual)], len(usual))
    hit = files.filter(F.col("file").isin(usual) | F.col("file").rlike(r"(^|/)prisma/schema\.prisma$")).filter(~F.col("file").rlike("(^|/)node_modules/"))
    return hit.orderBy(order, "file").limit(1)


def migrations(files: DataFrame) -> DataFrame:
    return files.filter(F.col("file").rlike(r"(^|/)migrations/(.*/)?[^/]*\.sql$") & ~F.col("file").rlike("(^|/)node_modules/"))


# -- tests -------------------------------------------------------------------------------


def infer_test_type(path: Column) -> Column:
    p = F.lower(path)
    return first_match([(test_any(p, ["e2e", "end-to-end", "playwright"], ""), "e2e"), (test_any(p, ["integration", "api"], ""), "integration")], "unit")


def call_name(nodes: DataFrame) -> DataFrame:
    """Adds cname: a plain callee, or ``it``/``test``/``describe`` of ``it.each`` and the like."""
    plain = F.when(F.col("callee_object").isNull(), F.col("name")).when(F.col("callee_object").isin("it", "test", "describe"), F.col("callee_object"))
    return calls(nodes).withColumn("cname", plain)


def literal(arg: Column) -> Column:
    """The value of a string or template literal argument, else null."""
    return F.when(arg.rlike(r"^(['\"`])[\s\S]*\1$"), F.substring(arg, F.lit(2), F.length(arg) - 2))


def test_cases(nodes: DataFrame) -> DataFrame:
    """Tests with their describes (never popped), assertions and anti-patterns."""
    c = call_name(nodes).withColumn("title", literal(F.get("args", 0)))
    blocks = c.filter("cname IN ('describe', 'context', 'it', 'test') AND title IS NOT NULL AND title <> ''")
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.collect_list(F.when(F.col("cname").isin("describe", "context"), F.col("title"))).over(w)
    tests = blocks.withColumn("describes", stack).filter("cname IN ('it', 'test')")
    heads = tests.select("file", "ord", "start_off", "end_off", "start_line", "text", "title")
    # Functions that assert count as assertions where they are called.
    asserts = lambda n: n.rlike(r"^(expect|assert|verify|check)")
    inner_calls = c.select("file", "ord", "start_off", "end_off", "start_line", "cname", "name", "callee_object", "text", "parent_ord", "leading")
    helpers = (
        inside(inner_calls.filter(asserts(F.coalesce("cname", F.lit(""))) | ((F.col("name") == "expect") & F.col("callee_object").isNotNull())), named_functions(nodes))
        .select(F.col("o.file").alias("file"), F.col("fname").alias("helper")).distinct()
    )
    within = inside(inner_calls, heads).select(
        F.col("o.file").alias("file"), F.col("o.ord").alias("test"), *[F.col(f"i.{x}").alias(x) for x in ("ord", "start_line", "cname", "name", "callee_object", "text", "parent_ord", "leading")]
    )
    within = within.join(helpers.withColumn("is_helper", F.lit(True)), (within.file == helpers.file) & (within.cname == helpers.helper), "left").drop(helpers.file, helpers.helper)
    parents = nodes.select("file", F.col("ord").alias("parent_ord"), F.col("text").alias("up_text"))
    within = within.join(parents, ["file", "parent_ord"], "left")
    counted = asserts(F.coalesce("cname", F.lit(""))).cast("int") + F.coalesce("is_helper", F.lit(False)).cast("int") + (
        F.col("callee_object").isNotNull() & F.col("name").isin("expect", "should", "equal", "eql", "include", "contain", "have", "be", "property")
    ).cast("int")
    anti = lambda kind, line, text: F.struct(F.lit(kind).alias("type"), line.alias("line"), F.lit(text).alias("description"))
    line = F.col("start_line")
    sleep = F.when(F.col("cname").isin("setTimeout", "sleep", "delay", "wait"), anti("sleep", line, "Test uses timing-based waiting instead of explicit waits"))
    ticket = test_any(F.coalesce("leading", F.lit("")), ["TODO", "FIXME", "JIRA", "LINEAR", r"[A-Z]+-[0-9]+"], "")
    skip = F.when(F.col("callee_object").isNotNull() & F.col("name").isin("skip", "todo") & ~ticket, anti("silent_skip", line, "Test is skipped without a TODO or ticket reference"))
    assertion = F.when(F.col("cname") == "expect", F.struct(
        line.alias("line"), F.when(test_any(F.coalesce("up_text", F.lit("")), ["200", "201"], ""), "status").otherwise("unknown").alias("type"), F.lit(False).alias("is_permissive")))
    per_call = within.groupBy("file", "test").agg(
        F.sum(counted).alias("n_assertions"),
        F.transform(F.array_sort(F.collect_list(F.when(assertion.isNotNull(), F.struct("ord", assertion.alias("a"))))), lambda x: x["a"]).alias("assertions"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", present(sleep, skip).alias("a")))), lambda x: x["a"])).alias("call_patterns"),
    )
    tries = inside(nodes.filter("kind = 'TryStatement' AND size(args) > 0"), heads).select(F.col("o.file").alias("file"), F.col("o.ord").alias("test"), F.col("i.ord").alias("ord"), F.col("i.start_line").alias("start_line"), F.get(F.col("i.args"), 0).alias("body"))
    checks = test_any(F.col("body"), ["expect", "assert", "throw"], "")
    swallow = first_match([
        (F.regexp_replace("body", r"\s", "") == "{}", anti("error_swallowing", line, "Test has empty catch block - errors are silently ignored")),
        (F.col("body").rlike(r"^\s*\{\s*console\.(log|warn|error|info)\s*\(") & ~checks, anti("error_swallowing", line, "Test catches errors but only logs them without assertion")),
        (~checks, anti("error_swallowing", line, "Test catches errors without asserting on them")),
    ], F.lit(None))
    caught = tries.withColumn("a", swallow).filter("a IS NOT NULL").groupBy("file", "test").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a"))), lambda x: x["a"]).alias("try_patterns"))
    t = F.col("text")
    permissive = F.when(test_any(t, [r"expect.*status.*\.\s*toBe\s*\(\s*20[0-9]\s*\|\|", r"expect.*\.(toBeOneOf|toBeIn)\s*\(", r"expect.*\|\|.*expect"], ""),
                        anti("permissive_assertion", line, "Test uses permissive assertions that accept multiple values"))
    always = F.when(t.rlike("|".join([
        r"expect\s*\(\s*true\s*\)\s*\.(toBe|toEqual)\s*\(\s*true\s*\)", r"expect\s*\(\s*false\s*\)\s*\.(toBe|toEqual)\s*\(\s*false\s*\)",
        r"expect\s*\(\s*(?<n>\d+)\s*\)\s*\.(toBe|toEqual)\s*\(\s*\k<n>\s*\)", r"expect\s*\(\s*(?<q>['\"`])(?<v>[^'\"]+)\k<q>\s*\)\s*\.(toBe|toEqual)\s*\(\s*\k<q>\k<v>\k<q>\s*\)",
        r"expect\s*\(\s*(['\"`][^'\"]+['\"`]|\d+|true|false)\s*\)\s*\.toBeDefined\s*\(", r"expect\s*\(\s*(['\"`][^'\"]+['\"`]|[1-9]\d*|true)\s*\)\s*\.toBeTruthy\s*\(",
    ])), anti("always_passes", line, "Test contains tautological assertion that can never fail"))
    none = F.when((F.coalesce("n_assertions", F.lit(0)) == 0) & ~test(F.col("title"), "setup|teardown|before|after|helper"), anti("no_assertions", line, "Test has no assertions (expect/assert calls)"))
    mocked = F.when(test(t, r"\.mock(?:ReturnValue|ResolvedValue)\s*\(", "") & test(t, r"expect\s*\(\s*mock\w*\s*\(", ""),
                    anti("mocked_sut", line, "Test asserts mocked function returns its configured value - tests nothing"))
    empty_a, empty_p = F.array().cast("array<struct<line:int,type:string,is_permissive:boolean>>"), F.array().cast("array<struct<type:string,line:int,description:string>>")
    keys = ["file", "ord"]
    return (
        tests.join(per_call.withColumnRenamed("test", "ord"), keys, "left").join(caught.withColumnRenamed("test", "ord"), keys, "left")
        .select("file", F.col("start_line").alias("line"), F.col("title").alias("name"), infer_test_type(F.col("file")).alias("type"), "describes",
                F.coalesce("assertions", empty_a).alias("assertions"),
                F.concat(F.coalesce("call_patterns", empty_p), F.coalesce("try_patterns", empty_p), present(permissive, always, none, mocked)).alias("anti_patterns"), "ord")
    )


def mocked_sut(files: DataFrame, tests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tests that only call what their file mocks, or whose file mocks the module under test: file, ord, kind."""
    names = F.array_distinct(F.transform(F.flatten(F.array(*[
        F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)) for p in (
            r"jest\.spyOn\s*\([^,]+,\s*['\"`](\w+)['\"`]\s*\)", r"vi\.spyOn\s*\([^,]+,\s*['\"`](\w+)['\"`]\s*\)", r"\((\w+)\s+as\s+jest\.Mock\)", r"mocked(\w+)\.mock",
            r"\b(mock\w+)\.mock(?:ReturnValue|ResolvedValue|Implementation)")
    ])), F.lower))
    base = F.lower(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.test\.(ts|js|tsx|jsx)$", ""))
    modules = F.transform(F.regexp_extract_all("text", F.lit(r"jest\.mock\s*\(\s*['\"`]\./([^'\"]+)['\"`]"), F.lit(1)), F.lower)
    per_file = files.select("file", names.alias("mocked"), F.exists(modules, lambda m: F.contains(base, m)).alias("own_module"))
    body = nodes.select("file", "ord", "text")
    known = ["expect", "describe", "it", "test", "beforeEach", "afterEach", "beforeAll", "afterAll", "jest", "vi", "mock", "fn", "spyOn"]
    called = F.transform(F.filter(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1)), lambda f: ~f.isin(known)), F.lower)
    real = F.exists(F.array_except(called, F.col("mocked")), lambda f: ~F.startswith(f, F.lit("mock")) & ~F.startswith(f, F.lit("create")))
    joined = tests.select("file", "ord", "line").join(body, ["file", "ord"]).join(per_file, "file")
    only = ~real & test(F.col("text"), r"=\s*mocked\w+\s*\(", "") & test(F.col("text"), r"expect\s*\(\s*\w+\s*\)", "")
    return joined.select("file", "ord", "line", F.explode(present(F.when(only, F.lit("mocked_call")), F.when(F.col("own_module"), F.lit("mocked_module")))).alias("kind"))


# -- directives --------------------------------------------------------------------------


def directives(files: DataFrame) -> DataFrame:
    """Leading string directives in the first 50 lines: file, directive."""
    ls = files.select("file", F.posexplode(F.slice(F.split("text", r"\r?\n"), 1, 50)).alias("i", "line")).withColumn("line", F.trim("line"))
    ls = ls.filter(~(F.col("line") == "") & ~F.col("line").rlike(r"^(//|/\*|\*)"))
    d = F.regexp_extract("line", r"^['\"]([^'\"]+)['\"]\s*;?\s*$", 1)
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("directive", d)
    return ls.withColumn("over", F.max(F.col("directive") == "").over(w)).filter("NOT over").select("file", "directive").distinct()
