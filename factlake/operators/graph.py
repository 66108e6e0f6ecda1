"""Imports, call edges and reachability, as flat relations.

Reachability is a breadth-first frontier with a visited anti-join, one staged round for each level
(at most ``max_depth``): each node counts at its smallest depth. ``callers_dfs`` reproduces the
order-dependent depth-first walk for parity on one graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import first_match
from ..sources.shipping import ship

# Objects whose methods are no call edges, and suffixes tried for relative modules, in order.
BUILTIN_OBJECTS = ["console", "Math", "JSON", "Object", "Array", "Promise", "String", "Number", "Boolean", "Date", "RegExp", "Error", "Map", "Set", "WeakMap", "WeakSet"]
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]

BINDINGS = "file string, ord int, local_name string, original_name string, source_module string, type string"


def _bindings_of(text: str) -> list[tuple[str, str, str, str]]:
    """(local, original, module, type) of one import or require text."""
    out = []
    m = re.match(r"import\s+(?:type\s+)?(.*?)\s*from\s*['\"]([^'\"]+)['\"]", text, re.S)
    if m:
        clause, module = m[1], m[2]
        named = re.search(r"\{([^}]*)\}", clause, re.S)
        head = re.sub(r"\{[^}]*\}", "", clause, flags=re.S)
        space = re.search(r"\*\s+as\s+([\w$]+)", head)
        default = re.match(r"\s*([\w$]+)", re.sub(r"\*\s+as\s+[\w$]+", "", head))
        if default:
            out.append((default[1], "default", module, "default"))
        if space:
            out.append((space[1], "*", module, "namespace"))
        for part in (named[1].split(",") if named else []):
            n = re.match(r"\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*$", part)
            if n:
                out.append((n[2] or n[1], n[1], module, "named"))
        return out
    m = re.match(r"(\{[^}]*\}|[\w$]+)\s*(?::[^=]+)?=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", text, re.S)
    if m and m[1].startswith("{"):
        for part in m[1][1:-1].split(","):
            n = re.match(r"\s*([\w$]+)(?:\s*:\s*([\w$]+))?\s*$", part)
            if n:
                out.append((n[2] or n[1], n[1], m[2], "named"))
    elif m:
        out.append((m[1], "default", m[2], "commonjs"))
    return out


def import_bindings(nodes: DataFrame) -> DataFrame:
    """Default, namespace, named, destructured-require and require bindings of each file."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(f, o * 100 + k, *b) for f, o, t in zip(pdf["file"], pdf["ord"], pdf["text"], strict=True) for k, b in enumerate(_bindings_of(t))]
            yield pd.DataFrame(rows, columns=["file", "ord", "local_name", "original_name", "source_module", "type"])

    ship(nodes.sparkSession)
    wanted = nodes.filter("kind = 'ImportDeclaration' OR (kind = 'VariableDeclaration' AND text LIKE '%require(%')")
    return wanted.select("file", "ord", "text").mapInPandas(run, BINDINGS)


def exports(nodes: DataFrame, files: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """name, file: what each file exports: declarations, lists, ``default``, and with ``files`` what stars pass on from other files.

    cap: most rows, in order of file and name.
    """
    kinds = nodes.filter("exported AND kind IN ('FunctionDeclaration', 'ClassDeclaration', 'VariableDeclaration') AND name IS NOT NULL")
    declared = kinds.select(F.explode(F.split("name", ",")).alias("name"), "file")
    said = nodes.filter("kind = 'ExportDeclaration'")
    listed = said.filter(F.col("text").rlike(r"^export\s*\{")).select(F.explode(F.split(F.regexp_extract("text", r"\{([^}]*)\}", 1), ",")).alias("part"), "file")
    listed = listed.select(F.trim(F.regexp_replace("part", r"^\s*(type\s+)?([\w$]+\s+as\s+)?", "")).alias("name"), "file").filter("name <> ''")
    named = said.filter(F.col("text").rlike(r"^export\s*\*\s*as\s")).select(F.regexp_extract("text", r"\bas\s+([\w$]+)", 1).alias("name"), "file")
    default = said.filter("name = 'default' AND text NOT LIKE '%{%'").select(F.lit("default").alias("name"), "file")
    own = declared.unionByName(listed).unionByName(named).unionByName(default).distinct()
    if files is not None:
        stars = said.filter(F.col("text").rlike(r"^export\s*\*\s*from\b")).select("file", F.col("name").alias("source_module"))
        passed = resolve_modules(stars, files).filter("resolved_path IS NOT NULL").select(F.col("file").alias("src"), F.col("resolved_path").alias("dst"))
        seen = reachable(passed, passed.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct())
        more = seen.select("root", F.col("node").alias("file")).join(own.filter("name <> 'default'"), "file").select("name", F.col("root").alias("file"))
        own = own.unionByName(more).distinct()
    return own if cap is None else own.orderBy("file", "name").limit(cap)


def normalize_segments(path: Column) -> Column:
    """Resolves ``.`` and ``..`` in a relative path."""
    return F.array_join(F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    ), "/")


def resolve_modules(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved_path: relative modules try seven suffixes in order; without a hit the bare path stays."""
    folder = F.regexp_replace("file", r"(^|/)[^/]*$", "")
    relative = F.col("source_module").rlike(r"^[./]")
    base = F.when(relative, F.when(F.startswith("source_module", F.lit("/")), normalize_segments(F.col("source_module"))).otherwise(normalize_segments(F.concat(folder, F.lit("/"), F.col("source_module")))))
    b = bindings.withColumn("base", base)
    tries = b.filter("base IS NOT NULL").select("base").distinct().select("base", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in SUFFIXES])).alias("prio", "candidate"))
    best = tries.join(files.select(F.col("file").alias("candidate")).distinct(), "candidate").groupBy("base").agg(F.min_by("candidate", "prio").alias("hit"))
    return b.join(best, "base", "left").withColumn("resolved_path", F.coalesce("hit", "base")).drop("base", "hit")


def call_functions(nodes: DataFrame) -> DataFrame:
    """Declared functions, methods, and functions held by variables or properties: file, function_name, line, start_off, end_off, ord."""
    up = nodes.select("file", F.col("ord").alias("parent_ord"), F.col("name").alias("up_name"), F.col("kind").alias("up_kind"))
    own = nodes.filter("kind IN ('FunctionDeclaration', 'MethodDeclaration') AND name IS NOT NULL").withColumn("function_name", F.col("name"))
    held = nodes.filter("kind IN ('ArrowFunction', 'FunctionExpression')").join(up, ["file", "parent_ord"]).filter("up_kind IN ('VariableDeclaration', 'PropertyAssignment')").withColumn("function_name", F.col("up_name"))
    cols = ["file", "function_name", F.col("start_line").alias("line"), "start_off", "end_off", "ord"]
    return own.select(*cols).unionByName(held.select(*cols))


def call_edges(nodes: DataFrame, resolved: DataFrame, cap: int | None = None) -> DataFrame:
    """First call of each (target file, target function, original name) inside each function, nested functions included.

    cap: most functions that are looked at, in order of file and place.
    """
    obj = F.regexp_extract(F.coalesce("callee_object", F.lit("")), r"([\w$]+)$", 1)
    c = nodes.filter("kind = 'CallExpression' AND name IS NOT NULL").withColumn("object", F.when(F.col("callee_object").isNotNull(), F.when(F.col("callee_object").rlike(r"^[\w$.]+$"), obj).otherwise("")))
    c = c.filter(~F.coalesce(F.col("object").isin(BUILTIN_OBJECTS), F.lit(False)))
    last = resolved.groupBy("file", "local_name").agg(F.max_by(F.struct("original_name", "resolved_path", "type"), "ord").alias("b"))
    c = c.withColumn("local_name", F.coalesce("object", "name")).join(last, ["file", "local_name"], "left")
    plain = F.col("object").isNull()
    original = first_match([
        (plain & F.col("b").isNotNull(), F.when(F.col("b.original_name") == "default", F.col("local_name")).otherwise(F.col("b.original_name"))),
        (~plain & F.col("b.type").isin("namespace", "default", "commonjs"), F.col("name")),
    ])
    c = c.withColumn("resolved_name", original).withColumn("target_file", F.when(F.col("resolved_name").isNotNull(), F.col("b.resolved_path")))
    c = c.select("file", F.col("ord").alias("call_ord"), F.col("start_off").alias("cs"), F.col("end_off").alias("ce"), F.col("start_line").alias("call_line"), F.col("name").alias("target_function"), "target_file",
                 F.when(F.col("resolved_name") != F.col("name"), F.col("resolved_name")).alias("original_name"))
    fns = call_functions(nodes)
    fns = (fns if cap is None else fns.orderBy("file", "ord").limit(cap)).withColumnRenamed("ord", "fn_ord")
    inner = fns.join(c, ["file"]).filter("cs >= start_off AND ce <= end_off AND call_ord > fn_ord")
    w = Window.partitionBy("file", "fn_ord", "target_file", "target_function", "original_name").orderBy("call_ord")
    return inner.withColumn("k", F.row_number().over(w)).filter("k = 1").select(
        "file", F.col("function_name").alias("caller"), "line", "target_function", "target_file", "original_name", "call_line", "fn_ord", "call_ord"
    )


def called_by(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """file, function_name, caller_function, caller_file: by (name, file) where that exists, else by name alone."""
    f = functions.select("file", "function_name").distinct()
    e = edges.select(F.coalesce("original_name", "target_function").alias("function_name"), F.col("target_file"), F.col("caller").alias("caller_function"), F.col("file").alias("caller_file")).distinct()
    exact = e.filter("target_file IS NOT NULL").join(f.withColumnRenamed("file", "target_file"), ["function_name", "target_file"])
    rest = e.join(f.withColumnRenamed("file", "target_file"), ["function_name", "target_file"], "left_anti")
    by_name = rest.drop("target_file").join(f.withColumnRenamed("file", "target_file"), "function_name")
    return exact.unionByName(by_name.select(*exact.columns)).select(F.col("target_file").alias("file"), "function_name", "caller_function", "caller_file").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """root, node, depth (smallest): nodes reached from seeds (root, node) along edges (src, dst)."""
    # Kept once for all rounds, dealt by the node that a step looks up.
    edges = _cut(edges.select("src", "dst").distinct().repartition("src"))
    frontier = seeds.select("root", "node").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = (
            frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
        )
        frontier = _cut(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen.filter("depth > 0")


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; a local default only where driver and executors are one machine."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints/factlake").rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a round in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def callers_of(callers: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """root, node, depth: callers of each target name, by name, breadth first."""
    e = callers.select(F.col("function_name").alias("src"), F.col("caller_function").alias("dst"))
    return reachable(e, targets.select(F.col("name").alias("root"), F.col("name").alias("node")), max_depth)


def callees_of(edges: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    e = edges.select(F.col("caller").alias("src"), F.coalesce("original_name", "target_function").alias("dst"))
    return reachable(e, targets.select(F.col("name").alias("root"), F.col("name").alias("node")), max_depth)


def has_auth_in_chain(callers: DataFrame, edges: DataFrame, targets: DataFrame, auth_names: list[str], max_depth: int = 10) -> DataFrame:
    """name, has_auth: some caller's name is an authorization function, or the target calls one."""
    above = callers_of(callers, targets, max_depth).filter(F.col("node").isin(auth_names)).select(F.col("root").alias("name"))
    direct = edges.filter(F.coalesce("original_name", "target_function").isin(auth_names)).select(F.col("caller").alias("name"))
    found = above.unionByName(direct).distinct().withColumn("found", F.lit(True))
    return targets.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("has_auth"))


def callers_dfs(callers: list[tuple[str, str, str, str]], target: str, max_depth: int = 10) -> list[tuple[str, str, int]]:
    """The depth-first walk on one small graph given as (file, function, caller, caller file) rows in order."""
    by_name: dict[str, dict[str, list]] = {}
    for file, fn, caller, caller_file in callers:
        by_name.setdefault(fn, {}).setdefault(file, []).append((caller, caller_file))
    out: list[tuple[str, str, int]] = []
    visited: set[tuple[str, str]] = set()

    def walk(name: str, depth: int) -> None:
        if depth > max_depth:
            return
        for file, ups in by_name.get(name, {}).items():
            if (file, name) not in visited:
                visited.add((file, name))
                for caller, caller_file in ups:
                    out.append((caller, caller_file, depth))
                    walk(caller, depth + 1)

    walk(target, 1)
    return out
