"""File inventory: partitions, globs, test and generated files, dependencies, framework signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.matching import any_of, first_match, glob_any, test, test_any

# Caps of a scan, and folders left out by default.
MAX_FILES, MAX_PARSED = 20_000, 10_000
INCLUDE = ["**/*.{ts,tsx,js,jsx,mjs,cjs}"]
EXCLUDE = [
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**", "**/*.d.ts", "**/*.test.{ts,js}", "**/*.spec.{ts,js}", "**/__tests__/**", "**/data/**", "**/golden-benchmark/**",
    "**/benchmark/**", "**/fixtures/**", "**/samples/**", "**/examples/**", "**/generated/**", "**/vendor/**", "**/.cache/**",
]
TEST_GLOBS = ["**/*.test.{ts,tsx,js}", "**/*.spec.{ts,tsx,js}", "**/tests/**/*.{ts,js}", "**/__tests__/**/*.{ts,js}", "**/e2e/**/*.{ts,js}"]
SERVICE_GLOBS = ["**/{services,service,lib,server,api}/**/*.{ts,js}"]


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """file (path below root), text: one row a file, read whole."""
    path = F.col("_metadata.file_path")
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.url_decode(path).alias("path"))
    base = root.split(":", 1)[-1].strip("/")
    return raw.select(F.regexp_replace("path", r"^.*?" + _quoted(base) + "/", "").alias("file"), "text")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def is_test_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return any_of(test(p, s, f) for s, f in T.TEST_PATHS)


def is_test_text(text: Column, imports: Column) -> Column:
    """Two points for a test import, one each for test calls, hooks, and assertions; two are enough."""
    known = F.exists(F.coalesce(imports, F.array().cast("array<string>")), lambda m: test_any(m, T.TEST_IMPORTS, ""))
    n = lambda c: F.when(c, 1).otherwise(0)
    score = F.when(known, 2).otherwise(0) + n(test(text, T.TEST_CALL, "")) + n(test(text, T.TEST_HOOK, "")) + n(test(text, T.TEST_ASSERT, "") | test(text, T.TEST_CYPRESS, ""))
    return score >= 2


def imports_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+(?:[^'\";]*?from\s+)?['\"]([^'\"]+)['\"]"), F.lit(1))


def skip_tests(path: Column, text: Column, mode: str = "exclude", strategy: str = "both") -> Column:
    if mode != "exclude":
        return F.lit(False)
    by_text = is_test_text(text, imports_of(text))
    return {"path": is_test_path(path), "heuristic": by_text}.get(strategy, is_test_path(path) | by_text)


def is_generated_path(path: Column) -> Column:
    return test_any(F.replace(path, F.lit("\\"), F.lit("/")), T.GENERATED_PATHS)


def is_generated_text(text: Column) -> Column:
    return test_any(F.substring(text, 1, 4096), T.GENERATED_HEADERS)


def skip_generated(path: Column, text: Column, mode: str = "exclude", strategy: str = "both") -> Column:
    if mode != "exclude":
        return F.lit(False)
    return {"path": is_generated_path(path), "header": is_generated_text(text)}.get(strategy, is_generated_path(path) | is_generated_text(text))


def discover_partitions(files: DataFrame) -> DataFrame:
    """relative_path, kind: the root, and children of apps and packages that hold a package or compiler file."""
    p = r"^(apps|packages)/([^/.][^/]*)/(package|tsconfig)\.json$"
    kids = files.filter(F.col("file").rlike(p)).select(
        F.concat_ws("/", F.regexp_extract("file", p, 1), F.regexp_extract("file", p, 2)).alias("relative_path"), F.when(F.regexp_extract("file", p, 1) == "apps", "app").otherwise("package").alias("kind")
    ).dropDuplicates(["relative_path"])
    root = kids.agg(F.lit("").alias("relative_path"), F.when(F.count("*") > 0, "workspace").otherwise("root").alias("kind"))
    return root.unionByName(kids).orderBy("relative_path")


def rebase_globs(globs: Sequence[str], relative_path: str, kind: str) -> list[str]:
    """Globs as seen from a partition: its own folder stripped, other partitions' globs dropped."""
    out = []
    for g in globs:
        top = g.split("/", 1)[0]
        if kind in ("root", "workspace"):
            if kind == "root" or top not in ("apps", "packages"):
                out.append(g)
            continue
        own_top, _, own = relative_path.partition("/")
        if top not in ("apps", "packages"):
            out.append(g)
        elif top == own_top:
            rest = g.split("/", 1)[1] if "/" in g else "**"
            head, _, tail = rest.partition("/")
            if head == own:
                out.append(tail or "**")
            elif head in ("*", "**"):
                out.append(tail or "**")
    return out


def partition_overrides(partitions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Partitions with the override of the longest path prefix; the empty path only fits the root."""
    p, o = F.col("p.relative_path"), F.col("o.path")
    fits = F.when(o == "", p == "").otherwise((p == o) | F.startswith(p, F.concat(o, F.lit("/"))))
    j = partitions.alias("p").join(F.broadcast(overrides.alias("o")), fits, "left")  # overrides are configuration: a few rows
    w = Window.partitionBy(p).orderBy(F.length(o).desc_nulls_last())
    return j.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("p.*", F.col("o.path").alias("override_path"), *[F.col(f"o.{c}") for c in overrides.columns if c != "path"])


def framework_excludes(frameworks: Sequence[str]) -> list[str]:
    return [g for f in frameworks for g in T.FRAMEWORK_EXCLUDES.get(f.lower(), [])]


def inventory(files: DataFrame, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE, tests: str = "exclude", generated: str = "exclude", cap: int | None = None) -> DataFrame:
    """Source files that pass globs and skips; a cap keeps the first in path order (none by default)."""
    f, t = F.col("file"), F.coalesce("text", F.lit(""))
    # Path tests first: they are cheap and spare the text tests.
    out = files.filter(glob_any(f, include) & ~glob_any(f, exclude))
    if tests == "exclude":
        out = out.filter(~is_test_path(f))
    if generated == "exclude":
        out = out.filter(~is_generated_path(f))
    out = out.filter(~skip_tests(f, t, tests, "heuristic") & ~skip_generated(f, t, generated, "header")).dropDuplicates(["file"])
    return out.orderBy("file").limit(cap) if cap else out


def test_inventory(files: DataFrame, globs: Sequence[str] = TEST_GLOBS, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """Test files: test globs, without the excludes that name tests."""
    kept = [e for e in exclude if "test" not in e and "spec" not in e]
    return files.filter(glob_any(F.col("file"), globs) & ~glob_any(F.col("file"), kept)).dropDuplicates(["file"])


def read_packages(files: DataFrame) -> DataFrame:
    """folder, deps (names), versions (map): package files; later sections override, bad JSON counts as none."""
    pkg = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).select(F.regexp_replace("file", r"/?package\.json$", "").alias("folder"), "text")
    sections = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    doc = F.try_parse_json("text")
    parts = [F.coalesce(F.try_variant_get(doc, f"$.{s}", "map<string,variant>"), F.create_map().cast("map<string,variant>")) for s in sections]
    pairs = pkg.select("folder", F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.map_entries(m).alias("e")) for i, m in enumerate(parts)])).alias("s"))
    flat = pairs.select("folder", F.col("s.no").alias("no"), F.explode_outer("s.e").alias("e")).select("folder", "no", F.col("e.key").alias("name"), F.when(F.schema_of_variant("e.value") == "STRING", F.try_variant_get("e.value", "$", "string")).alias("version"))
    last = flat.groupBy("folder", "name").agg(F.max_by("version", F.when(F.col("version").isNotNull(), F.col("no"))).alias("version"))
    return last.groupBy("folder").agg(
        F.array_sort(F.collect_list("name")).alias("deps"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("name", "version"))))).alias("versions")
    )


def framework_signals(packages: DataFrame, files: DataFrame) -> DataFrame:
    """folder, framework, confidence (capped at 1), sources, version: from dependencies and configuration files."""
    dep = F.create_map(*[F.lit(x) for kv in T.DEPENDENCY_SIGNALS.items() for x in kv])
    order = {k: i for i, k in enumerate(T.DEPENDENCY_SIGNALS)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    known = packages.select("folder", F.explode("versions").alias("name", "version")).withColumn("framework", F.try_element_at(dep, F.col("name"))).filter("framework IS NOT NULL")
    a = known.select("folder", "framework", F.lit(T.DEPENDENCY_CONFIDENCE).alias("weight"), F.concat(F.lit("dependency:"), "name").alias("source"), "version", F.try_element_at(rank, F.col("name")).alias("no"))
    parts = []
    base = 1000
    for fw, names in T.CONFIG_SIGNALS.items():
        for n in names:
            parts.append(F.when(F.endswith(F.concat(F.lit("/"), F.col("file")), F.lit("/" + n)), F.struct(F.lit(fw).alias("framework"), F.lit(n).alias("name"), F.lit(base).alias("no"))))
            base += 1
    cfg = files.select("file", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("c")).select(
        F.regexp_replace(F.expr("left(file, length(file) - length(c.name))"), "/$", "").alias("folder"), F.col("c.framework").alias("framework"), F.lit(T.CONFIG_CONFIDENCE).alias("weight"), F.concat(F.lit("config:"), F.col("c.name")).alias("source"), F.lit(None).cast("string").alias("version"), F.col("c.no").alias("no"))
    return a.unionByName(cfg).groupBy("folder", "framework").agg(
        F.least(F.lit(1.0), F.sum("weight")).alias("confidence"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("no", "source"))), lambda x: x["source"])).alias("sources"),
        F.min_by("version", F.when(F.col("version").isNotNull(), F.col("no"))).alias("version"),
    )


def effective_frameworks(signals: DataFrame, partitions: DataFrame) -> DataFrame:
    """relative_path, frameworks: a partition's own frameworks and those of the root, sorted."""
    own = signals.select(F.col("folder").alias("relative_path"), "framework")
    root = signals.filter("folder = ''").select("framework").distinct()
    every = partitions.select("relative_path").join(own, "relative_path").unionByName(partitions.select("relative_path").crossJoin(F.broadcast(root)))  # at most the known frameworks
    return every.groupBy("relative_path").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))


def artifact_frameworks(codebase: list[str] | None, routes: DataFrame, services: DataFrame, hooks: DataFrame) -> DataFrame:
    """framework: the codebase's list if given, else from routes, service paths and providers."""
    if codebase is not None:
        return routes.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(x.lower() for x in codebase)], "framework string")
    nextjs = F.contains("file", F.lit("/app/")) & (F.endswith("file", F.lit("route.ts")) | F.endswith("file", F.lit("route.js")) | F.contains("file", F.lit("/actions/")))
    return (
        routes.filter("framework <> 'unknown'").select(F.lower("framework").alias("framework"))
        .unionByName(services.filter(nextjs).select(F.lit("nextjs").alias("framework"))).unionByName(hooks.filter("provider IS NOT NULL").select(F.lower("provider").alias("framework"))).distinct()
    )


def languages(files: DataFrame) -> DataFrame:
    """One row: n_files and the languages of the extensions present."""
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    lang = first_match([(ext.isin("ts", "tsx"), "typescript"), (ext.isin("js", "jsx", "mjs", "cjs"), "javascript")])
    return files.agg(F.count_distinct("file").alias("n_files"), F.array_sort(F.collect_set(lang)).alias("languages"))


def merge_config(base: dict, override: dict) -> dict:
    """Arrays replace; function and cache lists unite without repeats; nested objects merge one level deep."""
    out = dict(base)
    for k, v in (override or {}).items():
        if k == "authzFunctions" and k in base:
            out[k] = list(dict.fromkeys([*base[k], *v]))
        elif k == "cachePatterns" and isinstance(base.get(k), dict):
            out[k] = {n: list(dict.fromkeys([*base[k].get(n, []), *v.get(n, [])])) for n in ("get", "set", "delete")}
        elif isinstance(v, dict) and isinstance(base.get(k), dict):
            out[k] = base[k] | v
        else:
            out[k] = v
    return out
