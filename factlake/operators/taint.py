"""Data flow inside a function: sources, sinks, transforms, and the flows that connect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.matching import any_of, classify, first_match, group, test, test_any

LIT_INPUT = "input"


def access_path(text: Column) -> Column:
    p = r"(?:req(?:uest)?|params|query|body|headers|cookies)\.[a-zA-Z_.[\]]+"
    return F.coalesce(group(text, p, 0, ""), F.substring(text, 1, 50))


def _first_context(df: DataFrame) -> Column:
    """The function a node lies in, itself included if it is a declared one."""
    own = F.when(F.col("kind").isin("FunctionDeclaration", "MethodDeclaration"), F.col("name")).when(
        F.col("kind").isin("ArrowFunction", "FunctionExpression") & (F.col("parent_kind") == "VariableDeclaration"), F.col("var")
    )
    return F.coalesce(own, F.col("fn"))


def sources(nodes: DataFrame) -> DataFrame:
    """Nodes that read untrusted input; of one (file, line, type) the outermost."""
    kind = classify(F.col("text"), T.SOURCES, "")
    w = Window.partitionBy("file", "line", "type").orderBy("ord")
    return (
        nodes.withColumn("type", kind).filter("type IS NOT NULL").withColumn("line", F.col("start_line"))
        .withColumn("k", F.row_number().over(w)).filter("k = 1")
        .select("file", "line", "type", F.coalesce("var", F.lit(LIT_INPUT)).alias("variable"), _first_context(nodes).alias("function_context"), access_path(F.col("text")).alias("access_path"), "ord")
    )


def sinks(nodes: DataFrame) -> DataFrame:
    t = F.col("text")
    pick = lambda rows: first_match([(test(t, p, f), F.struct(F.lit(k).alias("type"), F.lit(d).alias("description"))) for p, f, k, d in rows])
    none = F.array().cast("array<string>")
    cols = lambda ctx: ["file", F.col("start_line").alias("line"), F.col("s.type").alias("type"), F.col("fn").alias("function_context"), ctx.alias("context"), F.coalesce("idents", none).alias("tainted_inputs"), "ord"]
    calls = nodes.filter("kind = 'CallExpression'").withColumn("s", pick(T.SINKS)).filter("s IS NOT NULL")
    dom = nodes.filter("kind IN ('BinaryExpression', 'PropertyAccess')").withColumn("s", pick([r for r in T.SINKS if r[2] == "dom_sink"])).filter("s IS NOT NULL")
    return calls.select(*cols(F.concat(F.col("s.description"), F.lit(": "), F.substring(t, 1, 120)))).unionByName(dom.select(*cols(F.col("s.description"))))


def transforms(nodes: DataFrame) -> DataFrame:
    t = F.col("text")
    kind = first_match([(test(t, p, f), F.struct(F.lit(k).alias("type"), F.lit(d).alias("description"))) for p, f, k, d in T.TRANSFORMS])
    first = F.get("args", 0)
    return nodes.withColumn("s", kind).filter("s IS NOT NULL").select(
        "file", F.col("start_line").alias("line"), F.col("s.type").alias("type"), F.coalesce(F.when((F.col("kind") == "CallExpression") & first.rlike(r"^[\w$]+$"), first), F.lit(LIT_INPUT)).alias("input_variable"),
        F.col("var").alias("output_variable"), _first_context(nodes).alias("function_context"), F.col("s.description").alias("description"), "ord",
    )


def is_admin_context(path: Column, function: Column) -> Column:
    fn = F.coalesce(function, F.lit(""))
    return test_any(path, T.ADMIN_PATHS) | any_of(test(fn, p, f) for p, f in T.ADMIN_FUNCTIONS)


def is_connected(variable: Column, inputs: Column, path: Column, function: Column, kind: Column) -> Column:
    """A variable and an input contain one another, or the path's leaf is in an input, or an unnamed untrusted source."""
    low = F.transform(inputs, F.lower)
    names = F.split(F.lower(variable), ",")
    either = F.exists(names, lambda v: F.exists(low, lambda i: F.contains(i, v) | F.contains(v, i)))
    leaf = F.lower(F.element_at(F.split(path, r"\."), -1))
    by_leaf = (F.length(leaf) > 1) & F.exists(low, lambda i: F.contains(i, leaf))
    unnamed = F.array_contains(names, LIT_INPUT) & function.isNotNull() & (function != "") & kind.isin(T.UNTRUSTED)
    return F.coalesce(either, F.lit(False)) | F.coalesce(by_leaf, F.lit(False)) | F.coalesce(unnamed, F.lit(False))


def connect(src: DataFrame, snk: DataFrame, trf: DataFrame) -> DataFrame:
    """Flows of a file: equal function (both absent counts), connected names; transforms strictly between by line."""
    s = src.select("file", F.struct("line", "type", "variable", "function_context", "access_path", "ord").alias("source"))
    k = snk.select("file", F.struct("line", "type", "function_context", "context", "tainted_inputs", "ord").alias("sink"))
    pairs = k.join(s, (k.file == s.file) & k.sink["function_context"].eqNullSafe(s.source["function_context"])).select(k.file, "source", "sink").filter(
        is_connected(F.col("source.variable"), F.col("sink.tainted_inputs"), F.col("source.access_path"), F.col("source.function_context"), F.col("source.type"))
    )
    t = trf.select(F.col("file").alias("tf"), F.struct("ord", "line", "type", "input_variable", "output_variable", "description").alias("t"), F.col("function_context").alias("tc"))
    between = pairs.join(
        t, (F.col("file") == F.col("tf")) & F.col("tc").eqNullSafe(F.col("source.function_context")) & (F.col("t.line") > F.col("source.line")) & (F.col("t.line") < F.col("sink.line")), "left"
    )
    out = between.groupBy("file", "source", "sink").agg(
        F.array_sort(F.collect_list("t")).alias("transforms"),
        F.coalesce(F.bool_or(F.col("t.type") == "sanitize"), F.lit(False)).alias("is_sanitized"), F.coalesce(F.bool_or(F.col("t.type") == "validate"), F.lit(False)).alias("is_validated"),
    )
    steps = F.filter(F.transform("transforms", lambda t: t["output_variable"]), lambda v: v.isNotNull())
    return out.withColumn("is_admin_protected", is_admin_context(F.concat(F.lit("/"), F.col("file")), F.col("source.function_context"))).withColumn(
        "flow_path", F.concat(F.array(F.col("source.variable")), steps, F.slice(F.col("sink.tainted_inputs"), 1, 1))
    )


def sorted_flows(flows: DataFrame) -> DataFrame:
    return flows.orderBy(F.collate("file", "UNICODE"), "source.line", "source.ord", "sink.ord")
