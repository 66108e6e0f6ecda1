"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

The rates r_i >= 0 of the documents minimise the relative entropy to their prior rates q_i under one
token constraint for each source s, with w_i the words of a document:

    minimise  sum_i (r_i log(r_i / q_i) - r_i + q_i)   with   sum_{i in s} w_i r_i = t_s,  r_i <= most

The convex dual has one multiplier for each source and the exponentially tilted solution
r_i = min(most, q_i exp(lambda_s w_i)): a source that has to grow repeats its long documents most, one
that has to shrink gives them up first. Newton steps on the logarithm of the words given, kept inside a bracket,
solve it; each needs the sums of w r and w^2 r over the documents. A document enters these by its size and
prior only, so the documents are first counted by (source, size, prior) and the sums run over these classes.

Rates become whole copies: a document is taken floor(r_i) times. The fractions of the classes of a source
are added up from long to short in units of 1 / UNIT; wherever the sum passes a half, one document of
that class is taken once more, which keeps the words within half of the longest document of the sum of the rates. Which documents of
a class these are is told by the order of a hash of their identifiers. All orders are global: ranges of rows, their sizes,
and positions inside each range; no task sees a whole source or class.

Defined results: a null text has size 0; documents of size 0 have rate min(most, q). A null source is a source, the last.
A source of size 0 has target 0; a source whose target is most times its size takes each document so often. Repeated rows are
separate documents. A null doc_id comes first in ties. A prior must be positive, null counts as 1. Columns other than doc_id, text and
source are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, discard, stage

#: Most words that a document, and so a source, may give, as a multiple of its size.
MOST = 3
#: Weights of the sources in code-point order, repeating.
CYCLE = 3
#: Fractions of copies are added up as whole numbers of 1 / UNIT.
UNIT = 1 << 20
#: Most Newton steps, those in one job, and the miss from which the next step is the last one.
NEWTON_STEPS, STEPS_IN_JOB = 120, 4
TOLERANCE = 1e-9
#: Decimals of a multiplier: reruns agree although sums of doubles depend on their order.
DECIMALS = 12


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with, for each of ``sums`` (long), its total over all rows that come before in a global order.

    Ranges of rows are numbered in order; the totals of the ranges, as many as there are shuffle
    partitions, come to the driver, and every range is summed up in a task of its own.
    """
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = stage(dealt.select("*", *[c.cast("long").alias(f"{n}_own") for n, c in sums.items()]), name)
    totals = {r["part"]: r for r in parts.groupBy("part").agg(*[F.sum(f"{n}_own").alias(n) for n in sums]).collect()}
    out, upto = parts, dict.fromkeys(sums, 0)
    known: dict[str, list] = {n: [] for n in sums}
    for p in sorted(totals):
        for n in sums:
            known[n] += [F.lit(p), F.lit(upto[n]).cast("long")]
            upto[n] += totals[p][n] or 0
    w = Window.partitionBy("part").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for n in sums:
        first = F.create_map(*known[n])[F.col("part")] if known[n] else F.lit(0).cast("long")
        out = out.withColumn(n, F.coalesce(F.sum(f"{n}_own").over(before), F.lit(0)) + first)
    return out.drop("part", *[f"{n}_own" for n in sums])


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Adds weight 1, 2, .., CYCLE by position in code-point order, null last."""
    placed = running(sources.withColumn("absent", F.col("source").isNull()), ["absent", "source"], {"at": F.lit(1)}, "source_parts")
    return placed.withColumn("weight", (F.col("at") % CYCLE + 1).cast("long")).drop("absent", "at")


def capped_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds target: all words shared by weight, none above most * source_size, the excess reshared.

    Words are poured in at a level that is common to all; a source is full at most * source_size / weight. In
    the order of these levels, the first one above what its predecessors leave for the rest is still open.
    """
    cap = F.col("source_size") * most
    all_of = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, weights = all_of["total"] or 0, all_of["weights"] or 0
    full_at = cap.cast("double") / F.col("weight").cast("double")
    levels = sources.groupBy(full_at.alias("full_at")).agg(F.sum(cap).alias("cap"), F.sum("weight").alias("weight"))
    placed = running(levels, ["full_at"], {"poured": F.col("cap"), "closed": F.col("weight")}, "levels")
    level = (F.lit(total).cast("long") - F.col("poured")).cast("double") / (F.lit(weights).cast("long") - F.col("closed")).cast("double")
    found = placed.withColumn("level", level).filter("full_at > level").agg(F.min_by("level", "full_at").alias("level")).first()["level"]
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(found or 0)) * F.col("weight").cast("double")))


def tilted(lam: Column, size: Column, prior: Column, most: float) -> Column:
    """The rate of a document; a multiplier of infinity takes everything ``most`` times."""
    rate = F.least(F.lit(float(most)), prior * F.exp(lam * size.cast("double")))
    return F.when(size == 0, F.least(F.lit(float(most)), prior)).otherwise(rate)


def solve_dual(classes: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """source_key, lam of each source. classes: source_key, size, prior, n; sources: source_key, target.

    A step is one distributed sum over the classes; only the number of open sources comes to the driver.
    """
    live = classes.filter("size > 0").withColumn("words", F.col("n").cast("double") * F.col("size"))
    at_one = live.groupBy("source_key").agg(
        F.sum(F.col("words") * F.col("prior")).alias("given"),
        F.sum(F.col("words") * F.col("size") * F.col("prior")).alias("slope"),
        F.sum("words").alias("words"),
        F.min("size").alias("least"),
        F.min("prior").alias("rarest"),
    )
    t, share = F.col("target"), F.log(F.col("target") / F.col("given"))
    begun = sources.select("source_key", "target").join(at_one, "source_key").withColumn(
        "fixed", F.when(t <= 0, float("-inf")).when(t >= most * F.col("words"), float("inf"))
    )
    state = begun.select(
        "source_key",
        "target",
        F.coalesce("fixed", share * F.col("given") / F.col("slope")).alias("lam"),
        F.least(F.lit(0.0), share / F.col("least")).alias("lo"),
        F.greatest(F.lit(0.0), F.log(F.lit(float(most)) / F.col("rarest")) / F.col("least")).alias("hi"),
        F.col("fixed").isNotNull().alias("done"),
    )
    state = stage(state.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(F.greatest("lo", F.least("hi", "lam")))), "dual")
    carried = ["target", "lam", "lo", "hi", "done"]
    for _ in range(0, NEWTON_STEPS, STEPS_IN_JOB):
        now = state
        for _ in range(STEPS_IN_JOB):
            free = F.col("prior") * F.exp(F.col("lam") * F.col("size"))
            sums = (
                live.join(now, "source_key")
                .groupBy("source_key")
                .agg(
                    *[F.first(c).alias(c) for c in carried],
                    F.sum(F.col("words") * F.least(F.lit(float(most)), free)).alias("given"),
                    F.sum(F.when(free < most, F.col("words") * F.col("size") * free).otherwise(0.0)).alias("slope"),
                )
                .withColumn("lo", F.when(F.col("given") <= F.col("target"), F.col("lam")).otherwise(F.col("lo")))
                .withColumn("hi", F.when(F.col("given") >= F.col("target"), F.col("lam")).otherwise(F.col("hi")))
            )
            newton = F.col("lam") - F.when(F.col("slope") > 0, F.col("given") / F.col("slope") * F.log(F.col("given") / F.col("target")))
            inside = (newton >= F.col("lo")) & (newton <= F.col("hi"))
            step = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
            near = F.abs(F.col("given") / F.col("target") - 1) <= TOLERANCE
            now = sums.select(
                "source_key",
                "target",
                F.when(F.col("done"), F.col("lam")).otherwise(step).alias("lam"),
                "lo",
                "hi",
                (F.col("done") | near | (F.col("lo") >= F.col("hi"))).alias("done"),
            )
        state = stage(now, "dual", after=(state,))
        if state.filter("NOT done").isEmpty():
            break
    exact = F.when(F.abs("lam") < float("inf"), F.round("lam", DECIMALS)).otherwise(F.col("lam"))
    known = state.select("source_key", exact.alias("lam"))
    # A source without words has no class to sum over.
    return sources.select("source_key").join(known, "source_key", "left").withColumn("lam", F.coalesce("lam", F.lit(float("-inf"))))


def _source_key() -> Column:
    """A null-safe join key: '-' for null, else '=' and the source."""
    return F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source")))


CLASS = ["source_key", "size", "prior"]


def mix_sources(docs: DataFrame, prior: str | None = None, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate, source for each row of docs.

    prior: column of prior rates > 0 (1 where null or not given).
    """
    q = F.coalesce(F.col(f"`{prior}`").cast("double"), F.lit(1.0)) if prior else F.lit(1.0)
    rows = stage(
        docs.select(
            "doc_id",
            "source",
            _source_key().alias("source_key"),
            n_words("text").alias("size"),
            q.alias("prior"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    classes = stage(rows.groupBy(*CLASS, "source").agg(F.count("*").alias("n")), "classes")
    totals = classes.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = stage(capped_targets(stage(cycled_weights(totals), "weights"), most), "targets")
    state = sources.join(solve_dual(classes, sources, most), "source_key").select("source_key", "source_size", "target", "lam")

    rate = tilted(F.col("lam"), F.col("size"), F.col("prior"), most)
    rated = (
        classes.join(state, "source_key")
        .withColumn("rate", rate)
        # A rate within rounding of a whole number is that number.
        .withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate")))
        .withColumn("floor", F.floor("rate"))
        .withColumn("units", F.round(F.col("n") * (F.col("rate") - F.col("floor")) * UNIT).cast("long"))
    )
    long_first = ["source_key", F.col("size").desc(), "prior"]
    placed = stage(running(rated, long_first, {"units_before": F.col("units"), "start": F.col("n")}, "rated"), "placed")
    # Sums inside a source: those of all classes less those before its first class.
    begins = placed.groupBy("source_key").agg(F.min("units_before").alias("begin"))
    half = F.lit(UNIT // 2)
    upto = F.col("units_before") - F.col("begin") + half
    cuts = stage(
        placed.join(begins, "source_key")
        .withColumn("extra", F.floor((upto + F.col("units")) / UNIT) - F.floor(upto / UNIT))
        .select(*CLASS, "source_size", "target", "rate", "floor", "extra", "start"),
        "cuts",
    )
    discard(placed)
    order = [*long_first, "order", "doc_id", "row"]
    ranked = running(rows, order, {"at": F.lit(1)}, "ranked")
    # Classes are skewed by nature: both sides of this join are files, so hot ones are split at run time.
    out = ranked.join(cuts, CLASS).withColumn(
        "copies", (F.col("floor") + (F.col("at") - F.col("start") < F.col("extra")).cast("int")).cast("long")
    )
    return out.select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "rate",
        "source",
    )


#: The multipliers by bisection over all documents; documents are told apart by doc_id.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents)
, s AS (SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)
, w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {CYCLE} + 1 AS weight FROM s)
, c AS (SELECT *, {MOST} * source_size / weight::DOUBLE AS full_at FROM w)
, o AS (
  SELECT *, (SELECT sum(source_size) FROM s)
      - coalesce(sum({MOST} * source_size) OVER (ORDER BY full_at, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY full_at, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM c)
, lv AS (SELECT first(rest::BIGINT / open::DOUBLE ORDER BY full_at, source_key) AS level FROM o WHERE full_at > rest::BIGINT / open::DOUBLE)
, t AS (SELECT source_key, source_size, least(({MOST} * source_size)::DOUBLE, coalesce((SELECT level FROM lv), 0) * weight) AS target FROM c)
, h AS (SELECT source_key, size, count(*) AS n FROM d GROUP BY 1, 2)
, b AS (
  SELECT 0 AS step, t.source_key, any_value(target) AS target,
    least(0.0::DOUBLE, ln(any_value(target) / sum(n * size)) / min(size)) AS lo, ln({MOST}.0::DOUBLE) / min(size) AS hi
  FROM t JOIN h ON t.source_key = h.source_key WHERE size > 0 AND target > 0 AND target < {MOST} * source_size GROUP BY t.source_key
  UNION ALL
  SELECT step, source_key, target, CASE WHEN given < target THEN mid ELSE lo END, CASE WHEN given < target THEN hi ELSE mid END
  FROM (
    SELECT any_value(step) + 1 AS step, b.source_key, any_value(target) AS target, any_value(lo) AS lo, any_value(hi) AS hi,
      any_value((lo + hi) / 2) AS mid, sum(n * size * least({MOST}.0::DOUBLE, exp((lo + hi) / 2 * size))) AS given
    FROM b JOIN h ON b.source_key = h.source_key WHERE size > 0 AND step < 80 GROUP BY b.source_key))
, m AS (SELECT source_key, round((lo + hi) / 2, {DECIMALS}) AS lam FROM b WHERE step = 80)
, r AS (
  SELECT h.source_key, h.size, h.n, t.source_size, t.target,
    CASE WHEN h.size = 0 THEN 1.0::DOUBLE WHEN t.target <= 0 THEN 0.0::DOUBLE WHEN m.lam IS NULL THEN {MOST}.0::DOUBLE ELSE least({MOST}.0::DOUBLE, exp(m.lam * h.size)) END AS rate0
  FROM h JOIN t ON h.source_key = t.source_key LEFT JOIN m ON m.source_key = h.source_key)
, r1 AS (SELECT *, CASE WHEN abs(rate0 - round(rate0)) < 1e-9 THEN round(rate0) ELSE rate0 END AS rate FROM r)
, r2 AS (SELECT *, floor(rate)::BIGINT AS base, round(n * (rate - floor(rate)) * {UNIT})::BIGINT AS units FROM r1)
, r3 AS (SELECT *, sum(units) OVER (PARTITION BY source_key ORDER BY size DESC) + {UNIT // 2} AS upto FROM r2)
, k AS (SELECT *, (upto::BIGINT // {UNIT}) - ((upto - units)::BIGINT // {UNIT}) AS extra FROM r3)
, p AS (SELECT *, row_number() OVER (PARTITION BY source_key, size ORDER BY md5(doc_id::VARCHAR), doc_id) AS at FROM d)
SELECT p.doc_id, p.size, k.source_size, k.target,
  ((k.base + CASE WHEN p.at <= k.extra THEN 1 ELSE 0 END) * p.size)::BIGINT AS taken, (k.base + CASE WHEN p.at <= k.extra THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p JOIN k ON p.source_key = k.source_key AND p.size = k.size
"""
