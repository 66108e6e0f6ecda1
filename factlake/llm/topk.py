"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector of d components is cut into S equal segments. With the mean m and the deviation s of a
segment of length L, Cauchy-Schwarz gives for the part of the inner product in that segment
``q . c <= L * (mq * mc + sq * sc)``; since |q - c|^2 = |q|^2 + |c|^2 - 2 q . c, this is the lower
bound of the distance from segment means and deviations. Coarse bounds (few segments) come first,
finer ones follow for what is left, and exact products are computed for the survivors only.

Vectors are dealt into blocks in the order of the signs of their segment means, so that like vectors share a block, and a
block keeps the ranges of its means and its largest deviations. First each block of queries meets the
one block of vectors that may hold its best scores; the worst k-th score of its queries is its floor. Then it meets all blocks
whose ranges allow a score from its floor on, each pair in a task of its own, and the best k of all pairs are merged. The
pairs are a join of the blocks' ranges, some hundred bytes each. No row is dropped by a bound unless k better rows are known.

Defined results: a vector that is null, or has a null or non-finite component (as given or scaled),
takes no part; neither does a row without vec_id. Products are whole numbers: beyond 2**53 they are computed
as such and not in doubles, and a score beyond a long is its nearest end. Vectors of another length than the
query's are not its candidates; vectors without components are candidates of each other, with score 0.
Every row with the query's own vec_id is left out. Equal scores go to the smaller vec_id; repeated
rows of a candidate are ranked each; a repeated vec_id among the queries is asked once, by its
smallest vector. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, prepare, stage

LEVELS = (4, 16)
#: Rows in a block of vectors and of queries: at 64 components 2 MB and half a MB.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Segments whose signs give the order of the blocks.
SIGNS = 8
#: Most tasks for pairs of blocks.
TASKS = 20_000
#: Rounding margin of the bounds, relative to the lengths of the vectors.
MARGIN = 1e-9
#: Doubles hold all whole numbers up to here.
EXACT = float(1 << 53)


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row the weighted means and deviations of its segments: bound = stats(q) @ stats(c)."""
    d = x.shape[1]
    edges = np.unique(np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part, n = x[:, a:b], b - a
        mean = part.mean(1)
        out += [np.sqrt(n) * mean, np.sqrt(np.maximum((part**2).sum(1) - n * mean**2, 0))]
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def _best_of_whole_numbers(qid, q, cid, c, k: int):
    """``best_in_block`` for vectors whose products a double does not hold."""
    rows, whole, out = [[int(v) for v in x] for x in c.tolist()], np.iinfo(np.int64), []
    for i, x in enumerate(q.tolist()):
        x = [int(v) for v in x]
        score = [min(max(sum(a * b for a, b in zip(x, y, strict=True)), whole.min), whole.max) for y in rows]
        best = sorted((j for j in range(len(rows)) if cid[j] != qid[i]), key=lambda j: (-score[j], cid[j]))[:k]
        out.append((np.full(len(best), i), np.array(best, np.int64), np.array([score[j] for j in best], np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_in_block(qid, q, cid, c, k: int, floor: float = -np.inf):
    """(query position, candidate position, score) of every query's best k in a block, exactly; scores below floor may be left out."""
    if not len(q) or not len(c):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    if np.sqrt((q**2).sum(1).max()) * np.sqrt((c**2).sum(1).max()) >= EXACT or not (np.isfinite(q).all() and np.isfinite(c).all()):
        return _best_of_whole_numbers(qid, q, cid, c, k)
    slack = MARGIN * np.sqrt((q**2).sum(1))[:, None] * np.sqrt((c**2).sum(1).max()) + 1e-6
    bound = segment_stats(q, LEVELS[0]) @ segment_stats(c, LEVELS[0]).T + slack
    bound[qid[:, None] == cid[None, :]] = -np.inf
    fine_q, fine_c = segment_stats(q, LEVELS[-1]), segment_stats(c, LEVELS[-1])
    first = min(len(c), 4 * k)
    out = []
    for i in range(len(q)):
        b = bound[i]
        seeds = np.argpartition(-b, first - 1)[:first] if first < len(c) else np.arange(len(c))
        seeds = seeds[np.isfinite(b[seeds])]
        exact = c[seeds] @ q[i]
        least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
        least = max(least, floor)
        rest = np.flatnonzero(b >= least)
        rest = rest[np.isfinite(b[rest])]
        if len(rest) > first:
            rest = rest[fine_c[rest] @ fine_q[i] + slack[i] >= least]
        score = c[rest] @ q[i]
        if len(rest) > k:
            order = np.lexsort((cid[rest], -score))[:k]
            rest, score = rest[order], score[order]
        out.append((np.full(len(rest), i), rest, score.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vectors(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, "<f8").reshape(len(ids), dim)


PACKED = "dim int, ids binary, data binary, low array<double>, high array<double>, deviation array<double>"


def _pack(size: int):
    """Blocks of vectors of one length with the ranges of their coarse statistics."""

    def pack(it):
        held: dict[int, list] = {}

        def out(dim):
            ids, vecs = zip(*held.pop(dim), strict=True)
            x = np.array(vecs, "<f8").reshape(len(ids), dim)
            stats = segment_stats(x, LEVELS[0])
            mean, deviation = stats[:, ::2], stats[:, 1::2]
            return {"dim": dim, "ids": np.array(ids, "<i8").tobytes(), "data": x.tobytes(), "low": mean.min(0).tolist(), "high": mean.max(0).tolist(), "deviation": deviation.max(0).tolist()}

        names = ["dim", "ids", "data", "low", "high", "deviation"]
        for pdf in it:
            done = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    done.append(out(len(v)))
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([out(d) for d in list(held)], columns=names)

    return pack


def _signs(x):
    """The signs of the sums of SIGNS segments as a number."""
    n, code = F.size(x), F.lit(0)
    for i in range(SIGNS):
        a, b = F.floor(F.lit(i) * n / SIGNS).cast("int"), F.floor(F.lit(i + 1) * n / SIGNS).cast("int")
        total = F.aggregate(F.slice(x, a + 1, b - a), F.lit(0.0), lambda s, v: s + v)
        code = code + F.when(total > 0, 1 << i).otherwise(0)
    return code


def _block_bound(q: str, c: str):
    """No product of a vector of block q with one of block c is larger."""
    at = F.sequence(F.lit(0), F.size(f"{q}low") - 1)
    get = lambda name, i: F.get(F.col(name), i)
    corner = lambda i: F.greatest(*[get(f"{q}{a}", i) * get(f"{c}{b}", i) for a in ("low", "high") for b in ("low", "high")])
    total = F.aggregate(at, F.lit(0.0), lambda s, i: s + corner(i) + get(f"{q}deviation", i) * get(f"{c}deviation", i))
    return F.when(F.size(f"{q}low") == 0, F.lit(0.0)).otherwise(total)


def _floor(v):
    """floor as double; Spark's own goes by way of a long, which holds no value from 2**63 on."""
    return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (vec_id divisible by ``every``) over all rows."""
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull()
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) != float("inf")))
    rows = stage(
        fresh(vectors, "vec_id", "embedding")
        .filter(ok & finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"),
                F.transform(x, lambda v: _floor(v.cast("double") * scale)).alias("embedding")),
        "vectors",
    )
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def deal(df, size, name):
        n = max(1, -(-df.count() // size))
        order = [F.size("embedding"), _signs(F.col("embedding")), F.col("vec_id")]
        return stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_pack(size), PACKED).withColumn("no", F.monotonically_increasing_id()), name)

    qs, cs = deal(queries, QUERY_BLOCK, "query_blocks"), deal(rows, block, "vector_blocks")
    side = lambda df, p: df.select(*[F.col(x).alias(f"{p}{x}") for x in ("no", "low", "high", "deviation")], "dim")
    bound = _block_bound("q_", "c_")
    # Rounding of the sums of a bound, relative to its size.
    pairs = stage(side(qs, "q_").join(side(cs, "c_"), "dim").select("q_no", "c_no", (bound + 1e-6 + 1e-9 * F.abs(bound)).alias("bound")), "pairs")

    def met(todo, name):
        """query_id, vec_id, score, q_no: the best k of each pair (q_no, c_no, floor)."""
        tasks = max(1, min(todo.count(), TASKS))
        joined = (
            todo.join(qs.select(F.col("no").alias("q_no"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "q_no")
            .join(cs.select(F.col("no").alias("c_no"), "ids", "data"), "c_no")
        )
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        out = stage(joined.repartition(tasks, "q_no", "c_no").mapInPandas(meet, "query_id long, vec_id long, score long, q_no long"), name)
        prepare(spark)
        return out

    def meet(it):
        for pdf in it:
            for _, r in pdf.iterrows():
                qid, q = _vectors(r["q_ids"], r["q_data"], r["dim"])
                cid, c = _vectors(r["ids"], r["data"], r["dim"])
                floor = -np.inf if pd.isna(r["floor"]) else float(r["floor"])
                for a in range(0, len(q), 128):
                    i, j, s = best_in_block(qid[a : a + 128], q[a : a + 128], cid, c, k, floor)
                    yield pd.DataFrame({"query_id": qid[a : a + 128][i], "vec_id": cid[j], "score": s, "q_no": np.full(len(i), r["q_no"])})

    home = pairs.groupBy("q_no").agg(F.max_by("c_no", "bound").alias("c_no"))
    first = met(home.withColumn("floor", F.lit(None).cast("double")), "first")
    # The floor of a block holds for all its queries, or there is none.
    each = first.groupBy("q_no", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = each.groupBy("q_no").agg(F.min("least").cast("double").alias("floor"), F.count("least").alias("n_floors"))
    known = stage(qs.select(F.col("no").alias("q_no"), F.expr("octet_length(ids) DIV 8").alias("n")).join(known, "q_no", "left").select("q_no", F.when(F.col("n_floors") == F.col("n"), F.col("floor")).alias("floor")), "floors")
    rest = pairs.join(home.select("q_no", "c_no"), ["q_no", "c_no"], "left_anti").join(known, "q_no").filter("floor IS NULL OR bound >= floor")
    best = first.unionByName(met(stage(rest.select("q_no", "c_no", "floor"), "todo"), "best"))
    # The ranking filter lets Spark keep k rows of each query and task before the shuffle.
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(64 * x::DOUBLE))) = 0)
, s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
