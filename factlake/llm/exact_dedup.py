"""Exact dedup through a log-structured merge index (DataFrame operations only).

Writing: digests arrive in batches. Every task sorts what it holds and flushes it as files of at most
``MEMTABLE`` entries, each a sorted run; no rows are shuffled for that. A run carries a Bloom filter of
blocks of 256 bits, one block for each value of the digest's first bits. ``FANOUT`` runs of a level are merged
into one run of the next, and of every digest the smallest identity stays, with the number of its rows.

Reading: a row first meets the filters of the runs, a small table that is broadcast only while it has at
most ``FILTER_BYTES``. Only rows that a filter lets through are looked up in the runs. Beyond that size every row
is looked up, which gives the same result.

Hits are verified by their bytes: among the rows of a digest the smallest and the largest normalised text
must be equal. Copies meet inside each task first, so a large group of copies costs one text for each task. Where
the texts of a digest differ, they are told apart by their bytes.

Defined results: a null text counts as empty, so null, empty and all-blank texts form one group.
Repeated rows are members like any others; rows that share text, length and doc_id with the row that stays are
all kept. Columns beyond ``doc_id`` and ``text`` are ignored. An empty table gives an empty result. A null ``doc_id``
sorts before every other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, new_dir, stage

#: Entries of a memtable, and so of a flushed run.
MEMTABLE = 1 << 17
#: Batches in which a table is appended.
BATCHES = 4
#: Runs of a level that are merged into the next.
FANOUT = 3
#: Bits of a filter for each entry, words of 64 bits in a block, bits set by an entry (one in each word).
FILTER_BITS, WORDS = 12, 4
#: Most bytes of filters that are broadcast.
FILTER_BYTES = 64 << 20


def normalised(text) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _part(digest: str, at: int, n: int) -> Column:
    """n bytes of the digest as a number."""
    return F.conv(F.hex(F.substring(digest, at, n)), 16, 10).cast("long")


def _bits(digest: str) -> list[Column]:
    """For each word of a block the bit that the digest sets."""
    # F.shiftleft takes a number of bits that is the same for all rows.
    return [F.expr(f"shiftleft(1L, cast(conv(hex(substring({digest}, {9 + i}, 1)), 16, 10) AS int) & 63)") for i in range(WORDS)]


@dataclass
class Run:
    """A sorted file set of (digest, best, n) and its filter (block, w0 ..); entries: at most so many rows."""

    rows: DataFrame
    filter: DataFrame
    blocks: int
    entries: int


class DigestIndex:
    """Levels of runs of (digest, best identity, number of rows); append, probe, look up, compact."""

    def __init__(self, spark, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.spark, self.memtable, self.fanout = spark, memtable, fanout
        self.levels: list[list[Run]] = []

    def _flush(self, rows: DataFrame, entries: int | None = None) -> Run:
        path = new_dir(self.spark, "run")
        (
            rows.sortWithinPartitions("digest")
            .write.option("maxRecordsPerFile", self.memtable)
            .option("compression", "zstd")
            .parquet(path)
        )
        out = self.spark.read.schema(rows.schema).parquet(path)
        out.staged_at = path
        entries = out.count() if entries is None else entries
        blocks = 1 << max(0, (entries * FILTER_BITS // (64 * WORDS)).bit_length())
        words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits("digest"))]
        made = out.groupBy((_part("digest", 1, 6) % blocks).alias("block")).agg(*words)
        return Run(out, stage(made, "filter"), blocks, entries)

    def append(self, rows: DataFrame, entries: int | None = None) -> None:
        """Flush memtables of rows (digest, n_points, doc_id) as a sorted run of the first level; merge full levels.

        entries: number of the rows, if known.
        """
        identity = F.struct((-F.col("n_points")).alias("order"), "doc_id")
        run = self._flush(rows.select("digest", identity.alias("best"), F.lit(1).cast("long").alias("n")), entries)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _merge(self, runs: list[Run]) -> Run:
        both = runs[0].rows
        for r in runs[1:]:
            both = both.unionByName(r.rows)
        out = self._flush(both.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")), sum(r.entries for r in runs))
        discard(*[r.rows for r in runs], *[r.filter for r in runs])
        return out

    def compact(self) -> DataFrame:
        """Merge all runs into one; digest, keep_id, group_size of every digest."""
        runs = [r for level in self.levels for r in level]
        self.levels = [[self._merge(runs)]]
        return self.entries()

    def entries(self) -> DataFrame:
        """What the runs hold, each digest once for each run."""
        out = None
        for r in (r for level in self.levels for r in level):
            rows = r.rows.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def only(self, condition: str) -> DigestIndex:
        """An index of the entries (digest, best, n) that meet a condition, after compaction."""
        out = DigestIndex(self.spark, self.memtable, self.fanout)
        out.levels = [[out._flush(self.levels[0][0].rows.filter(condition))]]
        return out

    def probe(self, rows: DataFrame) -> DataFrame:
        """Adds ``maybe``: whether the filter of any run lets the row's digest through; false means absent."""
        runs = [r for level in self.levels for r in level]
        # A block of a filter takes its number and words, and no filter has more blocks than entries ask for.
        if sum(8 * (1 + WORDS) * min(r.blocks, r.entries) for r in runs) > FILTER_BYTES:
            return rows.withColumn("maybe", F.lit(True))
        out = rows.withColumn("maybe", F.lit(False))
        for r in runs:
            words = r.filter.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
            out = out.join(F.broadcast(words), (_part("digest", 1, 6) % r.blocks) == F.col("_block"), "left")
            set_in_all = F.lit(True)
            for i, b in enumerate(_bits("digest")):
                set_in_all = set_in_all & (F.col(f"_w{i}").bitwiseAND(b) != 0)
            out = out.withColumn("maybe", F.col("maybe") | F.coalesce(set_in_all, F.lit(False))).drop("_block", *[f"_w{i}" for i in range(WORDS)])
        return out


def exact_dedup(docs: DataFrame, memtable: int = MEMTABLE, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row."""
    docs = fresh(docs, "doc_id", "text")
    path = new_dir(docs.sparkSession, "digests")
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    measured = docs.select("doc_id", digest.alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))
    by_batch = measured.withColumn("batch", F.pmod(F.xxhash64("digest", "doc_id"), F.lit(batches)).cast("int"))
    by_batch.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    digests = docs.sparkSession.read.schema(by_batch.schema).parquet(path)
    index = DigestIndex(docs.sparkSession, memtable)
    sizes = {r["batch"]: r["count"] for r in digests.groupBy("batch").count().collect()}
    for b in sorted(sizes):
        index.append(digests.filter(F.col("batch") == b).drop("batch"), sizes[b])
    if not sizes:
        index.append(digests.drop("batch"), 0)
    index.compact()
    # Digests of one row are settled: only rows that the filter of the others lets through are looked up.
    repeated = index.only("n > 1")
    level = repeated.entries()
    alone = F.lit(1).cast("long")
    probed = repeated.probe(digests.drop("batch"))
    looked = probed.filter("maybe").join(level, "digest", "left")
    columns = ["doc_id", "keep_id", "group_size", "digest", "n_points"]
    out = (
        probed.filter("NOT maybe")
        .select("doc_id", F.col("doc_id").alias("keep_id"), alone.alias("group_size"), "digest", "n_points")
        .unionByName(
            looked.select(
                "doc_id",
                F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("group_size", alone).alias("group_size"),
                "digest",
                "n_points",
            )
        )
    )
    # Texts of the hits, straight from the documents: smallest and largest of each digest, inside each task first.
    texts = docs.select("doc_id", F.col("text"), normalised(F.col("text")).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    hits = repeated.probe(texts).filter("maybe")
    differ = stage(
        hits.groupBy("digest").agg(F.min("norm").alias("first"), F.max("norm").alias("last")).filter("first != last").select("digest"),
        "differ",
    )
    if not differ.isEmpty():  # several texts have one digest: its rows are told apart by their bytes
        w = Window.partitionBy("digest", "norm")
        apart = (
            texts.join(differ, "digest", "left_semi")
            .withColumn("n_points", F.char_length(F.coalesce("text", F.lit(""))))
            .withColumn("keep_id", F.min(F.struct(-F.col("n_points"), F.col("doc_id"))).over(w)["doc_id"])
            .withColumn("group_size", F.count("*").over(w))
        )
        out = out.join(differ, "digest", "left_anti").select(*columns).unionByName(apart.select(*columns))
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
