"""Finding every window of W symbols that occurs more than once, over texts of any number and length.

Each window picks an anchor inside itself by a rule that looks only at the window, so all its
occurrences pick the same one. Consecutive windows that share an anchor form a stretch; stretches
travel as packed records to the bucket of their anchor's key. There, stretches with equal content
form a class. Where an anchor has one class only, each of its windows occurs once per member; where
it has several, one member of each class is looked at again in its text. The ranges to remove
travel back to their documents.

Nothing is capped or sampled: an anchor that a third of all texts share costs one record for each
occurrence, and one look for each different surrounding.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, buckets_for, light, merged, mix64, powers, row_keys, stage, text_bytes
from .deal import Gatherer, Layout, runs

STRETCH = Layout(key="<u8", dig="<u8", doc="<i8", start="<i4", count="<u2", off="<u2")
MEMBER = Layout(key="<u8", dig="<u8", doc="<i8", start="<i4", first="u1")
REQUEST = Layout(key="<u8", dig="<u8", doc="<i8", start="<i4", count="<u2", off="<u2", many="u1")
RANGE = Layout(doc="<i8", start="<i4", end="<i4")
#: Symbols handled at once.
CHUNK = 1 << 19


class Sums:
    """Hashes of ranges of a sequence of 64-bit symbols (see common.RollingHash, symbols already scrambled)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(symbols * powers(n), out=self.sums[1:])
        self.inverse = powers(n + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * BASE)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of values[i : i + width], for every i that fits.

    Values are compared by their upper 40 bits.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    packed = (values & ~low) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    block = np.concatenate([packed, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def pieces(texts: list[tuple[int, np.ndarray]], window: int):
    """Flat sequences of about CHUNK symbols: (symbols, part starts, part ids, offset of each part in its text).

    A long text comes in parts that overlap by window - 1 symbols, so that each window is in one part.
    """
    held, size = [], 0

    def out():
        starts = np.cumsum([0, *[len(x[1]) for x in held]])
        return np.concatenate([x[1] for x in held]), starts, np.array([x[0] for x in held], np.int64), np.array([x[2] for x in held], np.int64)

    for doc, seq in texts:
        if len(seq) < window:
            continue
        for a in range(0, len(seq) - window + 1, CHUNK):
            part = seq[a : a + CHUNK + window - 1]
            if held and size + len(part) > CHUNK:
                yield out()
                held, size = [], 0
            held.append((doc, part, a))
            size += len(part)
    if held:
        yield out()


def stretches(flat, starts, docs, offsets, window: int, anchors: Callable) -> dict[str, np.ndarray]:
    """STRETCH records of a flat sequence. anchors(flat) -> (anchor of each window, key of each position, Sums)."""
    at, key_of, sums = anchors(flat)
    lengths = np.diff(starts)
    n_windows = np.maximum(lengths - window + 1, 0)
    part = np.repeat(np.arange(len(docs)), n_windows)
    s = np.arange(len(part)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + starts[part]
    a = at[s]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(s)) - 1
    first, last, anchor, part = s[lo], s[hi], a[lo], part[lo]
    off, count = anchor - first, last - first + 1
    dig = sums.of(first, last + window)
    with np.errstate(over="ignore"):
        dig = mix64(dig + off.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + count.astype(np.uint64))
    return {
        "key": key_of(anchor), "dig": dig, "doc": docs[part],
        "start": (first - starts[part] + offsets[part]).astype(np.int32), "count": count, "off": off,
    }


def deal_stretches(docs: DataFrame, symbols: Callable, window: int, anchors: Callable, buckets: int) -> DataFrame:
    def run(it):
        out = Gatherer(STRETCH)
        for batch in it:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for flat, starts, doc, offsets in pieces(
                ((i, symbols(t.as_py())) for i, t in zip(ids, texts, strict=True)), window
            ):
                got = stretches(flat, starts, doc, offsets, window, anchors)
                yield from out.add(got, (got["key"] % np.uint64(buckets)).astype(np.int64))
        yield out.flush()

    return docs.mapInArrow(light(run), STRETCH.ddl)


KINDS = "kind string, bucket int, key binary, dig binary, doc binary, start binary, end binary, count binary, off binary, flag binary"
_KINDS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *[(f, pa.binary()) for f in ("key", "dig", "doc", "start", "end", "count", "off", "flag")]])


def _kind(kind: str, layout: Layout, data: dict, bucket: np.ndarray) -> pa.Table:
    rows = layout.split(data, bucket)
    cols = {n: rows.column(n) for n in rows.schema.names}
    for a in ("first", "many"):
        if a in cols:
            cols["flag"] = cols.pop(a)
    none = pa.nulls(rows.num_rows, pa.binary())
    return pa.Table.from_arrays([pa.array([kind] * rows.num_rows, pa.string()), *[cols.get(f.name, none) for f in list(_KINDS)[1:]]], schema=_KINDS)


def _take(data: dict, index: np.ndarray) -> dict:
    return {f: v[index] for f, v in data.items()}


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def classify(dealt: DataFrame, window: int, buckets: int, keep_first: bool) -> DataFrame:
    """Per bucket of anchors: ranges that are settled, and requests and members of anchors with several classes."""

    def run(t: pa.Table) -> pa.Table:
        d = STRETCH.join(t)
        order = np.lexsort((d["start"], d["doc"], d["dig"], d["key"]))
        d = _take(d, order)
        a, b = runs(d["key"])
        many = np.repeat(b - a > 1, b - a)
        d = _take(d, np.flatnonzero(many))
        if not len(d["key"]):
            return pa.Table.from_batches([], schema=_KINDS)
        class_new = np.concatenate([[True], (d["key"][1:] != d["key"][:-1]) | (d["dig"][1:] != d["dig"][:-1])])
        c_at = np.flatnonzero(class_new)
        c_n = np.diff(np.append(c_at, len(class_new)))
        k_at, k_end = runs(d["key"][c_at])
        mixed_class = np.repeat(k_end - k_at > 1, k_end - k_at)
        mixed = np.repeat(mixed_class, c_n)
        # The first place of a class; a repeated row has the same place.
        rep = np.repeat(c_at, c_n)
        first = (d["doc"] == d["doc"][rep]) & (d["start"] == d["start"][rep])
        settled = ~mixed & ~(first if keep_first else np.zeros(len(mixed), bool))
        s = _take(d, np.flatnonzero(settled))
        ranges = {"doc": s["doc"], "start": s["start"], "end": s["start"] + s["count"].astype(np.int32) - 1 + window}
        m = _take(d | {"first": first.astype("u1")}, np.flatnonzero(mixed))
        r = _take(d, c_at[mixed_class]) | {"many": (c_n[mixed_class] > 1).astype("u1")}
        return pa.concat_tables([
            _kind("range", RANGE, ranges, doc_bucket(ranges["doc"], buckets)),
            _kind("member", MEMBER, m, (m["key"] % np.uint64(buckets)).astype(np.int64)),
            _kind("request", REQUEST, r, doc_bucket(r["doc"], buckets)),
        ])

    return dealt.groupBy("bucket").applyInArrow(light(run), KINDS)


def requests_by_doc(kinds: DataFrame) -> DataFrame:
    fields = ["key", "dig", "start", "count", "off", "many"]
    schema = pa.schema([("id", pa.int64()), *[(f, pa.binary()) for f in fields]])

    def run(t: pa.Table) -> pa.Table:
        d = REQUEST.join(t.rename_columns(["many" if n == "flag" else n for n in t.column_names]))
        d = _take(d, np.argsort(d["doc"], kind="stable"))
        a, b = runs(d["doc"])
        cols = [pa.array(d["doc"][a], pa.int64())]
        cols += [pa.array([d[f][x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()) for f in fields]
        return pa.Table.from_arrays(cols, schema=schema)

    picked = kinds.filter("kind = 'request'").select("bucket", "key", "dig", "doc", "start", "count", "off", "flag")
    return picked.groupBy("bucket").applyInArrow(light(run), "id long, " + ", ".join(f"{f} binary" for f in fields))


def decode_requests(row: dict) -> dict[str, np.ndarray]:
    return {f: np.frombuffer(row[f], REQUEST.fields[f]) for f in ("key", "dig", "start", "count", "off", "many")}


def ranges_by_doc(*kinds: DataFrame) -> DataFrame:
    """id, starts, ends: the union of the ranges of each document, packed."""
    schema = pa.schema([("id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        d = RANGE.join(t)
        d = _take(d, np.lexsort((d["start"], d["doc"])))
        a, b = runs(d["doc"])
        starts, ends = [], []
        for x, y in zip(a, b, strict=True):
            s, e = merged(d["start"][x:y], d["end"][x:y])
            starts.append(s.astype("<i4").tobytes())
            ends.append(e.astype("<i4").tobytes())
        return pa.Table.from_arrays([pa.array(d["doc"][a], pa.int64()), pa.array(starts, pa.binary()), pa.array(ends, pa.binary())], schema=schema)

    both = None
    for k in kinds:
        k = k.filter("kind = 'range'").select("bucket", "doc", "start", "end")
        both = k if both is None else both.unionByName(k)
    return both.groupBy("bucket").applyInArrow(light(run), "id long, starts binary, ends binary")


def repeated_ranges(docs: DataFrame, symbols: Callable, window: int, anchors: Callable, look: Callable, settle: Callable, layout: Layout, keep_first: bool) -> DataFrame:
    """docs with the packed ranges to remove (null: none): doc_id, text, starts, ends.

    look(text, requests) -> records of ``layout`` (has key); settle(records, members) -> RANGE records.
    """
    docs = row_keys(docs)
    buckets = buckets_for(text_bytes(docs))
    kinds = stage(classify(deal_stretches(docs, symbols, window, anchors, buckets), window, buckets, keep_first), "kinds")

    def fetch(it):
        out = Gatherer(layout, 200_000)
        for batch in it:
            for row in batch.to_pylist():
                got = look(row["text"], row["id"], decode_requests(row))
                yield from out.add(got, (got["key"] % np.uint64(buckets)).astype(np.int64))
        yield out.flush()

    wanted = stage(requests_by_doc(kinds), "requests")
    # Requests and ranges follow the documents in number, so they are never broadcast, however few there are now.
    looked = docs.join(wanted.hint("merge"), "id").select("id", "text", "key", "dig", "start", "count", "off", "many").mapInArrow(light(fetch), layout.ddl)
    extra = [f for f in layout.fields if f not in MEMBER.fields]
    members = kinds.filter("kind = 'member'").select("bucket", "key", "dig", "doc", "start", F.col("flag").alias("first"))
    for f in extra:
        members = members.withColumn(f, F.lit(None).cast("binary"))
    members = members.withColumn("what", F.lit("member"))
    for f in MEMBER.fields:
        if f not in layout.fields:
            looked = looked.withColumn(f, F.lit(None).cast("binary"))
    both = members.unionByName(looked.withColumn("what", F.lit("looked")))

    def run(t: pa.Table) -> pa.Table:
        is_member = np.array([w == "member" for w in t.column("what").to_pylist()], bool)
        m = MEMBER.join(t.filter(pa.array(is_member)))
        x = layout.join(t.filter(pa.array(~is_member)))
        r = settle(x, m)
        return _kind("range", RANGE, r, doc_bucket(r["doc"], buckets))

    settled = stage(both.groupBy("bucket").applyInArrow(light(run), KINDS), "settled")
    ranges = stage(ranges_by_doc(kinds, settled), "ranges")
    return docs.join(ranges.hint("merge"), "id", "left").select("doc_id", "text", "starts", "ends")
