"""Suffix-array dedup: maximal repeats from the common-prefix interval tree.

Texts are UTF-8 bytes. Windows of ``WINDOW`` bytes pick as anchor the K bytes with the smallest
hash, which brings all places that may share a window into one bucket (see repeats.py). There an
enhanced suffix array is built over the different contexts of each anchor: their suffixes in
lexicographic order with the common-prefix length of neighbours. A stack scan turns it into the
tree of common-prefix intervals; an interval whose occurrences have different bytes to their left
(or begin their context) is a maximal repeat, and is put out with all its occurrences. Every byte
of an occurrence of a repeat of at least WINDOW bytes is removed.

Defined results: a null text is empty; texts shorter than WINDOW keep everything; windows never
cross documents. Repeated rows are repeats of each other; rows with one doc_id and different texts, or
with a null doc_id, are documents of their own.
Other columns are ignored; an empty table gives an empty result. Equal windows are recognised by
64-bit hashes of stretches, and by their bytes where an anchor has several contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import covered, fresh, light, mix64, prepare
from .deal import MixedLayout, runs
from .repeats import Sums, repeated_ranges, sliding_first_min

WINDOW = 200
#: Bytes of an anchor.
K = 32

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def byte_anchors(window: int, k: int):
    def anchors(flat: np.ndarray):
        sums = Sums(_BYTES[flat])
        at = np.arange(len(flat) - k + 1)
        grams = sums.of(at, at + k)
        return sliding_first_min(mix64(grams), window - k + 1), lambda p: grams[p], sums

    return anchors


def sparse_suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int):
    """Order of the suffixes data[start:end] by their first ``depth`` bytes, and groups that share all of these.

    Returns (indices into starts in lexicographic order, group number along it). Suffixes that are
    shorter than depth or alone in their prefix are left out.
    """
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    # The eight bytes from every position on as one number: a step of the sort reads one word a suffix.
    words = np.zeros(len(data) + depth, np.uint64)
    for b in range(8):
        words |= padded[b : b + len(words)].astype(np.uint64) << np.uint64(56 - 8 * b)
    live = np.flatnonzero(ends - starts >= depth)
    group_live = np.zeros(len(live), np.int64)
    for step in range(0, depth, 8):
        word = words[starts[live] + step]
        if depth - step < 8:
            word = word >> np.uint64(64 - 8 * (depth - step))
        o = np.lexsort((word, group_live))
        live, word, g = live[o], word[o], group_live[o]
        if not len(live):
            break
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (g[1:] != g[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        keep = np.repeat(size > 1, size)
        # Suffixes that are alone stand in order already but share no repeat: they are left out.
        live, group_live = live[keep], np.repeat(np.arange(len(at)), size)[keep]
    return live, group_live


def common_prefix(sums: Sums, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most ``most``."""
    have = np.zeros(len(a), np.int64)
    step = 1 << int(max(1, most.max(initial=1))).bit_length()
    while step:
        ok = have + step <= most
        x = np.where(ok, have + step, have)
        same = ok & (sums.of(a + have, a + x) == sums.of(b + have, b + x))
        have[same] += step
        step >>= 1
    return have


def interval_tree(lcp: np.ndarray, left: np.ndarray, least: int):
    """Left-diverse common-prefix intervals (length, first, last) of one lexicographic run, by a stack scan.

    lcp[i] is the common prefix of entries i - 1 and i; left[i] the byte before entry i, or -1 when
    it stands at the start of its context, which differs from every other.
    """
    found = []
    stack: list[list] = []  # [length, first entry, diverse, left byte]
    n = len(left)
    for i in range(1, n + 1):
        length = int(lcp[i]) if i < n else 0
        leaf = [length, i - 1, left[i - 1] < 0, left[i - 1]]
        while stack and stack[-1][0] > length:
            top = stack.pop()
            top[2] |= leaf[2] or top[3] != leaf[3]
            if top[0] >= least and top[2]:
                found.append((top[0], top[1], i - 1))
            leaf = [length, top[1], top[2], top[3]]
        if stack and stack[-1][0] == length:
            stack[-1][2] |= leaf[2] or stack[-1][3] != leaf[3]
        elif length:
            stack.append(leaf)
    return found


def maximal_repeats(contexts: list[bytes], counts: np.ndarray, window: int):
    """Maximal repeats of at least ``window`` bytes among contexts: (length, [(context, offset), ...]).

    Only suffixes at the first counts[i] offsets of a context are sorted: every window starts there.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(lengths) - lengths
    which = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, ends = base[which] + offset, (base + lengths)[which]
    sa, group = sparse_suffix_array(data, starts, ends, window)
    a, b = runs(group)
    left_all = np.where(offset > 0, data[np.maximum(starts - 1, 0)].astype(np.int16), np.int16(-1))
    left = left_all[sa]
    # A group whose suffixes all follow the same byte is no maximal repeat: it continues one that starts earlier.
    diverse = np.zeros(len(a), bool)
    if len(a):
        diverse = (np.maximum.reduceat(left, a) != np.minimum.reduceat(left, a)) | (np.minimum.reduceat(left, a) < 0)
    if not diverse.any():
        return
    sums = Sums(_BYTES[data])
    for x, y in zip(a[diverse], b[diverse], strict=True):
        own = sa[x:y]
        tail = [contexts[w][o:] for w, o in zip(which[own], offset[own], strict=True)]
        own = own[sorted(range(len(tail)), key=tail.__getitem__)]
        s, e = starts[own], ends[own]
        lcp = np.zeros(len(own), np.int64)
        lcp[1:] = common_prefix(sums, s[:-1], s[1:], np.minimum(e[:-1] - s[:-1], e[1:] - s[1:]))
        for length, i, j in interval_tree(lcp, left_all[own], window):
            yield length, which[own[i : j + 1]], offset[own[i : j + 1]]


CONTEXTS = MixedLayout(key="<u8", dig="<u8", count="<u2", many="u1", text="O")


def contexts_of(window: int):
    def look(text, doc, r):
        data = text_bytes(text).tobytes()
        texts = np.empty(len(r["key"]), object)
        texts[:] = [data[s : s + c - 1 + window] for s, c in zip(r["start"].tolist(), r["count"].tolist(), strict=True)]
        return {"key": r["key"], "dig": r["dig"], "count": r["count"], "many": r["many"], "text": texts}

    return look


#: Bytes of contexts in one suffix array; the contexts of one anchor stay together.
ARRAY_BYTES = 4 << 20


def settle_contexts(window: int):
    def settle(x, m):
        order = np.lexsort((x["dig"], x["key"]))
        x = {f: v[order] for f, v in x.items()}
        # A repeated row shows the context of a class again.
        once = runs(np.rec.fromarrays([x["key"], x["dig"]]))[0] if len(order) else order
        order, x = once, {f: v[once] for f, v in x.items()}
        empty = {"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "end": np.zeros(0, np.int32)}
        if not len(order):
            return empty
        size = np.array([len(t) for t in x["text"]], np.int64)
        cls, lo, hi = [], [], []
        # A class with several members is itself a repeat with all its members as occurrences.
        many = np.flatnonzero(x["many"])
        cls.append(many)
        lo.append(np.zeros(len(many), np.int64))
        hi.append(size[many])
        a, b = runs(x["key"])
        at, held = 0, 0
        cuts = [0]
        for g in range(len(a)):
            held += int(size[a[g] : b[g]].sum())
            if held >= ARRAY_BYTES:
                cuts.append(int(b[g]))
                held = 0
        if cuts[-1] != len(order):
            cuts.append(len(order))
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            for length, which, offset in maximal_repeats(list(x["text"][at:to]), x["count"][at:to].astype(np.int64), window):
                cls.append(which + at)
                lo.append(offset)
                hi.append(offset + length)
        cls, lo, hi = np.concatenate(cls), np.concatenate(lo), np.concatenate(hi)
        # From classes to their members, by (key, dig).
        o = np.lexsort((m["dig"], m["key"]))
        m = {f: v[o] for f, v in m.items()}
        ma, mb = runs(np.rec.fromarrays([m["key"], m["dig"]])) if len(o) else (np.zeros(0, int), np.zeros(0, int))
        # Classes and member groups are both in (key, dig) order and correspond one to one.
        n = (mb - ma)[cls]
        rows = np.repeat(ma[cls], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = m["start"][rows].astype(np.int64)
        return {"doc": m["doc"][rows], "start": (start + np.repeat(lo, n)).astype(np.int32), "end": (start + np.repeat(hi, n)).astype(np.int32)}

    return settle


def suffix_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept: the remaining bytes), one row a document."""
    prepare(docs.sparkSession)
    ranged = repeated_ranges(
        fresh(docs, "doc_id", "text"), text_bytes, window, byte_anchors(window, k), contexts_of(window), settle_contexts(window), CONTEXTS, False
    )

    def cut(it):
        for batch in it:
            rows = []
            for row in batch.to_pylist():
                data = text_bytes(row["text"])
                n = len(data)
                s, e = (np.minimum(np.frombuffer(row[f] or b"", "<i4").astype(np.int64), n) for f in ("starts", "ends"))
                s, e = s[e > s], e[e > s]
                gone = covered(n, s, e)
                kept = data[~gone].tobytes()
                out = [row["doc_id"], n, int(gone.sum()), len(s), hashlib.sha256(kept).hexdigest()]
                rows.append(out + [[{"start": int(p), "end": int(q)} for p, q in zip(s, e, strict=True)], kept] * with_text)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return ranged.mapInArrow(light(cut), schema + ", spans array<struct<start: long, end: long>>, kept binary" * with_text)


#: Over the bytes as hex digits; windows of WINDOW bytes are told apart by a hash.
SQL = r"""
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)
, w AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS s FROM n WHERE n >= 200))
, r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1)
, i AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS first FROM r)
, g AS (SELECT doc_id, s, sum(first) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM i)
, p AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, g)
, q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p)
, k AS (
  SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM q JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""
