"""Substring dedup by recompression: Spark rounds name words, runs and pairs for all documents alike.

Texts are dealt into chunks of about ``CHUNK`` words. In a round every chunk asks for the names of its
distinct words, runs or pairs; the questions of all chunks meet in buckets, where each different one that occurs
more than once anywhere gets a number (``answer_words``, ``answer_keys``); the answers travel back, and the chunk
replaces what was named. Rounds: words; then, for each of ``ACTIVE``, block compression (a run of one
symbol becomes a symbol) and pair compression (neighbours whose names have coins tails and heads become a symbol).
Only symbols of at most ACTIVE words take part in a round, so what becomes of a symbol depends on that many words
around it: of a window of equal words, the symbols between its zone's ends (``ZONES`` words from
either edge after each round) are the same wherever it occurs. What occurs once has the name 0; a window
with such a symbol inside its zone occurs once, and words that only such windows hold are dropped after the words
and after each pair compression.

What is left is anchored: a window takes the longest symbol in its zone, of these the one with the smallest hash. One more
round asks which anchors are shared, together with the words around them that every window of the anchor holds. Windows
in a row with one shared anchor then travel with their words to the anchor's bucket; there windows are equal
if their names agree word by word, and the earliest place of each is told. A chunk asks once for what it
holds many times, so an anchor or passage that a third of all texts share costs one record for each chunk;
anchors with more than ``HOT`` places deal their windows by the hash of all their words.

Defined results: a null text has no words; texts of fewer words than the window keep all; windows never
cross documents; earlier means smaller doc_id (null first), or the same document and an earlier
start. Repeated rows are one place and keep or lose the same words; rows with one doc_id and different
texts, or with a null doc_id, are documents of their own, in a fixed order. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, covered, fresh, light, merged, mix64, prepare, row_keys, stage, text_bytes
from .deal import runs
from .repeats import Sums, sliding_first_min

WINDOW = 20
#: Words of a chunk; longer texts go on in the next one.
CHUNK = 1 << 20
#: Longest symbols, in words, that take part in the block and pair compression of each level.
ACTIVE = (1, 2)
#: Places of an anchor from which its windows are dealt one by one.
HOT = 1 << 16
#: Seconds between rounds in which Spark's cleaner drops the shuffle files of the last one.
REST = 0.7
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20

_COIN, _LEFT, _RIGHT = (np.uint64(x) for x in (0x589965CC75374CC3, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Rows between rounds: the state of a chunk, its words, or what it asks one bucket.
FIELDS = ("docs", "offsets", "ends", "starts", "names", "dead", "other", "many")
ROWS = "kind string, chunk long, bucket int, " + ", ".join(f"{f} binary" for f in FIELDS)
SCHEMA = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), *[(f, pa.binary()) for f in FIELDS]])
REPLY = "chunk long, bucket int, names binary"
REPLY_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("names", pa.binary())])


def zones(active=ACTIVE) -> list[int]:
    """Words at either edge of a window inside which symbols may differ: after the words, then after each compression."""
    out = [0]
    for a in active:
        out += [out[-1] + a, out[-1] + 2 * a]
    return out


# --- packed numbers -------------------------------------------------------------------------


_CODEC = "zstd"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers >= 0 in as few bytes each as the largest needs, lowest bytes of all first, compressed: Spark's own shuffle codec leaves such bytes as they are."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, _CODEC, asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    width, size = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.decompress(b[9:], size, _CODEC, asbytes=True), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_rising(x: np.ndarray) -> bytes:
    """Numbers that never fall, as their differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{f: r.get(f) for f in SCHEMA.names} for r in rows], schema=SCHEMA)


class Chunk:
    """Parts of texts in a row. names: the symbols; starts: their first words; words counted through all parts."""

    def __init__(self, number: int, docs, offsets, ends, starts, names, dead):
        #: docs, offsets, ends: document, first word in it, and end in the chunk of each part.
        self.number, self.docs, self.offsets, self.ends = number, docs, offsets, ends
        self.starts, self.names, self.dead = starts, names, dead

    @property
    def size(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    @property
    def stops(self) -> np.ndarray:
        return np.append(self.starts[1:], self.size)

    def living(self, window: int) -> np.ndarray:
        """Starts of the windows that may occur again."""
        start = np.arange(max(self.size - window + 1, 0))
        end = np.repeat(self.ends, np.diff(np.append(0, self.ends)))
        return start[~self.dead[: len(start)] & (start + window <= end[: len(start)])]

    def compact(self, words: np.ndarray, window: int) -> tuple[Chunk, np.ndarray]:
        """Only the symbols that living windows touch; each stretch of them is a part."""
        s = self.living(window)
        held = covered(self.size, s, s + window)
        symbols = np.logical_or.reduceat(held, self.starts) if len(self.starts) else np.zeros(0, bool)
        keep = np.repeat(symbols, self.stops - self.starts)
        first = keep.copy()
        first[1:] &= ~keep[:-1]
        border = np.append(0, self.ends[:-1])
        border = border[border < self.size]
        first[border] = keep[border]
        a = np.flatnonzero(first)
        place = np.cumsum(keep) - 1
        part = np.searchsorted(self.ends, a, "right")
        offsets = self.offsets[part] + a - np.append(0, self.ends[:-1])[part]
        ends = np.append(place[a], int(keep.sum()))[1:] if len(a) else np.zeros(0, np.int64)
        return Chunk(self.number, self.docs[part], offsets, ends, place[self.starts[symbols]], self.names[symbols], self.dead[keep]), words[keep]

    def row(self, whole: bool = False) -> dict:
        """As a row; a symbol of one word has that word's name, so only names of longer ones are put down unless ``whole``."""
        names = self.names if whole else self.names[self.stops - self.starts > 1]
        mark = np.zeros(self.size, bool)
        mark[self.starts] = True
        return {
            "kind": "state", "chunk": self.number, "docs": self.docs.astype("<i8").tobytes(), "offsets": pack(self.offsets), "ends": pack(self.ends),
            "starts": np.packbits(mark).tobytes(), "names": pack(names), "dead": np.packbits(self.dead).tobytes(),
        }

    @staticmethod
    def of(row: dict, words: np.ndarray | None = None) -> Chunk:
        ends = unpack(row["ends"]).astype(np.int64)
        n = int(ends[-1]) if len(ends) else 0
        starts = np.flatnonzero(np.unpackbits(np.frombuffer(row["starts"], np.uint8), count=n))
        dead = np.unpackbits(np.frombuffer(row["dead"], np.uint8), count=n).astype(bool)
        names = unpack(row["names"])
        if words is not None:
            longer = np.append(starts[1:], n) - starts > 1
            given, names = names, words[starts]
            names[longer] = given
        return Chunk(row["chunk"], np.frombuffer(row["docs"], "<i8"), unpack(row["offsets"]).astype(np.int64), ends, starts, names, dead)

    def same_part(self) -> np.ndarray:
        """Whether a symbol and its successor are in one part (the last one is not)."""
        out = np.ones(len(self.starts), bool)
        last = np.searchsorted(self.starts, self.ends) - 1
        out[last[last >= 0]] = False
        return out

    def bury(self, window: int, zone: int) -> None:
        """Windows that hold, inside their zone, a symbol that occurs nowhere else occur nowhere else."""
        once = self.names == 0
        first = np.maximum(self.stops[once] - window + zone, 0)
        last = np.minimum(self.starts[once] - zone, self.size - 1)
        ok = first <= last
        self.dead |= covered(self.size, first[ok], last[ok] + 1)


# --- chunks of words ------------------------------------------------------------------------


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, those of about PIECE bytes at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        to = at + PIECE
        if to < len(data):
            gap = _GAP.search(data, to)
            to = gap.start() if gap else len(data)
        yield data[at:to].split()
        at = to


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def deal_words(docs: DataFrame, window: int, buckets: int, chunk: int) -> DataFrame:
    """State rows whose names are places in the chunk's own vocabulary, and questions about its words."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        made = _Maker(number, window, buckets)
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, recent, fresh_part = 0, [], True
                for words in word_lists(text):
                    if not at and len(words) < window and len(text) < PIECE // 4:
                        break  # no window in the whole text
                    if fresh_part:
                        made.begin(doc, at - len(recent), recent)
                        fresh_part = False
                    made.add(words)
                    at += len(words)
                    recent = (words if len(words) >= window else recent + words)[1 - window :] if window > 1 else []
                    if made.size >= chunk:
                        yield from made.out().to_batches()
                        number += 1
                        made, fresh_part = _Maker(number, window, buckets), True
        if made.size:
            yield from made.out().to_batches()

    return docs.mapInArrow(light(run), ROWS)


class _Maker:
    def __init__(self, number: int, window: int, buckets: int):
        self.number, self.window, self.buckets, self.size = number, window, buckets, 0
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.arrays: list[np.ndarray] = []
        self.parts: list[tuple[int, int]] = []
        self.ends: list[int] = []

    def begin(self, doc: int, offset: int, words: list[bytes]) -> None:
        self.parts.append((doc, offset))
        self.ends.append(self.size)
        self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.arrays.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)
        self.ends[-1] = self.size

    def out(self) -> pa.Table:
        ids = np.concatenate(self.arrays)
        words = list(self.vocabulary)
        bucket = np.fromiter((zlib.crc32(w) % self.buckets for w in words), np.int64, len(words))
        many = np.bincount(ids, minlength=len(words)) > 1
        docs, offsets = (np.array(x, np.int64) for x in zip(*self.parts, strict=True))
        state = Chunk(self.number, docs, offsets, np.array(self.ends, np.int64), np.arange(len(ids)), ids, np.zeros(len(ids), bool)).row(True)
        rows = [state | {"other": pack(bucket)}]
        order = np.argsort(bucket, kind="stable")
        for a, b in zip(*runs(bucket[order]), strict=True):
            of = order[a:b]
            rows.append({"kind": "ask", "chunk": self.number, "bucket": int(bucket[of[0]]), "names": b" ".join([words[i] for i in of.tolist()]), "many": np.packbits(many[of]).tobytes()})
        return _table(rows)


def answer_words(buckets: int, round_no: int, rounds: int) -> Callable:
    def answer(t: pa.Table) -> pa.Table:
        found: dict[bytes, int] = {}
        shared: list[bool] = []
        asked = []
        for names, many in zip(t.column("names").to_pylist(), t.column("many").to_pylist(), strict=True):
            words = names.split(b" ")
            often = np.unpackbits(np.frombuffer(many, np.uint8), count=len(words)).tolist()
            own = []
            for w, m in zip(words, often, strict=True):
                k = found.get(w)
                if k is None:
                    k = found[w] = len(shared)
                    shared.append(bool(m))
                else:
                    shared[k] = True
                own.append(k)
            asked.append(np.array(own, np.int64))
        bucket = t.column("bucket")[0].as_py()
        name = _numbered(np.array(shared, bool), bucket, buckets, round_no, rounds)
        return _replies(t, bucket, [name[a] for a in asked])

    return answer


def _numbered(shared: np.ndarray, bucket: int, buckets: int, round_no: int, rounds: int) -> np.ndarray:
    """Names that no other bucket or round gives; 0 for what occurs once."""
    rank = np.cumsum(shared).astype(np.uint64)  # from 1
    return np.where(shared, (rank * np.uint64(buckets) + np.uint64(bucket)) * np.uint64(rounds) + np.uint64(round_no), np.uint64(0))


def _replies(t: pa.Table, bucket: int, names: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays(
        [t.column("chunk").combine_chunks(), pa.array([bucket] * t.num_rows, pa.int32()), pa.array([pack(n) for n in names], pa.binary())], schema=REPLY_SCHEMA
    )


# --- runs and pairs -------------------------------------------------------------------------


def find_blocks(c: Chunk, active: int) -> tuple[np.ndarray, np.ndarray]:
    """Block compression: (first symbol, number of symbols) of each run of two or more."""
    live = (c.stops - c.starts <= active) & (c.names != 0)
    same = c.same_part() & live
    same[:-1] &= c.names[:-1] == c.names[1:]
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, b - a + 1


def find_pairs(c: Chunk, active: int, round_no: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair compression: (first symbol, 2) of each pair; a symbol is in one pair at most, as its coin is one or the other."""
    live = (c.stops - c.starts <= active) & (c.names != 0)
    with np.errstate(over="ignore"):
        heads = (mix64(c.names ^ (_COIN * np.uint64(2 * round_no + 1))) & np.uint64(1)).astype(bool)
    first = c.same_part() & live & ~heads
    first[:-1] &= live[1:] & heads[1:]
    a = np.flatnonzero(first)
    return a, np.full(len(a), 2, np.int64)


def _keys(c: Chunk, a: np.ndarray, n: np.ndarray, blocks: bool):
    """Distinct runs (symbol, length) or pairs (symbol, symbol): their two halves, the place of each found one, and which occur twice here."""
    left = c.names[a]
    right = n.astype(np.uint64) if blocks else (c.names[a + 1] if len(a) else left)
    lv, li = np.unique(left, return_inverse=True)
    rv, ri = np.unique(right, return_inverse=True)
    both, place, times = np.unique(li.astype(np.uint64) * np.uint64(max(len(rv), 1)) + ri.astype(np.uint64), return_inverse=True, return_counts=True)
    return lv[(both // np.uint64(max(len(rv), 1))).astype(np.int64)], rv[(both % np.uint64(max(len(rv), 1))).astype(np.int64)], place, times


def _dealt(left: np.ndarray, right: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket, and the bucket of each key."""
    with np.errstate(over="ignore"):
        bucket = (mix64(left * _LEFT + mix64(right ^ _RIGHT)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), bucket


def _asks(c: Chunk, left, right, times, buckets: int) -> list[dict]:
    order, bucket = _dealt(left, right, buckets)
    return [
        {"kind": "ask", "chunk": c.number, "bucket": int(bucket[order[a]]), "names": pack_rising(left[order[a:b]]), "other": pack(right[order[a:b]]), "many": pack(times[order[a:b]])}
        for a, b in zip(*runs(bucket[order]), strict=True)
    ]


def answer_keys(buckets: int, round_no: int, rounds: int, hot: int | None = None) -> Callable:
    """Names of keys that occur more than once; with ``hot`` only 1, or 2 for those with more places than that."""

    def answer(t: pa.Table) -> pa.Table:
        left = [unpack_rising(b) for b in t.column("names").to_pylist()]
        right = [unpack(b) for b in t.column("other").to_pylist()]
        sizes = np.cumsum([len(x) for x in left])[:-1]
        x, y = np.concatenate(left), np.concatenate(right)
        times = np.concatenate([unpack(b) for b in t.column("many").to_pylist()]).astype(np.int64)
        o = np.lexsort((y, x))
        new = np.append(True, (x[o][1:] != x[o][:-1]) | (y[o][1:] != y[o][:-1]))
        at = np.flatnonzero(new)
        places = np.add.reduceat(times[o], at)
        bucket = t.column("bucket")[0].as_py()
        if hot is None:
            name = _numbered(places > 1, bucket, buckets, round_no, rounds)
        else:
            name = (places > 1).astype(np.uint64) + (places > hot).astype(np.uint64)
        out = np.empty(len(x), np.uint64)
        out[o] = name[np.cumsum(new) - 1]
        return _replies(t, bucket, np.split(out, sizes))

    return answer


def _received(replies: pa.Table, order: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """What the buckets answered, back in the order of the keys."""
    out = np.zeros(len(order), np.uint64)
    by = {b: n for b, n in zip(replies.column("bucket").to_pylist(), replies.column("names").to_pylist(), strict=True)}
    for a, b in zip(*runs(bucket[order]), strict=True):
        out[order[a:b]] = unpack(by[int(bucket[order[a]])])
    return out


def _compressed(c: Chunk, a: np.ndarray, n: np.ndarray, names: np.ndarray) -> None:
    """Replace n[i] symbols from a[i] on by the symbol names[i]."""
    gone = covered(len(c.names), a + 1, a + n)
    c.names[a] = names
    c.names, c.starts = c.names[~gone], c.starts[~gone]


def _found(c: Chunk, step: int, active: tuple[int, ...]):
    """What round ``step`` (1: blocks of the first level, 2: its pairs, ...) names in a chunk."""
    blocks = step % 2 == 1
    a, n = find_blocks(c, active[(step - 1) // 2]) if blocks else find_pairs(c, active[(step - 1) // 2], step)
    return a, n, _keys(c, a, n, blocks)


# --- anchors --------------------------------------------------------------------------------


def anchors(c: Chunk, words: np.ndarray, window: int, zone: int):
    """For each living window in order: (start, first and end word of its anchor, key). Without a symbol in the zone the zone itself is the anchor."""
    n, s = c.size, c.living(window)
    room = window - 2 * zone
    first, end = np.full(len(s), -1, np.int64), np.zeros(len(s), np.int64)
    length = c.stops - c.starts
    for size in sorted({int(x) for x in np.unique(length) if x <= room}, reverse=True):
        value = np.full(n, _MOST)
        of = length == size
        # Names of a symbol are compared by 40 bits, equal ones by place: both lie inside the zone.
        value[c.starts[of]] = mix64(c.names[of]) >> np.uint64(1)
        best = sliding_first_min(value, room - size + 1)
        at = best[np.minimum(s + zone, len(best) - 1)]
        ok = (first < 0) & (value[at] != _MOST)
        first[ok], end[ok] = at[ok], at[ok] + size
    none = first < 0
    first[none], end[none] = s[none] + zone, s[none] + zone + room
    sums = Sums(mix64(words))
    # Words that each window of the anchor holds: from zone words before it to zone words behind it. The key only
    # brings windows together, so 48 bits of it do.
    key = sums.of(first - zone, end + zone) >> np.uint64(16)
    return s, first, end, key, sums


def stretches(c: Chunk, s, first, key, kind, words: np.ndarray, window: int, sums: Sums):
    """Windows in a row with one shared anchor: (start, number of windows, place of the anchor, key), alike ones as one class.

    kind: 0 for anchors that no other place has, 2 for hot ones, whose windows go one by one.
    """
    keep = kind > 0
    s, first, key, hot = s[keep], first[keep], key[keep], kind[keep] == 2
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none, none
    new = np.append(True, (s[1:] != s[:-1] + 1) | (first[1:] != first[:-1]) | hot[1:])
    at = np.flatnonzero(new)
    start, count = s[at], np.diff(np.append(at, len(s)))
    off = np.where(hot[at], 0, first[at] - start)
    key = np.where(hot[at], mix64(sums.of(start, start + window) ^ _COIN) >> np.uint64(16), key[at])
    with np.errstate(over="ignore"):
        same = mix64(sums.of(start, start + count - 1 + window) + mix64(key) * _LEFT + (off * 4096 + count).astype(np.uint64) * _RIGHT)
    _, lead, cls = np.unique(same, return_index=True, return_inverse=True)
    cls = _verified(cls, lead, start, count, off, key, words, window)
    return start, count, off, key, cls, len(lead)


def _verified(cls, lead, start, count, off, key, words, window: int) -> np.ndarray:
    """Members of a class must agree with its first one word by word; hashes are 64 bits wide, so they do."""
    to = lead[cls]
    alike = (count == count[to]) & (off == off[to]) & (key == key[to])
    n = count + window - 1
    for a in range(0, len(start), 1 << 16):
        b = min(a + (1 << 16), len(start))
        m = n[a:b]
        flat = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        differ = words[np.repeat(start[a:b], m) + flat] != words[np.minimum(np.repeat(start[to[a:b]], m) + flat, len(words) - 1)]
        alike[a:b] &= np.add.reduceat(differ, np.cumsum(m) - m) == 0
    if not alike.all():
        raise ValueError("two stretches of different words have one hash")
    return cls


def settle(window: int) -> Callable:
    """Of the windows that meet in a bucket the earliest place of each: a bit for each window of each class that a chunk sent."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        bucket = rows[0]["bucket"]
        key, count, words, doc, at, sizes = [], [], [], [], [], []
        for r in rows:
            k = unpack(r["names"])
            key.append(k)
            count.append(unpack(r["offsets"]).astype(np.int64))
            doc.append(np.frombuffer(r["docs"], "<i8"))
            at.append(unpack(r["starts"]).astype(np.int64))
            words.append(unpack(r["other"]))
            sizes.append(len(k))
        key, count, doc, at, words = (np.concatenate(x) for x in (key, count, doc, at, words))
        length = count + window - 1
        base = np.cumsum(length) - length
        record = np.repeat(np.arange(len(key)), count)
        off = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        pos = base[record] + off
        hashes = Sums(mix64(words)).of(pos, pos + window)
        place = at[record] + off
        o = np.lexsort((place, doc[record], hashes, key[record]))
        a, b = runs(np.rec.fromarrays([key[record][o], hashes[o]]))
        lead = np.repeat(o[a], b - a)
        for k in range(window):  # every word of a window against the earliest one
            if not (words[pos[o] + k] == words[pos[lead] + k]).all():
                raise ValueError("two windows of different words have one hash")
        first = np.zeros(len(o), bool)
        first[o] = (doc[record][o] == doc[record][lead]) & (place[o] == place[lead])
        cut = np.cumsum(np.add.reduceat(count, np.cumsum([0, *sizes[:-1]])))[:-1]
        return pa.Table.from_arrays(
            [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([np.packbits(x).tobytes() for x in np.split(first, cut)], pa.binary())], schema=REPLY_SCHEMA
        )

    return run


# --- rounds ---------------------------------------------------------------------------------


def _kinds(t: pa.Table) -> dict[str, dict]:
    return {r["kind"]: r for r in t.to_pylist()}


def removed_ranges(docs: DataFrame, window: int, active: tuple[int, ...], chunk: int, hot: int) -> DataFrame:
    """id, starts, ends: for each document that loses words, the ranges of them, packed; a row for each part of a long text."""
    buckets = buckets_for(text_bytes(docs))
    edge, rounds = zones(active), 2 * len(active) + 2
    if window - 2 * edge[-1] < 2 * max(active):
        raise ValueError("windows this short need fewer levels")
    last = 2 * len(active)

    def ask(c: Chunk, step: int, words: np.ndarray) -> list[dict]:
        if step <= last:
            _, _, (left, right, _, times) = _found(c, step, active)
            return _asks(c, left, right, times, buckets)
        _, _, _, key, _ = anchors(c, words, window, edge[-1])
        k, times = np.unique(key, return_counts=True)
        return _asks(c, k, np.zeros(len(k), np.uint64), times, buckets)

    def held(t: pa.Table) -> tuple[Chunk, np.ndarray]:
        got = _kinds(t)
        words = unpack(got["words"]["names"])
        return Chunk.of(got["state"], words), words

    def out(c: Chunk, words: np.ndarray, step: int) -> pa.Table:
        """State, words and questions of the next round; nothing of a chunk that has no window left."""
        if not c.size:
            return _table([])
        return _table([c.row(), {"kind": "words", "chunk": c.number, "names": pack(words)}, *ask(c, step + 1, words)])

    def name_words(t: pa.Table, replies: pa.Table) -> pa.Table:
        row = _kinds(t)["state"]
        c, bucket = Chunk.of(row), unpack(row["other"]).astype(np.int64)
        c.names = _received(replies, np.argsort(bucket, kind="stable"), bucket)[c.names.astype(np.int64)]
        c.bury(window, 0)
        return out(*c.compact(c.names, window), 0)

    def compress(step: int) -> Callable:
        def run(t: pa.Table, replies: pa.Table) -> pa.Table:
            c, words = held(t)
            a, n, (left, right, place, _) = _found(c, step, active)
            names = _received(replies, *_dealt(left, right, buckets))
            _compressed(c, a, n, names[place])
            c.bury(window, edge[step])
            return out(*(c.compact(words, window) if step % 2 == 0 else (c, words)), step)

        return run

    def members(t: pa.Table, replies: pa.Table) -> pa.Table:
        """Classes of stretches with shared anchors: their words go to the anchors' buckets, their places stay."""
        c, words = held(t)
        s, first, _, key, sums = anchors(c, words, window, edge[-1])
        k, place = np.unique(key, return_inverse=True)
        kind = _received(replies, *_dealt(k, np.zeros(len(k), np.uint64), buckets))[place]
        start, count, _, key, cls, n = stretches(c, s, first, key, kind, words, window, sums)
        if not len(start):
            return _table([])
        part = np.searchsorted(c.ends, start, "right")
        begin = np.append(0, c.ends[:-1])
        doc, at = c.docs[part], start - begin[part] + c.offsets[part]
        o = np.lexsort((at, doc, cls))
        lead = o[runs(cls[o])[0]]  # the earliest member of each class
        earliest = (doc == doc[lead[cls]]) & (at == at[lead[cls]])
        bucket = (key[lead] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        rows = [
            c.row()
            | {"kind": "members", "starts": pack(start), "names": pack(number[cls]), "many": np.packbits(earliest).tobytes(), "other": pack(count[lead][order]), "dead": pack(bucket[order])}
        ]
        for a, b in zip(*runs(bucket[order]), strict=True):
            of = lead[order[a:b]]
            m = count[of] + window - 1
            flat = np.repeat(start[of], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            rows.append(
                {"kind": "ask", "chunk": c.number, "bucket": int(bucket[order[a]]), "names": pack(key[of]), "offsets": pack(count[of]), "docs": doc[of].astype("<i8").tobytes(), "starts": pack(at[of]), "other": pack(words[flat])}
            )
        return _table(rows)

    out_schema = pa.schema([("id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])

    def ranges(t: pa.Table, replies: pa.Table) -> pa.Table:
        row = _kinds(t).get("members")
        if row is None:
            return out_schema.empty_table()
        docs, offsets, ends = np.frombuffer(row["docs"], "<i8"), unpack(row["offsets"]).astype(np.int64), unpack(row["ends"]).astype(np.int64)
        count, bucket = unpack(row["other"]).astype(np.int64), unpack(row["dead"]).astype(np.int64)
        by = dict(zip(replies.column("bucket").to_pylist(), replies.column("names").to_pylist(), strict=True))
        bits = []
        for a, b in zip(*runs(bucket), strict=True):
            bits.append(np.unpackbits(np.frombuffer(by[int(bucket[a])], np.uint8), count=int(count[a:b].sum())))
        bits = np.concatenate(bits).astype(bool)
        start, cls = unpack(row["starts"]).astype(np.int64), unpack(row["names"]).astype(np.int64)
        earliest = np.unpackbits(np.frombuffer(row["many"], np.uint8), count=len(start)).astype(bool)
        n = count[cls]
        base = (np.cumsum(count) - count)[cls]
        member = np.repeat(np.arange(len(start)), n)
        off = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
        # The earliest place of a window keeps it; all other places lose it.
        late = ~(bits[base[member] + off] & earliest[member])
        at = start[member][late] + off[late]
        a, b = merged(at, at + window)
        part = np.searchsorted(ends, a, "right")
        # Ranges that touch at a border of parts belong to either.
        a, b, part = _split_at(a, b, part, ends)
        begin = np.append(0, ends[:-1])
        x, y = a - begin[part] + offsets[part], b - begin[part] + offsets[part]
        f, g = runs(docs[part])
        return pa.Table.from_arrays(
            [
                pa.array(docs[part[f]], pa.int64()),
                pa.array([x[i:j].astype("<i8").tobytes() for i, j in zip(f, g, strict=True)], pa.binary()),
                pa.array([y[i:j].astype("<i8").tobytes() for i, j in zip(f, g, strict=True)], pa.binary()),
            ],
            schema=out_schema,
        )

    def round_of(table: DataFrame, answer: Callable, step: Callable, schema: str) -> DataFrame:
        replies = table.filter("kind = 'ask'").groupBy("bucket").applyInArrow(light(answer), REPLY)
        return table.filter("kind != 'ask'").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(light(step), schema)

    now = stage(deal_words(docs.select("id", "text"), window, buckets, chunk), "words")
    now = stage(round_of(now, answer_words(buckets, 0, rounds), name_words, ROWS), "named", after=(now,), rest=REST)
    for step in range(1, last + 1):
        now = stage(round_of(now, answer_keys(buckets, step, rounds), compress(step), ROWS), f"round{step}", after=(now,), rest=REST)
    now = stage(round_of(now, answer_keys(buckets, 0, rounds, hot), members, ROWS), "members", after=(now,), rest=REST)
    return stage(round_of(now, settle(window), ranges, "id long, starts binary, ends binary"), "ranges", after=(now,), rest=REST)


def _split_at(a: np.ndarray, b: np.ndarray, part: np.ndarray, ends: np.ndarray):
    """Cut ranges where they cross an end of a part."""
    over = np.searchsorted(ends, b, "left") - part
    n = over + 1
    which = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    p = part[which] + k
    lo = np.where(k == 0, a[which], ends[np.maximum(p - 1, 0)])
    hi = np.minimum(b[which], ends[p])
    ok = hi > lo
    return lo[ok], hi[ok], p[ok]


def substring_dedup(docs: DataFrame, window: int = WINDOW, active: tuple[int, ...] = ACTIVE, with_text: bool = False, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the remaining words), one row a document."""
    prepare(docs.sparkSession)
    docs = row_keys(fresh(docs, "doc_id", "text"))
    found = removed_ranges(docs, window, active, chunk, hot)
    # Of a long text each chunk tells its part; ranges follow the documents in number, so they are never broadcast.
    by_doc = found.groupBy("id").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    ranged = docs.join(by_doc.hint("merge"), "id", "left").select("doc_id", "text", "starts", "ends")

    def cut(it):
        for batch in it:
            rows = []
            for row in batch.to_pylist():
                words = (row["text"] or "").encode("utf-8", "surrogatepass").split()
                n, removed = len(words), 0
                if row["starts"]:
                    s, e = (np.concatenate([np.frombuffer(x, "<i8") for x in row[f]]) for f in ("starts", "ends"))
                    gone = covered(n, s, e)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append([row["doc_id"], n, removed, hashlib.sha256(kept).hexdigest()] + [kept.decode("utf-8", "surrogatepass")] * with_text)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)

    return ranged.mapInArrow(light(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
, w AS (
  SELECT doc_id, s, hash(array_to_string(list_slice(words, s, s + 19), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d WHERE len(words) >= 20))
, late AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w) WHERE k > 1)
, gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late)
, g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(g.gone, []), i)), lambda i: words[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
