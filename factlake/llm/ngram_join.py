"""N-gram Jaccard self-join by prefix tries.

A document is the set of its distinct n-word shingles. All sets share one global order, rare
shingles first: shingles are numbered by (class of the count of their hash bucket, hash), where the
counts fill a table of fixed size. Equal sets are one class with one representative. Two similar
sets share a shingle among the first |x| - ceil(t |x|) + 1 of each (prefix filter); these prefixes
travel as packed arrays to the bucket of the shingle.

Round 1 sends every representative with a shared prefix shingle to the fragment of the rarest one.
Fragments are cut into blocks of sets of like size, neighbouring blocks sharing one set; in each
block the sets go through a trie (see trie.py), which gives links and so first components.
Round 2 looks at the run of every prefix shingle again, and verifies neighbours by size that are in
different components, so that groups of near copies become one component from a number of
comparisons that is linear in their size. The last round takes all pairs of a run that are still in
different components and that the length, position and signature bounds cannot rule out; these
form clusters, and the sets of a cluster go through tries, block against block. No similar pair is
missed: each is in one component by then or in one cluster of the last round.

Defined results: a text without words has the empty set and links with nothing; with fewer than n
words the whole sequence is its one shingle. Repeated rows are copies. Rows with one doc_id and
different texts count by their own sets. A null doc_id is a document of its own; a component is named
by its smallest doc_id that is not null, null if it has none. Other columns are
ignored; an empty table gives an empty result. Shingles are compared by 56 bits of a hash and their
count class.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, buckets_for, fresh, light, mix64, prepare, row_keys, stage, text_bytes, word_spans
from .components import components
from .deal import Gatherer, Layout, MixedLayout, runs
from .repeats import Sums, doc_bucket
from .trie import Components, linked

N = 5
PERCENT = 75
#: Hash buckets of the table of shingle counts: one for about 64 bytes of input, between these bounds
#: (its broadcast classes take a byte each), and pieces in which it travels.
TABLE = (1 << 20, 1 << 25)
PIECES = 64
#: Most sets in a block of a fragment.
BLOCK = 512
#: Most bytes of wanted identifiers and blocks that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST = 32 << 20
#: Rounds in which only neighbours in a run are compared, before all that is left.
CHAINS = 2
#: About how many pairs of the last round are looked at at once.
CELLS = 1 << 18
#: Signature bits for each shingle, rounded up to a power of two, and least bits.
SIGNATURE_BITS = (1, 256)

SHARE = Layout(token="<u8", rep="<i8", size="<i4", at="<i4")
LABELLED = Layout(token="<u8", rep="<i8", size="<i4", at="<i4", label="<i8")
OWNED = Layout(token="<u8", rep="<i8", size="<i4")
PLACED = Layout(block="<i8", rep="<i8", label="<i8")
PAIRED = Layout(a="<i8", b="<i8")
SETS = MixedLayout(block="<i8", rep="<i8", label="<i8", tokens="O")


#: Bytes of texts that are hashed at once.
TOGETHER = 1 << 20
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64))[_LOWER]


def shingle_sets(texts: list[str | None], n: int = N):
    """For each text the sorted distinct 64-bit hashes of its shingles; short texts share the work of hashing."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > TOGETHER:
            yield from _sets_of(held, n)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from _sets_of(held, n)


def _sets_of(held: list[bytes], n: int):
    a, start, end = word_spans(b"\n".join(held))
    if not len(start):
        yield from [np.zeros(0, np.uint64)] * len(held)
        return
    sums = Sums(Sums(_LETTERS[a]).of(start, end))
    offsets = np.cumsum([0, *[len(d) + 1 for d in held]])
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.searchsorted(doc, np.arange(len(held) + 1))
    at = np.arange(max(len(start) - n + 1, 0))
    at = at[doc[at] == doc[at + n - 1]] if len(at) else at
    whole = mix64(sums.of(at, at + n))
    cut = np.searchsorted(doc[at], np.arange(len(held) + 1))
    for d in range(len(held)):
        m = words[d + 1] - words[d]
        if m == 0:
            yield np.zeros(0, np.uint64)
        elif m < n:
            yield mix64(sums.of(words[d : d + 1], words[d + 1 : d + 2]))
        else:
            yield np.unique(whole[cut[d] : cut[d + 1]])


def table_slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h & np.uint64(slots - 1)).astype(np.int64)


def count_table(docs: DataFrame, n: int = N, size: int | None = None) -> np.ndarray:
    """Class of the count of each hash bucket over all documents: four classes for each doubling."""
    size = text_bytes(docs) if size is None else size
    slots = min(TABLE[1], max(TABLE[0], 1 << (size // 64).bit_length()))

    def count(it):
        t = np.zeros(slots, np.int32)
        for batch in it:
            held = list(shingle_sets(batch.column("text").to_pylist(), n))
            if held:
                at, times = np.unique(table_slot(np.concatenate(held), slots), return_counts=True)
                t[at] += times.astype(np.int32)
        parts = [zlib.compress(p.astype("<i4").tobytes(), 1) for p in t.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(slots // PIECES, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), "<i4")
        cls = np.minimum(np.round(4 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.table({"piece": t.column("piece").slice(0, 1), "counts": pa.array([cls.tobytes()], pa.binary())})

    schema = "piece int, counts binary"
    summed = docs.select("text").mapInArrow(light(count), schema).groupBy("piece").applyInArrow(light(add), schema)
    t = np.zeros((PIECES, slots // PIECES), np.uint8)
    for r in summed.collect():
        t[r["piece"]] = np.frombuffer(r["counts"], np.uint8)
    return t.ravel()


def ordered_set(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set of hashes in the global order: class in the upper 8 bits, hash below."""
    return np.sort((h >> np.uint64(8)) | (classes[table_slot(h, len(classes))].astype(np.uint64) << np.uint64(56)))


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the set's hash buckets, as many as its size asks for.

    The Hamming distance of two signatures of one length is at most the symmetric difference of the
    sets; a longer one is folded by exclusive or.
    """
    bits = max(SIGNATURE_BITS[1], 1 << (SIGNATURE_BITS[0] * len(tokens)).bit_length())
    odd = np.bincount((mix64(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def fold(sig: bytes, length: int) -> np.ndarray:
    """A signature at a shorter length, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, np.uint64).reshape(-1, length // 8), 0)


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(token) % np.uint64(buckets)).astype(np.int64)


def profiles(docs: DataFrame, classes, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest, prefix, sig of each row."""

    def run(it):
        for batch in it:
            rows = [ordered_set(h, classes.value) for h in shingle_sets(batch.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in rows], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in rows], pa.binary()),
                    pa.array([s[: _prefix(len(s), percent)].tobytes() for s in rows], pa.binary()),
                    pa.array([signature(s) for s in rows], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "prefix", "sig"],
            )

    return docs.mapInArrow(light(run), "doc_id long, n_shingles long, digest binary, prefix binary, sig binary")


def _shared_prefixes(reps: DataFrame, buckets: int) -> DataFrame:
    """SHARE records, by bucket of the representative, of prefix shingles that several have."""

    def deal(it):
        out = Gatherer(SHARE)
        for batch in it:
            for rep, n, prefix in zip(batch.column("rep").to_pylist(), batch.column("n_shingles").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                t = np.frombuffer(prefix, "<u8")
                d = {"token": t, "rep": np.full(len(t), rep), "size": np.full(len(t), n), "at": np.arange(len(t))}
                yield from out.add(d, _bucket(t, buckets))
        yield out.flush()

    def shared(t: pa.Table) -> pa.Table:
        d = SHARE.join(t)
        o = np.argsort(d["token"], kind="stable")
        a, b = runs(d["token"][o])
        o = o[np.repeat(b - a > 1, b - a)]
        d = {f: v[o] for f, v in d.items()}
        return pa.Table.from_batches([SHARE.split(d, doc_bucket(d["rep"], buckets))])

    return stage(reps.select("rep", "n_shingles", "prefix").mapInArrow(light(deal), SHARE.ddl).groupBy("bucket").applyInArrow(light(shared), SHARE.ddl), "shared")


def _blocks(shared: DataFrame, buckets: int) -> DataFrame:
    """PLACED records: the block(s) of each representative, in the fragment of its rarest shared shingle."""

    def own(t: pa.Table) -> pa.Table:
        d = SHARE.join(t)
        o = np.lexsort((d["at"], d["rep"]))
        a, _ = runs(d["rep"][o])
        d = {f: d[f][o[a]] for f in OWNED.fields}
        return pa.Table.from_batches([OWNED.split(d, _bucket(d["token"], buckets))])

    def cut(t: pa.Table) -> pa.Table:
        d = OWNED.join(t)
        o = np.lexsort((d["rep"], d["size"], d["token"]))
        a, b = runs(d["token"][o])
        block, rep = [], []
        for x, y in zip(a, b, strict=True):
            if y - x > 1:
                token = d["token"][o[x]]
                for no, at in enumerate(range(x, y - 1, BLOCK - 1)):  # neighbouring blocks share a set
                    part = d["rep"][o[at : min(at + BLOCK, y)]]
                    with np.errstate(over="ignore"):
                        name = mix64(np.array([token + np.uint64(no) * np.uint64(0x9E3779B97F4A7C15)]))[0]
                    rep.append(part)
                    block.append(np.full(len(part), name, np.uint64).view(np.int64))
        d = {"block": np.concatenate(block or [np.zeros(0, np.int64)]), "rep": np.concatenate(rep or [np.zeros(0, np.int64)])}
        d["label"] = d["rep"]
        return pa.Table.from_batches([PLACED.split(d, doc_bucket(d["rep"], buckets))])

    owned = shared.groupBy("bucket").applyInArrow(light(own), OWNED.ddl)
    return stage(owned.groupBy("bucket").applyInArrow(light(cut), PLACED.ddl), "blocks")


def _sets_to_blocks(docs: DataFrame, reps: DataFrame, placed: DataFrame, classes, n: int, buckets: int, few: bool = False) -> DataFrame:
    """SETS records: the ordered set of each placed representative, at each of its blocks.

    few: later rounds want the texts of few documents; these are found by a broadcast if it is small enough.
    """
    schema = pa.schema([("id", pa.int64()), ("blocks", pa.binary()), ("labels", pa.binary())])

    def by_rep(t: pa.Table) -> pa.Table:
        d = PLACED.join(t)
        o = np.argsort(d["rep"], kind="stable")
        a, b = runs(d["rep"][o])
        blocks = [d["block"][o[x:y]].tobytes() for x, y in zip(a, b, strict=True)]
        labels = [d["label"][o[x:y]].tobytes() for x, y in zip(a, b, strict=True)]
        return pa.Table.from_arrays([pa.array(d["rep"][o[a]], pa.int64()), pa.array(blocks, pa.binary()), pa.array(labels, pa.binary())], schema=schema)

    def build(it):
        out = Gatherer(SETS, 20_000)
        for batch in it:
            for rep, digest, blocks, labels, h in zip(*(batch.column(c).to_pylist() for c in ("id", "digest", "blocks", "labels")), shingle_sets(batch.column("text").to_pylist(), n), strict=True):
                s = ordered_set(h, classes.value)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != digest:
                    continue  # another row with this doc_id
                b = np.frombuffer(blocks, "<i8")
                tokens = np.empty(len(b), object)
                tokens[:] = [s.tobytes()] * len(b)
                d = {"block": b, "rep": np.full(len(b), rep), "label": np.frombuffer(labels, "<i8"), "tokens": tokens}
                yield from out.add(d, doc_bucket(b, buckets))
        yield out.flush()

    wanted = placed.groupBy("bucket").applyInArrow(light(by_rep), "id long, blocks binary, labels binary")
    # Rows with one doc_id and several sets: a representative is told by its digest too.
    wanted = wanted.join(reps.select("digest", F.col("rep").alias("id")), "id")
    how = "merge"
    if few:
        wanted = stage(wanted, "wanted")
        size = wanted.agg(F.sum(2 * F.octet_length("blocks") + F.octet_length("digest") + 8)).first()[0] or 0
        how = "broadcast" if size <= BROADCAST else "merge"
    return docs.join(wanted.hint(how), "id").select("id", "text", "digest", "blocks", "labels").mapInArrow(light(build), SETS.ddl)


def _trie_links(sets: DataFrame, percent: int, name: str) -> DataFrame:
    """a, b: what the links found by a trie connect in each block, as stars."""

    def run(t: pa.Table) -> pa.Table:
        d = SETS.join(t)
        o = np.lexsort((d["rep"], d["block"]))
        a, b = runs(d["block"][o])
        left, right = [], []
        for x, y in zip(a, b, strict=True):
            reps, first = np.unique(d["rep"][o[x:y]], return_index=True)
            tokens = [np.frombuffer(d["tokens"][o[x:y][i]], "<u8") for i in first]
            comp = Components(len(reps))
            # What earlier rounds have connected is one component from the start.
            leader: dict[int, int] = {}
            for i, v in enumerate(d["label"][o[x:y]][first].tolist()):
                comp.join(i, leader.setdefault(v, i))
            linked(tokens, percent, comp)
            # A star for each component of the block: labels spread over few edges.
            for i in range(len(reps)):
                if comp.find(i) != i:
                    left.append(int(reps[i]))
                    right.append(int(reps[comp.find(i)]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return stage(sets.groupBy("bucket").applyInArrow(light(run), "a long, b long"), name)


def _labelled(shared: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """LABELLED records by bucket of the shingle: the prefix shingles with their representatives' components."""
    packed = Layout(rep="<i8", label="<i8")

    def pack(it):
        out = Gatherer(packed)
        for batch in it:
            rep, label = batch.column("node").to_numpy(), batch.column("label").to_numpy()
            yield from out.add({"rep": rep, "label": label}, doc_bucket(rep, buckets))
        yield out.flush()

    known = labels.mapInArrow(light(pack), packed.ddl).select("bucket", _none("token"), "rep", _none("size"), _none("at"), "label", F.lit("label").alias("what"))
    both = shared.select("bucket", "token", "rep", "size", "at", _none("label"), F.lit("share").alias("what")).unionByName(known)

    def attach(t: pa.Table) -> pa.Table:
        is_label = np.array([w == "label" for w in t.column("what").to_pylist()], bool)
        d, known = SHARE.join(t.filter(pa.array(~is_label))), packed.join(t.filter(pa.array(is_label)))
        at, hit = _find(known["rep"], d["rep"])
        label = d["rep"].copy()
        label[hit] = known["label"][at[hit]]
        return pa.Table.from_batches([LABELLED.split(d | {"label": label}, _bucket(d["token"], buckets))])

    return both.groupBy("bucket").applyInArrow(light(attach), LABELLED.ddl)


def _none(name: str):
    return F.lit(None).cast("binary").alias(name)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into keys, whether found) of each wanted value."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    o = np.argsort(keys, kind="stable")
    at = o[np.minimum(np.searchsorted(keys[o], wanted), len(o) - 1)]
    return at, keys[at] == wanted


def _mixed(t: pa.Table):
    """Records of one bucket in order of shingle and size, and the runs that hold several components."""
    d = LABELLED.join(t)
    o = np.lexsort((d["rep"], d["size"], d["token"]))
    d = {f: v[o] for f, v in d.items()}
    a, b = runs(d["token"])
    apart = np.minimum.reduceat(d["label"], a) != np.maximum.reduceat(d["label"], a) if len(a) else np.zeros(0, bool)
    return d, a[apart], b[apart]


def _chain_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """a, b: neighbours by size in the run of a shingle whose components differ; fewer than the run has members."""

    def run(t: pa.Table) -> pa.Table:
        d, a, b = _mixed(t)
        found = [np.zeros((0, 2), np.int64)]
        for x, y in zip(a, b, strict=True):
            i = np.arange(x, y - 1)
            i = i[(d["label"][i] != d["label"][i + 1]) & (100 * d["size"][i].astype(np.int64) >= percent * d["size"][i + 1].astype(np.int64))]
            found.append(np.sort(np.stack([d["rep"][i], d["rep"][i + 1]], 1), 1))
        p = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64())})

    return labelled.groupBy("bucket").applyInArrow(light(run), "a long, b long").distinct()


def _near(sigs: np.ndarray):
    """A function of two lists of places in ``sigs``, the first one's not longer: their Hamming distances at the length of the first."""
    length = np.array([len(v) for v in sigs], np.int64)
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(m: int):
        if m not in folded:
            some = np.flatnonzero(length >= m)
            slot = np.full(len(sigs), -1)
            slot[some] = np.arange(len(some))
            folded[m] = slot, np.stack([fold(v, m) for v in sigs[some]])
        return folded[m]

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for m in np.unique(length[a]).tolist():
            slot, words = at(m)
            which = np.flatnonzero(length[a] == m)
            step = max(1, TOGETHER // m)
            for k in range(0, len(which), step):
                w = which[k : k + step]
                out[w] = np.bitwise_count(words[slot[a[w]]] ^ words[slot[b[w]]]).sum(1, dtype=np.int64)
        return out

    return distance


SIGNED = MixedLayout(token="<u8", rep="<i8", size="<i4", at="<i4", label="<i8", sig="O")


def _clusters(labelled: DataFrame, reps: DataFrame, buckets: int, percent: int) -> DataFrame:
    """a, b: stars that connect all pairs that share a prefix shingle, differ in component and may be similar.

    Length, position and signature bounds rule pairs out; those left are not listed but joined to clusters in each bucket.
    """

    def mixed(t: pa.Table) -> pa.Table:
        d, a, b = _mixed(t)
        keep = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)] or [np.zeros(0, np.int64)])
        d = {f: v[keep] for f, v in d.items()}
        return pa.Table.from_batches([LABELLED.split(d, doc_bucket(d["rep"], buckets))])

    packed = MixedLayout(rep="<i8", sig="O")

    def pack(it):
        out = Gatherer(packed, 100_000)
        for batch in it:
            sig = np.empty(len(batch), object)
            sig[:] = batch.column("sig").to_pylist()
            rep = batch.column("rep").to_numpy()
            yield from out.add({"rep": rep, "sig": sig}, doc_bucket(rep, buckets))
        yield out.flush()

    members = labelled.groupBy("bucket").applyInArrow(light(mixed), LABELLED.ddl).select("*", _none("sig"), F.lit("member").alias("what"))
    sigs = reps.select("rep", "sig").mapInArrow(light(pack), packed.ddl).select("bucket", _none("token"), "rep", _none("size"), _none("at"), _none("label"), "sig", F.lit("sig").alias("what"))

    def attach(t: pa.Table) -> pa.Table:
        is_sig = np.array([w == "sig" for w in t.column("what").to_pylist()], bool)
        d, known = LABELLED.join(t.filter(pa.array(~is_sig))), packed.join(t.filter(pa.array(is_sig)))
        at, hit = _find(known["rep"], d["rep"])
        assert hit.all()
        return pa.Table.from_batches([SIGNED.split(d | {"sig": known["sig"][at] if len(at) else np.zeros(0, object)}, _bucket(d["token"], buckets))])

    def pairs(t: pa.Table) -> pa.Table:
        d = SIGNED.join(t)
        o = np.lexsort((d["rep"], d["size"], d["token"]))
        d = {f: v[o] for f, v in d.items()}
        every, first, who = np.unique(d["rep"], return_index=True, return_inverse=True)
        comp = Components(len(every))
        near = _near(d["sig"][first])
        n, label, at = d["size"].astype(np.int64), d["label"], d["at"].astype(np.int64)
        # Partners stand behind in the run and are no smaller, up to the largest allowed.
        run = np.cumsum(np.concatenate([np.zeros(1, np.int64), d["token"][1:] != d["token"][:-1]])[: len(n)])
        wide = 100 * int(n.max(initial=0)) // percent + 1
        many = np.searchsorted(run * wide + n, run * wide + 100 * n // percent, "right") - np.arange(len(n)) - 1
        sums = np.concatenate([[0], np.cumsum(many)])
        cluster, p = np.arange(len(every)), 0
        while p < len(n):
            q = max(p + 1, int(np.searchsorted(sums, sums[p] + CELLS, "right")) - 1)
            i = np.repeat(np.arange(p, q), many[p:q])
            j = i + 1 + np.arange(len(i)) - (sums[i] - sums[p])
            p = q
            apart = (label[i] != label[j]) & (cluster[who[i]] != cluster[who[j]])
            i, j = i[apart], j[apart]
            # The overlap lies in what follows this shingle, itself included, or before it in both.
            fits = (np.minimum(n[i] - at[i], n[j] - at[j]) + np.minimum(at[i], at[j])) * (100 + percent) >= percent * (n[i] + n[j])
            i, j = i[fits], j[fits]
            fits = near(who[i], who[j]) * (100 + percent) <= (100 - percent) * (n[i] + n[j])
            pair = np.unique(cluster[who[i[fits]]] * len(every) + cluster[who[j[fits]]])
            for k in pair.tolist():
                comp.join(*divmod(k, len(every)))
            if len(pair):
                cluster = np.array([comp.find(k) for k in range(len(every))], np.int64)
        up = np.array([comp.find(i) for i in range(len(every))], np.int64)
        rest = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": pa.array(every[rest], pa.int64()), "b": pa.array(every[up[rest]], pa.int64())})

    signed = members.unionByName(sigs).groupBy("bucket").applyInArrow(light(attach), SIGNED.ddl)
    return signed.groupBy("bucket").applyInArrow(light(pairs), "a long, b long").distinct()


CLUSTERED = Layout(cluster="<i8", rep="<i8", size="<i8", label="<i8")


def _cluster_blocks(clusters: DataFrame, labels: DataFrame, reps: DataFrame, buckets: int, percent: int) -> DataFrame:
    """PLACED records: of each cluster, pairs of blocks of like size that can hold similar sets."""
    rows = (
        clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")).join(reps.select("rep", F.col("n_shingles").alias("size")), "rep")
        .join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("cluster", "rep", "size", F.coalesce("label", "rep").alias("label"))
    )

    def pack(it):
        for batch in it:
            d = {f: batch.column(f).to_numpy() for f in CLUSTERED.fields}
            yield CLUSTERED.split(d, doc_bucket(d["cluster"], buckets))

    def place(t: pa.Table) -> pa.Table:
        d = CLUSTERED.join(t)
        o = np.lexsort((d["rep"], d["size"], d["cluster"]))
        d = {f: v[o] for f, v in d.items()}
        block, take = [], []
        half = BLOCK // 2
        for x, y in zip(*runs(d["cluster"]), strict=True):
            parts = [np.arange(p, min(p + half, y)) for p in range(x, y, half)]
            near = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)) if percent * d["size"][parts[j][0]] <= 100 * d["size"][parts[i][-1]]]
            met = {k for pair in near for k in pair}
            # Two blocks that meet also compare their own members; a block that meets no other is alone.
            for i, j in near + [(i, i) for i in range(len(parts)) if i not in met]:
                both = parts[i] if j == i else np.concatenate([parts[i], parts[j]])
                key = mix64(mix64(d["cluster"][x : x + 1].view(np.uint64)) ^ np.uint64(i << 32 | j)).view(np.int64)
                take.append(both)
                block.append(np.full(len(both), key[0]))
        take = np.concatenate(take or [np.zeros(0, np.int64)])
        out = {"block": np.concatenate(block or [np.zeros(0, np.int64)]), "rep": d["rep"][take], "label": d["label"][take]}
        return pa.Table.from_batches([PLACED.split(out, doc_bucket(out["rep"], buckets))])

    return rows.mapInArrow(light(pack), CLUSTERED.ddl).groupBy("bucket").applyInArrow(light(place), PLACED.ddl)


def _pair_blocks(pairs: DataFrame, buckets: int) -> DataFrame:
    """PLACED records: pairs of one left side share blocks of at most BLOCK sets."""

    def place(it):
        for batch in it:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            d = {"a": a, "b": b}
            yield PAIRED.split(d, doc_bucket(a, buckets))

    def block(t: pa.Table) -> pa.Table:
        d = PAIRED.join(t)
        o = np.lexsort((d["b"], d["a"]))
        name, rep = [], []
        for x, y in zip(*runs(d["a"][o]), strict=True):
            a = d["a"][o[x]]
            for no, at in enumerate(range(x, y, BLOCK - 1)):
                part = d["b"][o[at : min(at + BLOCK - 1, y)]]
                with np.errstate(over="ignore"):
                    key = mix64(mix64(np.array([a]).view(np.uint64)) + np.uint64(no))[0]
                rep += [np.array([a]), part]
                name.append(np.full(len(part) + 1, key, np.uint64).view(np.int64))
        d = {"block": np.concatenate(name or [np.zeros(0, np.int64)]), "rep": np.concatenate(rep or [np.zeros(0, np.int64)])}
        d["label"] = d["rep"]
        return pa.Table.from_batches([PLACED.split(d, doc_bucket(d["rep"], buckets))])

    return pairs.mapInArrow(light(place), PAIRED.ddl).groupBy("bucket").applyInArrow(light(block), PLACED.ddl)


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; documents with a common component are connected by links."""
    spark = docs.sparkSession
    prepare(spark)
    docs = row_keys(fresh(docs, "doc_id", "text"), nulls_first=False)
    # Keys that are not the doc_id itself are staged; they lead back to it at the end.
    renamed = not docs.filter("doc_id IS NULL OR doc_id != id").isEmpty()
    size = text_bytes(docs)
    buckets = buckets_for(size)
    classes = spark.sparkContext.broadcast(count_table(docs, n, size))
    profile = stage(profiles(docs.select(F.col("id").alias("doc_id"), "text"), classes, n, percent), "profiles")
    reps = stage(
        profile.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig")),
        "reps",
    )
    shared = _shared_prefixes(reps, buckets)
    first = _trie_links(_sets_to_blocks(docs, reps, _blocks(shared, buckets), classes, n, buckets), percent, "links1")
    links, labels = first, components(first)

    def verify(placed: DataFrame, name: str) -> DataFrame:
        return _trie_links(_sets_to_blocks(docs, reps, placed, classes, n, buckets, True), percent, name)

    for _ in range(CHAINS):
        pairs = stage(_chain_pairs(_labelled(shared, labels, buckets), percent), "pairs")
        more = verify(_pair_blocks(pairs, buckets), "chained")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = components(links)
    clusters = components(stage(_clusters(_labelled(shared, labels, buckets), reps, buckets, percent), "clusters"))
    last = verify(_cluster_blocks(clusters, labels, reps, buckets, percent), "last")
    # Members of one component may have met in separate blocks only: both sets of links count.
    final = labels if last.isEmpty() else components(links.unionByName(last))
    members = profile.select("doc_id", "n_shingles", "digest")
    linked_reps = reps.select("digest", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    known = stage(linked_reps.select("digest", F.coalesce("label", "rep").alias("label")), "known")
    out = members.join(known, "digest", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    if not renamed:
        return out
    names = docs.select(F.col("id").alias("key"), F.col("doc_id").alias("name")).distinct()
    for c in ("doc_id", "component_id"):
        out = out.join(names.hint("merge"), F.col(c) == F.col("key")).withColumn(c, F.col("name")).drop("key", "name")
    return out


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
, g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))
, n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
, o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
, e AS (SELECT a, b FROM o JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * o >= 75 * (p.n + q.n - o))
, r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON d.doc_id = r.a LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
