"""Operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlake.llm import bpe, exact_dedup, language, mixing, ngram_join, pii, recompression, suffix_dedup, topk, trie, warc
from factlake.llm import queries as Q
from factlake.llm.common import new_dir

from ..compare import same

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, runs and repeated rows."""
    r = random.Random(5)
    passage, base = words(r, 70), words(r, 300)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "a b c"), (6, "A B C"), (7, "a  b\nc"), (8, base), (9, base), (10, base + " tail"), (11, base.upper()), (12, words(r, 4000)), (13, "a " * 500), (14, "a " * 30), (15, "é" * 400), (16, "0123456789" * 45), (17, "z" + "0123456789" * 45), (18, "<|endoftext|> 🙂 1,234 don't")]
    near = base.split()
    for i in range(20, 60):
        w = list(near)
        for _ in range(4):
            w[r.randrange(len(w))] = f"w{r.randrange(999)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 90):
        rows.append((i, words(r, r.randint(1, 90)) + " " + passage + " " + words(r, r.randint(0, 60))))
    for i in range(90, 130):
        rows.append((i, words(r, r.randint(1, 200))))
    rows += [(8, base), (61, rows[40][1])][:1]
    return [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "clash", 7) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


ORACLES = sorted(Q.ORACLES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.ORACLES[name], SMALL)


# -- 1 -----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://www.b.example/x", "<p>"), (2, "http://a.example/", "<p>"), (3, None, None), (4, "not a url", ""), (5, "http://a.example/", "é" * 70000), (6, "http://h:99999/", "<p>"), (2, "http://a.example/", "<p>")]
    pages = spark.createDataFrame([(*r, "k", "f") for r in rows], "page_id long, url string, html string, key string, file string")
    root = f"file://{tmp_path}/w"
    got = warc.archive_round_trip(spark, pages, root).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", 0), i)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        p = html[r["page_id"]].encode()
        keep = best[html[r["page_id"]]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == r["page_id"] else ("revisit", keep))
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "http://a.example/", "<p>"), (3, "http://a.example/", "<p>"), (None, None, None), (1 << 60, "u", "x")], "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark, lost).collect()}
    assert got == {(None, 3, "revisit", 3), (3, 3, "response", None), (None, 0, "response", None), (1 << 60, 1, "response", None)}


def test_capture_index_finds_each_key(spark, tmp_path):
    keys = [(f"k{i % 50:03d}", i) for i in range(3000)]
    caps = spark.createDataFrame([(p, k, "f", p * 10, 5) for k, p in keys], "page_id long, key string, file string, at long, length long")
    index = warc.CaptureIndex.build(caps, f"file://{tmp_path}/i", block=16)
    reader = index.reader()
    assert [c[1] for c in reader.find("k007")] == list(range(7, 3000, 50)) and reader.find("nope") == [] and reader.find("k000", 50)[0][3] == 500 and reader.find("k000", 51) == []
    assert warc.reversed_host_key("http://www.A.example:8080/P?q=1") == "example,a:8080)/p?q=1"


# -- 2 -----------------------------------------------------------------------------------


def test_mixing_targets_and_limits(spark, docs, odd, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(odd) and mixing.mix_sources(none).count() == 0
    size = {i: len((t or "").encode().split()) for i, t, *_ in odd}
    taken, target, total = defaultdict(int), {}, Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        total[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - sum(total.values())) < 1e-6 and all(target[s] <= 3 * total[s] + 1e-9 for s in total)
    biggest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], biggest / 20) for s in total), (dict(taken), target)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_tilts_by_size_and_meets_its_targets(spark):
    """Two long documents against 150 short ones: the shrinking source gives up the long, the growing one repeats them."""
    size = {i: 20_000 if i < 2 else 100 + i % 7 for i in range(152)}
    rows = [(i, "w " * n, None, "b", 0, "", 0) for i, n in size.items()] + [(1000 + i, "w " * (40 + 3 * i), None, "a", 0, "", 0) for i in range(40)]
    rows += [(2000 + i, "w " * (300 + i), None, "c", 0, "", 0) for i in range(100)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    for rs in by.values():
        target = rs[0]["target"]
        # The rates meet the constraint, whole copies come within half of the longest document that is not whole.
        assert sum(r["rate"] * r["size"] for r in rs) == pytest.approx(target, rel=1e-6)
        assert abs(sum(r["taken"] for r in rs) - target) <= max((r["size"] for r in rs if r["rate"] % 1), default=0) / 2 + 1
        assert all(abs(r["copies"] - r["rate"]) < 1 for r in rs)
        # Stationarity of the dual: one multiplier for all documents below the limit.
        lam = [np.log(r["rate"]) / r["size"] for r in rs if 0 < r["rate"] < 3]
        assert not lam or max(lam) - min(lam) < 1e-9
    rates = {s: [r["rate"] for r in sorted(rs, key=lambda r: r["size"])] for s, rs in by.items()}
    assert rates["b"] == sorted(rates["b"], reverse=True) and rates["b"][-1] < 0.5 < 0.9 < rates["b"][0]
    assert set(rates["a"]) == {3.0} or rates["a"] == sorted(rates["a"])
    assert rates["c"] == sorted(rates["c"]) and rates["c"][0] < rates["c"][-1]


def test_mixing_odd_rows(spark):
    """Null texts, sources and ids, repeated rows, columns with clashing names, one class with most rows."""
    rows = [(None, None, None, None, 0, "", 0)] * 2 + [(1, "a b", None, "x", 0, "", 0)] * 3 + [(i, "a b c", None, "y", 0, "", 0) for i in range(500)] + [(None, "q " * 50, None, None, 0, "", 0)]
    t = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"digest": "size", "id": "order", "n_chars": "part", "lang": "at"})
    out = mixing.mix_sources(t).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1.5 for s in ("x", "y")) and taken[None] == target[None] == 150
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, None, "x", 0, "", 0), (2, " ", None, None, 0, "", 0)], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_mixing_water_level_and_prior(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 1, 2), ("c", 100, 3), ("d", 0, 1)], "source string, source_size long, weight long")
    t = {r["source"]: r["target"] for r in mixing.capped_targets(s).collect()}
    assert t["b"] == 3 and t["d"] == 0 and t["a"] == pytest.approx(27) and t["c"] == pytest.approx(81)
    many = spark.createDataFrame([(f"{i:03}", 2**i, i % 3 + 1) for i in range(50)], "source string, source_size long, weight long")
    got = mixing.capped_targets(many).collect()
    assert sum(r["target"] for r in got) == pytest.approx(2**50 - 1, rel=1e-12) and all(r["target"] <= 3 * r["source_size"] for r in got)
    classes = spark.createDataFrame([("=a", 10, 1.0, 1), ("=a", 5, 2.0, 2), ("=a", 1, 0.5, 7), ("=b", 3, 1.0, 4)], "source_key string, size long, prior double, n long")
    state = {r["source_key"]: r["lam"] for r in mixing.solve_dual(classes, spark.createDataFrame([("=a", 50.0), ("=b", 5.0), ("=c", 0.0)], "source_key string, target double")).collect()}
    given = sum(n * w * min(3, q * np.exp(state["=a"] * w)) for w, q, n in ((10, 1, 1), (5, 2, 2), (1, 0.5, 7)))
    assert given == pytest.approx(50.0) and 12 * np.exp(3 * state["=b"]) == pytest.approx(5.0) and state["=c"] == -np.inf


# -- 3 -----------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_ngram_components(spark, docs, odd, none):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()]
    sets = {i: shingles(t) for i, t, *_ in odd}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert sorted(rows) == sorted((i, len(sets[i]), find(i)) for i, *_ in odd)
    assert ngram_join.ngram_components(none).count() == 0


def test_trie_links_equal_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(60):
        base = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.concatenate([b[r.random(len(b)) > 0.1], r.integers(0, 60, 2).astype(np.uint64)])) for b in base for _ in range(6)]
        a, b = trie.Components(len(sets)), trie.Components(len(sets))
        for i, j in trie.linked(sets, 75):
            o = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o)
            a.join(i, j)
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                    b.join(i, j)
        assert [a.find(i) for i in range(len(sets))] == [b.find(i) for i in range(len(sets))]


def test_signatures_bound_the_difference():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 500, r.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        x, y = sorted((ngram_join.signature(a), ngram_join.signature(b)), key=len)
        d = int(np.bitwise_count(ngram_join.fold(x, len(x)) ^ ngram_join.fold(y, len(x))).sum())
        assert d <= len(np.setxor1d(a, b))


# -- 4 -----------------------------------------------------------------------------------


def test_distances_of_signatures_of_several_lengths():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 2**63, int(k)).astype(np.uint64)) for k in (1, 40, 300, 310, 900, 5000)]
    sigs = np.empty(len(sets), object)
    sigs[:] = [ngram_join.signature(x) for x in sets]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(i, len(sets))], strict=True))
    want = []
    for i, j in zip(a, b, strict=True):
        bits = np.unpackbits(np.frombuffer(sigs[j], np.uint8)).reshape(-1, 8 * len(sigs[i])).sum(0) % 2
        want.append(int((bits != np.unpackbits(np.frombuffer(sigs[i], np.uint8))).sum()))
    assert ngram_join._near(sigs)(a, b).tolist() == want
    assert ngram_join._near(sigs)(a[:0], b[:0]).tolist() == []


def test_bpe_equals_the_library(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path = Q.vocabulary_path()
    lib, coder = Tokenizer.from_file(path), bpe.encoder(path)
    r = random.Random(3)
    texts = [t or "" for _, t, *_ in odd] + ["".join(r.choice("ab cdeé中🙂<|>\n\t'5.-") for _ in range(80)) for _ in range(400)] + ["aaaa" * 3000, "<|endoftext|>" * 3, "  x\x85"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids and coder.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = bpe.bpe_round_trip(docs, path, with_ids=True).collect()
    by = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in odd)
    assert Counter((g["doc_id"], g["decoded_sha256"]) for g in got) == by and all(g["n_tokens"] == len(g["ids"]) for g in got)
    assert bpe.bpe_round_trip(none, path).count() == 0


def test_bpe_remembers_the_pieces_of_a_task(monkeypatch):
    from tokenizers import Tokenizer

    path = Q.vocabulary_path()
    lib, coder = Tokenizer.from_file(path), bpe.encoder(path)
    coder.forget()
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(90_000)]
    texts = [" ".join(words[i : i + 900]) for i in range(0, len(words), 900)]
    first = [coder.encode(t) for t in texts]
    made = []
    encode = coder.vocab.encode_piece
    monkeypatch.setattr(coder.vocab, "encode_piece", lambda p: made.append(p) or encode(p))
    assert [coder.encode(t) for t in texts] == first and not made
    coder.forget()
    assert not coder.seen and not coder.vocab.n_known
    # Little memory changes no id.
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 20_000)
    assert [coder.encode(t) for t in texts[:20]] == first[:20] == [lib.encode(t, add_special_tokens=False).ids for t in texts[:20]]
    assert coder.seen.held <= 20_500 and coder.vocab.n_known * bpe.PAIR_BYTES <= 20_000
    coder.forget()


# -- 5 -----------------------------------------------------------------------------------


def test_exact_dedup(spark, docs, odd, none):
    norm = lambda t: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
    groups = defaultdict(list)
    for i, t, *_ in odd:
        groups[norm(t)].append((-len(t or ""), i))
    want = sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), i == min(groups[norm(t)])[1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in odd)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_digest_index_levels_and_probes(spark):
    """Five batches in runs of three a level; what was never written is let through by no more than a few filters."""
    rng, want, index = random.Random(4), defaultdict(list), exact_dedup.DigestIndex(spark, memtable=40)
    name = lambda k: hashlib.sha256(str(k).encode()).digest()
    for b in range(5):
        rows = [(name(rng.randrange(400)), rng.randrange(3), 1000 * b + i) for i in range(150)]
        for d, n, i in rows:
            want[d].append((-n, i))
        index.append(spark.createDataFrame(rows, "digest binary, n_points int, doc_id long"))
        assert [len(x) for x in index.levels] == [[1], [2], [0, 1], [1, 1], [2, 1]][b]
    asked = spark.createDataFrame([(name(k), k) for k in range(3000)], "digest binary, k int")
    got = {r["k"]: r["maybe"] for r in index.probe(asked).collect()}
    assert len(got) == 3000 and all(got[k] for k in range(400) if name(k) in want) and sum(got[k] for k in range(400, 3000)) < 260
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.compact().collect()} == {d: (min(v)[1], len(v)) for d, v in want.items()}
    repeated = index.only("n > 1")
    assert {bytes(r["digest"]) for r in repeated.entries().collect()} == {d for d, v in want.items() if len(v) > 1}


def test_filters_beyond_the_broadcast_change_nothing(spark, docs):
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    most = exact_dedup.FILTER_BYTES
    try:
        exact_dedup.FILTER_BYTES = 0
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs, memtable=7, batches=1).collect())) == got
    finally:
        exact_dedup.FILTER_BYTES = most


# -- 6 -----------------------------------------------------------------------------------


def test_language_accuracy(spark, none, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d, keep=("lang",)).filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert language.identify(none).count() == 0
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[16] == "und" and odd[8] == "en"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_letters_are_those_of_category_l():
    """Number forms and fractions are no letters."""
    assert not any(language.has_letter(c) for c in "\u00bd\u00b2\u2167\u24601 _!") and not language.has_letter(None)
    assert all(language.has_letter(f"1 {c}") for c in "a\u00e9\u4e2d\u0431\u00aa")


def test_every_language_is_learned(spark):
    """More languages than 32, one of them rare."""
    rows = [(40 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(107 + k % 11)}" for _ in range(20 + i)), f"l{k:02}", None, 0, "", 0) for k in range(45) for i in range(40 if k else 12)]
    model = language.train(spark.createDataFrame(rows, DOCS))
    assert model.languages == [f"l{k:02}" for k in range(45)] and model.code.shape[1] == 48
    assert model.predict([r[1] for r in rows])[0].tolist() == [r[2] for r in rows]


def test_codewords_correct_errors():
    for n in (2, 3, 4, 6, 9):
        c = language.codewords(n)
        assert len({tuple(r) for r in c}) == n
    far = min((a != b).sum() for i, a in enumerate(language.codewords(4)) for b in language.codewords(4)[:i])
    assert far >= 3


# -- 7 -----------------------------------------------------------------------------------


def test_suffix_dedup(spark, docs, odd, none):
    W = 200
    seen = Counter()
    for _, t, *_ in odd:
        b = (t or "").encode()
        seen.update(b[p : p + W] for p in range(len(b) - W + 1))
    want = []
    for i, t, *_ in odd:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - W + 1):
            if seen[b[p : p + W]] > 1:
                gone[p : p + W] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == sorted(want)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_maximal_repeats_are_left_diverse():
    r = random.Random(2)
    x = bytes(r.randrange(97, 123) for _ in range(90))
    texts = [b"q" + x, b"w" + x[:60], x[10:80]]
    got = {(n, tuple(sorted(zip(c.tolist(), o.tolist(), strict=True)))) for n, c, o in suffix_dedup.maximal_repeats(texts, np.array([60, 31, 40]), 30)}
    assert (60, ((0, 1), (1, 1))) in got and (70, ((0, 11), (2, 0))) in got
    for n, places in got:
        assert len({texts[c][o : o + n] for c, o in places}) == 1


# -- 8 -----------------------------------------------------------------------------------


def test_base_spans_equal_the_patterns():
    import re

    r = random.Random(8)
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s)), "phone": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15}
    for _ in range(4000):
        t = "".join(r.choice("ab@.1 2-34+()9876500") for _ in range(r.randint(1, 60)))
        want = [(k, m.start(), m.end()) for k, p in pats.items() for m in re.finditer(p, t) if ok[k](m[0])]
        assert pii.base_spans(t) == want, t
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)] and pii.base_spans("1" * 6000 + ".1.1.1") == []


def test_pii_query_and_tagger(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(none).count() == 0
    tagger = pii.trained()
    text = "call me at (555) 123-4567 or from 192 . 168 . 1 . 20 please"
    spans = {(k, text[s:e]) for k, s, e, _ in pii.tagged_spans([text], tagger)[0]}
    assert ("phone", "(555) 123-4567") in spans
    # Forms of the review, and one that stood in the overlap of two windows.
    for text, kind, span in [
        ("pay with 4111.1111.1111.1111 now", "card", "4111.1111.1111.1111"), ("or 4111  1111  1111  1111 then", "card", "4111  1111  1111  1111"),
        ("on the " * 109 + "line (555) 123-4567 is", "phone", "(555) 123-4567"),
    ]:
        assert (kind, span) in {(k, text[s:e]) for k, s, e, _ in pii.tagged_spans([text], tagger)[0]}, text


def test_spans_of_fresh_sentences():
    """Recall and precision of whole spans on sentences that no training step saw."""
    tagger, r = pii.trained(), np.random.default_rng(77)
    found = missed = false = 0
    for _ in range(250):
        s, y = pii.labelled(r, 150)
        begin = np.flatnonzero(y % 2 == 1)
        want = set()
        for b in begin:
            e = b + 1
            while e < len(y) and y[e] == y[b] + 1:
                e += 1
            if e < len(y):
                want.add((pii.KINDS[(y[b] - 1) // 2], int(b), int(e)))
        got = {(k, a, b) for k, a, b, _ in pii.tagged_spans([s], tagger)[0] if b < len(s) - 20}
        found += len(got & want)
        false += len(got - want)
        missed += len([w for w in want - got if w[2] < len(s) - 20])
    assert found / (found + missed) > 0.85 and found / (found + false) > 0.95, (found, missed, false)


def test_decoding_equals_double_precision():
    tagger = pii.trained()
    exact = pii.Tagger.__new__(pii.Tagger)
    exact.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    r = np.random.default_rng(8)
    for length in (1, 2, 160, 1024):
        codes = np.stack([pii.encode(pii.labelled(r, length)[0]) for _ in range(6)])
        path, prob = tagger.decode(codes)
        e, _ = exact.scores(codes)
        best, back = exact.p["start"] + e[:, 0], []
        for t in range(1, length):
            step = best[:, :, None] + exact.p["T"]
            back.append(step.argmax(1))
            best = step.max(1) + e[:, t]
        want = [best.argmax(1)]
        for b in back[::-1]:
            want.append(b[np.arange(6), want[-1]])
        assert (path == np.stack(want[::-1], 1)).all()
        each = np.take_along_axis(exact.marginals(e)[1], path[:, :, None], 2)[:, :, 0]
        some = path.any(1)
        assert np.abs(prob - each)[some].max(initial=0) < 1e-4 and (prob[~some] == 1).all()


def test_spans_at_window_edges_are_whole():
    """A signal in the overlap of two windows opens both; what no window holds is decoded again."""
    for k in range(1, 40):
        at = 96 * k + 5
        assert pii.windows("x" * at + "@" + "x" * 300) == [96 * (k - 1), 96 * k]
    mail = "alice.smith [at] host [dot] org"
    text = "the on is " * 76 + "\n" + mail + " " + "the on is " * 30
    assert text.index(mail) == 761 and pii.windows(text)[0] == 672

    class Marks:
        """Tags every run of '@' in full, wherever a window shows it."""

        def decode(self, codes):
            on = codes == pii.encode("@")[0]
            begin = on & ~np.concatenate([np.zeros((len(on), 1), bool), on[:, :-1]], 1)
            return np.where(begin, 1, np.where(on, 2, 0)), np.ones(on.shape)

    seen, holds = [], pii.holds
    try:
        pii.holds = lambda kind, s: True
        for start, n in [(90, 80), (150, 159), (40, 700), (0, 300), (500, 20)]:
            text = "x" * start + "@" * n + "x" * 400
            seen.append([(s, e) for _, s, e, _ in pii.tagged_spans([text], Marks())[0]] == [(start, start + n)])
    finally:
        pii.holds = holds
    assert all(seen), seen


def test_tagger_gradient():
    t, r = pii.Tagger(), np.random.default_rng(3)
    made = [pii.labelled(r, 20) for _ in range(3)]
    c, y = np.stack([pii.encode(s) for s, _ in made]), np.stack([q for _, q in made])
    _, g = t.loss_and_gradient(c, y)
    for k in t.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        t.p[k][i] += 1e-5
        a = t.loss_and_gradient(c, y)[0]
        t.p[k][i] -= 2e-5
        b = t.loss_and_gradient(c, y)[0]
        t.p[k][i] += 1e-5
        assert (a - b) / 2e-5 * 20 == pytest.approx(g[k][i], rel=1e-4)


# -- 9 -----------------------------------------------------------------------------------


def test_substring_dedup(spark, docs, odd, none):
    W, first = 20, {}
    for i, t, *_ in sorted(odd, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for p in range(len(w) - W + 1):
            first.setdefault(tuple(w[p : p + W]), (i, p))
    want = []
    for i, t, *_ in odd:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - W + 1):
            if first[tuple(w[p : p + W])] < (i, p):
                gone[p : p + W] = [True] * W
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, recompression.substring_dedup(docs).collect())) == sorted(want)
    assert recompression.substring_dedup(none).count() == 0


def brute_windows(rows, W):
    first, out = {}, []
    for i, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - W + 1):
            first.setdefault(tuple(w[p : p + W]), (i, p))
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - W + 1):
            if first[tuple(w[p : p + W])] < (i, p):
                gone[p : p + W] = [True] * W
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "hot"), [(1 << 20, 1 << 16), (300, 3)])
def test_substring_dedup_of_runs_periods_and_long_texts(spark, monkeypatch, chunk, hot):
    """Runs of one word and of two, periodic and long texts over several chunks, few different words, hot anchors."""
    monkeypatch.setattr(recompression, "PIECE", 400)
    r = random.Random(chunk)
    base = [r.choice("abcdefghij") + r.choice("klmnop") for _ in range(900)]
    texts = ["a " * 70, "b " + "a " * 45 + "c", "a b " * 40, "x a b " + "a b " * 22 + "y", "a b c " * 30, "q " + "a b c " * 12, "a a b " * 20, " ".join(base), " ".join(base[100:700]), " ".join(base[:50] + base[400:460] + base[20:45])]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 160))) for _ in range(30)]
    texts += [" ".join(base[k : k + 33] + [f"u{i}"] + base[k + 5 : k + 26]) for i, k in enumerate(r.randrange(800) for _ in range(40))]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    t = spark.createDataFrame([(i, x, None, None, 0, "", 0) for i, x in rows], DOCS)
    got = recompression.substring_dedup(t, with_text=True, chunk=chunk, hot=hot).collect()
    assert sorted((g["doc_id"], g["n_words"], g["n_removed"], g["kept"]) for g in got) == brute_windows(rows, 20)


def test_names_are_global():
    """Runs and pairs of any chunk have one name; in equal stretches the symbols inside the zone are alike."""
    r = np.random.default_rng(6)
    shared = r.integers(1, 40, 60).astype(np.uint64)
    shared[20:29] = 7  # a run that both chunks hold whole
    chunks = []
    for k in range(2):
        names = np.concatenate([r.integers(1, 40, 30 + 7 * k).astype(np.uint64), shared, r.integers(1, 40, 25).astype(np.uint64)])
        n = len(names)
        chunks.append(recompression.Chunk(k, np.array([k]), np.array([0]), np.array([n]), np.arange(n), names, np.zeros(n, bool)))
    at, buckets = [30, 37], 3
    for step in range(1, 5):
        found = [recompression._found(c, step, (1, 2)) for c in chunks]
        asks = [a for c, (_, _, (x, y, _, times)) in zip(chunks, found, strict=True) for a in recompression._asks(c, x, y, times, buckets)]
        t = recompression._table(asks)
        replies = []
        for b in range(buckets):
            part = t.filter(np.array(t.column("bucket")) == b)
            if part.num_rows:
                replies += recompression.answer_keys(buckets, step, 6)(part).to_pylist()
        for c, (a, n, (x, y, place, _)) in zip(chunks, found, strict=True):
            own = pa.Table.from_pylist([x for x in replies if x["chunk"] == c.number], schema=recompression.REPLY_SCHEMA)
            recompression._compressed(c, a, n, recompression._received(own, *recompression._dealt(x, y, buckets))[place])
        zone = recompression.zones()[step]
        inside = []
        for c, s in zip(chunks, at, strict=True):
            ok = (c.starts >= s + zone) & (c.stops <= s + 60 - zone)
            inside.append([(int(p - s), int(q)) for p, q in zip(c.starts[ok], c.names[ok], strict=True)])
        assert inside[0] == inside[1] and inside[0] and all(q for _, q in inside[0])
        if step == 1:
            assert len({q for p, q in inside[0] if p == 20}) == 1 and not any(20 < p < 29 for p, _ in inside[0])
    assert len(inside[0]) < 40


# -- 10 ----------------------------------------------------------------------------------


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    r = random.Random(8)
    a, b, c, d, e = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(80)) for k in "abcde")
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, b + " tail"), (9, e + " tail"), (9, d)]
    t = spark.createDataFrame([(i, x, None, None, 0, "", 0) for i, x in rows], DOCS)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(t).collect())
    assert got == Counter([(None, 76, None)] * 2 + [(None, 76, 8), (7, 76, 7), (7, 76, 7), (8, 77, 8), (9, 77, 7), (9, 76, 7)])
    kept = sorted((str(x["doc_id"]), x["kept"]) for x in recompression.substring_dedup(t, with_text=True).collect())
    assert kept == sorted([("None", a), ("None", b), ("None", c), ("7", d), ("7", e), ("8", "tail"), ("9", "tail"), ("9", "")])
    kept = sorted((str(x["doc_id"]), bytes(x["kept"]).decode()) for x in suffix_dedup.suffix_dedup(t, with_text=True).collect())
    assert kept == sorted([("None", a), ("None", ""), ("None", c), ("7", ""), ("7", ""), ("8", " tail"), ("9", " tail"), ("9", "")])


def test_topk(spark, none):
    r = np.random.default_rng(9)
    v = r.normal(0, 0.3, (400, 24)).round(2)
    rows = [(i, [float(x) for x in v[i % 300]], 1) for i in range(400)] + [(401, None, 1), (420, [float("nan")] * 24, 1), (440, [None] * 24, 1), (460, [0.5, 0.5], 1), (461, [0.5, 0.25], 1), (480, [], 1), (481, [], 1), (0, [float(x) for x in v[0]], 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for x in topk.top_k(df, k=7, block=64).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    ok = [(i, np.floor(64 * np.array(e))) for i, e, _ in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    for q, e in {i: e for i, e in ok if i % 20 == 0}.items():
        want = sorted(((i, int(e @ c)) for i, c in ok if i != q and len(c) == len(e)), key=lambda x: (-x[1], x[0]))[:7]
        assert got[q] == want, q
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    """Products that a double or a long does not hold."""
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (20, [1e9, 1.0]), (21, [1e9, 2.0]), (22, [1e9, 1.0]), (23, [1e308, 1.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    most = (1 << 63) - 1
    assert got[0, 1] == got[20, 0] == most and got[0, 2] == -most - 1 and got[20, 21] == most and (0, 23) not in got
    small = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, 1.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()]
    assert got == [(0, 1, 1, 64000000**2 + 64 * 128), (0, 2, 2, 64000000**2 + 64 * 64)]


def test_segment_bounds():
    r = np.random.default_rng(2)
    q, c = r.normal(size=(20, 30)), r.normal(size=(50, 30))
    for s in (1, 4, 7, 30, 64):
        assert (topk.segment_stats(q, s) @ topk.segment_stats(c, s).T >= q @ c.T - 1e-9).all()


def test_shared_folder_is_the_named_one(spark):
    assert new_dir(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file:///tmp/checkpoints/")
