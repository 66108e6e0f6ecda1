"""The pipeline against a plain version of its stages."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from factlake.llm import bpe, language, mixing

from .test_operators import SMALL, shingles


def test_stages_take_effect(spark):
    raw = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = raw.unionByName(spark.createDataFrame([(900001, None, "en", "src1", 0), (900002, "123 !!", "en", "src1", 0)], raw.schema))
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {i: r["text"] for i, r in rows.items() if language.has_letter(r["text"])}
    a = P.identify_language(spark, docs, SMALL)
    assert a.columns == list(P.COLUMNS) and {r["doc_id"] for r in a.collect()} == set(kept)
    groups = defaultdict(list)
    for i, t in kept.items():
        groups["".join(t.split(" ")).translate({ord(c): None for c in "\t\n\x0b\x0c\r"})].append((-len(t), i))
    kept = {i: kept[i] for i in (min(g)[1] for g in groups.values())}
    b = P.drop_exact_copies(spark, a, SMALL)
    assert {r["doc_id"] for r in b.collect()} == set(kept)
    sets = {i: shingles(t) for i, t in kept.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    c = P.drop_near_copies(spark, b, SMALL)
    assert {r["doc_id"] for r in c.collect()} == set(kept)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(c).collect()}
    d = P.mix_sources(spark, c, SMALL)
    got = Counter(r["doc_id"] for r in d.collect())
    assert got == Counter({i: n for i, n in copies.items() if n})
    e = P.encode_tokens(spark, d, SMALL).collect()
    coder = bpe.encoder(P.vocabulary_path())
    assert Counter(r["doc_id"] for r in e) == got and all(r["n_tokens"] == len(coder.encode(kept[r["doc_id"]])) for r in e)


def test_empty_tables_pass(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in P.STAGES:
        empty = step(spark, empty, SMALL)
    assert empty.count() == 0


def test_unlabelled_corpus_passes_language_id(spark):
    rows = [(1, "some words", None, "s", 1), (2, "123 !!", None, "s", 1), (3, None, None, "s", 1), (None, "été", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.identify_language(spark, docs, SMALL).collect()} == {1, None}


def test_null_and_repeated_ids_lose_no_document(spark):
    """Rows are known by a key of the row, not by doc_id."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    rows = [(0, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "d"), (None, "a"), (None, "d"), (2, "e"), (2, "f"), (2, "f")]
    docs = spark.createDataFrame([(i, texts[k], "en", "s", 1) for i, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted((str(i), texts[k]) for i, k in [(None, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e"), (2, "f")])
    b = P.drop_exact_copies(spark, docs, SMALL)
    assert sorted((str(r["doc_id"]), r["text"]) for r in b.collect()) == want
    c = P.drop_near_copies(spark, b, SMALL)
    assert sorted((str(r["doc_id"]), r["text"]) for r in c.collect()) == want
    assert sorted((str(r["doc_id"]), r["text"]) for r in P.mix_sources(spark, c, SMALL).collect()) == want
