"""Language identification with error-correcting output codes.

Each learned language has a codeword; one binary logistic classifier on hashed character n-grams
predicts each bit. Decoding weighs the loss of every bit: the language with the smallest summed
logistic loss wins; a text is ambiguous when the runner-up is nearly as close.

Learning takes a bounded sample of the labelled rows: from each language about ``PER_LANGUAGE``
documents, chosen by a hash of their identifiers; of more than ``FULL_LANGUAGES`` languages each gives
fewer, so that the rows in memory stay bounded, but ``LEAST_PER_LANGUAGE`` or all it has. Every language
is learned. Prediction covers every row and whole texts.

Defined results: ``und`` with score 0 for a null text or one without a letter. Without a single
labelled row every text is ``und`` (``letters_only`` gives the model that tells letters alone). lang, source and doc_id are no inputs of a prediction; other
columns are ignored; an empty table gives an empty result. Equal losses go to the language that
sorts first. A null doc_id counts as text '' in the split.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, light, mix64, prepare, stage

#: Hashed features: n-grams of 1 to 3 bytes of the lower-cased text.
FEATURES = 1 << 12
PER_LANGUAGE = 600
LEAST_PER_LANGUAGE = 40
#: Up to so many languages give PER_LANGUAGE documents each.
FULL_LANGUAGES = 32
#: Bits of a codeword for 7 to 32 languages; more have BITS_PER_DOUBLING for each doubling of their
#: number; up to six, all distinct splits are used.
CODE_BITS = 40
BITS_PER_DOUBLING = 8
EPOCHS = 120
#: Ambiguous: the runner-up's mean loss per bit is at most this much larger.
MARGIN = 0.05
HELD_OUT = 1
UNKNOWN = "und"
#: A letter is a character of Unicode category L: number forms and fractions are none.
_LETTER = regex.compile(r"\p{L}")
_SEEDS = mix64(np.arange(1, 4, dtype=np.uint64))


def split_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of n-gram frequencies, square-rooted and of unit length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        a = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        # Whatever is no letter counts as one blank; digits and marks tell nothing.
        a = np.where((a < 97) & (a < 128), np.uint8(32), a).astype(np.uint32)
        row = np.zeros(FEATURES, np.int64)
        for n in range(1, 4):
            if len(a) >= n:
                code = np.zeros(len(a) - n + 1, np.uint32)
                for k in range(n):
                    code = (code << np.uint32(8)) | a[k : len(a) - n + 1 + k]
                code = (code + np.uint32(n)) * np.uint32(2654435761)
                row += np.bincount(code >> np.uint32(20), minlength=FEATURES)
        x = np.sqrt(row)
        out[i] = x / max(np.linalg.norm(x), 1e-9)
    return out


def codewords(n: int) -> np.ndarray:
    """One row of +-1 for each of n classes: exhaustive for few classes, else seeded and spread."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cols = [c for c in itertools.product([-1, 1], repeat=n) if c[0] == 1 and min(c) == -1]
        return np.array(cols, float).T
    best, rng = None, np.random.default_rng(7)
    bits = max(CODE_BITS, BITS_PER_DOUBLING * (n - 1).bit_length())
    for _ in range(200 if n <= 1000 else 10):
        code = rng.choice([-1.0, 1.0], (n, bits))
        alike = code @ code.T
        np.fill_diagonal(alike, -bits)
        near = (bits - alike.max()) / 2
        if best is None or near > best[0]:
            best = (near, code)
    return best[1]


class CodeModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.code, self.weights, self.bias = languages, code, weights, bias

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Mean logistic loss of every codeword, row by row."""
        margin = x @ self.weights + self.bias
        return np.stack([np.logaddexp(0, -margin * c).mean(1) for c in self.code], 1)

    def predict(self, texts: list[str | None]):
        """(languages, scores 0..1, ambiguous)."""
        n = len(texts)
        lang, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
        ok = np.array([has_letter(t) for t in texts], bool)
        if self.languages and ok.any():
            loss = self.losses(features([t for t, k in zip(texts, ok, strict=True) if k]))
            best = loss.argmin(1)
            p = np.exp(-loss * self.code.shape[1])
            lang[ok] = np.array(self.languages, object)[best]
            score[ok] = np.clip(p[np.arange(len(p)), best] / np.maximum(p.sum(1), 1e-300), 0, 1)
            two = np.sort(loss, 1)[:, :2]
            unsure[ok] = len(self.languages) > 1 and (two[:, -1] - two[:, 0] < MARGIN)
        return lang, score, unsure


def fit(texts: list[str], labels: list[str]) -> CodeModel:
    """Logistic regression for all bits at once, by accelerated gradient steps."""
    return fit_features(features(texts), labels)


def fit_features(x: np.ndarray, labels: list[str]) -> CodeModel:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return CodeModel(languages, code, np.zeros((FEATURES, code.shape[1]), np.float32), np.ones(code.shape[1]))
    place = {v: i for i, v in enumerate(languages)}
    number = np.array([place[v] for v in labels])
    y = code[number].astype(np.float32)
    # Languages weigh alike, however many rows each has.
    row = (1.0 / np.bincount(number, minlength=len(languages)))[number][:, None].astype(np.float32) / np.float32(len(languages))
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 6.0
    for _ in range(EPOCHS):
        m = y * (x @ w + b)
        g = -y * row / (1 + np.exp(np.clip(m, -30, 30)))
        vw = np.float32(0.9) * vw - np.float32(rate) * (x.T @ g + np.float32(1e-5) * w)
        vb = np.float32(0.9) * vb - np.float32(rate) * g.sum(0)
        w, b = w + vw, b + vb
    return CodeModel(languages, code, w.astype(np.float32), b)


def letters_only() -> CodeModel:
    """Learned from nothing: one name for whatever has a letter, ``und`` for the rest."""
    return fit_features(np.zeros((0, FEATURES), np.float32), ["?"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> CodeModel:
    """Learn from rows with a lang whose split is not HELD_OUT: a bounded sample of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (split_of() != HELD_OUT))
    counts = stage(rows.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n_rows")), "languages")
    n = counts.count()
    if not n:
        return fit_features(np.zeros((0, FEATURES), np.float32), [])
    if n > FULL_LANGUAGES:
        per_language = min(per_language, max(LEAST_PER_LANGUAGE, per_language * FULL_LANGUAGES // n))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n_rows"))
    sample = rows.join(F.broadcast(counts), F.col("lang") == F.col("name")).filter(unit < share)

    def run(it):
        for pdf in it:
            keep = pdf[pdf["text"].map(has_letter)]
            if not len(keep):
                continue
            x = features(list(keep["text"])).astype(np.float16)
            yield pd.DataFrame({"lang": list(keep["lang"]), "order": list(keep["doc_id"]), "x": [v.tobytes() for v in x]})

    got = sample.select("doc_id", "lang", "text").mapInPandas(run, "lang string, order long, x binary").collect()
    got.sort(key=lambda r: (r["order"] is not None, r["order"] or 0, r["lang"], r["x"]))
    if not got:
        return fit_features(np.zeros((0, FEATURES), np.float32), [])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return fit_features(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: CodeModel | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, held_out, lang_pred, score, ambiguous for every row."""
    prepare(docs.sparkSession)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in dict.fromkeys(["text", *keep]) if c != "doc_id"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(it):
        import pyarrow as pa

        for batch in it:
            lang, score, unsure = [], [], []
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 512):
                p, q, r = shared.value.predict(texts[a : a + 512])
                lang, score, unsure = lang + p.tolist(), score + q.tolist(), unsure + r.tolist()
            cols = [batch.column(c) for c in ["doc_id", *keep, "held_out"] if c in batch.schema.names]
            cols += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*dict.fromkeys(["doc_id", *keep, "held_out"]), "lang_pred", "score", "ambiguous"])

    need = fresh(docs, "doc_id", *kept).withColumn("held_out", split_of() == HELD_OUT)
    out = [f"`{c}` {fields[c]}" for c in dict.fromkeys(["doc_id", *keep])]
    return need.mapInArrow(light(run), ", ".join([*out, "held_out boolean, lang_pred string, score double, ambiguous boolean"]))
