"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For each prefix of a piece there is one last token of its encoding. Going through the piece, the
automaton of all tokens gives the tokens that end at each position, longest first; a token is the
prefix's last one if it is compatible with the last token of the prefix before it. Following the
last tokens back from the end emits the ids. Two tokens are compatible when no merge across their
border would happen before both are complete; this is tested once per pair and remembered.

The automaton keeps, for each position, suffix links to every token that ends there; its size is
that of the vocabulary. Pieces come from the tokenizer's own split of the text. What a task remembers of
pieces and pairs is bounded in bytes (``REMEMBERED``) and forgotten at the end of the task, so that an
idle worker holds the vocabulary and nothing else; it changes no result.

Defined results: a null text is empty and has no ids; special tokens in a text are encoded as
such. Ties cannot occur. Decoding replaces invalid UTF-8 by U+FFFD, as the library does.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import fresh, light, prepare

#: The split that byte-level pre-tokenizers make (fixed value of the file format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most bytes that remembered pieces take, and most that remembered pairs take.
REMEMBERED, REMEMBERED_PAIRS = 96 << 20, 24 << 20
#: Bytes of a remembered pair, and of a remembered piece besides 4 for each of its bytes and 8 for each id (the ids are
#: the automaton's own objects).
PAIR_BYTES, PIECE_BYTES = 112, 200
#: Stands before the first token of a piece and is compatible with all.
NOTHING = -1
#: Pieces longer than this are not remembered.
LONG = 64


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable bytes stand for themselves, others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the automaton of a byte-level BPE file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], byte_letters()
        self.token: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for text, i in self.special.items():
            self.token[i] = text.encode()
        ids = model["vocab"]
        #: (left, right) -> (rank, made); made -> (rank, left, right)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, out = ids[a], ids[b], ids[a + b]
            self.merge.setdefault((left, right), (rank, out))
            self.made.setdefault(out, (rank, left, right))
        self.automaton = ahocorasick.Automaton()
        #: For each token whether those before it are compatible, as far as known, and how many pairs that are.
        self.known: list[dict[int, bool]] = []
        self.n_known = 0
        for t, i in ids.items():
            b = self.token[i]
            if len(b) == 1 or i in self.made:
                self.known.append({NOTHING: True})
                self.automaton.add_word(b.decode("latin-1"), (i, len(b), self.known[-1]))
        self.automaton.make_automaton()
        self.whole = {self.token[i].decode("latin-1"): i for i in ids.values() if len(self.token[i]) == 1 or i in self.made}
        self.edges: tuple[dict, dict] = ({}, {})
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The symbols that stand at a border of the token while it is built: (symbol, rank at which it is merged away)."""
        memo = self.edges[right]
        if token not in memo:
            at, steps = token, [(token, float("inf"))]
            while at in self.made:
                rank, a, b = self.made[at]
                at = b if right else a
                steps.append((at, rank))
            memo[token] = steps[::-1]
        return memo[token]

    def forget(self) -> None:
        """Drop what is remembered of pairs."""
        if self.n_known:
            for pairs in self.known:
                if len(pairs) > 1:
                    pairs.clear()
                    pairs[NOTHING] = True
        self.n_known = 0

    def _learn(self, left: int, right: int, pairs: dict[int, bool]) -> bool:
        """Remember among the right one's pairs whether it stays apart from the left one."""
        if self.n_known * PAIR_BYTES >= REMEMBERED_PAIRS:
            self.forget()
        self.n_known += 1
        apart = pairs[left] = self._stays_apart(left, right)
        return apart

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge over the border of the pair comes before both sides' own."""
        a, b = self._edge(left, True), self._edge(right, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            merge = self.merge.get((x, y))
            # Equal ranks go from left to right: the left side's own merge is first, the right side's is last.
            if merge and merge[0] < x_ends and merge[0] <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            if y_ends <= x_ends:
                j += 1

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece given as bytes in latin-1."""
        found = self.whole.get(piece)
        if found is not None:  # the longest match at the last position is the piece itself
            return (found,)
        n, learn = len(piece), self._learn
        last = [None] * n
        last.append(NOTHING)  # found at -1, before the first position
        for end, (token, size, pairs) in self.automaton.iter(piece):
            if last[end] is None:
                before = last[end - size]
                apart = pairs.get(before)
                if apart or (apart is None and learn(before, token, pairs)):
                    last[end] = token
        out, at, token = [], n - 1, self.token
        while at >= 0:
            out.append(last[at])
            at -= len(token[last[at]])
        return tuple(out[::-1])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces(dict):
    """Piece -> ids; what is not remembered is encoded, and remembered unless it is long."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.held = vocab, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        plain = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1")
        ids = self.vocab.encode_piece(plain)
        if len(piece) <= LONG:
            self.held += PIECE_BYTES + 4 * len(piece) + 8 * len(ids)
            if self.held > REMEMBERED:
                self.forget()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0


class Encoder:
    """Encodes whole texts, remembering pieces."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.seen = vocab, Pieces(vocab)

    def forget(self) -> None:
        """Drop all that was remembered."""
        self.seen.forget()
        self.vocab.forget()
        self.vocab.edges = ({}, {})

    def _plain(self, text: str, out: list[int]) -> None:
        out += chain.from_iterable(map(self.seen.__getitem__, self.vocab.split.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.vocab.specials is None or not any(s in text for s in self.vocab.special):
            self._plain(text, out)
            return out
        for part in self.vocab.specials.split(text):
            if part in self.vocab.special:
                out.append(self.vocab.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        token = self.vocab.token
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def bpe_round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded), after the columns ``keep``, one row a document."""
    prepare(docs.sparkSession)
    kept = [c for c in keep if c != "doc_id"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(
        [f"`{c}` {fields[c]}" for c in ["doc_id", *kept]]
        + ["n_tokens long, ids_sha256 string, decoded_sha256 string"]
        + ["ids array<int>, decoded string"] * with_ids
    )

    def run(it):
        coder = encoder(path)
        try:
            yield from encoded(coder, it)
        finally:
            coder.forget()

    def encoded(coder, it):
        for batch in it:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                row = [
                    len(ids),
                    hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(),
                ]
                rows.append(row + [ids, decoded] * with_ids)
            import pyarrow as pa

            cols = [batch.column(c) for c in ["doc_id", *kept]]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols += [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *kept, *names])

    need = fresh(docs, *dict.fromkeys(["doc_id", "text", *kept]))
    return need.mapInArrow(light(run), schema)
