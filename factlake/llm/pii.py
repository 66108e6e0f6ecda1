"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions.

The base spans are fixed by patterns and tests (see ``base_spans``). A tagger in numpy adds spans of
the same kinds that the patterns cannot express: two LSTMs read a window of characters forwards and
backwards, a linear layer scores begin/inside tags of each kind, and a CRF with learnt transitions
gives the best tag sequence. It is trained here from labelled spans in invented sentences.

Texts are read whole. A labelled span holds a digit, an ``@`` or the word "at": windows without any of them
hold nothing that the labels know and are not decoded. Windows overlap by OVERLAP characters;
their spans are reconciled over the whole text: a span cut by a window's edge gives way to the
window that sees it whole, or is decoded again in a window around it that grows until it does; the better-scored of two overlapping spans stays, and a span that
touches a base span is dropped. What is a span is decided by the CRF: a tagged span counts above ``LEAST`` mean tag
probability, and only what its kind defines by arithmetic is tested besides (``holds``: the number of digits, Luhn's
sum, parts of at most 255), which a tagger cannot compute.

Defined results: a null text is empty and has no spans. Repeated rows give equal results; other
columns are ignored; an empty table gives an empty result. The counts are those of the base spans.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import fresh, light, prepare

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, not overlapping within a kind.

    The local part of an address is taken backwards from its sign, which finds the leftmost match
    in time linear in the text.
    """
    out, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


# --- tagger ---------------------------------------------------------------------------------

HIDDEN, EMBED = 24, 12
WINDOW, OVERLAP = 160, 64
STEPS, BATCH, LENGTH, RATE = 520, 32, 84, 0.012
LEAST = 0.9
SEED = 11

_ALPHABET = "abcdefghijklmnopqrstuvwxyz@.-_+()/:;,!?'\"[]{}#%&*=<>|\\~^$` \n\t"
_CODE = np.full(0x180, 1, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i + 4
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CODE[ord(_c)] = _CODE[ord(_c.lower())]
for _c in "0123456789":
    _CODE[ord(_c)] = 2
N_CODES = len(_ALPHABET) + 4


def encode(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(a < len(_CODE), _CODE[np.minimum(a, len(_CODE) - 1)], 3)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Parameters of both LSTMs, the linear layer and the CRF."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        k = len(TAGS)
        self.p = {"E": r.normal(0, 0.3, (N_CODES, EMBED))}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.2, (EMBED + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p |= {"V": r.normal(0, 0.2, (2 * HIDDEN, k)), "v": np.zeros(k), "T": np.zeros((k, k)), "start": np.zeros(k)}

    def _lstm(self, x, w, c0, keep: bool):
        b, n, _ = x.shape
        h, c, hs, cache = np.zeros((b, HIDDEN), x.dtype), np.zeros((b, HIDDEN), x.dtype), np.empty((b, n, HIDDEN), x.dtype), []
        xw = x @ w[:EMBED] + c0
        wh = w[EMBED:]
        for t in range(n):
            z = xw[:, t] + h @ wh
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, h0 = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[:, t] = h
            if keep:
                cache.append((i, f, o, g, before, tc, h0))
        return hs, cache

    def _lstm_back(self, dh_all, x, w, cache):
        b, n, _ = x.shape
        dw, dc0, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.empty_like(x)
        dh, dc = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
        for t in range(n - 1, -1, -1):
            i, f, o, g, before, tc, h0 = cache[t]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            dw[:EMBED] += x[:, t].T @ dz
            dw[EMBED:] += h0.T @ dz
            dc0 += dz.sum(0)
            dx[:, t] = dz @ w[:EMBED].T
            dh, dc = dz @ w[EMBED:].T, dc * f
        return dw, dc0, dx

    def scores(self, codes: np.ndarray, keep: bool = False):
        p = self.p
        x = p["E"][codes]
        hf, cf = self._lstm(x, p["Wf"], p["cf"], keep)
        hb, cb = self._lstm(x[:, ::-1], p["Wb"], p["cb"], keep)
        h = np.concatenate([hf, hb[:, ::-1]], 2)
        return h @ p["V"] + p["v"], (x, h, cf, cb)

    def marginals(self, e: np.ndarray):
        """Log partition, tag probabilities and summed transition probabilities of the CRF."""
        p, (b, n, k) = self.p, e.shape
        lse = lambda m, axis: (mx := m.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(m - mx).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = p["start"] + e[:, 0]
        for t in range(1, n):
            alpha[:, t] = e[:, t] + lse(alpha[:, t - 1][:, :, None] + p["T"], 1)
        for t in range(n - 2, -1, -1):
            beta[:, t] = lse(p["T"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        prob = np.exp(alpha + beta - z[:, None, None])
        return z, prob, alpha, beta

    def loss_and_gradient(self, codes, tags):
        p, (b, n) = self.p, codes.shape
        e, (x, h, cf, cb) = self.scores(codes, True)
        z, prob, alpha, beta = self.marginals(e)
        at = np.arange(b)[:, None], np.arange(n)[None, :], tags
        gold = p["start"][tags[:, 0]] + e[at].sum(1) + p["T"][tags[:, :-1], tags[:, 1:]].sum(1)
        de = prob.copy()
        de[at] -= 1
        dT = np.zeros_like(p["T"])
        for t in range(n - 1):
            dT += np.exp(alpha[:, t][:, :, None] + p["T"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dT, (tags[:, :-1], tags[:, 1:]), -1)
        ds = prob[:, 0].sum(0)
        np.add.at(ds, tags[:, 0], -1)
        g = {"T": dT, "start": ds, "V": np.einsum("bnh,bnk->hk", h, de), "v": de.sum((0, 1))}
        dh = de @ p["V"].T
        g["Wf"], g["cf"], dxf = self._lstm_back(dh[:, :, :HIDDEN], x, p["Wf"], cf)
        g["Wb"], g["cb"], dxb = self._lstm_back(dh[:, ::-1, HIDDEN:], x[:, ::-1], p["Wb"], cb)
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], codes, dxf + dxb[:, ::-1])
        return float((z - gold).mean()) / n, {k: v / b for k, v in g.items()}

    def light(self) -> Tagger:
        """The same parameters in single precision, for decoding."""
        out = Tagger.__new__(Tagger)
        out.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return out

    def fit(self, steps: int = STEPS, seed: int = SEED) -> Tagger:
        """Adam over batches of labelled sentences."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            made = [labelled(r, LENGTH) for _ in range(BATCH)]
            _, g = self.loss_and_gradient(np.stack([encode(s) for s, _ in made]), np.stack([y for _, y in made]))
            scale = min(1.0, 5.0 / max(np.sqrt(sum((x**2).sum() for x in g.values())), 1e-9))
            rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x * scale
                v[k] = 0.99 * v[k] + 0.01 * (x * scale) ** 2
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """The scores of ``scores`` as (place, tag, window): both LSTMs step by step in arrays that stay in the cache."""
        p, (b, n) = self.p, codes.shape
        kind = p["v"].dtype
        half = np.ones((4 * HIDDEN, 1), kind)
        half[: 3 * HIDDEN] = 0.5  # a sigmoid is a tanh of half the value
        # Columns: the state, the character, one for the bias.
        w = np.stack([np.concatenate([p["W" + d][EMBED:], p["W" + d][:EMBED], p["c" + d][None]]).T * half for d in "fb"])
        v = np.stack([p["V"][:HIDDEN].T, p["V"][HIDDEN:].T])
        x = np.ascontiguousarray(p["E"][codes].transpose(1, 2, 0))
        e = np.empty((n, len(TAGS), b), kind)
        e[:] = p["v"][:, None]
        held = np.zeros((2, HIDDEN + EMBED + 1, b), kind)
        held[:, -1] = 1
        h, c, z, part = held[:, :HIDDEN], np.zeros((2, HIDDEN, b), kind), np.empty((2, 4 * HIDDEN, b), kind), np.empty((2, len(TAGS), b), kind)
        s = z[:, : 3 * HIDDEN]
        i, f, o, g = (z[:, q * HIDDEN : (q + 1) * HIDDEN] for q in range(4))
        for t in range(n):
            held[0, HIDDEN:-1], held[1, HIDDEN:-1] = x[t], x[n - 1 - t]
            np.matmul(w, held, out=z)
            np.tanh(z, out=z)
            s += 1
            s *= 0.5
            c *= f
            i *= g
            c += i
            np.tanh(c, out=h)
            h *= o
            np.matmul(v, h, out=part)
            e[t] += part[0]
            e[n - 1 - t] += part[1]
        return e

    def decode(self, codes: np.ndarray):
        """Best tag sequence of each window and the probability of each of its tags."""
        e, p = self.emissions(codes), self.p
        n, k, b = e.shape
        best = np.empty_like(e)
        best[0] = p["start"][:, None] + e[0]
        for t in range(1, n):
            most = best[t - 1, 0] + p["T"][0][:, None]
            for j in range(1, k):
                np.maximum(most, best[t - 1, j] + p["T"][j][:, None], out=most)
            np.add(most, e[t], out=best[t])
        # The way back is found again from the scores.
        path = np.empty((b, n), np.int64)
        path[:, -1] = best[-1].argmax(0)
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = (best[t - 1] + p["T"][:, path[:, t]]).argmax(0)
        prob = np.ones((b, n), e.dtype)
        some = path.any(1)  # windows without a tag need no probabilities
        if some.any():
            prob[some] = self.path_probabilities(e[:, :, some].astype(np.float64), path[some])
        return path, prob

    def path_probabilities(self, e: np.ndarray, path: np.ndarray) -> np.ndarray:
        """The probability of each tag of the paths, as ``marginals`` gives it; scaled at each place instead of kept as logarithms."""
        n, _, b = e.shape
        start, steps = (self.p[q].astype(np.float64) for q in ("start", "T"))
        e[0] += start[:, None]
        e = np.exp(e - e.max(1, keepdims=True))
        steps = np.exp(steps - steps.max())
        alpha, beta = np.empty_like(e), np.ones((len(steps), b))
        alpha[0] = e[0] / e[0].sum(0)
        for t in range(1, n):
            now = (steps.T @ alpha[t - 1]) * e[t]
            alpha[t] = now / now.sum(0)
        out, every = np.empty((b, n)), np.arange(b)
        for t in range(n - 1, -1, -1):
            both = alpha[t] * beta
            out[:, t] = both[path[:, t], every] / both.sum(0)
            beta = steps @ (e[t] * beta)
            beta /= beta.sum(0)
        return out


#: Signs that stand for "@" and "." in addresses, and between the parts of numbers. Forms that tests hold out combine them anew.
AT = ("@", "@", "@", " @ ", "@ ", " @", "[at]", " [at] ", "(at)", " (at) ", "{at}", " {at} ", " AT ", " at ")
DOT = (".", ".", " . ", "[.]", "[dot]", " [dot] ", "(dot)", " (dot) ", " dot ", " DOT ")
IP_DOT = (".", " . ", "[.]", "(.)", " .", ". ", "[dot]", " dot ")
CARD_GAP = (" ", "-", "", ".", "  ", " - ", "/", "_", ", ")
PHONE_GAP = (" ", "-", ".", "/", "  ", " - ")


def labelled(r: np.random.Generator, length: int) -> tuple[str, np.ndarray]:
    """An invented sentence of exactly ``length`` characters and its tags."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    word = lambda: "".join(pick("re", "an", "the", "on", "is", "ou", "st", "le", "er", "ti", "ka", "mo", "be", "de") for _ in range(int(r.integers(1, 4))))
    num = lambda n: "".join(str(int(d)) for d in r.integers(0, 10, n))

    one = lambda *makers: pick(*makers)()

    def email():
        local = one(word, lambda: f"{word()}.{word()}", lambda: f"{word()}{num(2)}", lambda: f"{word()}_{word()}", lambda: f"{word()}-{word()}.{num(1)}", lambda: f"{pick('j', 'k', 'm')}.{word()}+{word()}")
        host = one(word, lambda: f"{word()}-{word()}", lambda: f"{word()}{num(1)}", lambda: f"{word()}.{word()}")
        sign = pick(*AT)
        # A bare word "at" makes an address only together with a written dot.
        dot = pick(*DOT[4:]) if sign.strip().lower() == "at" else pick(*DOT)
        s = local.replace(".", pick(".", ".", dot)) + sign + host.replace(".", dot) + dot + pick("com", "org", "net", "de", "example", "co.uk", "io")
        return s.upper() if r.random() < 0.1 else s

    def card():
        size = pick(16, 16, 16, 16, 19, 18)
        d = num(size - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        cuts = pick((4, 8, 12), (4, 8, 12), (6,), (4, 10), (8,), (4, 8, 12, 16))
        return pick(*CARD_GAP).join(d[i:j] for i, j in zip((0, *cuts), (*cuts, size), strict=True) if i < size)

    def phone():
        g = pick(*PHONE_GAP)
        head = one(
            lambda: f"+{num(pick(1, 2, 3))}", lambda: f"00{num(2)}", lambda: f"({num(3)})", lambda: f"+{num(1)}{g}({num(3)})",
            lambda: f"0{num(pick(2, 3))}{g}{num(3)}", lambda: f"{num(3)}{pick('-', '.')}{num(3)}", lambda: f"+{num(2)}{g}(0){num(2)}",
        )
        tail = one(lambda: f"{num(3)}{g}{num(4)}", lambda: f"{num(3)}{g}{num(2)}{g}{num(2)}", lambda: num(6), lambda: num(7), lambda: f"{num(3)}-{num(4)}")
        return head + (pick("", g, " ") if head.endswith(")") else g) + tail

    def other():
        at = pick("at", "At", "dot", "AT")
        return one(
            lambda: num(1), lambda: num(2), lambda: num(4), lambda: f"{num(2)}.{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)},{num(3)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"#{num(5)}",
            lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(1)}.{num(2)}.{num(4)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: num(12), lambda: num(9), lambda: f"@{word()}", lambda: f"{num(3)}%",
            lambda: f"{num(2)} - {num(2)}", lambda: f"{num(3)}, {num(3)}, {num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(1)} {num(2)} {num(3)}", lambda: f"{num(2)}.{num(4)}, {num(2)}.{num(4)}", lambda: f"{at} {num(2)}", lambda: at,
            lambda: f"{word()} {at} {word()}", lambda: f"{word()} {at} {word()}", lambda: f"a{num(2)}c{num(5)}f{num(3)}", lambda: f"AK{num(1)}X{num(4)}Q", lambda: f"{at} {word()}. {word()}", lambda: f"{word()} . {word()}", lambda: f"key={num(2)}b{num(4)}e{num(2)}",
        )

    def item():
        kind = pick(*KINDS, "none", "none", "none")
        if kind == "ip":
            return kind, pick(*IP_DOT).join(str(int(x)) for x in r.integers(0, 256, 4))
        made = {"email": email, "card": card, "phone": phone}
        return (kind, made[kind]()) if kind in made else (None, other())

    text, tags = "", []
    while len(text) < length:
        if r.random() < 0.3:
            kind, s = item()
            b = 0 if kind is None else TAGS.index(f"B-{kind}")
            tags += [b] + [b + 1 if b else 0] * (len(s) - 1)
        else:
            s = word()
            s = s.capitalize() if r.random() < 0.2 else s
            tags += [0] * len(s)
        text += s
        gap = pick(" ", " ", " ", ", ", ". ", "\n", ": ")
        text += gap
        tags += [0] * len(gap)
    return text[:length], np.array(tags[:length])


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return Tagger().fit().light()


#: What every labelled span holds.
_SIGNAL = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")


def windows(text: str):
    """Starts of the overlapping windows in which there is anything to tag."""
    out, last = [], -1
    step = WINDOW - OVERLAP
    for m in _SIGNAL.finditer(text):
        for w in sorted({max(0, m.start() - OVERLAP) // step, m.start() // step}):
            if w > last and w * step <= m.start() < w * step + WINDOW:
                out.append(w * step)
                last = w
    return out


def holds(kind: str, s: str) -> bool:
    """Whether the digits of a tagged span are what its kind defines by arithmetic; how they are written is the tagger's to tell."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _by_job(texts: list[str], jobs: list[tuple[int, int, int]], tagger: Tagger) -> list[list]:
    """(whole, score, kind, start, end) of the spans in each window (text, start, length)."""
    found: list[list] = [[] for _ in jobs]
    by_length: dict[int, list[int]] = {}
    for j, (_, _, length) in enumerate(jobs):
        by_length.setdefault(length, []).append(j)
    for length, of in by_length.items():
        some = max(1, 256 * WINDOW // length)
        for a in range(0, len(of), some):
            part = of[a : a + some]
            codes = np.zeros((len(part), length), np.int64)
            for r, j in enumerate(part):
                i, w, _ = jobs[j]
                c = encode(texts[i][w : w + length])
                codes[r, : len(c)] = c
            path, prob = tagger.decode(codes)
            for r, t0 in zip(*np.nonzero((path % 2 == 1) & (path > 0)), strict=True):
                i, w, _ = jobs[part[r]]
                kind, end = KINDS[(path[r, t0] - 1) // 2], t0 + 1
                while end < length and path[r, end] == path[r, t0] + 1:
                    end += 1
                whole = (t0 > 0 or w == 0) and (end < length or w + length >= len(texts[i]))
                end_at = min(w + end, len(texts[i]))
                found[part[r]].append((bool(whole), float(prob[r, t0:end].mean()), kind, int(w + t0), int(end_at)))
    return found


def _decoded(texts: list[str], jobs: list[tuple[int, int, int]], tagger: Tagger) -> list[list]:
    """The spans of all windows, text by text."""
    found: list[list] = [[] for _ in texts]
    for (i, _, _), spans in zip(jobs, _by_job(texts, jobs, tagger), strict=True):
        found[i] += spans
    return found


def _joined_places(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of places as sorted disjoint places (touching ones join)."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(places):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cut_places(spans) -> list[tuple[int, int]]:
    """Where windows cut spans that no window holds whole."""
    whole = sorted((s, e) for held, _, _, s, e in spans if held)
    reach, starts = list(itertools.accumulate((e for _, e in whole), max)), [s for s, _ in whole]
    cut = []
    for held, _, _, s, e in spans:
        k = bisect.bisect_right(starts, s)
        if not held and not (k and reach[k - 1] >= e):
            cut.append((s, e))
    return _joined_places(cut)


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int, float]]]:
    """Reconciled spans of whole texts: (kind, start, end, score)."""
    found = [set(x) for x in _decoded(texts, [(i, w, WINDOW) for i, t in enumerate(texts) for w in windows(t)], tagger)]
    cut = [_cut_places(x) for x in found]
    size = 2 * WINDOW
    while any(cut):
        jobs, places = [], []
        for i, spans in enumerate(cut):
            for s, e in spans:
                length = max(size, 2 * (e - s))
                length = 1 << (length - 1).bit_length()
                jobs.append((i, max(0, (s + e - length) // 2), length))
                places.append((s, e))
        cut = [[] for _ in texts]
        for (i, _, _), (s, e), spans in zip(jobs, places, _by_job(texts, jobs, tagger), strict=True):
            near = [x for x in spans if x[3] < e and s < x[4]]
            found[i].update(x for x in near if x[0])
            cut[i] += [(min(x[3], s), max(x[4], e)) for x in near if not x[0]]
        cut = [_joined_places(x) for x in cut]
        size *= 2
    out = []
    for i, spans in enumerate(found):
        kept: list[tuple[str, int, int, float]] = []
        for whole, score, kind, s, e in sorted(spans, key=lambda x: (not x[0], -x[1], x[3], x[4], x[2])):
            if whole and score >= LEAST and holds(kind, texts[i][s:e]) and all(e <= k[1] or s >= k[2] for k in kept):
                kept.append((kind, s, e, score))
        out.append(sorted(kept, key=lambda k: k[1]))
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row."""
    spark = docs.sparkSession
    prepare(spark)
    tagger = spark.sparkContext.broadcast(trained())

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                for text, more in zip(part, tagged_spans(part, tagger.value), strict=True):
                    base = base_spans(text)
                    added = [(k, s, e) for k, s, e, _ in more if all(e <= b[1] or s >= b[2] for b in base)]
                    n = [sum(b[0] == k for b in base) for k in KINDS]
                    rows.append([*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = [batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return fresh(docs, "doc_id", "text").mapInArrow(
        light(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
