"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained here, in NumPy, from labelled spans: those that the patterns find in a bounded sample of the
corpus, and spans of other notations (spelled-out addresses, grouped numbers, IPv6, ...) planted in its passages, next
to numbers, dates, versions and keys that are no personal data. It labels characters in windows that overlap by half;
each window is decoded on its own (Viterbi, with the probabilities of forward-backward), and the spans of all windows
of a document are reconciled globally: the set of disjoint spans of largest total confidence that keeps clear of the
patterns' spans. What is labelled as an address gets the bounds that the format of the one address there gives it. The
tests ask for nine of ten of each form: addresses with "at", "dot" and "@" in words, brackets or capitals, grouped numbers, IPv6,
cards with points or slashes. A span must hold a digit, "@" or an "at" spelled out (before a host with a dot, spelled out or not,
unless in brackets), as every kind here does; a window without any of these can give no span and is not decoded, which changes no result (see tests). A span that a window's edge cuts is
joined with its pieces in the windows beside and decoded again in a window that holds all of it with STEP characters on
either side, and wider ones as long as it is cut.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, small_batches, with_fields

KINDS = ("email", "ip", "card", "phone")
#: Window and its step; least probability of a label along an added span; documents and characters of the training sample.
WINDOW, STEP, SURE, SAMPLE, PASSAGE = 96, 48, 0.5, 400, 600
#: The same, if the format of an address says where the span begins and ends.
SURE_OF_FORMAT = 0.25
HIDDEN, EMBED = 20, 14
#: Passages with planted spans that training draws its windows from.
EXAMPLES = 6000

_host = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Characters of the longest address, spelled out: a local part of 64, and 253 of a host with at most 126 times " [dot] "; digits of other kinds.
LONGEST, MOST_DIGITS = 64 + 6 + 253 + 6 * 126, 32
#: An address about a span that was labelled as one: spaces only beside what is spelled out, so that it ends with its sentence.
_about = re.compile(r"[A-Za-z0-9._%+-]+(?:@| @ | ?[\[(]at[\])] ?| at )[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]+)+", re.I)
#: What a part of an added span of each kind can be.
_part = [re.compile(p) for p in (r"[A-Za-z0-9._%+@\[\]() -]+", "[0-9A-Fa-f:]+", "[0-9 ./-]+", "[0-9 ().+-]+")]
#: What a span must hold one of.
_sign = re.compile(r"[0-9@]|[\[(]at[\])]| at ", re.I)
_needs = re.compile(r"[0-9@]|[\[(]at[\])]| at (?=[A-Za-z0-9-]+ ?(?:\.|[\[(]dot[\])]|dot) ?[A-Za-z0-9-])", re.I)
#: An address that an added span can be.
_address = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]|at) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]|dot) ?[A-Za-z0-9-]+)+", re.I)

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def patterns(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind; leftmost and disjoint for each kind, in one pass over the text."""
    out: list[Span] = []
    at = text.find("@")
    free = 0  # where the last address ended
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        m = _host.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _digit.search(text):
        if "." in text:
            for m in _ip.finditer(text):
                if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), 1))
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- characters -> symbols

SYMBOLS = 56


def _symbol_table() -> np.ndarray:
    """A symbol for each code point: digits alike, capitals alike, small letters by themselves (as words such as "dot" matter)."""
    table = np.zeros(0x110000, np.int8)
    for c in range(0x250):
        ch = chr(c)
        table[c] = 1 if ch.isdigit() else 2 if ch.isupper() else 3 if ch.isalpha() else 0
    for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(ch)] = 4 + i
    for i, ch in enumerate(" \n\t@.-+()[]:,;/_%#'\"=*&!?"):
        table[ord(ch)] = 30 + i
    return table


_table: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _table:
        _table.append(_symbol_table())
    return _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


# ---- the tagger. Labels: 0 none, then first and later characters of each kind

LABELS = 1 + 2 * len(KINDS)
_ALLOWED = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(LABELS)] for i in range(LABELS)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        r = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = {"embed": r(SYMBOLS, EMBED) * 2, "out": r(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32), "moves": np.zeros((LABELS, LABELS), np.float32)}
        # both directions, forward first
        p |= {"w": np.stack([r(EMBED, 4 * HIDDEN) for _ in "fb"]), "u": np.stack([r(HIDDEN, 4 * HIDDEN) for _ in "fb"]), "c": np.zeros((2, 1, 4 * HIDDEN), np.float32)}
        p["c"][..., HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return cls(p)

    def to_bytes(self) -> bytes:
        """The tagger to be kept, so that it need not be fitted again."""
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tagger:
        with np.load(io.BytesIO(raw)) as kept:
            return cls(dict(kept))

    def _lstm(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions along x: (time, window) of symbols."""
        table = self.p["embed"] @ self.p["w"] + self.p["c"]  # a row for each symbol
        gates = np.stack([table[0][x], table[1][x[::-1]]], axis=1)
        n, w = x.shape
        h = c = np.zeros((2, w, HIDDEN), np.float32)
        out = np.empty((n, 2, w, HIDDEN), np.float32)
        for t in range(n):
            z = gates[t] + h @ self.p["u"]
            s, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            before, last = c, h
            c = s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * g
            tc = np.tanh(c)
            h = np.multiply(s[..., 2 * HIDDEN :], tc, out=out[t])
            if keep is not None:
                keep.append((s, g, before, tc, last))
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)

    def _back(self, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
        back = self.p["u"].transpose(0, 2, 1)
        dout = np.stack([dout[..., :HIDDEN], dout[::-1, :, HIDDEN:]], axis=1)
        dh = dc = np.zeros_like(dout[0])
        dz = np.empty((len(x), 2, x.shape[1], 4 * HIDDEN), np.float32)
        du = np.zeros_like(self.p["u"])
        for t in range(len(x) - 1, -1, -1):
            s, g, before, tc, last = kept[t]
            i, f, o = (s[..., k * HIDDEN : (k + 1) * HIDDEN] for k in (0, 1, 2))
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[..., :HIDDEN] = dc * g
            z[..., HIDDEN : 2 * HIDDEN] = dc * before
            z[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc
            z[..., : 3 * HIDDEN] *= s * (1 - s)
            z[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
            du += last.transpose(0, 2, 1) @ z
            dh, dc = z @ back, dc * f
        which = [(x[::step].reshape(-1) == np.arange(SYMBOLS)[:, None]).astype(np.float32) for step in (1, -1)]
        by_symbol = np.stack([which[k] @ dz[:, k].reshape(-1, 4 * HIDDEN) for k in (0, 1)])
        grad["u"], grad["c"] = du, by_symbol.sum(1, keepdims=True)
        grad["w"] = self.p["embed"].T @ by_symbol
        grad["embed"] = (by_symbol @ self.p["w"].transpose(0, 2, 1)).sum(0)

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kept: list | None = [] if keep is not None else None
        h = self._lstm(x, kept)
        if keep is not None:
            keep |= {"steps": kept, "h": h}
        return h @ self.p["out"] + self.p["bias"]

    def _moves(self) -> np.ndarray:
        return np.where(_ALLOWED, self.p["moves"], -30.0)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities (time, window, label), expected moves, and the mean log partition sum."""
        moves = np.exp(self._moves())
        top = e.max(2, keepdims=True)
        x = np.exp(e - top).astype(np.float64)
        start = np.array([float(j == 0 or j % 2 == 1) for j in range(LABELS)])
        alpha, log = np.empty_like(x), top.sum(0)[:, 0].astype(np.float64)
        for t in range(len(x)):
            a = x[t] * (start if t == 0 else alpha[t - 1] @ moves)
            s = a.sum(1, keepdims=True)
            alpha[t] = a / s
            log += np.log(s[:, 0])
        prob, beta, pairs = np.empty_like(x), np.ones_like(x[0]), np.zeros_like(moves)
        for t in range(len(x) - 1, -1, -1):
            if t < len(x) - 1:
                ahead = x[t + 1] * beta
                norm = ((alpha[t] @ moves) * ahead).sum(1)
                pairs += moves * (alpha[t].T @ (ahead / norm[:, None]))
                beta = ahead @ moves.T
                beta /= beta.max(1, keepdims=True)
            q = alpha[t] * beta
            prob[t] = q / q.sum(1, keepdims=True)
        return prob, pairs, float(log.mean())

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        moves = self._moves()
        best = e[0] + np.array([0.0 if j == 0 or j % 2 == 1 else -1e9 for j in range(LABELS)])
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            s = best[:, :, None] + moves
            back[t] = s.argmax(1)
            best = s.max(1) + e[t]
        path = np.empty(e.shape[:2], np.int8)
        path[-1] = best.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
        return path

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and its gradient for windows x with labels y, both (time, window)."""
        kept: dict = {}
        e = self.emissions(x, kept)
        prob, pairs, log = self.marginals(e)
        n = x.shape[1]
        gold = np.take_along_axis(e, y[:, :, None].astype(np.int64), 2).sum() + self._moves()[y[:-1], y[1:]].sum()
        de = prob.copy()
        np.put_along_axis(de, y[:, :, None].astype(np.int64), np.take_along_axis(de, y[:, :, None].astype(np.int64), 2) - 1, 2)
        de = (de / n).astype(np.float32)
        seen = np.bincount((y[:-1] * LABELS + y[1:]).reshape(-1), minlength=LABELS**2).reshape(LABELS, LABELS)
        grad = {"moves": ((pairs - seen) / n * _ALLOWED).astype(np.float32), "bias": de.sum((0, 1)), "out": kept["h"].reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, LABELS)}
        dh = de @ self.p["out"].T
        self._back(x, kept["steps"], dh, grad)
        return log - float(gold) / n, grad


# ---- training data

def _draw(rng: random.Random, passages: list[str]) -> tuple[str, list[Span]]:
    """A passage with spans of personal data and look-alikes planted in it."""
    text = rng.choice(passages)
    at = rng.randrange(max(1, len(text) - 2 * WINDOW))
    words = text[at : at + 2 * WINDOW].split(" ")
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    pick = lambda *x: rng.choice(x)
    word = lambda: re.sub("[^a-z]", "", rng.choice(words).lower()) or "mail"
    out, spans = "", []
    for k, w in enumerate(words):
        out += " " * (k > 0) + w
        if rng.random() > 0.12:
            continue
        kind = rng.randrange(8)
        if kind == 0:
            user = word() + pick("", "." + word(), digits(2), "_" + digits(1))
            host = [word() + pick("", digits(1), "-" + word()) for _ in range(pick(1, 1, 1, 2, 2, 3))] + [pick("com", "org", "net", "example.com", "de", "fr", "es", "edu", *["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 5)))] * 6)]
            dots = lambda spelled: host[0] + "".join(pick(spelled, spelled, spelled, ".") + h for h in host[1:-1]) + spelled + host[-1]
            new = pick(f"{user}@{dots('.')}", f"{user} [at] {dots(' [dot] ')}", f"{user}[at]{dots('.')}", f"{user} (at) {dots(' (dot) ')}", *[f"{user} at {dots(' dot ')}"] * 3, *[f"{user} at {dots('.')}"] * 2, f"{user} at {dots(pick(' [dot] ', ' (dot) '))}", f"{user} @ {dots('.')}")
            if rng.random() < 0.25:  # capitals, of all or of the words between
                new = new.upper() if rng.random() < 0.4 else re.sub(r"\b(at|dot)\b", lambda m: m[0].upper(), new)
        elif kind == 1:
            hexes = [f"{rng.randrange(65536):x}" for _ in range(8)]
            dotted = ".".join(str(rng.randrange(256)) for _ in range(4))
            new = pick(dotted, dotted, ":".join(hexes), "2001:db8::" + ":".join(hexes[:2]))
        elif kind == 2:
            n = digits(15)
            n += next(c for c in "0123456789" if luhn(n + c))
            sep = pick("", "", " ", "-", ".", "/")
            new = sep.join(n[i : i + 4] for i in range(0, 16, 4))
        elif kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            new = pick(f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", *[f"{a}.{b}.{c}"] * 2, f"00{digits(2)} {a} {b} {c}", f"0{digits(2)} {digits(4)} {c}", f"0{digits(3)} {digits(6)}", f"{a} {b} {c}")
        else:  # no personal data
            new = pick(
                lambda: digits(rng.randrange(1, 9)), lambda: digits(rng.randrange(10, 30)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
                lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"1{digits(1)}:{digits(2)}:{digits(2)}", lambda: f"{digits(2)}%", lambda: f"${digits(3)}.{digits(2)}",
                lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), lambda: "".join(rng.choices("abcdef0123456789", k=32)), lambda: f"{digits(3)},{digits(3)},{digits(3)}",
                lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: f"#{digits(4)}", lambda: f"({digits(1)})",
                lambda: f"ghp_{digits(6)}{word()}{digits(5)}", lambda: f"id={digits(5)}-{digits(3)}", lambda: f"{word()}{digits(2)}",
            )()
            kind = -1
        start = len(out) + 1
        out += " " + new
        if kind >= 0:
            spans.append((start, len(out), kind))
        out += pick("", "", ".", ",")
    return out, spans


def _labelled(rng: random.Random, passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of a drawn passage, what the corpus itself holds included."""
    text, taken = _draw(rng, passages)
    for s in patterns(text):
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
            taken.append(s)
    x, y = symbols(text), np.zeros(len(text), np.int64)
    for start, end, kind in taken:
        y[start:end] = 2 + 2 * kind
        y[start] = 1 + 2 * kind
    return x, y


def train(passages: list[str], *, seed: int = 5, rounds: int = 700, batch: int = 48) -> Tagger | None:
    """Fit a tagger to passages of the corpus; None without any. EXAMPLES passages are drawn, and windows of them at any place."""
    passages = [p for p in passages if p.strip()]
    if not passages:
        return None
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    tagger, m, v = Tagger.fresh(rng), {}, {}
    examples = [_labelled(draw, passages) for _ in range(EXAMPLES)]
    for k in range(1, rounds + 1):
        xs, ys = [], []
        for i in rng.integers(0, EXAMPLES, batch).tolist():
            x, y = examples[i]
            at = int(rng.integers(0, max(1, len(x) - WINDOW)))
            x, y = x[at : at + WINDOW], y[at : at + WINDOW].copy()
            if len(y) and y[0] and y[0] % 2 == 0:  # a cut span begins at the window
                y[0] -= 1
            xs.append(np.pad(x, (0, WINDOW - len(x)), constant_values=30))
            ys.append(np.pad(y, (0, WINDOW - len(y))))
        _, grad = tagger.step(np.stack(xs, 1).astype(np.int64), np.stack(ys, 1))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.012 * min(1.0, 2 * (1 - k / (rounds + 1)))
        for name, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[name] = 0.9 * m.get(name, 0) + 0.1 * g
            v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
            tagger.p[name] -= (rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return tagger


# ---- decoding


def _windows(text: str, every: bool) -> list[int]:
    """Where windows start: every STEP characters, to the end; without `every` only those that a span could lie in."""
    last = max(0, -(-(len(text) - WINDOW) // STEP)) if text else -1
    if every:
        return [STEP * i for i in range(last + 1)]
    found: set[int] = set()
    for m in _needs.finditer(text):
        low = max(0, -(-(m.end() - WINDOW) // STEP))
        found.update(range(low, min(last, m.start() // STEP) + 1))
    return [STEP * i for i in sorted(found)]


def _sound(text: str, kind: int) -> bool:
    """Whether an added span can be of its kind at all."""
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        return _address.fullmatch(text) is not None
    if kind == 1:
        return bool(re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}", text)) and digits >= 3 and (text.count(":") == 7 or "::" in text)
    if kind == 2:
        n = re.sub(r"[ ./-]", "", text)
        return n.isascii() and n.isdigit() and 14 <= len(n) <= 19 and luhn(n)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text)) and 10 <= digits <= 15 and bool(re.search(r"[ ().-]", text))


def _settled(text: str, span: Span) -> Span | None:
    """What is labelled as an address, with the bounds that its format gives it: those of the only address that half of it lies in, if there is one."""
    if span[2]:
        return None
    low = max(0, span[0] - 2 * WINDOW)
    near = [(m.start() + low, m.end() + low) for m in _about.finditer(text[low : span[1] + 2 * WINDOW])]
    near = [(a, b) for a, b in near if 2 * (min(b, span[1]) - max(a, span[0])) >= span[1] - span[0]]
    return (*near[0], 0) if len(near) == 1 else None


def _disjoint(spans: dict[Span, float]) -> list[Span]:
    """The disjoint spans of largest total confidence."""
    ordered = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends, best, came = [s[1] for s in ordered], [0.0], []
    for k, s in enumerate(ordered):
        fit = int(np.searchsorted(ends[:k], s[0], side="right"))
        gain = best[fit] + spans[s] * (s[1] - s[0])
        came.append((gain > best[k], fit))
        best.append(max(best[k], gain))
    out, k = [], len(ordered)
    while k:
        taken, fit = came[k - 1]
        if taken:
            out.append(ordered[k - 1])
        k = fit if taken else k - 1
    return out[::-1]


def _pieces(tagger: Tagger, texts: list[str], jobs: list[tuple[int, int]], width: int) -> Iterator[tuple[int, int, Span, float, bool]]:
    """What is labelled in windows of so many characters: text, window, span, confidence, and whether a window's edge cuts it."""
    size = max(1, 512 * WINDOW // width)
    for begin in range(0, len(jobs), size):
        part = jobs[begin : begin + size]
        x = np.full((width, len(part)), 30, np.int64)
        for k, (i, at) in enumerate(part):
            s = symbols(texts[i][at : at + width])
            x[: len(s), k] = s
        e = tagger.emissions(x)
        path = tagger.viterbi(e)
        hit = np.flatnonzero(path.any(0))
        if not len(hit):
            continue
        prob, _, _ = tagger.marginals(e[:, hit])
        for j, k in enumerate(hit.tolist()):
            i, at = part[k]
            y, t = path[:, k], 0
            while t < width:
                if y[t] % 2 == 1:
                    end = t + 1
                    while end < width and y[end] == y[t] + 1:
                        end += 1
                    sure = float(prob[np.arange(t, end), j, y[t:end]].min())
                    whole = (t > 0 or at == 0) and (end < width or at + width >= len(texts[i]))
                    yield i, at, (at + t, min(at + end, len(texts[i])), (int(y[t]) - 1) // 2), sure, not whole
                    t = end
                else:
                    t += 1


def _wider(texts: list[str], cut: list[tuple[int, Span]], base: list[list[Span]], found: list[dict[Span, float]]) -> dict[int, list[tuple[int, int]]]:
    """Windows about spans that were cut, by their width: pieces of a kind that meet are one, those that can be no span are left."""
    joined: list[tuple[int, int, int, int]] = []  # text, kind, start, end
    for i, k, start, end in sorted({(i, s[2], s[0], s[1]) for i, s in cut}):
        if joined and joined[-1][:2] == (i, k) and start <= joined[-1][3]:
            joined[-1] = (i, k, joined[-1][2], max(end, joined[-1][3]))
        else:
            joined.append((i, k, start, end))
    out: dict[int, set[tuple[int, int]]] = {}
    for i, k, start, end in joined:
        inside = texts[i][start:end]
        if end - start > LONGEST or not _part[k].fullmatch(inside) or k and sum(c.isdigit() for c in inside) > MOST_DIGITS:
            continue
        if any(s[0] < end and start < s[1] for s in base[i]) or any(s[0] <= start and end <= s[1] for s in found[i]):
            continue
        width = 2 * WINDOW
        while width < end - start + 2 * STEP:
            width *= 2
        out.setdefault(width, set()).add((i, max(0, min((start + end - width) // 2, len(texts[i]) - width))))
    return {w: sorted(jobs) for w, jobs in out.items()}


def find(tagger: Tagger | None, texts: list[str], every: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans, and the spans that the tagger adds."""
    base = [patterns(t) for t in texts]
    found: list[dict[Span, float]] = [{} for _ in texts]
    if tagger:
        jobs = {WINDOW: [(i, at) for i, t in enumerate(texts) for at in _windows(t, every)]}
        signed = {(i, at) for i, t in enumerate(texts) for at in _windows(t, False)} if every else set(jobs[WINDOW])
        done: set[tuple[int, int, int]] = set()
        while jobs:
            cut = []
            for width, part in jobs.items():
                done.update((width, *job) for job in part)
                for i, at, span, sure, edge in _pieces(tagger, texts, part, width):
                    inside = texts[i][span[0] : span[1]]
                    if edge:
                        if width > WINDOW or (i, at) in signed:  # another window can lack what makes it a span
                            cut.append((i, span))
                    elif sure >= SURE_OF_FORMAT:
                        settled = _settled(texts[i], span)
                        span = settled or span
                        inside = texts[i][span[0] : span[1]]
                        if (settled or sure >= SURE) and _sign.search(inside) and _sound(inside, span[2]):
                            found[i][span] = max(sure, found[i].get(span, 0.0))
            jobs = {w: new for w, part in _wider(texts, cut, base, found).items() if (new := [job for job in part if (w, *job) not in done])}
    out = []
    for spans, mine in zip(base, found, strict=True):
        free = {s: c for s, c in mine.items() if all(s[1] <= b[0] or b[1] <= s[0] for b in spans)}
        out.append((spans, _disjoint(free)))
    return out


def sample(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[str]:
    """Passages of at most SAMPLE documents, by hash of id and text: a bound on what the tagger is fitted to.

    Rows are drawn where they lie, by a threshold on the hash that follows from their number, so what reaches the driver
    is a few times SAMPLE passages whatever the table's size is. Null, empty and blank texts are never drawn; no rows, no
    passages; of rows that repeat more often than that, some.
    """
    n = docs.count()
    share = min(1.0, 4 * SAMPLE / max(1, n))
    keys = [col(c) for c in (doc_id, text) if c in docs.columns]
    drawn = docs.select(col(text).alias("text"), F.xxhash64(*keys).alias("h"))
    if share < 1:
        drawn = drawn.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = drawn.where(F.length(F.trim("text")) > 0).select("h", F.substring("text", 1, PASSAGE).alias("text")).limit(8 * SAMPLE).collect()
    return [t for _, t in sorted((r["h"], r["text"]) for r in rows)[:SAMPLE]]


def detect(docs: DataFrame, tagger: Tagger | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns of docs with pii: array of (kind, start, end, added), by start, then kind; code points, end exclusive.

    Defined results: a null or empty text has no spans; repeated rows give equal results; without a tagger only the
    patterns' spans are found; a kept column named pii is replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    rows = docs.select(*map(col, kept), col(text).alias("__text"))
    kinds = with_fields(rows.schema.fields[:-1], "pii array<struct<kind: string, start: int, end: int, added: boolean>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, added in find(tagger, [t or "" for t in batch.column(len(kept)).to_pylist()]):
                spans = sorted([(s, k, e, False) for s, e, k in base] + [(s, k, e, True) for s, e, k in added])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "added": a} for s, k, e, a in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*kept, "pii"])

    return map_arrow(rows, run, kinds)


def redacted(docs: DataFrame, tagger: Tagger | None, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets, and the length column brought up to date.

    Defined results: null, empty and blank texts stay as they are; without a tagger only the patterns' spans go; repeated
    rows stay repeated; all other columns, whatever their names, pass through; without a length column none is made; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    names, kinds = docs.columns, docs.schema
    at = names.index(text)

    def clean(t: str, spans: list[Span]) -> str:
        parts, done = [], 0
        for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2])):
            if start >= done:
                parts += [t[done:start], f"<{KINDS[kind].upper()}>"]
            done = max(done, end)
        return "".join([*parts, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, whole = list(batch.columns), batch.column(at).to_pylist()
            found = find(tagger, [t or "" for t in whole])
            texts = [t if t is None else clean(t, base + added) for t, (base, added) in zip(whole, found, strict=True)]
            columns[at] = pa.array(texts, pa.string())
            if length in names:
                k = names.index(length)
                columns[k] = pa.array([None if t is None else len(t) for t in texts]).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, run, kinds)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, and all spans as text, from detect(); a row for each of its rows, no spans give empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, texts = [[] for _ in KINDS], [], []
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if not s["added"]]
                show = lambda x: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s["kind"] == kind for s in base))
                hashes.append(hashlib.sha256(show(base).encode()).hexdigest())
                texts.append(show(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.select("doc_id", "pii").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
