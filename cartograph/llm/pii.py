"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF on top.

The network reads every character of every text, in windows of WINDOW characters that overlap by 2 * MARGIN, and tags it with a kind's begin or inside tag. Windows are decoded in
batches by Viterbi. Where windows overlap, the tag of
the window in which a character is more central holds, and spans are read from the reconciled tags of the whole text. A span of the network
counts if it overlaps no pattern span and its characters can be of its kind: check digits for cards and account numbers, and for the others no more than counts of
digits and letters.

The network is trained with numpy on labelled spans that a seeded generator puts into invented prose (train(), EXAMPLES windows, formats that the patterns miss included: phones
without a country code, dotted card numbers, addresses written with "at" and "dot", keys and tokens, streets). Gates are clipped lines instead of sigmoids, which numpy computes far faster. The
fitted weights are kept in tagger.json, which ``python -m cartograph.llm.pii`` writes; they are broadcast.

Offsets are code points, end exclusive. Null counts as empty and has no spans. Rows are scanned apart, without a shuffle: repeated rows have equal spans, time
and memory of a row are linear in its text, and long texts share batches of windows. Ties don't arise: pattern spans of a kind don't overlap, and one tag holds for each character. An empty table gives an
empty table. Only doc_id and the text are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, MARGIN, HIDDEN = 1024, 32, 8
BATCH = 1024  # windows decoded at once
EXAMPLES, CROP = 6144, 96  # training windows and their characters
KINDS = ("email", "ip", "card", "phone", "ssn", "secret", "iban", "address")
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
NEVER = -1e4  # score of a move that is not allowed
WEIGHTS = Path(__file__).with_name("tagger.json")

# The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile("[0-9@]")  # every base span has one of these


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def account(text: str) -> bool:
    """Whether an international bank account number's check digits fit."""
    s = re.sub(r"[ -]", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards so that long runs of letters cost nothing."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the pattern spans, by kind, then start."""
    if not TRIGGER.search(text):
        return []
    out = [(0, *s) for s in emails(text)]
    # All parts are compared as numbers; very long ones by length first.
    part = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(part, m.group().split(".")))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


# The network's input: letters (capitals by whether hexadecimal digits use them), digits as one class, marks that spans use, and the rest.
MARKS = "@.-+()[]_%:/ \n\"'=,"
N_CLASSES = 26 + 2 + 1 + 1 + len(MARKS) + 2


def char_classes() -> np.ndarray:
    """Class of each code point below 128; 0 is unused, the last two are other ASCII and non-ASCII."""
    table = np.full(128, N_CLASSES - 2, np.int16)
    for i in range(26):
        table[97 + i] = 1 + i
        table[65 + i] = 27 if i < 6 else 28
    table[48:58] = 29
    for i, c in enumerate(MARKS):
        table[ord(c)] = 30 + i
    return table


CLASSES = char_classes()


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, CLASSES[np.minimum(points, 127)], N_CLASSES - 1).astype(np.int16)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def allowed() -> np.ndarray:
    """[from, to]: moves between tags that spans can make; spans don't touch."""
    out = np.zeros((TAGS, TAGS), bool)
    out[0, 0] = out[0, 1::2] = out[1:, 0] = True
    for k in range(1, TAGS, 2):
        out[k, k + 1] = out[k + 1, k + 1] = True
    return out


class Tagger:
    """Two LSTM directions over one-hot classes, a linear layer and CRF transitions; arrays are [time, window, ...]."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {"out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": draw(TAGS, TAGS), "start": draw(TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": draw(N_CLASSES, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN)}
            self.p[f"x{d}"][:, : 3 * HIDDEN] += 0.5
            self.p[f"x{d}"][:, HIDDEN : 2 * HIDDEN] += 0.3  # forget gates start open
        self.p["move"][~allowed()] = NEVER

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over full windows, and what the backward pass needs."""
        steps, n = x.shape
        own, move = self.p[f"x{d}"], self.p[f"h{d}"]
        h, c = np.zeros((n, HIDDEN), own.dtype), np.zeros((n, HIDDEN), own.dtype)
        out, kept = np.zeros((steps, n, HIDDEN), own.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = h @ move + own[x[t]]
            gates, u = np.clip(z[:, : 3 * HIDDEN], 0, 1), np.clip(z[:, 3 * HIDDEN :], -1, 1)
            kept.append((t, h, c, z, gates, u))
            c = np.clip(gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * u, -1, 1)
            h = gates[:, 2 * HIDDEN :] * c
            out[t] = h
        return out, kept

    def emissions(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Tag scores [time, tag, window] of both directions; at each time of the first active[t] windows, which have a character there.

        The same steps as run(), written into a few buffers that stay in the processor's cache.
        """
        steps, n = x.shape
        H, kind = HIDDEN, self.p["out"].dtype
        e = np.zeros((steps, TAGS, n), kind)
        z, g, u = (np.empty((n, k), kind) for k in (4 * H, 4 * H, H))
        for d, times, out in (("f", range(steps), self.p["out"][:H]), ("b", range(steps - 1, -1, -1), self.p["out"][H:])):
            own, move, out = self.p[f"x{d}"].copy(), self.p[f"h{d}"].copy(), np.ascontiguousarray(out.T)
            # One clip to [0, 1] serves all columns if the last ones, which go from -1 to 1, are halved and moved up.
            own[:, 3 * H :] = own[:, 3 * H :] / 2 + 0.5
            move[:, 3 * H :] /= 2
            h, c = np.zeros((n, H), kind), np.zeros((n, H), kind)
            for t in times:
                m = int(active[t])
                zm, gm, um, hm, cm = z[:m], g[:m], u[:m], h[:m], c[:m]
                np.matmul(hm, move, out=zm)
                np.take(own, x[t, :m], axis=0, out=gm, mode="clip")
                zm += gm
                np.clip(zm, 0, 1, out=zm)
                np.multiply(zm[:, 3 * H :], 2, out=um)
                um -= 1
                um *= zm[:, :H]
                cm *= zm[:, H : 2 * H]
                cm += um
                np.clip(cm, -1, 1, out=cm)
                np.multiply(cm, zm[:, 2 * H : 3 * H], out=hm)
                e[t, :, :m] += out @ hm.T
        e += self.p["bias"][:, None]
        return e

    def decode(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows that have tags, their best tag paths [window, time]) by Viterbi; x: [time, window] with falling sizes."""
        steps, n = x.shape
        p, active = self.p["move"], np.searchsorted(-size, -np.arange(steps), "left")
        e = self.emissions(x, active)
        for t in range(int(size[-1]), steps):  # behind the end only the tag of none is possible
            e[t, 0, active[t] :], e[t, 1:, active[t] :] = 0, NEVER
        to_begin, stay, grow = p[0, 1::2, None], np.diag(p)[2::2, None], p[np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)][:, None]
        from_begin, from_inside = p[1::2, 0, None], p[2::2, 0, None]
        # Only the moves of allowed(): a kind begins from outside, goes on by itself, and ends outside.
        first = self.p["start"][:, None] + e[0]
        none, begin, inside = first[0].copy(), first[1::2].copy(), first[2::2].copy()
        trial = np.empty((TAGS, n), e.dtype)
        came, begun = np.zeros((steps, n), np.int8), np.zeros((steps, len(KINDS), n), bool)
        for t in range(1, steps):
            np.add(none, p[0, 0], out=trial[0])
            np.add(begin, from_begin, out=trial[1::2])
            np.add(inside, from_inside, out=trial[2::2])
            best = trial.max(axis=0)
            if len(ended := np.flatnonzero(best > trial[0])):
                came[t, ended] = trial[:, ended].argmax(axis=0)
            begin += grow
            inside += stay
            np.greater(begin, inside, out=begun[t])
            np.maximum(begin, inside, out=inside)
            inside += e[t, 2::2]
            np.add(none, to_begin, out=begin)
            begin += e[t, 1::2]
            np.add(best, e[t, 0], out=none)
        trial[0], trial[1::2], trial[2::2] = none, begin, inside
        path = np.zeros((steps, n), np.int8)
        path[-1] = trial.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            at = path[t]
            path[t - 1] = np.where(at == 0, came[t], 0)
            on = np.flatnonzero((at > 0) & (at % 2 == 0))
            if len(on):
                path[t - 1, on] = at[on] - begun[t, at[on] // 2 - 1, on]
        some = np.flatnonzero(path.any(axis=0))
        return some, path[:, some].T.copy()

    def gradients(self, x: np.ndarray, y: np.ndarray, leak: float = 0.0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a character, and its gradients; leak: slope of clipped gates."""
        p, (steps, n) = self.p, x.shape
        states = {d: self.run(x, d) for d in "fb"}
        h = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        e = h @ p["out"] + p["bias"]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[0] = p["start"] + e[0]
        for t in range(1, steps):
            fwd[t] = logsumexp(fwd[t - 1][:, :, None] + p["move"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            bwd[t] = logsumexp(p["move"] + (e[t + 1] + bwd[t + 1])[:, None, :], 2)
        total = logsumexp(fwd[-1], 1)
        rows = np.arange(n)
        gold = p["start"][y[0]] + np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + p["move"][y[:-1], y[1:]].sum(0)
        de = np.exp(fwd + bwd - total[:, None])
        grad = {"start": de[0].sum(0), "move": np.zeros_like(p["move"])}
        for t in range(1, steps):
            grad["move"] += np.exp(fwd[t - 1][:, :, None] + p["move"] + (e[t] + bwd[t])[:, None, :] - total[:, None, None]).sum(0)
        np.subtract.at(grad["start"], y[0], 1)
        np.subtract.at(grad["move"], (y[:-1], y[1:]), 1)
        de[np.arange(steps)[:, None], rows, y] -= 1
        grad["out"], grad["bias"] = np.einsum("tnh,tnk->hk", h, de), de.sum((0, 1))
        dh = de @ p["out"].T
        slope = lambda inside: np.where(inside, 1, leak).astype(e.dtype)
        H = HIDDEN
        for d, part in (("f", dh[:, :, :H]), ("b", dh[:, :, H:])):
            gx, gh = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"])
            next_h, next_c = np.zeros((n, H), e.dtype), np.zeros((n, H), e.dtype)
            for t, h0, c0, z, gates, u in reversed(states[d][1]):
                i, f, o = gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H :]
                c1 = f * c0 + i * u
                a = part[t] + next_h
                c = (next_c + a * o) * slope(np.abs(c1) < 1)
                open_ = slope((z[:, : 3 * H] > 0) & (z[:, : 3 * H] < 1))
                dz = np.concatenate([c * u * open_[:, :H], c * c0 * open_[:, H : 2 * H], a * np.clip(c1, -1, 1) * open_[:, 2 * H :], c * i * slope(np.abs(z[:, 3 * H :]) < 1)], axis=1)
                np.add.at(gx, x[t], dz)
                gh += h0.T @ dz
                next_h, next_c = dz @ p[f"h{d}"].T, c * f
            grad[f"x{d}"], grad[f"h{d}"] = gx, gh
        return float((total - gold).sum() / (n * steps)), {k: v / n for k, v in grad.items()}


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PARTS = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ü", "ñ", "ción", "sch", "eau", "ß"]


class Generator:
    """Invented prose with labelled spans, from a seed."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def one(self, options: list | tuple | str) -> str:
        return options[int(self.rng.integers(len(options)))]

    def some(self, alphabet: str, low: int, high: int | None = None) -> str:
        n = low if high is None else int(self.rng.integers(low, high + 1))
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def name(self) -> str:
        return self.some(LOWER, 2, 8)

    def email(self) -> str:
        user = self.one([self.name() + self.one(".-_") + self.some(DIGITS, 0, 3), self.name() + "." + self.name(), self.name()])
        host, top = self.name() + self.some(DIGITS, 0, 1), self.one(["com", "org", "net", "de", "fr", "es", "io"])
        shape = self.one(["{}@{}.{}", "{}@{}.{}", "{} [at] {} [dot] {}", "{} (at) {} (dot) {}", "{}[at]{}.{}", "{} at {} dot {}"])
        return shape.format(user, host, top)

    def ip(self) -> str:
        if self.rng.random() < 0.2:
            return ":".join(self.some("0123456789abcdef", 1, 4) for _ in range(8))
        return self.one([".", ".", "[.]"]).join(str(x) for x in self.rng.integers(0, 256, 4))

    def card(self) -> str:
        body = self.some(DIGITS, 12, 18)
        body += next(c for c in DIGITS if luhn(body + c))
        return self.one(["", " ", "-", "."]).join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone(self) -> str:
        shape = self.one(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 ({}) {}-{}", "+1-{}-{}-{}", "+4{} {} {}", "({}) {} {}", "0{} {} {}"])
        return shape.format(self.some(DIGITS, 3), self.some(DIGITS, 3), self.some(DIGITS, 4))

    def ssn(self) -> str:
        return f"{self.some(DIGITS, 3)}-{self.some(DIGITS, 2)}-{self.some(DIGITS, 4)}"

    def secret(self) -> str:
        hexes, letters = "0123456789abcdef", LOWER + UPPER + DIGITS
        return self.one([
            self.some(hexes, 32), self.some(hexes, 40), self.some(hexes, 64), self.some(letters, 20, 44), "AKIA" + self.some(UPPER + DIGITS, 16), "ghp_" + self.some(letters, 36),
            "sk-" + self.some(letters, 32, 48), "eyJ" + self.some(letters, 20, 40) + "." + self.some(letters, 20, 40),
        ])

    def iban(self) -> str:
        land, body = self.one(["DE", "FR", "ES", "GB", "NL", "IT"]), self.some(DIGITS, 12, 20)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return self.one(["", " "]).join(s[i : i + 4] for i in range(0, len(s), 4))

    def address(self) -> str:
        street = self.one([self.name().capitalize(), self.name().capitalize() + " " + self.name().capitalize()])
        return f"{self.some(DIGITS, 1, 4).lstrip('0') or '7'} {street} {self.one(['Street', 'St.', 'Avenue', 'Road', 'Lane', 'Drive', 'Boulevard', 'Court'])}"

    def span(self) -> tuple[int, str, str, str]:
        """(kind, text before, span, text behind)."""
        kind = int(self.rng.integers(len(KINDS)))
        before = behind = ""
        if KINDS[kind] == "secret" and self.rng.random() < 0.9:
            before = self.one(["token", "key", "api_key", "secret", "password", "apikey", "auth", "TOKEN", "API_KEY", "access_token"]) + self.one([" = ", "=", ": ", ":", " is "])
            quote = self.one(["\"", "'", "", "\""])
            before, behind = before + quote, quote
        return kind, before, getattr(self, KINDS[kind])(), behind

    def plain(self) -> str:
        """Numbers and marks that are no personal data."""
        d = lambda low, high=None: self.some(DIGITS, low, high)
        return self.one([
            d(1, 7), d(1, 3) + "." + d(1, 2), d(1, 3) + "," + d(3), d(4) + "-" + d(2) + "-" + d(2), d(2) + "/" + d(2) + "/" + d(4), d(2) + ":" + d(2), d(1, 3) + "%", "v" + d(1) + "." + d(1) + "." + d(1),
            d(1) + "." + d(1) + "." + d(1, 2), "www." + self.name() + ".com/" + self.name() + "?id=" + d(2, 4), "@" + self.name(), self.name() + "_" + self.name(), self.name() + "()", "#" + d(3, 5), "$" + d(2, 4), "+" + d(1, 2),
            self.some(UPPER, 3, 9), d(2) + "-" + d(2), self.name() + d(1, 3), "(" + d(4) + ")", self.some("0123456789abcdef", 7), "key = " + self.name(), "token", "password: " + self.name(), self.name() + " at " + self.name(), d(8, 10),
        ])

    def text(self, least: int, density: float) -> tuple[str, list[int]]:
        """A text of at least so many characters and the tag of each."""
        out, tags, first = [], [], True
        mark = self.one(["", "", "", "", "&&&", "###", "%%%", "***", "$$$", "!!", " |", ","])
        case = self.one([str, str, str, str.upper])

        def put(s: str, of: list[int] | None = None) -> None:
            out.append(s)
            tags.extend(of if of is not None else [0] * len(s))

        while len(tags) < least:
            draw = self.rng.random()
            if draw < density:
                kind, before, s, behind = self.span()
                put(before)
                put(s, [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))
                put(behind)
            elif draw < density + 0.06:
                put(self.plain())
            else:
                s = "".join(self.one(PARTS) for _ in range(int(self.rng.integers(1, 5))))
                put(case(s.capitalize() if first or self.rng.random() < 0.04 else s))
            put(mark)
            first = self.rng.random() < 0.1
            put(". " if first else self.one([" ", " ", " ", " ", " ", ", ", "\n", ": "]))
        return "".join(out), tags


def examples(n: int, seed: int, density: float = 0.07) -> tuple[np.ndarray, np.ndarray]:
    """[time, window] classes and tags of n windows."""
    g = Generator(seed)
    xs, ys = np.zeros((CROP, n), np.int16), np.zeros((CROP, n), np.int64)
    for k in range(n):
        at = int(g.rng.integers(0, 60))
        text, tags = g.text(CROP + at, density)
        xs[:, k], ys[:, k] = encode(text)[at : at + CROP], tags[at : at + CROP]
    return xs, ys


def train(steps: int = 600, batch: int = 64, seed: int = 7, rate: float = 0.02) -> Tagger:
    """The network after ``steps`` Adam steps on generated examples."""
    model = Tagger(seed)
    x, y = examples(EXAMPLES, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], batch)
        _, grad = model.gradients(x[:, pick], y[:, pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= (slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        model.p["move"][~allowed()] = NEVER
    return model


def save(model: Tagger, path: Path = WEIGHTS) -> None:
    path.write_text(json.dumps({k: np.round(v.astype(float), 4).tolist() for k, v in model.p.items()}) + "\n")


@functools.lru_cache(1)
def fitted() -> Tagger:
    """The network with the kept weights."""
    model = Tagger()
    model.p = {k: np.array(v, np.float32) for k, v in json.loads(WEIGHTS.read_text()).items()}
    return model


def windows(n: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of the windows over n characters, and the stretch in which each is the most central."""
    out, start = [], 0
    while start < n:
        end = min(start + WINDOW, n)
        out.append((start, end, start + MARGIN if start else 0, end - MARGIN if end < n else n))
        if end == n:
            break
        start += WINDOW - 2 * MARGIN
    return out


#: A date or time with what may follow it, which is no secret; and what an address must name, as numbered lines of text don't.
TIME = re.compile(r"\d{4}-\d\d-\d\d(?:[T_-]?\d\d[:.-]?\d\d)?")
STREET = re.compile(r"\b(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|place|way|square)\b", re.IGNORECASE)


def plausible(kind: int, s: str) -> bool:
    """Whether a span's characters can be of its kind."""
    d, letters, name = len(digits(s)), sum(c.isalpha() for c in s), KINDS[kind]
    if name == "card":
        return 13 <= d <= 19 and luhn(digits(s))
    if name == "iban":
        return account(s)
    if name == "ip":
        p = s.replace("[.]", ".").split(".")
        return s.count(":") >= 5 if ":" in s else len(p) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in p)
    if name == "phone":
        return 9 <= d <= 15 and not letters
    if name == "ssn":
        return d == 9 and not letters
    if name == "secret":
        return len(s) >= 16 and d >= 2 and letters >= 2 and not re.search(r"\s", s) and not TIME.match(s)
    if name == "address":
        return 1 <= d <= 5 and letters >= 5 and " " in s and STREET.search(s) is not None
    return letters >= 5 and bool(re.search(r"@|\bat\b", s)) and bool(re.search(r"\.|\bdot\b", s)) and s[0].isalnum() and s[-1].isalnum()


class Reader:
    """Tags texts in batches of windows."""

    def __init__(self, model: Tagger) -> None:
        self.model = model

    def found(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the (offset, tag) of its tagged characters after reconciliation, rising."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        codes = [encode(t) for t in texts]
        places = sorted(((k, *w) for k, t in enumerate(texts) for w in windows(len(t))), key=lambda p: (p[1] - p[2], p[0], p[1]))
        for i in range(0, len(places), BATCH):
            some = places[i : i + BATCH]
            size = np.array([b - a for _, a, b, _, _ in some])
            x = np.zeros((len(some), size[0]), np.intp)
            for row, (k, a, b, _, _) in enumerate(some):
                x[row, : b - a] = codes[k][a:b]
            hit, paths = self.model.decode(np.ascontiguousarray(x.T), size)
            for n, path in zip(hit.tolist(), paths, strict=True):
                k, a, b, first, last = some[n]
                at = np.flatnonzero(path[first - a : last - a])
                out[k] += zip((at + first).tolist(), path[first - a + at].tolist(), strict=True)
        return [sorted(x) for x in out]

    def spans(self, text: str, tags: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Plausible spans of the reconciled tags, without white space at their ends."""
        out: list[list[int]] = []
        for at, tag in tags:
            kind = (tag - 1) // 2
            if tag % 2 == 1 or not out or out[-1][2] != at or out[-1][0] != kind:
                out.append([kind, at, at + 1])
            else:
                out[-1][2] = at + 1
        found = []
        for kind, a, b in out:
            s = text[a:b]
            a, b = a + len(s) - len(s.lstrip()), b - len(s) + len(s.rstrip())
            if a < b and plausible(kind, text[a:b]):
                found.append((kind, a, b))
        return found


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def all_spans(reader: Reader, texts: list[str]) -> list[tuple[list, list]]:
    """(pattern spans, spans that the network adds) of each text."""
    out = []
    for t, tags in zip(texts, reader.found(texts), strict=True):
        base = base_spans(t)
        taken = sorted((a, z) for _, a, z in base)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate(np.array([z for _, z in taken])) if taken else starts
        extra = []
        for k, a, z in reader.spans(t, tags):
            before = int(np.searchsorted(starts, z, "left"))  # pattern spans that start before z
            if not before or ends[before - 1] <= a:
                extra.append((k, a, z))
        out.append((base, extra))
    return out


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), n_spans, n_secret, base (spans as kind:start:end), spans (all, likewise)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(fitted().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = weights.value
        reader = Reader(model)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                # Some rows at a time, so that the states of a batch of windows are all that is held.
                b = whole.slice(at, 512)
                at += b.num_rows
                found = all_spans(reader, [t or "" for t in b.column(1).to_pylist()])
                n = [[sum(s[0] == k for s in x) for x, _ in found] for k in range(4)]
                n += [[len(x) + len(y) for x, y in found], [sum(s[0] == KINDS.index("secret") for s in y) for _, y in found]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array([join_spans(x) for x, _ in found], pa.string()), pa.array([join_spans(x + y) for x, y in found], pa.string())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_spans", "n_secret", "base", "spans"],
                )

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, n_secret long, base string, spans string")


if __name__ == "__main__":
    save(train())
