"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 10, 20
WINDOW = 64
_ALPHABET = 130


def codes(text: str) -> np.ndarray:
    """A small alphabet: printable ASCII as it is, line ends, other white space, letters and signs."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((c >= 32) & (c < 127), c, 127)
    out[(c == 10) | (c == 13)] = 1
    out[c == 9] = 2
    out[c >= 0xC0] = 128
    return out.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """Parameters by name; arrays are float32."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> Tagger:
        draw = np.random.default_rng(seed)
        scaled = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"embed": scaled(_ALPHABET, EMBED) * 3, "out": scaled(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            p |= {f"x{d}": scaled(EMBED, 4 * HIDDEN), f"h{d}": scaled(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        return cls(p)

    def _direction(self, d: str, x: np.ndarray, keep: bool):
        batch, steps, _ = x.shape
        wx = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        hs, memory = np.empty((batch, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[:, t] + h @ self.p[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[:, t] = h
            if keep:
                memory.append((t, before, c_before, i, f, o, g, tc))
        return hs, memory

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (batch, steps, TAGS) of windows of character codes."""
        x = self.p["embed"][ids]
        (hf, mf), (hb, mb) = self._direction("f", x, keep), self._direction("b", x, keep)
        h = np.concatenate((hf, hb), 2)
        e = h @ self.p["out"] + self.p["out_b"]
        return (e, (x, h, mf, mb)) if keep else e

    def loss_and_gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the CRF, by window, and its gradient."""
        e, (x, h, mf, mb) = self.emissions(ids, True)
        batch, steps, _ = e.shape
        trans = self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[:, -1], 1)
        de = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        dtrans = pair.sum((0, 1))
        rows, cols = np.arange(batch)[:, None], np.arange(steps)
        gold = e[rows, cols, tags].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        de[rows, cols, tags] -= 1
        np.subtract.at(dtrans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g = {"trans": dtrans / batch}
        de /= batch
        g["out"], g["out_b"] = np.tensordot(h, de, ((0, 1), (0, 1))), de.sum((0, 1))
        dh = de @ self.p["out"].T
        dx = np.zeros_like(x)
        for d, memory, part in (("f", mf, dh[:, :, :HIDDEN]), ("b", mb, dh[:, :, HIDDEN:])):
            dz_all = np.zeros((batch, steps, 4 * HIDDEN), np.float32)
            gh = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
            back_h, back_c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t, before, c_before, i, f, o, gg, tc in reversed(memory):
                dht = part[:, t] + back_h
                dc = back_c + dht * o * (1 - tc * tc)
                dz = np.concatenate((dc * gg * i * (1 - i), dc * c_before * f * (1 - f), dht * tc * o * (1 - o), dc * i * (1 - gg * gg)), 1)
                dz_all[:, t] = dz
                gh += before.T @ dz
                back_h, back_c = dz @ self.p[f"h{d}"].T, dc * f
            g[f"h{d}"], g[f"b{d}"] = gh, dz_all.sum((0, 1))
            g[f"x{d}"] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            dx += dz_all @ self.p[f"x{d}"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.ravel(), dx.reshape(-1, EMBED))
        return float((total.sum() - gold) / batch), g

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of each tag at each step of padded rows of scores (rows, steps, TAGS).

        Both passes are kept near zero at each step, so that long rows lose no precision.
        """
        steps, trans = e.shape[1], self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = np.where((t < lengths)[:, None], _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t], alpha[:, t - 1])
            alpha[:, t] -= alpha[:, t].max(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where((t + 1 < lengths)[:, None], _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            beta[:, t] -= beta[:, t].max(1, keepdims=True)
        both = alpha + beta
        return np.exp(both - _logsumexp(both, 2)[:, :, None])

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of each padded row of scores (rows, steps, TAGS)."""
        rows, steps, _ = e.shape
        best, back = e[:, 0].copy(), np.zeros((rows, steps, TAGS), np.int8)
        for t in range(1, steps):
            best -= best.max(1, keepdims=True)
            score = best[:, :, None] + self.p["trans"]
            back[:, t] = score.argmax(1)
            best = np.where((t < lengths)[:, None], score.max(1) + e[:, t], best)
        tags = np.zeros((rows, steps), np.int8)
        now = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            tags[:, t] = np.where(t < lengths, now, 0)
            now = np.where((t < lengths) & (t > 0), back[np.arange(rows), t, now], now)
        return tags


def tag_ids(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Begin and inside tags of (kind, start, end) spans."""
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a:b] = k + 1
        tags[a] = k
    return tags


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def labelled_text(draw: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """Invented prose with personal data and look-alikes, and the spans of the former.

    About half of the spans are in forms that the base patterns miss: addresses spelled out or spaced, numbers
    without a country code, card numbers cut by dots or slashes, masked addresses of machines.
    """
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzéüßñ") for _ in range(draw.randint(1, 10)))
    plain = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 9)))

    def email() -> str:
        local = plain() + draw.choice(("", "." + plain(), digits(2), "." + digits(2), "_" + plain(), "+" + plain(), "-" + digits(1)))
        host = plain() + draw.choice(("", digits(1), "-" + plain()))
        end = draw.choice(("com", "org", "example.com", "co.uk", "net", "de"))
        at, dot = draw.choice((("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", ".")))
        return local + at + host + dot + end.replace(".", dot)

    def card() -> str:
        body = digits(draw.choice((12, 14, 15, 15, 15, 18)))
        number = next(body + x for x in "0123456789" if luhn(body + x))
        between = draw.choice(("", " ", "-", ".", "/", ". "))
        return between.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        s = draw.choice((" ", "-", ".", "/"))
        return draw.choice(("+1 (" + digits(3) + ") " + digits(3) + "-" + digits(4), "+" + digits(2) + " " + digits(2) + " " + digits(7), "+" + digits(11), "(" + digits(3) + ") " + digits(3) + "-" + digits(4), digits(3) + s + digits(3) + s + digits(4), "0" + digits(3) + s + digits(3) + s + digits(4), "00" + digits(2) + s + digits(2) + s + digits(7), "+" + digits(2) + "." + digits(3) + "." + digits(4) + "." + digits(2)))

    def ip() -> str:
        dot = draw.choice((".", ".", "[.]", "(.)"))
        return dot.join(str(draw.randint(0, 255)) for _ in range(4))

    def look_alike() -> str:
        return draw.choice((digits(4), digits(2) + "." + digits(2), "version " + digits(1) + ".0.", "v" + digits(1) + "." + digits(1) + "." + digits(2), digits(4) + "-" + digits(2) + "-" + digits(2), digits(2) + "." + digits(2) + "." + digits(4), digits(2) + "/" + digits(2) + "/" + digits(4), digits(2) + ":" + digits(2) + ":" + digits(2), "$" + digits(3) + "," + digits(3) + "," + digits(3), digits(6), digits(8), digits(24), "@" + plain(), "p. " + digits(2) + "/" + digits(3), digits(3) + "-" + digits(3), "#" + digits(7), "No. " + digits(8), "+" + digits(1), hexes(40), '"' + hexes(40) + '"', 'token = "' + hexes(32) + '"', "-".join(map(hexes, (8, 4, 4, 4, 12))), "ISBN " + digits(3) + "-" + digits(1) + "-" + digits(4), digits(3) + " " + digits(3), "(" + digits(4) + ")"))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    text, spans = "", []
    for _ in range(draw.randint(12, 30)):
        x = draw.random()
        if x < 0.16:
            kind = draw.choice(KINDS)
            item = make[kind]()
            spans.append((kind, len(text), len(text) + len(item)))
            text += item
        elif x < 0.30:
            text += look_alike()
        else:
            w = word()
            text += w.capitalize() if draw.random() < 0.2 else w.upper() if draw.random() < 0.05 else w
        text += draw.choice((" ", " ", " ", " ", ", ", ". ", ".\n", "\n", "*** ", " | ", "&&& ", "!! ", ": ", "; "))
    return text, spans


def train(texts: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 11, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Fit to labelled spans with Adam; each text is cut into windows that overlap by half."""
    ids, tags = [], []
    for text, spans in texts:
        c, y = codes(text), tag_ids(len(text), spans)
        for a in range(0, max(1, len(c) - WINDOW // 2), WINDOW // 2):
            pad = max(0, a + WINDOW - len(c))
            ids.append(np.pad(c[a : a + WINDOW], (0, pad)))
            tags.append(np.pad(y[a : a + WINDOW], (0, pad)))
    x, y = np.stack(ids), np.stack(tags)
    model, draw = Tagger.new(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in model.p.items()}, {k: np.zeros_like(a) for k, a in model.p.items()}, 0
    for r in range(rounds):
        order = draw.permutation(len(x))
        for a in range(0, len(order), batch):
            _, g = model.loss_and_gradient(x[order[a : a + batch]], y[order[a : a + batch]])
            step += 1
            for k in model.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                model.p[k] = (model.p[k] - rate * 0.8**r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


@lru_cache(1)
def invented_tagger(texts: int = 900, seed: int = 5) -> Tagger:
    """The tagger fitted to invented labelled prose; the same on every call."""
    draw = random.Random(seed)
    return train([labelled_text(draw) for _ in range(texts)], seed=seed)
