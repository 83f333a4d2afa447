"""Personal data by a character-level bidirectional LSTM with a CRF, over a base of patterns.

Base patterns find the plain forms. The tagger is trained in numpy on generated, labelled spans and adds written-out and
spaced forms (``ann (at) mail dot org``, ``192 . 168 . 0 . 1``). The CRF's tags are outside, begin and inside of each kind.

Overlapping windows are laid over the whole text, decoded in batches, and reconciled over the whole text: each character takes
the tag of the window in whose middle it lies most. Windows whose best path is outside throughout by a bound (``quiet``) need no
Viterbi. A span that the tagger adds must hold
the kind's own figures (Luhn digits, parts of at most 255, eight digits, a domain), and never overlaps a base span.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import text_of
from ontomill.plans.ship import arrow_rows, ship

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # possessive, from the start of a run of digits: the same matches, without trying each shorter run
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _fits(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(q) < 4 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in found.split(".")))
    if kind == "email":
        return True
    digits = re.sub("[^0-9]", "", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15



def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans by kind, then start: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    for kind, needs in zip(KINDS, ("@", ".", "", "+"), strict=True):
        if needs not in text or kind != "email" and not _DIGIT.search(text):
            continue
        matches = _emails(text) if kind == "email" else ((m.start(), m.end()) for m in BASE[kind].finditer(text))
        out += [(kind, a, b) for a, b in matches if _fits(kind, text[a:b])]
    return out


_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each at sign backwards: a long run without one is not searched again and again."""
    free = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            free = m.end()


# ---- the tagger

TAGS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
LETTERS = string.ascii_lowercase + "@.-_+()[]:,/ \n%"
CLASSES = 3 + len(LETTERS)  # padding, digit, other, then the letters and signs
TRAINED, WIDTH, STRIDE = 96, 256, 224
_EXTENT = 0x110000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(_EXTENT, 2, np.uint8)
    for i, c in enumerate(LETTERS):
        for form in {c, c.upper()}:
            out[ord(form)] = i + 3
    for c in range(_EXTENT):
        if chr(c).isdigit():
            out[c] = 1
    return out


def encode(text: str) -> np.ndarray:
    """The class of each character."""
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: an inside tag follows only its own kind."""
    out = np.zeros((len(TAGS), len(TAGS)))
    for j, to in enumerate(TAGS):
        if to[0] == "I":
            for i, of in enumerate(TAGS):
                if of not in (f"B-{to[2:]}", to):
                    out[i, j] = -1e4
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def tanh_of(x: np.ndarray, square: np.ndarray, below: np.ndarray) -> None:
    """The hyperbolic tangent in place, by a continued fraction cut after its fifth power (off by less than 0.002); two buffers."""
    np.minimum(x, 3.6, out=x)
    np.maximum(x, -3.6, out=x)
    np.multiply(x, x, out=square)
    np.multiply(square, 15, out=below)
    below += 420
    below *= square
    below += 945
    x /= below
    np.add(square, 105, out=below)
    below *= square
    below += 945
    x *= below


class Tagger:
    """Parameters by name: input tables and recurrent weights of both directions, output weights, transitions."""

    def __init__(self, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p[f"o{d}"] = rng.normal(0, 0.3, (hidden, len(TAGS)))
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1  # the forget gate starts open
        self.p["bias"] = np.zeros(len(TAGS))
        self.p["move"] = np.zeros((len(TAGS), len(TAGS)))

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) of one direction over classes (T, B)."""
        h = np.zeros((x.shape[1], self.hidden), self.p["bias"].dtype)
        c, out, kept, n = np.zeros_like(h), np.empty((*x.shape, self.hidden), h.dtype), [], self.hidden
        table, weights = self.p[f"x{d}"], self.p[f"h{d}"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ weights
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, came = c, h
            c = gates[:, n : 2 * n] * c + gates[:, :n] * g
            s = np.tanh(c)
            h = gates[:, 2 * n :] * s
            out[t] = h
            if keep:
                kept.append((t, gates, g, before, s, came))
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        (hf, kf), (hb, kb) = self._run(x, "f", keep), self._run(x, "b", keep)
        return hf @ self.p["of"] + hb @ self.p["ob"] + self.p["bias"], (hf, kf, hb, kb)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The emissions (T, B, tags) of classes (T, B), as ``emissions`` gives them to within ``tanh_of``, laid out for speed.

        A gate's rows lie together over the batch, so each step is a few passes over long rows; the logistic is
        ``(1 + tanh(x / 2)) / 2``, its halves folded into the weights.
        """
        n, (steps, batch), kind = self.hidden, x.shape, self.p["bias"].dtype
        out = np.empty((steps, len(TAGS), batch), kind)
        out[:] = self.p["bias"][:, None]
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], kind), n)[:, None]
        z, add, square, rows = (np.empty((4 * n, batch), kind) for _ in range(4))
        a, said = np.empty((n, batch), kind), np.empty((len(TAGS), batch), kind)
        for d in "fb":
            table, weights, to = (np.ascontiguousarray(m) for m in (self.p[f"x{d}"].T * half, self.p[f"h{d}"].T * half, self.p[f"o{d}"].T))
            h, c = np.zeros((n, batch), kind), np.zeros((n, batch), kind)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.matmul(weights, h, out=z)
                np.take(table, x[t], axis=1, out=add, mode="clip")
                z += add
                tanh_of(z, square, rows)
                # c = sigmoid(f) c + sigmoid(i) g, h = sigmoid(o) tanh(c)
                np.multiply(z[n : 2 * n], c, out=a)
                c += a
                np.multiply(z[:n], z[3 * n :], out=a)
                c += a
                c += z[3 * n :]
                c *= 0.5
                np.copyto(a, c)
                tanh_of(a, square[:n], rows[:n])
                np.multiply(z[2 * n : 3 * n], a, out=h)
                h += a
                h *= 0.5
                np.matmul(to, h, out=said)
                out[t] += said
        return out.transpose(0, 2, 1)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (T, B) of classes (T, B), by Viterbi over all windows at once."""
        e = self.scores(x)
        move = (self.p["move"] + allowed()).astype(e.dtype)
        loud = np.flatnonzero(~quiet(e, move))
        if len(loud) < x.shape[1]:
            out = np.zeros(x.shape, np.int8)
            if len(loud):
                out[:, loud] = self._viterbi(e[:, loud], move)
            return out
        return self._viterbi(e, move)

    def _viterbi(self, e: np.ndarray, move: np.ndarray) -> np.ndarray:
        first = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], e.dtype)
        score, back = e[0] + first, np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            all_ = score[:, :, None] + move
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        out = np.empty(e.shape[:2], np.int8)
        out[-1] = score.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a window of tags ``y`` (T, B), and its gradient."""
        steps, batch = x.shape
        e, (hf, kf, hb, kb) = self.emissions(x, keep=True)
        move = self.p["move"] + allowed()
        first = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS])
        alpha = np.empty_like(e)
        alpha[0] = e[0] + first
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + move, 1) + e[t]
        total = _logsumexp(alpha[-1], 1)
        beta = np.zeros_like(e[0])
        rows = np.arange(batch)
        de, dmove = np.empty_like(e), np.zeros_like(move)
        gold = e[0, rows, y[0]] + first[y[0]]
        for t in range(steps - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - total[:, None])
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta)[:, None, :] - total[:, None, None])
                dmove += pair.sum(0)
                np.add.at(dmove, (y[t - 1], y[t]), -1)
                gold = gold + e[t, rows, y[t]] + move[y[t - 1], y[t]]
                beta = _logsumexp(move + (e[t] + beta)[:, None, :], 2)
            de[t, rows, y[t]] -= 1
        de /= batch
        grad = {"move": dmove / batch, "bias": de.sum((0, 1))}
        for d, h, kept in (("f", hf, kf), ("b", hb, kb)):
            grad[f"o{d}"] = np.einsum("tbh,tbk->hk", h, de)
            self._back(x, d, kept, de @ self.p[f"o{d}"].T, grad)
        return float((total - gold).mean()), grad

    def _back(self, x: np.ndarray, d: str, kept: list, dh_out: np.ndarray, grad: dict) -> None:
        n, weights = self.hidden, self.p[f"h{d}"]
        dtable, dweights = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(weights)
        dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
        for t, gates, g, before, s, came in reversed(kept):
            dh = dh + dh_out[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g, dc * before, dh * s], 1) * gates * (1 - gates)
            dz = np.concatenate([dz, dc * i * (1 - g * g)], 1)
            np.add.at(dtable, x[t], dz)
            dweights += came.T @ dz
            dh, dc = dz @ weights.T, dc * f
        grad[f"x{d}"], grad[f"h{d}"] = dtable, dweights


def quiet(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Windows (of emissions (T, B, tags)) whose best path is surely outside throughout.

    All tags that begin a span are taken as one, and all inside one, with the best of their emissions and transitions: what the
    best path over three tags gains over staying outside bounds what any path gains, so where it gains nothing the full search
    needn't run.
    """
    begins, insides = ([i for i, t in enumerate(TAGS) if t[0] == x] for x in "BI")
    best = lambda of, to: float(move[np.ix_(of, to)].max() - move[0, 0])
    ob, bo, bb, bi, ib, ii, io = best([0], begins), best(begins, [0]), best(begins, begins), best(begins, insides), best(insides, begins), best(insides, insides), best(insides, [0])
    gain_b, gain_i = e[:, :, begins].max(2) - e[:, :, 0], e[:, :, insides].max(2) - e[:, :, 0]
    out, begun, inside = np.zeros(e.shape[1], e.dtype), gain_b[0], np.full(e.shape[1], -1e4, e.dtype)
    for t in range(1, len(e)):
        to_out = np.maximum(np.maximum(begun + bo, inside + io), out)
        to_inside = np.maximum(begun + bi, inside + ii) + gain_i[t]
        begun = np.maximum(np.maximum(out + ob, begun + bb), inside + ib) + gain_b[t]
        out, inside = to_out, to_inside
    return (out <= 0) & (begun < 0) & (inside < 0)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


# ---- labelled spans


#: Frequent words of four languages, the second source of the words around a span.
FREQUENT = "the of and to in is that for it was on are as with his they at be this have from or had by the your can said there each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who its now find long down day did get come made may part der die und das ist nicht von sie mit auf bitte eine auch wird bei oder nach el la de que y los se un por con para una es le et les des en du pour dans qui sur pas avec".split()


def _words(rng: np.random.Generator, n: int) -> str:
    if rng.random() < 0.5:
        return " ".join(rng.choice(FREQUENT, n))
    return " ".join("".join(rng.choice(list("etaoinshrdlucmgfépwybvüñ"), rng.integers(1, 9))) for _ in range(n))


def _name(rng: np.random.Generator) -> str:
    letters = "".join(rng.choice(list(string.ascii_lowercase), rng.integers(2, 9)))
    return letters + str(rng.choice(["", "", f".{_tail(rng)}", f"_{_tail(rng)}", f"-{_tail(rng)}", str(rng.integers(0, 100))]))


def _tail(rng: np.random.Generator) -> str:
    return str(rng.integers(0, 100)) if rng.random() < 0.4 else "".join(rng.choice(list(string.ascii_lowercase), rng.integers(2, 8)))


def _groups(rng: np.random.Generator, n: int, sep: str) -> str:
    """``n`` digits in groups of two to five or all in one."""
    digits, out = "".join(map(str, rng.integers(0, 10, n))), []
    while digits:
        k = int(rng.integers(2, 6))
        out.append(digits[:k])
        digits = digits[k:]
    return sep.join(out)


def _card(rng: np.random.Generator) -> str:
    digits = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))


def generated(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A short text and its labelled spans; some texts have figures that aren't personal data."""
    pick = rng.choice
    name, host = _name(rng), "".join(pick(list(string.ascii_lowercase), rng.integers(3, 9)))
    if rng.random() < 0.3:
        host += f"-{_tail(rng)}"
    tld = str(pick(["com", "org", "net", "example.com", "de", "co.uk", "fr", "es"]))
    at, dot = pick(["(at)", "[at]", "( at )", "at", "(at)", "[at]"]), pick(["dot", "(dot)", "[dot]", ".", "dot"])
    gap = "" if at in ("(at)", "[at]") and rng.random() < 0.3 else " "
    octets = [str(x) for x in rng.integers(0, 256, 4)]
    card = _card(rng)
    four = [card[i : i + 4] for i in range(0, 16, 4)]
    sep = str(pick([" ", " ", "-", "/", "."]))
    spelt = f"{name}{gap}{at}{gap}{host}{gap if dot == '.' and not gap else ' '}{dot} {tld.split('.')[-1]}" if dot != "." else f"{name}{gap}{at}{gap}{host}.{tld}"
    made = {
        "email": str(pick([f"{name}@{host}.{tld}", spelt, spelt, spelt, f"{name} @ {host} . com"])),
        "ip": str(pick([".".join(octets), " . ".join(octets), "[.]".join(octets), " dot ".join(octets), " .".join(octets)])),
        "card": str(pick([card, " ".join(four), "-".join(four), ".".join(four), "/".join(four), "  ".join(four)])),
        "phone": str(pick([f"+{rng.integers(1, 99)} {_groups(rng, int(rng.integers(7, 11)), ' ')}", f"00{rng.integers(1, 99)}{sep}{_groups(rng, int(rng.integers(7, 11)), sep)}", f"(0{rng.integers(1, 999)}) {_groups(rng, int(rng.integers(6, 9)), ' ')}", f"+{rng.integers(1, 99)}/{_groups(rng, 8, '/')}"])),
    }
    if rng.random() < 0.2:
        made["email"] = made["email"].upper()
    other = [str(rng.integers(1900, 2030)), f"{rng.integers(1, 99)}.{rng.integers(0, 99)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 20)}", f"{rng.integers(1, 28)}.{rng.integers(1, 12)}.{rng.integers(1990, 2030)}", f"{rng.integers(1, 999)} dot matrix", "look at it", f"{rng.integers(10**9, 10**14)}", f"no. {rng.integers(1, 10**6)}", f"{rng.integers(1, 99)}:{rng.integers(10, 59)}", "(at) last", f"http://{host}.{tld}/{rng.integers(1, 999)}", f"id {rng.integers(10**15, 10**16)}", f"@{host}"]
    text, spans = _words(rng, int(rng.integers(1, 5))), []
    for _ in range(int(rng.integers(0, 3))):
        text += pick([" ", ": ", ", ", "\n", " ("])
        if rng.random() < 0.6:
            kind = KINDS[rng.integers(0, 4)]
            spans.append((kind, len(text), len(text) + len(made[kind])))
            text += made[kind]
        else:
            text += str(pick(other))
        text += pick([" ", ". ", ", ", "\n", ") "]) + _words(rng, int(rng.integers(1, 4)))
    return text, spans


@lru_cache(maxsize=2)
def trained(examples: int = 2560, rounds: int = 10, hidden: int = 10, seed: int = 7) -> Tagger:
    """A tagger fitted by Adam on generated windows; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((TRAINED, examples), np.int64), np.zeros((TRAINED, examples), np.int64)
    for k in range(examples):
        text, spans = generated(rng)
        cut = int(rng.integers(0, max(1, len(text) - TRAINED + 1)))
        part = encode(text[cut : cut + TRAINED])
        x[: len(part), k] = part
        for kind, a, b in spans:
            if a >= cut and b <= cut + TRAINED:
                y[a - cut : b - cut, k] = TAGS.index(f"I-{kind}")
                y[a - cut, k] = TAGS.index(f"B-{kind}")
            else:  # cut by the window's edge: not to be learned from
                x[max(a - cut, 0) : max(b - cut, 0), k] = 0
    model = Tagger(hidden, seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    n = 0
    for r in range(rounds):
        order = rng.permutation(examples)
        for at in range(0, examples, 64):
            part = order[at : at + 64]
            _, grad = model.loss_and_gradient(x[:, part], y[:, part])
            n += 1
            rate = 0.02 * (1 - r / rounds) + 0.001
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


# ---- windows over whole texts


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over a text of ``n`` characters."""
    return [(s, min(s + WIDTH, n)) for s in range(0, max(1, n - WIDTH + STRIDE), STRIDE)] if n else []


def tagged(texts: list[str], model: Tagger, batch: int = 1024) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans in each whole text, its windows decoded together in batches and reconciled by character."""
    classes = [encode(t) for t in texts]
    laid = [(k, s, e) for k, c in enumerate(classes) for s, e in windows_of(len(c))]
    hits: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in texts]
    for at in range(0, len(laid), batch):
        part = laid[at : at + batch]
        x = np.zeros((WIDTH, len(part)), np.uint8)
        for col, (k, s, e) in enumerate(part):
            x[: e - s, col] = classes[k][s:e]
        tags = model.decode(x)
        for col in np.flatnonzero(tags.any(0)):
            k, s, e = part[col]
            hits[k].append((s, e, tags[: e - s, col].copy()))
    return [_spans(_reconciled(h, len(c))) if h else [] for h, c in zip(hits, classes, strict=True)]


def _reconciled(found: list[tuple[int, int, np.ndarray]], n: int) -> dict[int, int]:
    """The tags other than outside of a text's characters: each is that of the window in which it lies deepest.

    ``found`` are the windows with any tag but outside; the others were outside throughout. Two windows share
    ``WIDTH - STRIDE`` characters, and the halves of those lie deeper in the nearer window.
    """
    half, tags = (WIDTH - STRIDE) // 2, np.zeros(n, np.int8)
    for s, e, own in found:
        a, b = s + half if s else 0, e - half if e < n else n
        tags[a:b] = own[a - s : b - s]
    at = np.flatnonzero(tags)
    return dict(zip(at.tolist(), tags[at].tolist(), strict=True))


def _spans(tags: dict[int, int]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    last = -2
    for at in sorted(tags):
        tag = TAGS[tags[at]]
        if tag != "O":
            if tag[0] == "I" and out and last == at - 1 and out[-1][0] == tag[2:]:
                out[-1] = (out[-1][0], out[-1][1], at + 1)
            else:
                out.append((tag[2:], at, at + 1))
            last = at
    return out


# possessive: a long run that fits no address is left at once
_EMAIL_WORDS = re.compile(r"^[\w.%+-]++(?:\s*+(?:@|＠|[(\[]\s?at\s?[)\]])|\s++at\s)\s*+[\w-]++(?:(?:\s*+(?:\.|[(\[]\s?dot\s?[)\]])|\s++dot\s)\s*+[\w-]++)+$", re.IGNORECASE)
_PARTS = re.compile(r"\s*(?:\[?\.\]?|\sdot\s)\s*", re.IGNORECASE)


def plausible(kind: str, found: str) -> bool:
    """Whether an added span holds the kind's own figures."""
    if kind == "email":
        return bool(_EMAIL_WORDS.match(found))
    if kind == "ip":
        parts = _PARTS.split(found)
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(str(int(c)) for c in found if c.isdecimal())
    if sum(map(str.isalpha, found)):
        return False
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15 and (found.startswith(("+", "00", "(0")))


def find(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """Base spans, and all spans, of each text, both by kind, then start."""
    out = []
    for text, added in zip(texts, tagged(texts, model), strict=True):
        base = base_spans(text)
        more = []
        for kind, a, b in added:
            while a < b and text[a] in " \n\t,:;(" and not (text[a] == "(" and kind == "phone"):
                a += 1
            while a < b and text[b - 1] in " \n\t,:;.":
                b -= 1
            if a < b and not any(x < b and a < y for _, x, y in base) and plausible(kind, text[a:b]):
                more.append((kind, a, b))
        out.append((base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base, spans`` of every row's whole text; counts are of base spans; null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = model or trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = find(part.column(1).to_pylist(), model)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return arrow_rows(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")), rows, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(docs: DataFrame, model: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle brackets."""
    model = model or trained()
    ship(docs.sparkSession)

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, last = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= last:
                out += [text[last:a], f"<{kind}>"]
            last = max(last, b)
        return "".join(out) + text[last:]

    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(t, s) for t, (_, s) in zip(texts, find(list(texts), model), strict=True)])

    return docs.withColumn(text_col, F.pandas_udf(rows, "string", F.PandasUDFType.SCALAR)(text_of(text_col)))
