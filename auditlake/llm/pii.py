"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns of the contract find emails, IP addresses, card and phone numbers. The network finds
writings that they miss (phone numbers without a plus sign, "name (at) host (dot) com", cards with
dots): characters go through an LSTM in either direction, a linear layer scores the tags O, B-kind
and I-kind of each, and a CRF's transitions make the best path a set of spans. It is trained in
numpy from labelled spans, which ``labelled_spans`` makes from a seed. Long stretches are cut into
overlapping windows. The scores that windows give a character are averaged, those from the
windows' middles weighing most, and the CRF decodes each stretch once, from its start to its end:
the path is the best one of the whole, not joined from pieces. A span found so must also be valid
for its kind (number of digits, check digit, parts up to 255, a host's last part) and not touch a
pattern's.

A span of these kinds holds a digit, an @ or the word "at", so stretches are laid around these
characters only, as far as the address they stand in reaches; all others are O by rule, not by
sampling. An address found is read from the start of its name to the end of its host, however long.

Scale: one pass over the rows, no shuffle, in time linear in the text; the weights (under 100 KB)
are broadcast. Windows go through the network in batches of bounded size.

Defined cases: a null text counts as empty and has no spans; overlapping spans of different kinds
are all reported; matches that fail a kind's check are dropped without another try; numbers of any
length are read; null doc_ids are kept; repeated rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, so written that a run which begins no match is read once, not from each of its characters.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])(?:at|AT)(?![A-Za-z])(?=[)\] ])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Characters of addresses, in both directions, and the words that join their parts.
_ADDRESS = re.compile(r"[A-Za-z0-9._%+@()\[\]-]*")
_NO_ADDRESS = re.compile(r"[^A-Za-z0-9._%+@()\[\]-]")
_JOINT = re.compile(r"[(\[]?(?:at|AT|dot|DOT)[)\]]?")
_HOST = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]| at | AT ) ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?| dot | DOT )[A-Za-z0-9-]+)*")

WINDOW = 96
STRIDE = 48
CONTEXT = 32
HIDDEN = 20
N_TAGS = 1 + 2 * len(KINDS)


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _good(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))
    if kind == "card":
        return 12 <= len(d := digits(text)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits(text)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and without overlap in each kind."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text) if m.group(1)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if m.group(1) and _good("ip", m.group())]
        for kind, pattern, needs in (("card", _CARD, ""), ("phone", _PHONE, "+")):
            if needs in text:
                found += [(*m.span(), kind) for m in pattern.finditer(text) if _good(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- the network

def _table() -> np.ndarray:
    """Class of each code below 128: signs and the letters of "at" and "dot" each have their own; other letters and digits share."""
    names = {}
    kind = lambda c: "0" if c.isdigit() else c if c in "adotADOT" or not c.isalnum() and c > " " else "x" if c.islower() else "X" if c.isupper() else " "
    return np.array([names.setdefault(kind(chr(i)), len(names)) for i in range(127)] + [0], np.int16)


_CLASS = _table()
LETTER, OTHER, NOTHING = (int(_CLASS.max()) + i for i in (1, 2, 3))
N_CLASSES = NOTHING + 1


def classes(text: str) -> np.ndarray:
    """Classes of characters: of ASCII by the table, then letters and what follows them, others; the last stands for no character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)],
        np.where(codes >= 0xAA, LETTER, OTHER)).astype(np.int16)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(seed: int, hidden: int) -> dict[str, np.ndarray]:
    """x: by direction and class what goes into the gates; h: recurrent; o: output layer; t: transitions."""
    r = np.random.default_rng(seed)
    w = {"x": r.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)), "h": r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)),
        "o": r.normal(0, 0.2, (2 * hidden + 1, N_TAGS)), "t": np.zeros((N_TAGS, N_TAGS))}
    w["x"][:, :, hidden : 2 * hidden] += 1  # remember at first
    return {k: x.astype(np.float32) for k, x in w.items()}


def _lstm(w, codes, keep: bool):
    """Outputs [time, direction, batch, hidden] over codes [time, direction, batch]; with keep also what going back needs."""
    wx, wh = w["x"], w["h"]
    steps, _, batch = codes.shape
    hidden = wh.shape[1]
    h, c = np.zeros((2, batch, hidden), wh.dtype), np.zeros((2, batch, hidden), wh.dtype)
    out, tape = np.empty((steps, 2, batch, hidden), wh.dtype), []
    direction = np.arange(2)[:, None]
    for t in range(steps):
        z = wx[direction, codes[t]]
        z += h @ wh
        s = _sigmoid(z[..., : 3 * hidden])
        i, f, o = s[..., :hidden], s[..., hidden : 2 * hidden], s[..., 2 * hidden :]
        g = np.tanh(z[..., 3 * hidden :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            tape.append((i, f, o, g, before, tc, h_before))
    return out, tape


def _lstm_back(w, codes, tape, grad):
    wx, wh = w["x"], w["h"]
    steps, _, batch, hidden = grad.shape
    dzs, befores = np.empty((steps, 2, batch, 4 * hidden), grad.dtype), np.empty_like(grad)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    back = wh.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h_before = tape[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dzs[t]
        dz[..., :hidden] = dc * g * i * (1 - i)
        dz[..., hidden : 2 * hidden] = dc * before * f * (1 - f)
        dz[..., 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
        dz[..., 3 * hidden :] = dc * i * (1 - g * g)
        befores[t] = h_before
        dh = dz @ back
        dc = dc * f
    dx, dw = np.empty_like(wx), np.empty_like(wh)
    for d in (0, 1):
        flat, code = dzs[:, d].reshape(-1, 4 * hidden), codes[:, d].reshape(-1)
        one_hot = np.zeros((len(flat), N_CLASSES), grad.dtype)
        one_hot[np.arange(len(flat)), code] = 1
        dx[d], dw[d] = one_hot.T @ flat, befores[:, d].reshape(-1, hidden).T @ flat
    return dx, dw


def _emissions(w, codes, keep=False):
    """Tag scores [time, batch, tags] of codes [time, batch]."""
    two = np.stack([codes, codes[::-1]], axis=1)
    h, tape = _lstm(w, two, keep)
    both = np.concatenate([h[:, 0], h[::-1, 1], np.ones((*codes.shape, 1), h.dtype)], axis=2)
    return both @ w["o"], both, two, tape


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(e, transitions, tags):
    """(loss, gradient of emissions, gradient of transitions) of the CRF, summed over the batch."""
    steps, batch, n = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = e[t] + _logsum(a[t - 1][:, :, None] + transitions, 1)
    for t in range(steps - 2, -1, -1):
        b[t] = _logsum(transitions[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _logsum(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    dt = np.exp(a[:-1, :, :, None] + transitions + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0,
            1))
    time, rows = np.arange(steps)[:, None], np.arange(batch)[None]
    de[time, rows, tags] -= 1
    np.add.at(dt, (tags[:-1], tags[1:]), -1)
    score = e[time, rows, tags].sum() + transitions[tags[:-1], tags[1:]].sum()
    return z.sum() - score, de, dt


def viterbi(e, transitions) -> np.ndarray:
    """Best tags [time, batch]."""
    steps, batch, _ = e.shape
    from_, best = np.empty(e.shape, np.int8), e[0]
    for t in range(1, steps):
        s = best[:, :, None] + transitions
        from_[t] = s.argmax(axis=1)
        best = s.max(axis=1) + e[t]
    out = np.empty((steps, batch), np.int8)
    out[-1] = best.argmax(axis=1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = from_[t, rows, out[t]]
    return out


def _legal() -> np.ndarray:
    """Transitions that no path may take: into the inside of a kind from anything but that kind."""
    barred = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        barred[:, 2 + 2 * k] = -1e4
        barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return barred


def labelled_spans(n: int, seed: int, window: int = WINDOW) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made texts of one window each with the spans of personal data in them, and lookalikes that are none."""
    r = random.Random(seed)
    syllables = ("the", "in", "er", "th", "on", "re", "an", "ção", "é", "ö", "ung", "mi", "sel", "to", "que", "st")
    plain = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    word = lambda: plain().capitalize() if r.random() < 0.15 else plain()
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        body += next(d for d in "0123456789" if luhn(body + d))
        gap = r.choice(("", " ", "-", ".", " . "))
        return gap.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        form = r.choice(("+1 ({a}) {b}-{c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+49 30 {b}{c}",
                "0049 30 {b} {c}", "0049 {a} {c} {d}", "0{a} / {b}{c}", "+33 1 {b} {c}", "0{a}/{b}{c}", "0{a} {b} {c}",
                "1-{a}-{b}-{c}", "+44 20 {c} {c}"))
        return form.format(a=a, b=b, c=c, d=num(4))

    def email() -> str:
        user, host, top = r.choice((name(), f"{name()}.{name()}", f"{name()}{num(2)}",
                f"{name()}.{num(2)}")), r.choice((name(), f"mail{num(1)}.{name()}", name(),
                "".join(name() + r.choice(".--") for _ in range(r.randint(1, 5))) + name())), r.choice(("com", "org",
                "net", "de", "fr", "example.com"))
        at = r.choice(("@", "@", " (at) ", " [at] ", " at ", "(at)", " AT "))
        dot = "." if at == "@" else r.choice((".", " (dot) ", " [dot] ", " dot "))
        return f"{user}{at}{host}{dot}{top}"

    make = {"email": email, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card,
        "phone": phone}
    none = (
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 32, 40)))),
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 99)}",
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 99)}",
        lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(r.randint(1, 4))}",
        lambda: f"{num(r.randint(1, 3))},{num(3)}.{num(2)}", lambda: f"@{name()}", lambda: f"{word()} at {word()}",
        lambda: f"version {num(1)}.{num(1)}", lambda: f"{num(r.randint(5, 20))}", lambda: f"({num(4)})",
        lambda: f"{num(2)}-{num(2)}", lambda: f"{word()} at {num(2)}.", lambda: f"CC BY-NC {num(1)}.0",
        lambda: " ".join(num(2) for _ in range(r.randint(2, 7))),
    )
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 6))), []
        wanted = window if r.random() < 0.6 else r.randint(1, window)  # some end early, as short texts do
        while len(text) < wanted:
            if r.random() < 0.45:
                kind = r.choice(KINDS)
                item = make[kind]()
                text += r.choice((" ", " ", "\n", ", ", " tel ", ": ", f"{word()} ", " Fax ", " Mail ")) if text else ""
                spans.append((len(text), len(text) + len(item), kind))
                text += item + r.choice(("", "", ".", ","))
            elif r.random() < 0.6:
                text += " " + r.choice(none)() + r.choice(("", "", ".", ","))
            text += " " + " ".join(word() for _ in range(r.randint(1, 6))) + r.choice(("", ".", "", ".\n"))
        out.append((text[:window], [s for s in spans if s[1] <= window]))
    return out


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    codes, tags = np.full((WINDOW, n), NOTHING, np.int64), np.zeros((WINDOW, n), np.int64)
    for j, (text, spans) in enumerate(labelled_spans(n, seed)):
        codes[: len(text), j] = classes(text)
        for a, b, kind in spans:
            k = KINDS.index(kind)
            tags[a, j] = 1 + 2 * k
            tags[a + 1 : b, j] = 2 + 2 * k
    return codes, tags


def train(n: int = 3200, epochs: int = 8, batch: int = 64, rate: float = 0.015, seed: int = 3,
        hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Weights trained with Adam on ``n`` labelled windows."""
    codes, tags = _examples(n, seed)
    w = _start(seed, hidden)
    barred = _legal().astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order, step = np.random.default_rng(seed), 0
    total = epochs * (n // batch)
    for _ in range(epochs):
        shuffled = order.permutation(n)
        for at in range(0, n - batch + 1, batch):
            pick = shuffled[at : at + batch]
            x, y = codes[:, pick], tags[:, pick]
            e, both, two, tape = _emissions(w, x, keep=True)
            _, de, dt = _crf(e, w["t"] + barred, y)
            g = {"o": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, N_TAGS), "t": dt}
            back = de @ w["o"].T
            g["x"], g["h"] = _lstm_back(w, two, tape, np.stack([back[:, :, :hidden],
                        back[::-1, :, hidden : 2 * hidden]], axis=1))
            step += 1
            lr = rate * min(1, 2 * (1 - step / (total + 1)))
            for k in w:
                d = np.clip(g[k] / batch, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    w["t"] = w["t"] + barred
    return w


_trained: dict[tuple, dict[str, np.ndarray]] = {}


def trained(spark: SparkSession, **options) -> dict[str, np.ndarray]:
    """Weights for a session: trained once, in a task (where numpy keeps to the task's core), from labelled spans made there."""
    key = tuple(sorted(options.items()))
    if key not in _trained:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                out = io.BytesIO()
                np.savez(out, **train(**options))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["weights"])

        data = spark.range(0, 1, 1, 1).mapInArrow(run, "weights binary").first()["weights"]
        _trained[key] = dict(np.load(io.BytesIO(bytes(data))))
    return _trained[key]


def _run_end(text: str, b: int, since: int) -> int:
    """b, or where it lies in an address the end of that: white space that no "at" or "dot" precedes or follows."""
    start = b
    while start > since and not _NO_ADDRESS.match(text, start - 1):
        start -= 1
    while True:
        end = _ADDRESS.match(text, start).end()
        if end + 1 >= len(text) or text[end] != " ":
            return max(b, end)
        after = _ADDRESS.match(text, end + 1).end()
        if not (_JOINT.fullmatch(text, start, end) or _JOINT.fullmatch(text, end + 1, after)):
            return max(b, end)
        start = end + 1


def _run_start(text: str, a: int, since: int) -> int:
    """a, or the start of the address characters that it lies in, but not before since."""
    while a > since and not _NO_ADDRESS.match(text, a - 1):
        a -= 1
    return a


class Tagger:
    """Spans of many texts at once."""

    def __init__(self, weights: dict[str, np.ndarray], window: int = WINDOW, stride: int = STRIDE, at_once: int = 512):
        self.w = {k: x.astype(np.float32) for k, x in weights.items()}
        self.window, self.stride, self.at_once = window, stride, at_once

    def _regions(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for m in _TRIGGER.finditer(text):
            if out and m.end() + CONTEXT <= out[-1][1]:
                continue
            a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
            a, b = _run_start(text, a, out[-1][1] if out else 0), _run_end(text, b, m.start())
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        group: list[tuple[int, int, int]] = []  # text, start and end of a stretch
        windows = 0
        for i, text in enumerate(texts):
            for a, b in self._regions(text):
                group.append((i, a, b))
                windows += self._windows(b - a)
                if windows >= self.at_once:
                    self._tag(texts, group, out)
                    group, windows = [], 0
        if group:
            self._tag(texts, group, out)
        return out

    def _windows(self, length: int) -> int:
        return 1 + max(0, -(-(length - self.window) // self.stride))

    def _tag(self, texts, group, out) -> None:
        scores = self._scores([classes(texts[i][a:b]) for i, a, b in group])
        for (i, a, _), tags in zip(group, self._paths(scores)):
            out[i] += self._read(texts[i], a, tags)

    def _scores(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """Tag scores [time, tags] of each stretch: the windows' averaged, the nearer to a window's middle the heavier."""
        weight = np.minimum(np.arange(1, self.window + 1), np.arange(self.window, 0, -1)).astype(np.float32)[:, None]
        total = [np.zeros((len(x), N_TAGS), np.float32) for x in stretches]
        weights = [np.zeros((len(x), 1), np.float32) for x in stretches]
        places = [(r, at * self.stride) for r, x in enumerate(stretches) for at in range(self._windows(len(x)))]
        for first in range(0, len(places), self.at_once):
            some = places[first : first + self.at_once]
            codes = np.full((self.window, len(some)), NOTHING, np.int16)
            for j, (r, at) in enumerate(some):
                part = stretches[r][at : at + self.window]
                codes[: len(part), j] = part
            e = _emissions(self.w, codes)[0]
            for j, (r, at) in enumerate(some):
                n = min(self.window, len(stretches[r]) - at)
                total[r][at : at + n] += e[:n, j] * weight[:n]
                weights[r][at : at + n] += weight[:n]
        return [t / w for t, w in zip(total, weights)]

    def _paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each stretch; those of like lengths are decoded together, ended by O."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(scores)
        order = sorted(range(len(scores)), key=lambda r: len(scores[r]))
        at = 0
        while at < len(order):
            steps = -(-len(scores[order[at]]) // 32) * 32
            some = []
            while at < len(order) and len(scores[order[at]]) <= steps:
                some.append(order[at])
                at += 1
            e = np.full((steps, len(some), N_TAGS), -1e4, np.float32)
            e[:, :, 0] = 0
            for j, r in enumerate(some):
                e[: len(scores[r]), j] = scores[r]
            tags = viterbi(e, self.w["t"])
            for j, r in enumerate(some):
                out[r] = tags[: len(scores[r]), j]
        return out

    def _read(self, text: str, offset: int, tags: np.ndarray) -> list[tuple[int, int, str]]:
        out, i, n = [], 0, len(tags)
        while i < n:
            if not tags[i]:
                i += 1
                continue
            kind = (tags[i] - 1) // 2
            j = i + 1
            while j < n and tags[j] == 2 + 2 * kind:
                j += 1
            a, b = offset + i, offset + j
            while b > a and text[b - 1] in " .,;:\n":
                b -= 1
            while a < b and text[a] in " .,;:\n":
                a += 1
            if KINDS[kind] == "email":
                while 0 < a < b and text[a] not in "@(" and text[a - 1] in _LOCAL:
                    a -= 1
                m = _HOST.match(text, a)
                b = max(b, m.end()) if m else b
            if a < b and plausible(KINDS[kind], text[a:b]) and not _inside_word(text, a, b):
                out.append((a, b, KINDS[kind]))
                j = max(j, b - offset)
            i = j
        return out


_AT = re.compile(r"@|[(\[](?:at|AT)[)\]]| (?:at|AT) ")
_LAST = re.compile(r"(?:\.|[(\[](?:dot|DOT)[)\]] ?| (?:dot|DOT) )[A-Za-z]{2,}\Z")


def plausible(kind: str, text: str) -> bool:
    """What is valid for its kind: the checks of the contract, and for an address a name, an "at" and a host with a last part."""
    if kind == "email":
        at = _AT.search(text)
        sure = at and (at.group() in "@" or at.group()[0] in "([" or re.search(r"dot|DOT", text[at.end() :]))
        return bool(sure and at.start() > 0 and _LAST.search(text, at.end()))
    if kind == "ip":
        return text.count(".") == 3 and all(p.isascii() and p.isdigit() for p in text.split(".")) and _good(kind, text)
    if not _good(kind, text):
        return False
    # a bare run of digits may be anything
    return kind != "phone" or text[0] in "+(" or len(digits(text)) < len(text) and len(max(re.findall(r"[0-9]+", text),
            key=len)) <= 8 and len(re.findall(r"[0-9]+", text)) <= 6


def _inside_word(text: str, a: int, b: int) -> bool:
    return a > 0 and text[a - 1].isalnum() or b < len(text) and text[b].isalnum()


def join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def merge(base: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """base and those of more that touch none of it."""
    free = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in base)] if base else more
    return sorted({*base, *free}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_pii(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, base>>, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs.

    start and end are code points, end exclusive; the numbers and base_sha256 are of the
    patterns' spans, found and spans hold the network's too.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights or trained(docs.sparkSession))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            whole = [merge(b, m) for b, m in zip(base, tagger.spans(texts))]
            columns = [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b, "base": (a, b, k) in own} for a, b,
                        k in w] for w, own in zip(whole, base)], pa.list_(span))]
            columns += [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            columns += [pa.array([hashlib.sha256(join(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([join(w) for w in whole], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "found", *(f"n_{k}" for k in KINDS), "base_sha256",
                    "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long,base:boolean>>, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
