"""PII: fixed patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The network is trained in numpy from labelled spans (`examples` makes them from a seed; callers may
pass their own). It reads overlapping windows of a text; each window is decoded on its own, and the
windows' spans are reconciled over the whole text as the heaviest set of spans that don't overlap.

Every kind that the network is trained for holds a digit or an @. A window without either can hold no
span, so the network runs on the windows around those characters, wherever they are in the text.

Pattern spans always stay. A span of the network is added where it overlaps no pattern span, is
confident, and has the form of its kind (`plausible`).

Shapes of input with a defined result: a null text is an empty one; an empty text has no spans; texts
are read whole, whatever their length; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored or, where the text is redacted, carried.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common, spans

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: Characters of a window, and by how many consecutive windows overlap.
WINDOW, OVERLAP = 64, 32
#: Sizes of embedding and of each direction's state.
EMBED, STATE = 10, 12
_CHARS = "abcdefghijklmnopqrstuvwxyz0 .,-_+@()/:;'\"[]{}<>=#%&*!?|\n"
_CLASS = {c: i + 1 for i, c in enumerate(_CHARS)}
N_CLASSES = len(_CHARS) + 1

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]")
_ANCHOR = re.compile("[0-9@]")


def octet(part: str) -> bool:
    """Whether digits, of whatever number, say 255 at most."""
    own = part.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def luhn(digits: str) -> bool:
    """True if the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans: leftmost, non-overlapping per kind; failing matches are dropped."""
    found = [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _DIGITS.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


def plausible(kind: str, value: str) -> bool:
    """Whether a span found by the network has the form of its kind."""
    d = _DIGITS.sub("", value)
    if kind == "email":
        return re.fullmatch(r"[^\s@]{1,64}\s?@\s?[^\s@]+\.[^\s@.]{2,}", value) is not None
    if kind == "ip":
        parts = re.split(r"\s?\.\s?", value)
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and octet(p) for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", value) is not None
    return 10 <= len(d) <= 15 and re.fullmatch(r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9 .-]+", value) is not None


# Training


def examples(seed: int = 5, count: int = 1200) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans, and texts with numbers that are nothing of the kind."""
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(r.choice(letters, r.integers(2, 9)))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[r.integers(len(x))]

    def card() -> str:
        body = num(15)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        gap = pick("", "", " ", "-", ".", "/")
        return gap.join(full[i : i + 4] for i in range(0, 16, 4))

    def made(kind: str) -> str:
        if kind == "email":
            return f"{word()}{pick('.', '_', '-', '', '+')}{pick(word(), num(2))}@{word()}{pick('', num(1))}.{pick(word() + '.', '')}{pick('com', 'org', 'net', 'de', 'fr', 'io')}"
        if kind == "ip":
            return ".".join(str(x) for x in r.integers(0, 256, 4))
        if kind == "card":
            return card()
        cc = pick("+1 ", f"+{num(2)} ", "", "")
        return cc + pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}")

    def other() -> str:
        return pick(f"{num(4)}-{num(2)}-{num(2)}", f"${num(2)},{num(3)}.{num(2)}", num(int(r.integers(1, 9))), f"v{num(1)}.{num(1)}.{num(1)}", f"{num(2)}:{num(2)}", "".join(r.choice(list("0123456789abcdef"), 40)), f"@{word()}", f"{num(2)}%", f"{word()}{num(3)}")

    out = []
    for _ in range(count):
        parts, found, at = [], [], 0
        for _ in range(r.integers(4, 12)):
            kind = pick(*KINDS) if r.random() < 0.18 else ""
            piece = made(kind) if kind else other() if r.random() < 0.2 else word().capitalize() if r.random() < 0.2 else word()
            tail = pick("", "", "", ",", ".", "!!", "###", "&&&", " |") if not kind or r.random() < 0.3 else ""
            if kind:
                found.append((kind, at, at + len(piece)))
            parts.append(piece + tail + pick(" ", " ", " ", "\n"))
            at += len(parts[-1])
        out.append(("".join(parts), found))
    return out


def classes(text: str) -> np.ndarray:
    """Character classes: letters without case, one class for all digits, common marks, and 0 for the rest."""
    return np.array([_CLASS.get("0" if "0" <= c <= "9" else c.lower(), 0) for c in text], np.int64)


def tags(n: int, found: list[tuple[str, int, int]]) -> np.ndarray:
    """Tag of each of n characters."""
    y = np.zeros(n, np.int64)
    for kind, a, b in found:
        y[a:b] = TAGS.index(f"I-{kind}")
        y[a] = TAGS.index(f"B-{kind}")
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Embedding, two LSTMs, emissions and transitions; the last class of the embedding is padding."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        p = {"embed": r.normal(0, 0.5, (N_CLASSES + 1, EMBED)), "out": g(2 * STATE, len(TAGS)), "bias": np.zeros(len(TAGS)), "move": r.normal(0, 0.1, (len(TAGS), len(TAGS)))}
        for d in "fb":
            p[f"w{d}"], p[f"u{d}"], p[f"b{d}"] = g(EMBED, 4 * STATE), g(STATE, 4 * STATE), np.zeros(4 * STATE)
            p[f"b{d}"][STATE : 2 * STATE] = 1.0
        return Network(p)

    def lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States along the first axis of x (steps, windows, EMBED)."""
        u, s = self.p[f"u{d}"], STATE
        z = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((x.shape[1], s), x.dtype), np.zeros((x.shape[1], s), x.dtype)
        out, tape = np.empty((len(x), x.shape[1], s), x.dtype), []
        for t in range(len(x)):
            a = z[t] + h @ u
            g = _sigmoid(a[:, : 3 * s])
            n = np.tanh(a[:, 3 * s :])
            c0, h0 = c, h
            c = g[:, s : 2 * s] * c + g[:, :s] * n
            k = np.tanh(c)
            h = out[t] = g[:, 2 * s :] * k
            if keep:
                tape.append((g, n, c0, h0, k))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of tags (steps, windows, tags) for classes (steps, windows)."""
        e = self.p["embed"][x]
        f, tf = self.lstm(e, "f", keep)
        b, tb = self.lstm(e[::-1], "b", keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ self.p["out"] + self.p["bias"], (e, h, tf, tb)

    def backward(self, x: np.ndarray, saved: tuple, d_emit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from those of the emissions."""
        e, h, tf, tb = saved
        grad = {"out": np.einsum("tbh,tbk->hk", h, d_emit), "bias": d_emit.sum(axis=(0, 1))}
        dh = d_emit @ self.p["out"].T
        de = np.zeros_like(e)
        for d, tape, dout, inp in (("f", tf, dh[:, :, :STATE], e), ("b", tb, dh[::-1, :, STATE:], e[::-1])):
            s, u = STATE, self.p[f"u{d}"]
            gu, gz = np.zeros_like(u), np.zeros((len(inp), inp.shape[1], 4 * s))
            nh, nc = np.zeros((inp.shape[1], s)), np.zeros((inp.shape[1], s))
            for t in range(len(inp) - 1, -1, -1):
                g, n, c0, h0, k = tape[t]
                i, f, o = g[:, :s], g[:, s : 2 * s], g[:, 2 * s :]
                hh = dout[t] + nh
                cc = nc + hh * o * (1 - k * k)
                a = np.concatenate([cc * n * i * (1 - i), cc * c0 * f * (1 - f), hh * k * o * (1 - o), cc * i * (1 - n * n)], axis=1)
                gz[t], gu = a, gu + h0.T @ a
                nh, nc = a @ u.T, cc * f
            grad[f"u{d}"], grad[f"b{d}"] = gu, gz.sum(axis=(0, 1))
            grad[f"w{d}"] = np.einsum("tbe,tbz->ez", inp, gz)
            di = gz @ self.p[f"w{d}"].T
            de += di if d == "f" else di[::-1]
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], x.reshape(-1), de.reshape(-1, EMBED))
        return grad

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag marginals, expected transitions and log partition of the CRF, by forward and backward sums."""
        m = self.p["move"]
        fwd, bwd = np.empty_like(emit), np.zeros_like(emit)
        fwd[0] = emit[0]
        for t in range(1, len(emit)):
            fwd[t] = emit[t] + _logsum(fwd[t - 1][:, :, None] + m[None], 1)
        for t in range(len(emit) - 2, -1, -1):
            bwd[t] = _logsum(m[None] + (emit[t + 1] + bwd[t + 1])[:, None, :], 2)
        z = _logsum(fwd[-1], 1)
        p = np.exp(fwd + bwd - z[None, :, None])
        moves = np.zeros_like(m)
        for t in range(1, len(emit)):
            moves += np.exp(fwd[t - 1][:, :, None] + m[None] + (emit[t] + bwd[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        return p, moves, z

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """Best tags (steps, windows)."""
        m, back = self.p["move"], np.zeros(emit.shape, np.int64)
        best = emit[0]
        for t in range(1, len(emit)):
            s = best[:, :, None] + m[None]
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + emit[t]
        out = np.zeros(emit.shape[:2], np.int64)
        out[-1] = best.argmax(axis=1)
        for t in range(len(emit) - 2, -1, -1):
            out[t] = np.take_along_axis(back[t + 1], out[t + 1][:, None], 1)[:, 0]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @, each such character well inside of one of them."""
    if not _ANCHOR.search(text):
        return []
    step = WINDOW - OVERLAP
    at = np.array([m.start() for m in _ANCHOR.finditer(text)])
    first = np.maximum(0, (at - OVERLAP // 2) // step - 1)
    return sorted({int(k) * step for d in (0, 1, 2) for k in np.unique(first + d) if k * step < len(text)})


def padded(text: str, start: int, size: int = WINDOW) -> np.ndarray:
    """Classes of a window, padded beyond the text."""
    c = classes(text[start : start + size])
    return np.concatenate([c, np.full(size - len(c), N_CLASSES)])


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 3, epochs: int = 10, batch: int = 64, rate: float = 0.02) -> Network:
    """Fits the network by Adam on the log likelihood of the tags of each window."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    xs, ys = [], []
    for text, found in labelled:
        y = np.concatenate([tags(len(text), found), np.zeros(WINDOW, np.int64)])
        for start in range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP):
            xs.append(padded(text, start))
            ys.append(y[start : start + WINDOW])
    x, y = np.array(xs).T, np.array(ys).T
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        for at in np.array_split(r.permutation(x.shape[1]), max(1, x.shape[1] // batch)):
            bx, by = x[:, at], y[:, at]
            emit, saved = net.emissions(bx, keep=True)
            p, moves, _ = net.marginals(emit)
            p[np.arange(WINDOW)[:, None], np.arange(len(at))[None, :], by] -= 1
            np.add.at(moves, (by[:-1].reshape(-1), by[1:].reshape(-1)), -1)
            grad = net.backward(bx, saved, p / len(at)) | {"move": moves / len(at)}
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                net.p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Network({k: v.astype(np.float32) if k != "move" else v for k, v in net.p.items()})


@lru_cache(maxsize=1)
def default_network() -> Network:
    """The network trained on `examples`; once in a process, as it depends on nothing else."""
    return train(examples())


# Decoding


def reconciled(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The heaviest set of spans that don't overlap; a span that several windows agree on weighs their sum."""
    weight: dict[tuple[str, int, int], list[float]] = {}
    for kind, a, b, p in found:
        weight.setdefault((kind, a, b), []).append(p)
    rows = sorted((b, a, kind, (b - a) * sum(p), max(p)) for (kind, a, b), p in weight.items())
    best: list[tuple[float, int]] = [(0.0, -1)]
    ends = [r[0] for r in rows]
    prev = [int(np.searchsorted(ends, r[1], side="right")) for r in rows]
    for i, r in enumerate(rows):
        take = best[min(prev[i], i)][0] + r[3]
        best.append((take, i) if take > best[i][0] else (best[i][0], -1))
    out, i = [], len(rows)
    while i > 0:
        if best[i][1] >= 0:
            b, a, kind, _, p = rows[i - 1]
            out.append((kind, a, b, p))
            i = min(prev[i - 1], i - 1)
        else:
            i -= 1
    return out[::-1]


def decoded(texts: list[str], where: list[tuple[int, int]], size: int, net: Network) -> Iterator[tuple[int, tuple[str, int, int, float], bool]]:
    """Spans (kind, start, end, confidence) of windows (text, start) of one size, and whether the window's edge may cut them."""
    at_once = max(1, 2048 * WINDOW // size)
    for at in range(0, len(where), at_once):
        part = where[at : at + at_once]
        x = np.array([padded(texts[i], s, size) for i, s in part]).T
        emit = net.emissions(x)[0].astype(np.float64)
        path, p = net.viterbi(emit), net.marginals(emit)[0]
        sure = np.take_along_axis(p, path[:, :, None], 2)[:, :, 0]
        for w in np.flatnonzero((path > 0).any(axis=0)):
            i, s = part[w]
            n = min(size, len(texts[i]) - s)
            y, t = path[:n, w], 0
            while t < n:
                if y[t] == 0:
                    t += 1
                    continue
                kind = (y[t] - 1) // 2
                e = t + 1
                while e < n and y[e] == 2 * kind + 2:
                    e += 1
                cut = (t == 0 and s > 0) or (e == n and s + n < len(texts[i]))
                yield i, (KINDS[kind], s + t, s + e, float(sure[t:e, w].mean())), cut
                t = e


def network_spans(texts: list[str], net: Network, least: float = 0.8) -> list[list[tuple[str, int, int]]]:
    """Confident spans of each text, by the network alone.

    A piece that a window's edge cuts, and that no whole span holds, is read again in the windows of
    twice the size that meet it, until nothing is cut: a span is found whatever its length and place.
    """
    where, size = [(i, s) for i, t in enumerate(texts) for s in windows_of(t)], WINDOW
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    while where:
        cut: list[list[tuple[int, int]]] = [[] for _ in texts]
        for i, span, edge in decoded(texts, where, size, net):
            if edge:
                cut[i].append(span[1:3])
            else:
                found[i].append(span)
        size, again = 2 * size, set()
        for i, pieces in enumerate(cut):
            if not pieces:
                continue
            # The furthest end of the whole spans that start at or before each start.
            whole = sorted({x[1:3] for x in found[i]})
            starts, ends = [x[0] for x in whole], np.maximum.accumulate([x[1] for x in whole]) if whole else []
            step = size // 2
            for a, b in set(pieces):
                k = bisect_right(starts, a)
                if not k or ends[k - 1] < b:
                    again |= {(i, j * step) for j in range(max(0, a // step - 1), (b - 1) // step + 1)}
        where = sorted(again)
    return [[(k, a, b) for k, a, b, p in reconciled(f) if p >= least] for f in found]


def all_spans(texts: list[str], net: Network) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(pattern spans, spans that the network adds) of each text."""
    out = []
    for text, more in zip(texts, network_spans(texts, net), strict=True):
        base = base_spans(text)
        new = [(k, a, b) for k, a, b in more if plausible(k, text[a:b]) and all(b <= c or d <= a for _, c, d in base)]
        out.append((base, new))
    return out


def detect(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind, start, end, base) of every row."""
    spark = docs.sparkSession
    common.prepare(spark)
    held = spark.sparkContext.broadcast(net or default_network())  # a few thousand numbers
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))])

    def rows(batch: list[dict]) -> Iterator[dict]:
        for r, (base, new) in zip(batch, all_spans([r["text"] or "" for r in batch], held.value), strict=True):
            kinds = [s[0] for s in base]
            own = set(base)
            yield {"doc_id": r["doc_id"], **{f"n_{k}": kinds.count(k) for k in KINDS}, "base_sha256": spans.digest(spans.joined(base, KINDS)), "spans": [{"kind": k, "start": a, "end": b, "base": (k, a, b) in own} for k, a, b in spans.ordered(base + new, KINDS)]}

    return common.map_rows(docs.select("doc_id", "text"), rows, schema, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans, overlapping ones together, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans.ordered(found, KINDS):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """`docs` with personal data replaced, and n_chars counted anew where there is such a column; null texts stay null."""
    spark = docs.sparkSession
    common.prepare(spark)
    held = spark.sparkContext.broadcast(net or default_network())

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        common.serve("pii")
        given = [t or "" for t in texts]
        return pd.Series([None if t is None else redact(t, base + new) for t, (base, new) in zip(texts, all_spans(given, held.value), strict=True)], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
