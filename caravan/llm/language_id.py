"""Language identification by a bidirectional gated recurrent network over bytes.

Lower-cased UTF-8 bytes are read in windows; a network of two directions labels every byte with probabilities of the learned
languages, and a document's probability is the mean over its bytes. The network is trained in numpy by backpropagation through
time on a bounded sample of labelled documents and then broadcast; prediction is a map over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravan.llm.shared import attach, text_slices

#: Labelled documents that the network is fitted on, dealt evenly among the languages, and characters read of each; languages learned.
FIT_ROWS, FIT_CHARS, LANGUAGES = 2400, 600, 256
#: Bytes of a window, hidden units of a direction, windows that go through the network together.
WINDOW, HIDDEN, TOGETHER = 64, 16, 512
#: Of training: windows of a step, steps, step size.
BATCH, STEPS, RATE = 128, 150, 0.02
#: The label of texts without a letter.
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


def held_out(key) -> F.Column:
    """Documents that are never learned from: crc32 of the id as text, mod 3, is 1. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """A gated recurrent layer: table has what each byte adds to the gates (update, reset, candidate), u what the state adds."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)  # of the candidate, within the reset

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.u, self.bias]

    def forward(self, x: np.ndarray, keep: list) -> np.ndarray:
        """x: bytes by time and window -> states by time, window and unit. keep gets what backward() needs."""
        steps, n = x.shape
        k = self.hidden
        out = np.empty((steps, n, k), np.float32)
        h = np.zeros((n, k), np.float32)
        for t in range(steps):
            a, s = self.table.take(x[t], axis=0), h @ self.u
            gates = _sigmoid(a[:, : 2 * k] + s[:, : 2 * k])
            z, r, s = gates[:, :k], gates[:, k:], s[:, 2 * k :] + self.bias
            c = 2 * _sigmoid(2 * (a[:, 2 * k :] + r * s)) - 1  # the hyperbolic tangent
            keep.append((h, z, r, s, c))
            h = c + z * (h - c)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, from those of the states."""
        u, bias, dh = np.zeros_like(self.u), np.zeros_like(self.bias), np.zeros_like(above[0])
        gates = np.empty((len(x), x.shape[1], 3 * self.hidden), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, s, c = kept[t]
            dh = dh + above[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            ds = dc * r
            dr = dc * s * r * (1 - r)
            gates[t] = np.concatenate([dz, dr, dc], axis=1)
            back = np.concatenate([dz, dr, ds], axis=1)
            u += h.T @ back
            bias += ds.sum(axis=0)
            dh = dh * z + back @ self.u.T
        table, order = np.zeros_like(self.table), np.argsort(x, axis=None, kind="stable")
        seen, first = np.unique(x.ravel()[order], return_index=True)
        table[seen] = np.add.reduceat(gates.reshape(-1, gates.shape[2])[order], first)
        return [table, u, bias]


class Network:
    """Two directions and an output layer over both states."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.w = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.w, self.c]

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all real positions, whose label is their window's, and its gradients."""
        keep = ([], [])
        states = np.concatenate([self.ahead.forward(x, keep[0]), self.back.forward(x[::-1], keep[1])[::-1]], axis=2)
        p = states @ self.w + self.c
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        weight = real / max(real.sum(), 1)
        at = np.arange(len(y))
        loss = -float((np.log(p[:, at, y] + 1e-9) * weight).sum())
        p[:, at, y] -= 1
        p *= weight[:, :, None]
        k = self.ahead.hidden
        below = p @ self.w.T
        return loss, [
            *self.ahead.backward(x, keep[0], below[:, :, :k]), *self.back.backward(x[::-1], keep[1], below[::-1, :, k:]),
            np.tensordot(states, p, ((0, 1), (0, 1))), p.sum(axis=(0, 1)),
        ]


class Labeller:
    """A network's forward pass, laid out for speed: units by window, both directions at once, states held in (0, 1).

    With h = 2 g - 1 and tanh(a) = 2 sigmoid(2 a) - 1 the state g moves between sigmoids, so signs and factors go into the weights.
    """

    def __init__(self, net: Network):
        k = self.k = net.ahead.hidden
        both = (net.ahead, net.back)
        factor = np.r_[-np.ones(2 * k), np.full(k, -2.0)].astype(np.float32)[:, None]
        offset = [d.u.sum(axis=0) for d in both]  # what g's middle adds
        self.tables = [np.ascontiguousarray(d.table.T - np.r_[o[: 2 * k], np.zeros(k)][:, None]).astype(np.float32) * factor for d, o in zip(both, offset, strict=True)]
        self.u = np.stack([2 * d.u.T * factor for d in both]).astype(np.float32)
        self.bias = np.stack([(d.bias - o[2 * k :])[:, None] * np.float32(-2) for d, o in zip(both, offset, strict=True)]).astype(np.float32)
        self.w = np.stack([2 * net.w[:k].T, 2 * net.w[k:].T]).astype(np.float32)
        self.c = (net.c - net.w.sum(axis=0))[:, None].astype(np.float32)

    def label(self, x: np.ndarray) -> np.ndarray:
        """x: bytes by time and window -> probabilities by time, language and window."""
        steps, n = x.shape
        k = self.k
        parts = np.empty((2, steps, len(self.c), n), np.float32)
        g = np.full((2, k, n), 0.5, np.float32)
        a = np.empty((2, 3 * k, n), np.float32)
        s = np.empty_like(a)
        gates, c = a[:, : 2 * k], a[:, 2 * k :]
        z, r, inner = gates[:, :k], gates[:, k:], s[:, 2 * k :]
        for t in range(steps):
            np.take(self.tables[0], x[t], axis=1, out=a[0], mode="clip")
            np.take(self.tables[1], x[steps - 1 - t], axis=1, out=a[1], mode="clip")
            np.matmul(self.u, g, out=s)
            gates += s[:, : 2 * k]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            inner += self.bias
            inner *= r
            c += inner
            np.exp(c, out=c)
            c += 1
            np.reciprocal(c, out=c)
            g -= c
            g *= z
            g += c
            np.matmul(self.w[0], g[0], out=parts[0, t])
            np.matmul(self.w[1], g[1], out=parts[1, steps - 1 - t])
        p = parts[0]
        p += parts[1]
        p += self.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 1) -> Network:
    """A network for the labels of the texts. Steps draw windows at random, of each language as often as of any other; Adam."""
    languages = sorted(set(labels))
    net, rng = Network(languages, hidden, seed), np.random.default_rng(seed)
    by_language = [[_bytes(t) for t, m in zip(texts, labels, strict=True) if m == name] for name in languages]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        y = rng.integers(0, len(languages), BATCH)
        x, real = np.zeros((BATCH, WINDOW), np.uint8), np.zeros((BATCH, WINDOW), np.float32)
        for i, k in enumerate(y):
            text = by_language[k][rng.integers(len(by_language[k]))]
            size = WINDOW if rng.random() < 0.75 else int(rng.integers(4, WINDOW))  # a text's last window is seldom full
            at = rng.integers(0, max(1, len(text) - size + 1))
            part = np.frombuffer(text[at : at + size], np.uint8)
            x[i, : len(part)], real[i, : len(part)] = part, 1
        _, found = net.gradients(np.ascontiguousarray(x.T), real.T, y)
        norm = float(np.sqrt(sum((g * g).sum() for g in found)))
        rate = RATE * min(1.0, 4 * (1 - (step - 1) / steps))  # falls over the last three quarters
        for p, g, m, v in zip(net.parameters(), found, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, languages: int = LANGUAGES) -> Network | None:
    """A network learned from text and lang of at most fit_rows documents; None if none has a language and a letter.

    docs(doc_id, text, lang, ...). Held-out documents, null languages and texts without a letter are left out. Of each of the most
    frequent languages, at most so many, the documents whose hash is smallest are taken, as many of one as of another, and FIT_CHARS
    characters of each from a place that the hash tells. The sample doesn't depend on how the rows lie.
    """
    attach(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select(F.col("lang").cast("string"), "doc_id", F.col("text").cast("string"))
    names = [(r.lang, r["count"]) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not names:
        return None
    each = max(1, fit_rows // len(names))
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 11)
    size = F.length("text")
    place = F.when(size > FIT_CHARS, F.pmod(F.col("h"), size - FIT_CHARS + 1)).otherwise(0).cast("int") + 1
    # hashes are even, so few rows more than wanted are below a bound that follows from the language's count
    bounds = [(name, min(1.0, (each + 8 * each**0.5 + 40) / n) * 2.0**53) for name, n in names]
    limits = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, most double"))
    rows = known.withColumn("h", h).join(limits, "lang").where(F.col("h") < F.col("most")).select("lang", "h", F.substring("text", place, F.lit(FIT_CHARS)).alias("text")).where(r"text rlike '\\p{L}'")
    chosen = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= each)
    sample = sorted((r.lang, r.h, r.text) for r in chosen.collect())
    return train([t for _, _, t in sample], [m for m, _, _ in sample]) if sample else None


@dataclass
class Pooled:
    """Of one text: mean probabilities, and shares of the positions by their likeliest language."""

    probabilities: np.ndarray
    shares: np.ndarray


def pool(net: Network, texts: list[str | None]) -> list[Pooled | None]:
    """Whole texts of any length, window by window; None for a text that is null or has no letter."""
    wanted = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    encoded = [_bytes(texts[i]) for i in wanted]
    counts = np.array([len(b) for b in encoded], np.int64)
    windows = -(-counts // WINDOW)
    owner = np.repeat(np.arange(len(encoded)), windows)
    data = np.zeros(int(windows.sum()) * WINDOW, np.uint8)
    begin = (np.cumsum(windows) - windows) * WINDOW
    for b, at in zip(encoded, begin.tolist(), strict=True):
        data[at : at + len(b)] = np.frombuffer(b, np.uint8)
    data = data.reshape(-1, WINDOW)
    sizes = np.full(len(owner), WINDOW)
    if len(owner):
        sizes[np.cumsum(windows) - 1] = counts - (windows - 1) * WINDOW
    k, labeller = len(net.languages), Labeller(net)
    sums, votes = np.zeros((len(encoded), k)), np.zeros((len(encoded), k))
    for i in range(0, len(owner), TOGETHER):
        with np.errstate(over="ignore"):  # a gate far from 0 is closed
            p = labeller.label(np.ascontiguousarray(data[i : i + TOGETHER].T))
        real = np.arange(WINDOW)[:, None] < sizes[None, i : i + TOGETHER]
        best = p.argmax(axis=1)
        p *= real[:, None]
        mine = owner[i : i + TOGETHER]
        np.add.at(sums, mine, p.sum(axis=0).T)
        np.add.at(votes, mine, np.stack([((best == j) & real).sum(axis=0) for j in range(k)], axis=1))
    out: list[Pooled | None] = [None] * len(texts)
    for j, i in enumerate(wanted):
        out[i] = Pooled(sums[j] / counts[j], votes[j] / counts[j])
    return out


SHARES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = broadcast.value
        for batch in text_slices(batches):
            names, scores, shares = [], [], []
            for found in pool(net, batch.column("text").to_pylist()) if net else [None] * batch.num_rows:
                best = int(found.probabilities.argmax()) if found else 0
                names.append(net.languages[best] if found else UNDETERMINED)
                scores.append(min(1.0, float(found.probabilities[best])) if found else 0.0)
                shares.append([{"lang": net.languages[j], "share": float(found.shares[j])} for j in np.flatnonzero(found.shares)] if found else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, SHARES)], [*batch.schema.names, "lang_pred", "score", "shares"])

    return run


def label_languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(text, ...) with (lang_pred, score: mean probability of that language, shares: of the bytes by their likeliest language).

    Keeps every row and all columns but former ones of these names. A null text, or one without a letter, is 'und' with score 0 and
    no shares, and so is every text where nothing was learned. Equal probabilities go to the language that sorts first. Whole
    texts of any length are read, in windows; an empty table gives an empty result.
    """
    attach(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "shares").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(shared), f"{fields}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")
