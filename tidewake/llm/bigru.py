"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as windows of ``WINDOW`` bytes. In each, one network runs forward and one backward;
both states at a byte give probabilities of its language, so every position is labelled. A
document's probabilities are the mean over all its bytes. Trained here in numpy by backpropagation
through time on a bounded sample of windows, at most ``docs_per_language`` documents of each
language and ``windows_per_doc`` windows of each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import doc_crc_mod, schema_of, small_batches, texts_of

WINDOW = 64
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


class ByteBiGRU:
    """Weights of both directions; arrays are (features, windows), gates in the order update, reset, candidate."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 3):
        self.labels, self.hidden = labels, hidden
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.weights = {f"{k}{d}": v for d in "fb" for k, v in (("x", draw(3 * hidden, 256, scale=0.5)), ("u", draw(3 * hidden, hidden, scale=hidden**-0.5)))}
        self.weights |= {"v": draw(len(labels), 2 * hidden, scale=(2 * hidden) ** -0.5), "c": np.zeros((len(labels), 1), np.float32)}

    def _run(self, data: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (steps, hidden, windows) after each byte of ``data`` (steps, windows), in reading order of ``side``."""
        n, (x, u) = self.hidden, (self.weights["x" + side], self.weights["u" + side])
        half = np.ones((3 * n, 1), np.float32)
        half[: 2 * n] = 0.5  # a logistic gate is half of 1 + tanh of half its input
        x, u = x * half, u * half
        out, h = np.empty((len(data), n, data.shape[1]), np.float32), np.zeros((n, data.shape[1]), np.float32)
        steps = range(len(data)) if side == "f" else range(len(data) - 1, -1, -1)
        for t in steps:
            a, g = np.take(x, data[t], axis=1), u @ h
            gates = np.tanh(a[: 2 * n] + g[: 2 * n])
            gates += 1
            gates *= 0.5
            z, r = gates[:n], gates[n:]
            cand = np.tanh(a[2 * n :] + r * g[2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, cand, g[2 * n :]))
            h = h + z * (cand - h)
            out[t] = h
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (steps, labels, windows)."""
        return self._softmax(np.concatenate((self._run(data, "f"), self._run(data, "b")), axis=1))

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        p = np.matmul(self.weights["v"], states) + self.weights["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, data: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean log loss over the bytes of the windows, and the loss."""
        n, grads, kept = self.hidden, {}, {"f": [], "b": []}
        states = np.concatenate([self._run(data, s, kept[s]) for s in "fb"], axis=1)
        p = self._softmax(states)
        there = (np.arange(len(data))[:, None] < sizes[None, :]) / np.float32(max(1, sizes.sum()))
        cols = np.arange(data.shape[1])
        loss = float(-(np.log(p[:, label, cols] + 1e-30) * there).sum())
        d = p
        d[:, label, cols] -= 1
        d *= there[:, None, :].astype(np.float32)
        grads["v"] = np.einsum("tcn,thn->ch", d, states, optimize=True)
        grads["c"] = d.sum(axis=(0, 2))[:, None]
        into = np.matmul(self.weights["v"].T, d)
        for s in "fb":
            u, gx, gu = self.weights["u" + s], np.zeros_like(self.weights["x" + s]), np.zeros_like(self.weights["u" + s])
            dh, part = np.zeros((n, data.shape[1]), np.float32), slice(0, n) if s == "f" else slice(n, 2 * n)
            for t, h, z, r, cand, un in reversed(kept[s]):
                dh = dh + into[t, part]
                dcand = dh * z * (1 - cand * cand)
                dz, dr, dun = dh * (cand - h) * z * (1 - z), dcand * un * r * (1 - r), dcand * r
                inner = np.concatenate((dz, dr, dun))
                gu += inner @ h.T
                hot = np.zeros((data.shape[1], 256), np.float32)
                hot[cols, data[t]] = 1
                gx += np.concatenate((dz, dr, dcand)) @ hot
                dh = dh * (1 - z) + u.T @ inner
            grads |= {"x" + s: gx, "u" + s: gu}
        return grads, loss

    def fit(self, data: np.ndarray, sizes: np.ndarray, label: np.ndarray, *, steps: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 5) -> "ByteBiGRU":
        """Adam over random batches of windows (columns of ``data``)."""
        rng, m, v = np.random.default_rng(seed), {k: 0.0 for k in self.weights}, {k: 0.0 for k in self.weights}
        for i in range(1, steps + 1):
            pick = rng.integers(0, data.shape[1], min(batch, data.shape[1]))
            grads, _ = self.gradients(data[:, pick], sizes[pick], label[pick])
            pace = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - pace * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, labels) over all bytes of each text; zeros for empty texts."""
        data, sizes, owner = windows_of(texts)
        out = np.zeros((len(texts), len(self.labels)))
        for i in range(0, data.shape[1], 4096):
            part = slice(i, i + 4096)
            p = self.positions(data[:, part])
            p *= (np.arange(WINDOW)[:, None] < sizes[None, part])[:, None, :]
            np.add.at(out, owner[part], p.sum(axis=0).T)
        return out / np.maximum(1, [len(t) for t in texts])[:, None]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (WINDOW, windows) bytes, zero-filled at a text's end; their sizes and the text of each."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist())), np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    sizes = np.minimum(WINDOW, np.array([len(t) for t in texts], np.int64)[owner] - nth * WINDOW)
    return np.ascontiguousarray(raw.reshape(-1, WINDOW).T), sizes, owner


def training_sample(docs: DataFrame, docs_per_language: int, windows_per_doc: int) -> list:
    """(lang, windows) rows of at most ``docs_per_language`` documents of each language, drawn by hash."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    share = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(2.0 * docs_per_language) / F.col("count")).alias("share"))
    thin = rows.join(F.broadcast(share), "lang").filter(draw < F.col("share") * (1 << 30))  # one row per language
    at = F.sequence(F.lit(0), F.lit(windows_per_doc - 1))
    cut = F.transform(at, lambda i: F.encode(F.substring("text", (F.floor(i * F.length("text") / windows_per_doc) + 1).cast("int"), F.lit(WINDOW)), "UTF-8"))
    thin = thin.select("lang", draw.alias("draw"), "doc_id", F.array_distinct(cut).alias("windows"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    return thin.withColumn("rank", rank).filter(F.col("rank") <= docs_per_language).orderBy("lang", "rank").select("lang", "windows").collect()


def train(docs: DataFrame, *, docs_per_language: int = 512, windows_per_doc: int = 8, **fit) -> ByteBiGRU | None:
    """A network for the languages of ``docs`` (doc_id, text, lang); None where no row is labelled."""
    rows = training_sample(docs, docs_per_language, windows_per_doc)
    labels = sorted({r.lang for r in rows})
    if not labels:
        return None
    texts = [(bytes(w)[:WINDOW], labels.index(r.lang)) for r in rows for w in r.windows]
    # as many windows of one language as of another
    counts = np.bincount([c for _, c in texts], minlength=len(labels))
    order = np.random.default_rng(1).permutation(len(texts))
    data, sizes, _ = windows_of([texts[i][0] for i in order])
    label = np.array([texts[i][1] for i in order])
    weight = (1 / counts)[label]
    even = np.random.default_rng(2).choice(len(label), len(label), p=weight / weight.sum())
    return ByteBiGRU(labels).fit(data[:, even], sizes[even], label[even], **fit)


def predict_language(docs: DataFrame, model: ByteBiGRU | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its probability to (text, ...) as columns ``names``; the other columns are kept.

    ``und`` with score 0 for null texts, texts without letters and without a model. Ties go to the
    label that sorts first. A text of any length is read as a whole. Raises ValueError if ``docs`` has
    such columns already.
    """
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has columns {names} already")
    schema = f"{schema_of(docs)}, `{names[0]}` string, `{names[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            texts = texts_of(batch, "text")
            lettered = np.array([bool(LETTER[np.frombuffer(t, np.uint8)].any()) or any(c.isalpha() for c in t.decode()) for t in texts], bool)
            if model is None or not lettered.any():
                lettered[:] = False
                p, labels = np.zeros((len(texts), 1)), ["und"]
            else:
                p, labels = model.documents([t if ok else b"" for t, ok in zip(texts, lettered)]), model.labels
            best = p.argmax(axis=1)
            pred = [labels[i] if ok else "und" for i, ok in zip(best, lettered)]
            score = np.where(lettered, np.clip(p[np.arange(len(p)), best], 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, *, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learnt from labelled rows outside fold 0.

    Rows that share a doc_id share its fold. Columns besides doc_id, text and lang are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(doc_crc_mod("doc_id", folds) != 0))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", (doc_crc_mod("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
