"""A byte-level convolutional network for text quality, in numpy.

A text is cut into overlapping chunks that cover all its bytes. Learned filters of ``WIDTH`` bytes slide over each chunk and are max-pooled in it;
the pooled values of all chunks are combined by their mean and by their maximum, and a logistic layer makes one probability of
them. The network is trained here, by gradient descent, on a bounded sample of labelled texts.

Defined cases: null and empty texts are scored as one chunk of padding; with no labelled text, or labels of one class only, every score is the share of
label 1 among the labels (0.5 without any); repeated rows are scored alike; long texts are learned from and scored whole; other columns are kept, and
replaced only where they are named as a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.llm.common import extended

CHUNK, STEP, WIDTH, STRIDE = 256, 240, 8, 1  # bytes; chunks overlap by more than a filter's width
FILTERS, EMBED = 16, 6
SAMPLE_TEXTS = 4000  # labelled texts to train on, those of smallest id hash: the bound of the sample; each is learned from whole
SLICE = 512  # chunks that the filters slide over at a time
EPOCHS, STEPS, BATCH, RATE, DECAY = 7, 1000, 24, 4e-3, 1e-5  # as many epochs, and more while there are fewer steps
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover the whole text, the last one padded with zeros."""
    n = max(1, -(-(len(data) - CHUNK) // STEP) + 1) if len(data) > CHUNK else 1
    buf = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    buf[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::STEP]


@dataclass
class Net:
    """Parameters; ``share`` stands in when there is nothing to learn from."""

    emb: np.ndarray
    conv: np.ndarray  # (WIDTH, EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    share: float | None = None

    def tables(self) -> np.ndarray:
        """(WIDTH, 256, FILTERS): what a byte adds to the filters at each place of their width."""
        return np.einsum("be,wef->wbf", self.emb, self.conv).astype(np.float32)

    def pooled(self, x: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter values in each chunk (chunks, FILTERS), and at which place."""
        tops, places = [], []
        for lo in range(0, len(x), SLICE):
            part = x[lo : lo + SLICE]
            sums = tables[0][part[:, 0 : STRIDE * (PLACES - 1) + 1 : STRIDE]]
            for w in range(1, WIDTH):
                sums += tables[w][part[:, w : w + STRIDE * (PLACES - 1) + 1 : STRIDE]]
            at = sums.argmax(axis=1)
            tops.append(np.take_along_axis(sums, at[:, None, :], axis=1)[:, 0, :] + self.bias)
            places.append(at)
        return np.concatenate(tops), np.concatenate(places)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        tables, out = self.tables(), []
        held, owner, sums, tops, counts = [], [], np.zeros((len(texts), FILTERS)), np.full((len(texts), FILTERS), -np.inf), np.zeros(len(texts))

        def flush():
            if held:
                v = np.tanh(self.pooled(np.concatenate(held), tables)[0])
                o = np.concatenate(owner)
                np.add.at(sums, o, v), np.maximum.at(tops, o, v)
                held.clear(), owner.clear()

        size = 0
        for i, t in enumerate(texts):
            c = chunks_of(t)
            counts[i] = len(c)
            for lo in range(0, len(c), 512):
                part = c[lo : lo + 512]
                held.append(part), owner.append(np.full(len(part), i))
                size += len(part)
                if size >= 512:
                    flush()
                    size = 0
        flush()
        feats = np.concatenate([sums / counts[:, None], tops], axis=1)
        return 1 / (1 + np.exp(-(feats @ self.out + self.shift)))


def train(texts: list[bytes], labels: list[int], seed: int = 5) -> Net:
    """A network fitted by Adam to the labels of texts, by all of their chunks."""
    cut = [chunks_of(t) for t in texts]  # views of the texts
    y = np.array(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.3, (256, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    if len(set(labels)) < 2:
        net.share = float(y.mean()) if len(y) else 0.5
        return net
    net.shift = float(np.log(y.mean() / (1 - y.mean())))
    state = {k: [np.zeros_like(np.asarray(getattr(net, k))), np.zeros_like(np.asarray(getattr(net, k)))] for k in ("emb", "conv", "bias", "out", "shift")}
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(cut)))
    step, total = 0, epochs * -(-len(cut) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            x = np.concatenate([cut[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(cut[i]) for i in batch])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            n = np.bincount(owner)[:, None]
            tables = net.tables()
            raw, at = net.pooled(x, tables)
            v = np.tanh(raw)
            mean, top = np.add.reduceat(v, first) / n, np.maximum.reduceat(v, first)
            feats = np.concatenate([mean, top], axis=1)
            p = 1 / (1 + np.exp(-(feats @ net.out + net.shift)))
            d = (p - y[batch]) / len(batch)
            grads = {"out": feats.T @ d, "shift": d.sum()}
            df = d[:, None] * net.out
            dv = df[owner, :FILTERS] / n[owner]
            is_top = v == top[owner]
            dv += df[owner, FILTERS:] * is_top / np.maximum(1, np.add.reduceat(is_top, first)[owner])
            dr = dv * (1 - v * v)
            grads["bias"] = dr.sum(axis=0)
            grads["emb"], grads["conv"] = np.zeros_like(net.emb), np.zeros_like(net.conv)
            rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)
            for w in range(WIDTH):
                byte = x[rows, STRIDE * at + w]
                dt = np.bincount((byte.astype(np.int64) * FILTERS + cols).ravel(), weights=dr.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                grads["conv"][w] = net.emb.T @ dt
                grads["emb"] += dt @ net.conv[w].T
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in grads.items():
                m, s = state[k]
                value = getattr(net, k)
                g = g + DECAY * value
                m[...], s[...] = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                setattr(net, k, value - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8))
    net.shift = float(net.shift)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS) -> tuple[list[bytes], list[int]]:
    """Texts and labels of the sample: labels (doc_id, quality) of smallest id hash that are 0 or 1, one a document."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` labels
    got = sorted((str(r["doc_id"]), (r["text"] or "").encode(), r["quality"]) for r in found.collect())[:sample]
    return [t for _, t, _ in got], [y for _, _, y in got]


def score(docs: DataFrame, net: Net, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, unless it is kept) with _score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    work = lambda texts: (shared.value.scores([t.encode() if isinstance(t, str) else b"" for t in texts]).tolist(),)
    return extended(docs, [text], "_score double", work, () if keep_text else (text,))
