"""Language ID by interpolated Kneser-Ney character models.

A model of order ``ORDER`` is counted for each language on a bounded sample of labelled texts. The grams of all languages of one order
form one sorted array of 64-bit hashes with a row of log probabilities (one column a language) beside it, and the contexts another one
with back-off weights. A text is scored whole: each character takes the longest gram that any language has seen; shorter matches
add the weights of the contexts passed. The language with the least mean cross-entropy wins.

Calibration is done on sample texts that the models were not fitted on. The score is a softmax of the negative cross-entropies, its temperature
the one of least log loss there. For rejection the cross-entropy of a text of n characters in its own language is standardised
by mean and standard deviation sqrt(a + b / n), and an exponential tail is fitted to the largest standardised values: a text is rejected where a text of its
language would be with a chance of ``REJECTED``.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and are rejected; ties go to the first language by name; with
no labelled text every row is ``und``; repeated rows are scored alike; long texts are learned and scored whole, in slices; other columns are kept, and replaced only
where they are named as a result.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.common import extended

ORDER = 4
FIT_TEXTS, CALIBRATION_TEXTS = 400, 200  # labelled texts of a language that a model is fitted and calibrated on, those of smallest id hash: the bound of the sample
DISCOUNT = 0.75
FLOOR = 1e-6  # probability of a character that no language has seen
SLICE = 1 << 20
REJECTED = 1e-4  # share of a language's own texts that the calibrated threshold rejects
TAIL = 0.1  # share of the standardised cross-entropies that its tail is fitted on
LEAST_TEXTS = 20  # with fewer calibration texts of a language all of the sample's texts calibrate it

_SPACE = re.compile(r"\s+")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, white space as one blank, digits as 0, with blanks around it."""
    flat = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    out = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    out[(out >= 49) & (out <= 57)] = 48
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_hashes(c: np.ndarray) -> list[np.ndarray]:
    """For n = 1 .. ORDER the hash of the n characters that end at each place (the first n - 1 places have shorter ones)."""
    with np.errstate(over="ignore"):
        one = (c.astype(np.uint64) + np.uint64(1)) * _M[0]
        one ^= one >> np.uint64(29)
        out = [one]
        for _ in range(1, ORDER):
            prev = out[-1]
            nxt = prev.copy()
            nxt[1:] = prev[:-1] * _M[1] + one[1:]
            nxt[1:] ^= nxt[1:] >> np.uint64(31)
            out.append(nxt * _M[2])
    return out


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # sorted hashes, by order
    logp: list[np.ndarray]  # (grams, languages), by order
    contexts: list[np.ndarray]
    back: list[np.ndarray]  # log back-off weights (contexts, languages), by order of the gram they leave
    usual: np.ndarray  # (languages, 4): mean, a and b of the variance, and the standardised threshold
    sharp: float = 1.0  # what cross-entropies are multiplied by for the score

    def find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return at, table[at] == keys if len(table) else np.zeros(len(keys), dtype=bool)

    def total(self, c: np.ndarray, start: int = 0) -> tuple[np.ndarray, int]:
        """Sum of log probabilities of the characters from place ``start`` on, by language, and how many they are."""
        hashes = gram_hashes(c)
        todo = np.arange(max(start, 0), len(c))
        sums, n = np.zeros(len(self.langs)), len(todo)
        for order in range(ORDER, 0, -1):
            enough = todo >= order - 1
            here, rest = todo[enough], todo[~enough]
            at, hit = self.find(self.grams[order - 1], hashes[order - 1][here])
            if hit.any():
                sums += np.bincount(at[hit], minlength=len(self.grams[order - 1])) @ self.logp[order - 1] if hit.sum() > len(self.grams[order - 1]) else self.logp[order - 1][at[hit]].sum(axis=0)
            here = here[~hit]
            if order > 1 and len(here):
                at, known = self.find(self.contexts[order - 1], hashes[order - 2][here - 1])
                if known.any():
                    sums += self.back[order - 1][at[known]].sum(axis=0)
            todo = np.concatenate([rest, here])
        return sums + len(todo) * np.log(FLOOR), n

    def entropies(self, text: str) -> np.ndarray:
        """Mean cross-entropy in nats a character, by language, over the whole text."""
        return self.measured(text)[0]

    def measured(self, text: str) -> tuple[np.ndarray, int]:
        """Mean cross-entropies by language, and how many characters they are over."""
        c = codes(text)
        sums, n = np.zeros(len(self.langs)), 0
        for lo in range(0, len(c), SLICE):
            before = min(lo, ORDER - 1)
            s, k = self.total(c[lo - before : lo + SLICE], before)
            sums, n = sums + s, n + k
        return -sums / max(1, n), max(1, n)

    def strange(self, k: int, entropy: float, n: int) -> bool:
        """Whether a text of language ``k`` would hardly have so large a cross-entropy."""
        mean, a, b, limit = self.usual[k]
        return bool((entropy - mean) / np.sqrt(a + b / n) > limit)


def _merged(parts: list[tuple]) -> tuple:
    """One (hashes, counts, contexts, suffixes) of several, sorted by hash."""
    h, n, c, x = (np.concatenate([p[i] for p in parts]) for i in range(4))
    keys, first, place = np.unique(h, return_index=True, return_inverse=True)
    return keys, np.bincount(place, weights=n, minlength=len(keys)), c[first], x[first]


def count_grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order: hashes of distinct grams, their counts, the hash of their context and that of the gram without its first character.

    Counts are taken slice by slice and merged, so that memory follows the distinct grams and not the characters.
    """
    none = np.zeros(0, dtype=np.uint64)
    out = [(none, np.zeros(0), none, none)] * ORDER
    held: list[list[tuple]] = [[] for _ in range(ORDER)]

    def merge():
        for n in range(ORDER):
            out[n] = _merged([out[n], *held[n]])
            held[n].clear()

    size = 0
    for text in texts:
        c = codes(text)
        for lo in range(0, len(c), SLICE):
            before = min(lo, ORDER - 1)
            h = gram_hashes(c[lo - before : lo + SLICE])
            for n in range(ORDER):
                at = np.arange(max(n, before), len(h[0]))
                held[n].append((h[n][at], np.ones(len(at)), h[n - 1][at - 1] if n else np.zeros(len(at), dtype=np.uint64), h[n - 1][at] if n else np.zeros(len(at), dtype=np.uint64)))
            size += len(h[0])
            if size >= SLICE:
                merge()
                size = 0
    merge()
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    """Interpolated Kneser-Ney of every language, joined to arrays over the grams of all."""
    langs = sorted(samples)
    counted = [count_grams(samples[x]) for x in langs]
    grams = [np.unique(np.concatenate([c[n][0] for c in counted])) for n in range(ORDER)]
    contexts = [np.unique(np.concatenate([c[n][2] for c in counted])) for n in range(ORDER)]
    context_of = [np.zeros(len(g), dtype=np.uint64) for g in grams]
    suffix_of = [np.zeros(len(g), dtype=np.uint64) for g in grams]
    for c in counted:
        for n in range(ORDER):
            at = np.searchsorted(grams[n], c[n][0])
            context_of[n][at], suffix_of[n][at] = c[n][2], c[n][3]
    prob = [np.zeros((len(g), len(langs))) for g in grams]
    back = [np.ones((len(g), len(langs))) for g in contexts]
    for k, c in enumerate(counted):
        for n in range(ORDER):
            keys, raw = c[n][0], c[n][1]
            if n < ORDER - 1:  # in how many characters' wake the gram is seen
                longer = c[n + 1][3]
                kinds, many = np.unique(longer, return_counts=True)
                at = np.searchsorted(kinds, keys)
                at[at == len(kinds)] = 0
                raw = np.where(kinds[at] == keys, many[at], 1.0) if len(kinds) else np.ones(len(keys))
            ctx = np.searchsorted(contexts[n], c[n][2])
            total = np.bincount(ctx, weights=raw, minlength=len(contexts[n]))
            kinds = np.bincount(ctx, minlength=len(contexts[n]))
            seen = total > 0
            back[n][seen, k] = DISCOUNT * kinds[seen] / total[seen]
            here = np.zeros(len(grams[n]))
            here[np.searchsorted(grams[n], keys)] = np.maximum(raw - DISCOUNT, 0) / total[ctx]
            lower = np.full(len(grams[n]), 1.0 / max(256, len(grams[0])))
            if n:
                lower = prob[n - 1][np.searchsorted(grams[n - 1], suffix_of[n]), k]
            prob[n][:, k] = here + back[n][np.searchsorted(contexts[n], context_of[n]), k] * lower
    return Model(langs, grams, [np.log(np.maximum(p, 1e-12)).astype(np.float32) for p in prob], contexts, [np.log(np.maximum(b, 1e-12)).astype(np.float32) for b in back], np.tile([0.0, 1.0, 0.0, np.inf], (len(langs), 1)))


def calibrate(model: Model, samples: dict[str, list[str]]) -> None:
    """Sets the thresholds and the sharpness of ``model`` from texts by language that it was not fitted on."""
    rows, truth = [], []
    for k, lang in enumerate(model.langs):
        got = [model.measured(t) for t in samples.get(lang, [])]
        if not got:
            continue
        h, n = np.array([g[0][k] for g in got]), np.array([g[1] for g in got], dtype=np.float64)
        rows += [g[0] for g in got]
        truth += [k] * len(got)
        # Weighted by length, since the mean over n characters varies by about 1 / n; then the squares about it as a + b / n.
        mean = float((h * n).sum() / n.sum())
        square = (h - mean) ** 2
        x = 1 / n
        b = max(0.0, float(((x - x.mean()) * (square - square.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-300)))
        a = max(float(square.mean() - b * x.mean()), 1e-6)
        z = np.sort((h - mean) / np.sqrt(a + b * x))
        tail = max(1, int(np.ceil(TAIL * len(z))))
        edge = z[-tail - 1] if len(z) > tail else z[0]
        # Exponential tail: the chance of more than edge + y is (tail / texts) exp(-y / m). The largest value seen never counts as strange.
        m = max(float((z[-tail:] - edge).mean()), 0.1)
        limit = max(float(edge + m * np.log(tail / len(z) / REJECTED)), float(z[-1]))
        model.usual[k] = mean, a, b, limit
    if rows:
        h, k = np.array(rows), np.array(truth)
        gap = h - h[np.arange(len(k)), k][:, None]
        loss = lambda s: float(np.log(np.exp(np.minimum(-s * gap, 500)).sum(axis=1)).mean())
        model.sharp = min((2.0 ** (e / 2) for e in range(-4, 13)), key=loss)


def _least_hashed(rows: DataFrame, most: int) -> DataFrame:
    """(doc_id, lang, n): the ``most`` ids of each language of least hash, numbered. Taken within buckets first, so that no task sees all ids of a language."""
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    bucket = F.pmod("h", F.lit(64))
    near = Window.partitionBy("lang", bucket).orderBy("h", "doc_id")
    far = Window.partitionBy("lang").orderBy("h", "doc_id")
    some = hashed.withColumn("n", F.row_number().over(near)).where(F.col("n") <= most)
    return some.withColumn("n", F.row_number().over(far)).where(F.col("n") <= most).select("doc_id", "lang", "n")


def training_rows(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang, text, n) to fit and to calibrate on: those of the smallest id hashes, with a letter. Two scans: ids first, then their texts."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & F.col("doc_id").isNotNull())
    ids = _least_hashed(rows, FIT_TEXTS + CALIBRATION_TEXTS)  # so many rows a language
    return rows.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])


def dealt(found: list[tuple]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Texts by language to fit on and to calibrate on, from rows (lang, n, text)."""
    fit_on: dict[str, list[str]] = {}
    test_on: dict[str, list[str]] = {}
    of: dict[str, list] = {}
    for lang, _, text in sorted(found, key=lambda r: (str(r[0]), r[1], r[2])):
        of.setdefault(lang, []).append(text)
    for lang, texts in of.items():
        texts = texts[: FIT_TEXTS + CALIBRATION_TEXTS]
        held = len(texts) * CALIBRATION_TEXTS // (FIT_TEXTS + CALIBRATION_TEXTS)
        fit_on[lang] = texts[held:]
        test_on[lang] = texts[:held] if held >= LEAST_TEXTS else texts
    return fit_on, test_on


def train(labelled: DataFrame) -> Model | None:
    """A calibrated model from rows (doc_id, text, lang), or None when none is labelled. It is fitted in a task, on the bounded sample; the driver gets the model only."""

    def learn(batches):
        found = [row for rows in batches for row in zip(rows["lang"].tolist(), rows["n"].tolist(), rows["text"].tolist())]
        if found:
            fit_on, test_on = dealt(found)
            model = fit(fit_on)
            calibrate(model, test_on)
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    made = training_rows(labelled).select("lang", "n", "text").repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def decide(model: Model | None, text: str | None) -> tuple[str, float, bool, float]:
    """(language, score, rejected, cross-entropy) of one text."""
    if model is None or not has_letter(text):
        return "und", 0.0, True, float("nan")
    h, n = model.measured(text)
    best = int(np.argmin(h))
    p = np.exp((h[best] - h) * model.sharp)
    return model.langs[best], float(1 / p.sum()), model.strange(best, float(h[best]), n), float(h[best])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, unless it is kept) with _lang, _score, _rejected and _entropy."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def score(texts: list) -> tuple:
        return tuple(zip(*(decide(shared.value, t if isinstance(t, str) else None) for t in texts))) or ((), (), (), ())

    return extended(docs, [text], "_lang string, _score double, _rejected boolean, _entropy double", score, () if keep_text else (text,))
