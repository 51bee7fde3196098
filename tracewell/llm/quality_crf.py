"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's features are byte-class shares and word repetition, its own and those of the lines
before and after it; transitions tie neighbouring labels. Documents carry one label, lines none: lines start with
their document's label, and between rounds of training the lines of bad documents that the model
takes for good become good (each bad document keeps one bad line at least). A document's badness is the length-weighted mean of its
lines' forward-backward marginals, put on the scale of the labels by a logistic fit on the same rows.
All features are computed with numpy over the bytes of many documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices
from tracewell.llm.labels import MAX_CHARS, held_out, training_rows
from tracewell.llm.words import hash_words

THRESHOLD = 0.3
ROUNDS, STEPS, RATE, DECAY = 3, 100, 0.1, 1e-3
#: Byte classes, by their bytes; the last is everything else.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\x0b\x0c\r", "stop": b".,;:'\"-?()", "shout": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~", "wide": bytes(range(128, 256)), "rest": b""}
_CLASS = np.full(256, len(CLASSES) - 1, np.int64)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _k
LAGS = (1, 2, 3)
#: Shares of the classes, repeats at each lag, log of length, words per line on a log scale, and one.
N_OWN = len(CLASSES) + len(LAGS) + 2
N_ALL = 3 * N_OWN + 3
_MANY = 1 << 20


def line_features(texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
    r"""Lines of each text (split at \n; an empty text has one), their lengths in bytes, and a row of features each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    is_end = data == 10
    ends = np.flatnonzero(is_end)
    counts = [r.count(b"\n") + 1 for r in raw]
    lengths = np.diff(ends, prepend=-1) - 1
    n, k = len(ends), len(CLASSES)
    line = np.cumsum(is_end) - is_end
    tally = np.bincount(line * k + _CLASS[data], minlength=n * k).reshape(n, k)
    tally[:, k - 1] -= 1  # the line's own end
    own = np.zeros((n, N_OWN), np.float32)
    own[:, :k] = tally / np.maximum(lengths, 1)[:, None]
    starts, words = hash_words(data.tobytes())
    at = line[starts] if len(starts) else np.zeros(0, np.int64)
    per_line = np.bincount(at, minlength=n)
    for i, lag in enumerate(LAGS):
        same = (words[lag:] == words[:-lag]) & (at[lag:] == at[:-lag])
        own[:, k + i] = np.bincount(at[lag:], same, n) / np.maximum(per_line - lag, 1)
    own[:, k + len(LAGS)] = np.log1p(lengths) / 8
    own[:, k + len(LAGS) + 1] = np.log1p(per_line) / 6
    first = np.zeros(n, bool)
    first[np.cumsum([0, *counts])[:-1]] = True
    last = np.append(first[1:], True)
    features = np.zeros((n, N_ALL), np.float32)
    features[:, :N_OWN] = own
    features[1:, N_OWN : 2 * N_OWN] = np.where(first[1:, None], 0, own[:-1])
    features[:-1, 2 * N_OWN : 3 * N_OWN] = np.where(last[:-1, None], 0, own[1:])
    features[:, -3], features[:, -2], features[:, -1] = first, last, 1
    return counts, lengths, features


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a documents x lines grid for lines that lie one document after another."""
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def forward_backward(bad: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the probability of being bad, and of each adjacent pair of labels its expected count.

    bad: the log-potential of label 1 of every line (that of label 0 is 0); transitions: 2 x 2 log-potentials.
    Documents are worked off together in groups of like length, so that padding stays small.
    """
    marginals, pairs = np.zeros(len(bad)), np.zeros((2, 2))
    begin = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        limit = max(8, 2 * counts[order[at]])
        stop = at + int(np.searchsorted(counts[order[at:]], limit, "right"))
        stop = min(stop, at + max(1, 2_000_000 // int(limit)))
        some = order[at:stop]
        c = counts[some]
        doc, place = _padded(c)
        index = np.repeat(begin[some], c) + place
        width = int(c.max())
        phi = np.zeros((len(some), width, 2))
        phi[doc, place, 1] = bad[index]
        alpha, beta = np.zeros_like(phi), np.zeros_like(phi)
        alpha[:, 0] = phi[:, 0]
        for t in range(1, width):
            alpha[:, t] = phi[:, t] + _log_sum(alpha[:, t - 1, :, None] + transitions, 1)
        for t in range(width - 2, -1, -1):
            go = _log_sum(transitions + (phi[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t + 1 < c)[:, None], go, 0)
        total = _log_sum(alpha[np.arange(len(some)), c - 1], 1)
        both = alpha + beta - total[:, None, None]
        marginals[index] = np.exp(both[doc, place, 1])
        if width > 1:
            edge = alpha[:, :-1, :, None] + transitions + (phi[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
            inside = np.arange(1, width)[None, :] < c[:, None]
            pairs += np.exp(edge[inside]).sum(axis=0)
        at = stop
    return np.clip(marginals, 0, 1), pairs


@dataclass
class Crf:
    """weights: of the features for label bad; transitions: 2 x 2; slope and offset: from badness to the log-odds of a bad document."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def line_marginals(self, counts: np.ndarray, features: np.ndarray) -> np.ndarray:
        return forward_backward(features @ self.weights, counts, self.transitions)[0]

    def badness(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted share of bad lines; lines of no length count as one byte."""
        counts, lengths, features = line_features(texts)
        return document_badness(self.line_marginals(np.array(counts), features), np.array(counts), lengths)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of a good document, for texts of any length."""
        out = np.zeros(len(texts))
        for i, j in slices([len(t or "") for t in texts], _MANY):
            out[i:j] = self.badness(texts[i:j])
        return 1 / (1 + np.exp(np.clip(self.slope * _odds(out) + self.offset, -30, 30)))


def document_badness(marginals: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    weight = np.maximum(lengths, 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(doc, marginals * weight, len(counts)) / np.bincount(doc, weight, len(counts))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_chain(features, counts, labels, weights, transitions, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Maximise the conditional likelihood of line labels by Adam."""
    param = np.concatenate([weights, transitions.ravel()])
    m, v = np.zeros_like(param), np.zeros_like(param)
    doc, _ = _padded(counts)
    inner = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][inner], labels[1:][inner]), 1)
    observed = features.T @ labels
    for step in range(1, steps + 1):
        w, t = param[:-4], param[-4:].reshape(2, 2)
        p, pairs = forward_backward(features @ w, counts, t)
        grad = np.concatenate([features.T @ p - observed, (pairs - seen).ravel()]) / len(labels) + DECAY * param
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        param = param - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return param[:-4], param[-4:].reshape(2, 2)


def train(rows: list[tuple[str, int]], max_lines: int = 100) -> Crf:
    """rows: (text, 1 for good). Of each document max_lines lines at most are learnt from, evenly spread.

    Without both labels all documents are good, or all bad if only bad ones are known.
    """
    good = np.array([y for _, y in rows], int)
    if not len(rows) or good.min() == good.max():
        return Crf(np.zeros(N_ALL), np.zeros((2, 2)), 0.0, 3.0 if len(rows) and not good[0] else -3.0)
    texts = [t for t, _ in rows]
    counts, lengths, features = line_features(texts)
    begin = np.cumsum([0, *counts])
    chosen = np.concatenate([np.unique(np.linspace(a, b - 1, min(b - a, max_lines)).astype(int)) for a, b in zip(begin[:-1], begin[1:], strict=True)])
    c = np.bincount(np.searchsorted(begin, chosen, "right") - 1, minlength=len(rows))
    x, weight = features[chosen].astype(np.float64), np.maximum(lengths[chosen], 1)
    doc, _ = _padded(c)
    of_bad = good[doc] == 0
    labels = of_bad.astype(int)
    w, t = np.zeros(N_ALL), np.zeros((2, 2))
    for r in range(ROUNDS):
        w, t = _fit_chain(x, c, labels, w, t)
        p, _ = forward_backward(x @ w, c, t)
        labels = (of_bad & (p >= 0.5)).astype(int)
        # the worst line of a bad document stays bad
        order = np.lexsort((p, doc))
        labels[order[np.cumsum(c) - 1]] |= of_bad[order[np.cumsum(c) - 1]]
    p, _ = forward_backward(x @ w, c, t)
    odds = _odds(document_badness(p, c, weight))
    slope, offset = _logistic(odds, 1 - good)
    return Crf(w, t, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method on one feature, lightly held to zero; the slope is never negative."""
    b = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        b = b + np.clip(np.linalg.solve(hessian, z.T @ (y - p) - 0.01 * b), -2, 2)
    return max(0.0, float(b[0])), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = 1500, max_chars: int = MAX_CHARS) -> Crf:
    return train(training_rows(docs, labels, "quality", id_col, text_col, per_label, max_chars))


def quality(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (higher: better), predicted.

    A null or empty text is one empty line. Null and repeated ids pass through; other columns are not read.
    """

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score([t if isinstance(t, str) else None for t in texts]))

    out = docs.select(F.col(id_col), score(F.col(text_col).cast("string")).alias("score"))
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def label_lines(docs: DataFrame, model: Crf, text_col: str = "text", out: str = "line_bad") -> DataFrame:
    """docs with, for each line of the text, its probability of being bad."""

    @F.pandas_udf("array<double>")
    def mark(texts):
        import pandas as pd

        rows = []
        for t in texts:
            counts, _, features = line_features([t if isinstance(t, str) else None])
            rows.append(model.line_marginals(np.array(counts), features).tolist())
        return pd.Series(rows)

    return docs.withColumn(out, mark(F.col(text_col).cast("string")))
