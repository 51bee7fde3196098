"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5 code points, with its edges) and of itself, a
document the mean of its distinct words (so one word said fifty times is one), and two softmax weights sit on top; vectors and weights are trained jointly
in numpy with Adam. n-grams are hashed into a fixed table, so an unseen misspelling or word form shares
the vectors of the n-grams it keeps. As all is linear up to the softmax, scoring needs one number per
n-gram bucket: the model that goes to the executors is a table of 2^BITS floats whatever it was trained on.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, slices
from tracewell.llm.labels import MAX_CHARS, PER_LABEL, held_out, training_rows
from tracewell.llm.words import mix, prefix_sums

BITS, DIM, STEPS, BATCH = 18, 4, 380, 128
#: Learning rates of the vectors (momentum: what many documents share moves furthest) and of the softmax (Adam).
VECTOR_RATE, RATE = 0.5, 0.02
#: What a document's mean is multiplied by: the few telling words among hundreds must move the softmax in a few steps.
SCALE = 300.0
#: Words of no meaning that every mean holds besides a document's own, so that a few words decide nothing by chance.
NEUTRAL = 60
#: Documents of the training rows that an n-gram must stand in to count.
MIN_DOCS = 5
GRAMS = (3, 4, 5)
THRESHOLD = 0.5

_RNG = np.random.Generator(np.random.PCG64(77))
#: Characters that make words: letters, digits and marks, and all beyond the basic plane.
_INSIDE = np.array([c.isalnum() or unicodedata.category(c)[0] == "M" for c in map(chr, range(1 << 16))] + [True])
#: A number for each of those; the others all count as the edge of a word.
_VALUE = np.where(_INSIDE, _RNG.integers(0, 2**64, len(_INSIDE), dtype=np.uint64), _RNG.integers(0, 2**64, 1, dtype=np.uint64))
_MANY = 1 << 19


def _points(text: str | None) -> np.ndarray:
    """The code points of a text in lower case."""
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The texts with a space before, between and after them."""
    space = np.array([32], np.uint32)
    return np.concatenate([space, *(x for p in parts for x in (p, space))])


def _bags(points: np.ndarray, bounds: np.ndarray, seen: np.ndarray | None = None):
    """Distinct words of each text in points (which begins and ends with a space): starts, an iterator over (word of each n-gram, its bucket), and hashes.

    seen: sorted hashes of the words that came in earlier parts of the one text in points; they count no more.
    """
    data = np.minimum(points, np.uint32(1 << 16))
    inside = _INSIDE[data]
    value = _VALUE[data]
    if len(data) and data.max() == 1 << 16:
        far = points >= 1 << 16
        value[far] = mix(points[far].astype(np.uint64))
    total, down = prefix_sums(value)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    whole = mix((total[ends] - total[starts]) * down[starts])
    own = np.searchsorted(bounds, starts, "right").astype(np.uint64)
    _, chosen = np.unique(whole ^ mix(own), return_index=True)
    if seen is not None and len(seen):
        at = np.minimum(np.searchsorted(seen, whole[chosen]), len(seen) - 1)
        chosen = chosen[seen[at] != whole[chosen]]
    chosen.sort()
    if len(chosen) < len(starts):  # a word that came before in its text is as good as a space
        again = np.ones(len(starts), bool)
        again[chosen] = False
        inside = inside & ~again[np.maximum(np.cumsum(first, dtype=np.int64) - 1, 0)]
        starts, whole = starts[chosen], whole[chosen]
        first = np.zeros(len(data), bool)
        first[starts] = True
    word = np.cumsum(first, dtype=np.int64) - 1
    shift = np.uint64(64 - BITS)

    def grams():
        ok = inside
        for n in GRAMS:
            # windows whose inner characters all lie in one word; the outer two may be its edges
            ok = inside[1 : len(data) - n + 2].copy() if n == GRAMS[0] else ok[: len(data) - n + 1] & inside[n - 2 : len(data) - 1]
            at = np.flatnonzero(ok[: max(0, len(data) - n + 1)])
            yield word[at + 1], (mix((total[at + n] - total[at]) * down[at] + np.uint64(n)) >> shift).astype(np.int64)
        yield np.arange(len(starts)), (whole >> shift).astype(np.int64)

    return starts, grams(), whole


def _pieces(points: np.ndarray):
    """points cut between words into parts of about _MANY, for texts of any length."""
    at = 0
    while at < len(points):
        stop = min(at + _MANY, len(points))
        while stop < len(points) and _INSIDE[min(points[stop], 1 << 16)]:
            stop += 1
        yield points[at:stop]
        at = stop


@dataclass
class Model:
    """values: of each bucket, its vector times the difference of the softmax weights."""

    values: np.ndarray
    bias: float

    def _sums(self, points: np.ndarray, bounds: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of word scores and number of words between bounds, and the words' hashes."""
        starts, grams, words = _bags(points, bounds, seen)
        total, count = np.zeros(len(starts)), np.zeros(len(starts))
        for word, bucket in grams:
            total += np.bincount(word, self.values[bucket], len(starts))
            count += np.bincount(word, minlength=len(starts))
        scores = np.concatenate([[0.0], np.cumsum(total / np.maximum(count, 1))])
        at = np.searchsorted(starts, bounds)
        return scores[at[1:]] - scores[at[:-1]], at[1:] - at[:-1], words

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of toxicity of each text; one without words gets what the bias says."""
        logits = np.full(len(texts), self.bias)
        for i, j in slices([len(t or "") for t in texts], _MANY):
            points = [_points(t) for t in texts[i:j]]
            if j == i + 1:
                total, count, seen = 0.0, 0, np.zeros(0, np.uint64)
                for p in _pieces(points[0]):
                    s, n, words = self._sums(_joined([p]), np.array([0, len(p) + 2]), seen)
                    total, count = total + s[0], count + n[0]
                    if len(p) < len(points[0]):
                        seen = np.union1d(seen, words)
                logits[i] += total / (count + NEUTRAL)
            else:
                s, n, _ = self._sums(_joined(points), np.cumsum([0, *(len(p) + 1 for p in points)]))
                logits[i:j] += s / (n + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a document; with the neutral words' the weights add up to one."""
    points = _joined([_points(text)])
    starts, grams, _ = _bags(points, np.array([0, len(points)]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    found = list(grams)
    word, bucket = (np.concatenate([g[k] for g in found]) for k in (0, 1))
    weight = 1 / np.bincount(word, minlength=len(starts))[word] / (len(starts) + NEUTRAL)
    unique, which = np.unique(bucket, return_inverse=True)
    return unique, np.bincount(which, weight)


def _all_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags of all texts end to end, and where each begins; n-grams of fewer than MIN_DOCS texts, which can only be learnt by heart, are left out."""
    parts: list[list[np.ndarray]] = []  # of 256 documents each: buckets, weights, where each document begins
    seen = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(texts), 256):
        bags = [_bag(t) for t in texts[at : at + 256]]
        parts.append([np.concatenate([b for b, _ in bags]).astype(np.int32), np.concatenate([w for _, w in bags]).astype(np.float32), np.cumsum([0, *(len(b) for b, _ in bags)])])
        seen += np.bincount(parts[-1][0], minlength=1 << BITS)
    begin = [np.zeros(1, np.int64)]
    for part in parts:  # one after another, so that the arrays of a part go when it is thinned out
        kept = seen[part[0]] >= MIN_DOCS
        ends = np.concatenate([[0], np.cumsum(kept)])[part[2][1:]]
        part[:] = part[0][kept], part[1][kept], ends
        begin.append(ends + begin[-1][-1])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(begin)


def train(rows: list[tuple[str, int]], dim: int = DIM, least_steps: int = STEPS, seed: int = 5) -> Model:
    """Vectors (by momentum) and softmax weights (by Adam) together, on the log loss, in which both labels weigh the same in all.

    Without both labels there is nothing to tell apart: every score is then the one label's, or 0.
    """
    labels = np.array([y for _, y in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), 3.0 if len(rows) and labels[0] == 1 else -3.0)
    toxic_weight = (labels == 0).sum() / (labels == 1).sum()
    rng = np.random.Generator(np.random.PCG64(seed))
    buckets_of, weights_of, begin = _all_bags([t for t, _ in rows])
    vectors = rng.uniform(-0.001, 0.001, (1 << BITS, dim)).astype(np.float32)
    head = np.zeros((2, dim), np.float32)
    head[1] = rng.uniform(-1, 1, dim)
    head[0] = -head[1]
    bias = np.zeros(2, np.float32)
    speed = np.zeros_like(vectors)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (head, bias)]
    epochs = -(-least_steps // -(-len(rows) // BATCH))
    step, steps = 0, epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            buckets = np.concatenate([buckets_of[begin[k] : begin[k + 1]] for k in some])
            weights = np.concatenate([weights_of[begin[k] : begin[k + 1]] for k in some]) * np.float32(SCALE)
            doc = np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
            used, place = np.unique(buckets, return_inverse=True)
            mean = np.stack([np.bincount(doc, weights * vectors[buckets, d], len(some)) for d in range(dim)], 1).astype(np.float32)
            logits = mean @ head.T + bias
            p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
            err = ((p - labels[some]) * np.where(labels[some] == 1, toxic_weight, 1.0) / len(some)).astype(np.float32)
            both = np.stack([-err, err], 1)
            hidden = both @ head
            flow = np.stack([np.bincount(place, weights * hidden[doc, d], len(used)) for d in range(dim)], 1).astype(np.float32)
            step += 1
            rate = 1 - 0.9 * step / steps
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            speed[used] = 0.9 * speed[used] + 0.1 * flow
            vectors[used] -= np.float32(VECTOR_RATE * rate * fix) * speed[used]
            for param, grad, (m, v) in zip((head, bias), (both.T @ mean, both.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                param -= RATE * rate * fix * m / (np.sqrt(v) + 1e-10)
    return Model((vectors @ (head[1] - head[0]) * SCALE).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    return train(training_rows(docs, labels, "toxic", id_col, text_col, per_label, max_chars))


def with_score(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """docs with the score of each text added; null and empty texts get the score of no words."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn(out, score(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Null and repeated ids pass through; other columns are not read."""
    scored = with_score(docs.select(F.col(id_col), F.col(text_col).alias("text_")), model, "text_", "score")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without those whose score reaches the threshold."""
    name = fresh(docs, "toxic_score")
    return with_score(docs, model, text_col, name).where(F.col(name) < THRESHOLD).drop(name)


