"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad. What speaks for either are surface features of the line and of the
lines before and after it, and the label of the neighbouring line. Forward-backward gives each
line's probability of being good; their mean, weighted by the length of the line in bytes, is
the score of the document. In training every line of a document carries the document's label.

* A null text counts as empty; an empty text is one empty line and is scored like any other
  line. Without training rows every text scores 0.5.
* Every row gives one row, repeated rows included; a null id is kept as null and never trained
  on. Columns other than id and text are not read.
* Fitted on at most about ``max_rows`` labelled documents, dealt to ``shards`` groups. Each
  group fits its own field; the weights are averaged (parameter mixing), so that no task ever
  holds more than its share of that bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import held_out, kept, labelled, raw, table

_PLAIN = b".,;:'\"-()?"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_BLANK = b" \t\r\x0b\x0c"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _PLAIN + _LETTERS + _DIGITS)


def line_features(line: bytes, seen_before: bool) -> list[float]:
    """What one line looks like, every value between 0 and 1."""
    n = len(line)
    if not n:
        return [1.0] + [0.0] * 23

    def count(of: bytes) -> int:
        return n - len(line.translate(None, of))

    letters, upper, digits = count(_LETTERS), count(_UPPER), count(_DIGITS)
    symbols, plain = count(_SYMBOLS), count(_PLAIN)
    words = line.split()
    m = max(1, len(words))
    unique = len(set(words)) / m
    repeats = sum(map(bytes.__eq__, words, words[1:])) / m
    share = symbols / n
    caps = upper / max(1, letters)
    mean = (n - len(words) + 1) / m
    short = sum(len(w) == 1 for w in words) / m
    return [0.0, min(1.0, n / 100), min(1.0, n / 1000), letters / n, caps, float(caps > 0.5),
            digits / n, float(digits > 0.2 * n), share, float(share > 0.02), float(share > 0.1),
            min(1.0, 20 * share), plain / n, float(plain > 0.15 * n), min(1.0, mean / 20),
            float(mean > 12), unique, float(unique < 0.5), repeats, float(repeats > 0.2), short,
            float(short > 0.25), float(line[-1:] in (b".", b"!", b"?")), float(seen_before)]


def own_features(lines: list[bytes], block: int = 10_000):
    """Features of every line on its own, a block of lines at a time."""
    seen: set[bytes] = set()
    for at in range(0, len(lines), block):
        own = []
        for line in lines[at:at + block]:
            own.append(line_features(line.strip(_BLANK), line in seen))
            seen.add(line)
        yield np.array(own)


def document_lines(text: bytes | None) -> np.ndarray:
    """Features of every line with those of both neighbours."""
    own = np.vstack(list(own_features((text or b"").split(b"\n"))))
    edge = np.zeros((1, own.shape[1]))
    border = np.zeros((len(own), 3))
    border[:, 0], border[0, 1], border[-1, 2] = 1.0, 1.0, 1.0
    return np.hstack([border, own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])


def line_scores(text: bytes | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``document_lines(text) @ weights`` without the features of all lines at once, and the
    lengths of the lines."""
    lines = (text or b"").split(b"\n")
    border, by_place = weights[:3], weights[3:].reshape(3, -1).T
    own, ahead, behind = np.vstack([f @ by_place for f in own_features(lines)]).T
    scores = own + border[0]
    scores[0] += border[1]
    scores[-1] += border[2]
    scores[1:] += ahead[:-1]
    scores[:-1] += behind[1:]
    return scores, np.array([len(x) + 1.0 for x in lines])


class Chains:
    """Lines of many documents; positions are walked for all documents at once."""

    def __init__(self, sizes: list[int]):
        sizes = np.array(sizes)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        self.n, self.starts, sizes = int(sizes.sum()), starts[order], sizes[order]
        self.active = np.searchsorted(-sizes, -np.arange(int(sizes.max())), side="left")

    def place(self, t: int) -> np.ndarray:
        """The lines at place ``t`` of their documents, longest document first."""
        return self.starts[:self.active[t]] + t

    def marginals(self, unary: np.ndarray, step: np.ndarray):
        """log Z, probability of good per line, expected counts of label pairs.

        ``unary`` is the score of good per line (bad has 0), ``step`` the 2 x 2 scores of a
        label after a label.
        """
        score = np.stack([np.zeros(self.n), unary], 1)
        ahead, back = score.copy(), np.zeros((self.n, 2))
        last = len(self.active) - 1
        for t in range(last):
            here = self.place(t + 1)
            a = ahead[here - 1]
            ahead[here] += np.logaddexp(a[:, :1] + step[0], a[:, 1:] + step[1])
        pairs = np.zeros((2, 2))
        total = np.empty(len(self.starts))
        log_z = np.zeros(self.n)
        for t in range(last + 1):
            here = self.place(t)
            longer = self.active[t + 1] if t < last else 0
            if longer < len(here):
                total[longer:len(here)] = np.logaddexp(*ahead[here[longer:]].T)
        for t in range(last, -1, -1):
            here = self.place(t)
            log_z[here] = total[:len(here)]
            if t < last:
                after = self.place(t + 1)
                now = here[:len(after)]
                b = (back[after] + score[after])[:, None, :] + step
                back[now] = np.logaddexp(b[:, :, 0], b[:, :, 1])
                joint = ahead[now][:, :, None] + b - total[:len(after), None, None]
                pairs += np.exp(joint).sum(0)
        return total.sum(), np.exp(ahead[:, 1] + back[:, 1] - log_z), pairs


def minimise(f, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -slope, []
        for s, y in reversed(past):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), alpha in zip(past, reversed(alphas)):
            d = d + s * (alpha - y @ d / (s @ y))
        rate = 1.0 if past else 1.0 / max(1.0, np.abs(slope).sum())
        while rate > 1e-10:
            new = x + rate * d
            v, g = f(new)
            if v <= value + 1e-4 * rate * (slope @ d):
                break
            rate /= 2
        else:
            return x
        s, y = new - x, g - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - v < 1e-7 * abs(value)
        x, value, slope = new, v, g
        if done:
            break
    return x


def fit_field(texts: list[bytes], labels: list[int], ridge: float = 0.1) -> np.ndarray:
    """Line weights followed by the four scores of a label after a label."""
    docs = [document_lines(t) for t in texts]
    lines, chains = np.vstack(docs), Chains([len(d) for d in docs])
    good = np.repeat(np.array(labels, float), [len(d) for d in docs])
    counts = np.zeros((2, 2))
    for d, y in zip(docs, labels):
        counts[y, y] += len(d) - 1

    def loss(x: np.ndarray):
        w, step = x[:-4], x[-4:].reshape(2, 2)
        unary = lines @ w
        log_z, p, pairs = chains.marginals(unary, step)
        value = log_z - unary @ good - (step * counts).sum() + ridge / 2 * (x @ x)
        slope = np.concatenate([lines.T @ (p - good), (pairs - counts).ravel()]) + ridge * x
        return value / len(docs), slope / len(docs)

    return minimise(loss, np.zeros(lines.shape[1] + 4))


RARER_ROWS = 8


def dealt_rows(rows: DataFrame, shards: int) -> DataFrame:
    """Labelled rows (a bounded sample) with ``_shard``: each class is dealt evenly, to as many shards as
    give each at least ``RARER_ROWS`` rows of the rarer class, and to one when there are fewer."""
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = max(1, min(shards, min(found.values(), default=0) // RARER_ROWS))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"))) - 1
    return rows.withColumn("_shard", place % many)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, shards: int = 12) -> np.ndarray:
    """Mean of the fields fitted on the shards of the sample; without one of the classes there is none."""
    def shard(group: pa.Table) -> pa.Table:
        w = fit_field(group.column("text").to_pylist(), group.column("label").to_pylist())
        return pa.table({"weights": pa.array([w.tolist()], pa.list_(pa.float64()))})

    rows = kept(labelled(docs, labels, "quality", max_rows), "labelled")
    if rows.select("label").distinct().count() < 2:
        return np.zeros(0)
    fitted = dealt_rows(rows, shards).groupBy("_shard").applyInArrow(shard, "weights array<double>").collect()
    return np.mean([r["weights"] for r in fitted], axis=0)


def score_texts(texts: list[bytes | None], weights: np.ndarray,
                lines_at_once: int = 100_000) -> list[float]:
    """Documents are walked together until they hold ``lines_at_once`` lines."""
    if not len(weights):
        return [0.5] * len(texts)
    scores: list[float] = []
    docs: list[tuple[np.ndarray, np.ndarray]] = []

    def walk() -> None:
        sizes = [len(d) for d, _ in docs]
        unary, lengths = (np.concatenate(part) for part in zip(*docs))
        _, good, _ = Chains(sizes).marginals(unary, weights[-4:].reshape(2, 2))
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
        scores.extend(np.clip(mean, 0.0, 1.0).tolist())
        docs.clear()

    held = 0
    for text in texts:
        docs.append(line_scores(text, weights[:-4]))
        held += len(docs[-1][0])
        if held >= lines_at_once:
            walk()
            held = 0
    if docs:
        walk()
    return scores


def quality(docs: DataFrame, weights: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(list(texts), weights), dtype="float64")

    return score(raw("text"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"),
                         quality(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
