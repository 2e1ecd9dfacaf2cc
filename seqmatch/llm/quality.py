"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's evidence is a weighted sum of its own features and those of the lines before and
after it; neighbouring labels are tied by four transition weights.  Forward and backward messages give each line's
marginal probability; a document's score is their mean weighted by line length, put on the scale of the labels by a
logistic curve with two parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, free_names, text_buffer, without
from .langid import held_out
from .shingles import run_hashes

SAMPLE_ROWS = 2_000
PART_CHARS = 65_536
TRAIN_LINES = 64
BLOCK = 1 << 20
LINES = 1 << 16
_HALO = 3
THRESHOLD = 0.3
ADDED = ("score", "predicted")

# A class for each byte.
_LETTER, _UPPER, _DIGIT, _BLANK, _STOP, _QUOTE, _BANG, _BAR, _SYMBOL, _CONTROL = range(10)
N_CLASSES = 10


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[list(range(97, 123)) + list(range(128, 256))] = _LETTER
    out[65:91], out[48:58], out[:32], out[127] = _UPPER, _DIGIT, _CONTROL, _CONTROL
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[list(b".,;:?")], out[list(b"'\"()-")], out[ord("!")], out[ord("|")] = _STOP, _QUOTE, _BANG, _BAR
    return out


_CLASS = _classes()
N_OWN = N_CLASSES + 6
N_FEATURES = 3 * N_OWN + 3


def _spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the number of lines of each text; an empty text has one empty line."""
    lo, hi = int(at[0]), int(at[-1])
    breaks = np.flatnonzero(raw[lo:hi] == 10) + lo
    per = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    start, end = np.empty(int(per.sum()), np.int64), np.empty(int(per.sum()), np.int64)
    is_first, is_last = np.zeros(len(start), bool), np.zeros(len(start), bool)
    is_first[first], is_last[first + per - 1] = True, True
    start[is_first], start[~is_first] = at[:-1], breaks + 1
    end[is_last], end[~is_last] = at[1:], breaks
    return start, end, per


def _window(raw: np.ndarray, lo: int, hi: int, start: np.ndarray, end: np.ndarray, counts: np.ndarray, words: np.ndarray) -> None:
    """Add the bytes lo..hi-1 to the class counts of the lines, and their words, words equal to the one before, and word starts."""
    if hi <= lo:
        return
    a, b = np.searchsorted(end, lo, side="right"), np.searchsorted(start, hi, side="left")
    edges = np.clip(np.concatenate([start[a:b], end[b - 1 : b]]), lo, hi) if b > a else np.zeros(0, np.int64)
    if b <= a:
        return
    line = np.repeat(np.arange(a, b), np.diff(edges))
    if edges[0] > lo:
        line = np.concatenate([np.full(edges[0] - lo, a), line])
    if len(line) < hi - lo:
        line = np.concatenate([line, np.full(hi - lo - len(line), b - 1)])
    kind = _CLASS[raw[lo:hi]]
    width = b - a
    counts[a:b] += np.bincount((line - a) * N_CLASSES + kind, minlength=width * N_CLASSES).reshape(width, N_CLASSES)
    blank = kind == _BLANK
    edge = np.zeros(hi - lo + 1, bool)  # texts follow each other without a blank
    edge[edges - lo] = True
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1]))
    if not len(starts):
        return
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1
    size = ends - starts
    whole, of = run_hashes(raw[lo:hi], starts, ends), line[starts]
    again = np.concatenate([[False], (whole[1:] == whole[:-1]) & (size[1:] == size[:-1]) & (of[1:] == of[:-1])])
    words[a:b, 0] += np.bincount(of - a, minlength=width)
    words[a:b, 1] += np.bincount(of - a, weights=again, minlength=width)
    words[a:b, 2] += np.bincount(of - a, weights=size > 12, minlength=width)


def _features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, a: int, b: int) -> np.ndarray:
    """Features of the lines a..b-1 (own, previous and next line's); looks at a few lines on both sides only."""
    lo, hi = max(0, a - _HALO), min(len(start), b + _HALO)
    start, end, doc = start[lo:hi], end[lo:hi], doc[lo:hi]
    counts, words = np.zeros((len(start), N_CLASSES)), np.zeros((len(start), 3))
    for x in range(int(start[0]), int(end[-1]), BLOCK):
        _window(raw, x, min(x + BLOCK, int(end[-1])), start, end, counts, words)
    size = (end - start).astype(float)
    view = memoryview(raw)
    key = np.fromiter((zlib.crc32(view[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
    key = key << 20 ^ np.minimum(end - start, (1 << 20) - 1)
    again = np.zeros(len(start))
    for step in (1, 2):
        same = (key[step:] == key[:-step]) & (doc[step:] == doc[:-step]) & (size[step:] > 0)
        again[step:][same] = 1.0
        again[:-step][same] = 1.0
    own = np.empty((len(start), N_OWN))
    own[:, :N_CLASSES] = counts / np.maximum(size, 1)[:, None]
    own[:, N_CLASSES] = np.log1p(size) / 8
    own[:, N_CLASSES + 1] = words[:, 1] / np.maximum(words[:, 0], 1)
    own[:, N_CLASSES + 2] = words[:, 2] / np.maximum(words[:, 0], 1)
    own[:, N_CLASSES + 3] = words[:, 0] / np.maximum(size, 1)
    own[:, N_CLASSES + 4] = again
    own[:, N_CLASSES + 5] = size == 0
    out = np.zeros((len(start), N_FEATURES))
    out[:, :N_OWN] = own
    tied = np.concatenate([[False], doc[1:] == doc[:-1]])
    out[1:, N_OWN : 2 * N_OWN] = own[:-1] * tied[1:, None]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:] * tied[1:, None]
    out[:, -3], out[:, -2], out[:, -1] = 1.0, ~tied, np.concatenate([~tied[1:], [True]])
    return out[a - lo : b - lo]


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of all texts, the lines' bytes, and the lines of each text."""
    start, end, per = _spans(raw, at)
    return _features(raw, start, end, np.repeat(np.arange(len(per)), per), 0, len(start)), (end - start).astype(float), per


class Chain:
    """Forward and backward messages for many chains of lines at once, as log odds of good against bad."""

    def __init__(self, per: np.ndarray):
        self.order = np.argsort(-per, kind="stable")
        self.per = per[self.order]
        self.first = (np.cumsum(per) - per)[self.order]
        self.live = [int(np.searchsorted(-self.per, -t, side="right")) for t in range(1, int(self.per[0]) + 1)] if len(per) else []

    def messages(self, u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """u: evidence of each line; t[y, z]: weight of label z after label y.  Gives forward (with u) and backward."""
        ahead, back = u.copy(), np.zeros_like(u)

        def step(x: np.ndarray, m: np.ndarray) -> np.ndarray:
            return np.logaddexp(m[0, 1], x + m[1, 1]) - np.logaddexp(m[0, 0], x + m[1, 0])

        for i in range(1, len(self.live)):
            now = self.first[: self.live[i]] + i
            ahead[now] += step(ahead[now - 1], t)
        for i in range(len(self.live) - 1, 0, -1):
            now = self.first[: self.live[i]] + i
            back[now - 1] = step(u[now] + back[now], t.T)
        return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gradient(x: np.ndarray, y: np.ndarray, chain: Chain, per: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Of minus the log-likelihood of the labels y of all lines, by the weights of the features and of the transitions."""
    w, t = params[: x.shape[1]], params[x.shape[1] :].reshape(2, 2)
    tied = np.ones(len(y), bool)
    tied[np.cumsum(per) - per] = False
    right = np.flatnonzero(tied)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[right - 1].astype(int), y[right].astype(int)), 1.0)
    u = x @ w
    ahead, back = chain.messages(u, t)
    off = _sigmoid(ahead + back) - y
    pair = np.empty((len(right), 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[:, a, b] = a * ahead[right - 1] + t[a, b] + b * (u[right] + back[right])
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return np.concatenate([x.T @ off, (pair.sum(axis=0) - seen).ravel()])


class Model:
    """Weights of the field, of the features' scales and of the curve from field to score."""

    def __init__(self) -> None:
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.w, self.t, self.curve = np.zeros(N_FEATURES), np.zeros((2, 2)), np.array([1.0, 0.0])

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = 120, rate: float = 0.08, l2: float = 1e-3, train_lines: int = TRAIN_LINES, odds: float | None = None) -> Model:
        """Every line of a text has the text's label.  The fit, not the score, cuts chains after each ``train_lines``
        lines, so that its time is bounded.  ``odds`` are those of label 1 among all labelled rows, if the texts are a
        sample with others; the curve is moved by the difference."""
        if not texts:
            return self
        at = np.cumsum([0, *map(len, texts)])
        x, size, per = line_features(np.frombuffer(b"".join(texts), np.uint8), at)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.mean[-3], self.scale[-3] = 0.0, 1.0
        x = (x - self.mean) / self.scale
        y = np.repeat(labels, per).astype(float)
        pieces = np.concatenate([np.diff([*range(0, n, train_lines), n]) for n in per])
        chain = Chain(pieces)
        params = np.concatenate([self.w, self.t.ravel()])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for i in range(1, rounds + 1):
            g = gradient(x, y, chain, pieces, params) / len(y) + l2 * params
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params = params - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        self.w, self.t = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        z, target = self._logit(x @ self.w, size, per), labels.astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method with a weak prior
            p = _sigmoid(a * z + b)
            r = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - target) * z).sum() + 1e-2 * (a - 1), (p - target).sum() + 1e-2 * b])
            h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / np.abs(step).max())
            a, b = a - step[0], b - step[1]
        if odds and 0 < target.mean() < 1:
            b += np.log(odds) - np.log(target.mean() / (1 - target.mean()))
        self.curve = np.array([a, b])
        return self

    def _logit(self, u: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
        ahead, back = Chain(per).messages(u, self.t)
        good, weight = _sigmoid(ahead + back), size + 1.0
        first = np.cumsum(per) - per
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at) - 1)
        weight, shift = self.w / self.scale, float(self.mean / self.scale @ self.w)
        for a, b in blocks(at, BLOCK):
            start, end, per = _spans(raw, at[a : b + 1])
            doc, u = np.repeat(np.arange(b - a), per), np.empty(len(start))
            for c in range(0, len(start), LINES):  # bounded memory, however many lines one text has
                d = min(c + LINES, len(start))
                u[c:d] = _features(raw, start, end, doc, c, d) @ weight - shift
            z = self._logit(u, (end - start).astype(float), per)
            out[a:b] = _sigmoid(self.curve[0] * z + self.curve[1])
        return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, part_chars: int = PART_CHARS, train_lines: int = TRAIN_LINES) -> Model:
    """Fit on at most ``sample_rows`` labelled documents, chosen by a hash of ``doc_id`` among those that ``docs`` has.

    Both labels get equally many of them or, where one has fewer, all it has; the curve then goes back to the odds of all
    labelled documents.  Of a text of over ``part_chars`` code points the sample has one part of that size, at a place
    chosen by a hash, so long texts teach as well.  Chains are cut after each ``train_lines`` lines (the fit only).
    Rows that are held out, and labels that are null or of a null ``doc_id``, are not used; of several labels of one
    ``doc_id`` the largest counts; a null text is an empty one.  Without labels all scores are 0.5."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    total = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    pick = F.xxhash64("doc_id", F.lit("quality"))
    # a threshold on the hash lets about twice the sample of a label through, which one task can order
    limit = F.lit(0)
    for good, n in total.items():
        limit = F.when(F.col("good") == good, int(min(1.0, 2 * sample_rows / n) * (1 << 30))).otherwise(limit)
    place = F.row_number().over(Window.partitionBy("good").orderBy(pick, "doc_id"))
    few = marks.where(F.pmod(pick, F.lit(1 << 30)) < limit)
    chosen = few.withColumn("place", place).where(F.col("place") <= sample_rows).orderBy("place", "good").limit(sample_rows)
    # the broadcast side has sample_rows rows of three numbers at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("pick", pick)
    part = f"substring(text, cast(pmod(pick, (char_length(text) - 1) div {part_chars} + 1) * {part_chars} + 1 as int), {part_chars})"
    rows = rows.select("doc_id", "pick", "good", F.when(F.char_length("text") > part_chars, F.expr(part)).otherwise(F.col("text")).alias("part"))
    rows = rows.orderBy("pick", "doc_id", "part").limit(sample_rows).select("part", "good").collect()
    odds = total[1] / total[0] if len(total) == 2 else None
    return Model().fit([r["part"].encode() for r in rows], np.array([r["good"] for r in rows]), train_lines=train_lines, odds=odds)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, only_good: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to the columns ``keep`` (all, if None) of ``docs``; reads ``text`` only.

    Null and empty texts are one empty line and get a score like any other.  ``only_good`` drops the rows that are
    predicted 0.  Equal texts get equal scores.  A very long text is one chain of all its lines; features are made for
    LINES of them at a time.  Input columns named score or predicted are replaced; all others, however named, pass through.
    """
    docs = without(docs, *ADDED)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else [F.col("text").alias(free_names(docs, "__text")[0])]))
    at = keep.index("text") if "text" in keep else len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = m.score(*text_buffer(batch.column(at))) if batch.num_rows else np.zeros(0)
            out = pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *ADDED])
            yield out.filter(pa.array(s >= threshold)) if only_good else out

    return rows.mapInArrow(run, rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer"))
