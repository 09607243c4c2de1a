"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (character classes, word and line shapes,
repetition) feed boosted regression trees with logistic loss.  They are trained
on a bounded sample of labelled rows (``bound``), whose statistics Spark
computes and whose small matrix is fitted with numpy.  A tree splits on binned
features, grown level by level from gradient histograms.  For scoring, all
trees are flattened into arrays and a batch of documents walks them level by
level.

Null texts are judged as empty ones; null doc_ids are scored; repeated rows are
scored each; without usable labels every score is the share of label 1 among
them (0.5 if there are none); columns other than doc_id and text never reach a
score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from carelens.llm.shared import carried, carry, from_text, pick, sample_labels

# Byte classes whose shares are features (fixed values).
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"'\"`",
    "bracket": b"()[]{}<>",
    "symbol": b"#$%&*+-/=@\\^_|~",
    "control": bytes([*range(0, 9), *range(14, 32), 127]),
    "other": bytes(range(128, 256)),
}
_CLASS = np.array([[b in members for members in CLASSES.values()] for b in range(256)], float)
SHAPE = ["log_bytes", "log_words", "word_mean", "word_dev", "word_max", "word_types", "word_top", "word_repeat",
         "pair_types", "bytes_entropy", "bytes_top", "log_lines", "line_mean", "line_types", "line_stop",
         "word_upper", "word_symbol", "word_end"]
FEATURES = [*CLASSES, *SHAPE]


def statistics(text: str) -> np.ndarray:
    """The feature vector of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    share = counts[counts > 0] / n
    words = raw.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    graphic = np.delete(counts, [9, 10, 13, 32])
    return np.concatenate([counts @ _CLASS / n, [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean() if len(words) else 0, sizes.std() if len(words) else 0,
        min(int(sizes.max(initial=0)), 200), len(seen) / w, max(seen.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w,
        float(-(share * np.log2(share)).sum()), graphic.max() / n,
        np.log1p(len(lines)), min(np.mean([len(x) for x in lines]) if lines else 0, 2000),
        len(set(lines)) / max(len(lines), 1), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(len(lines), 1),
        sum(map(bytes.isupper, words)) / w, sum(not x[:1].isalnum() and x[0] < 128 for x in words) / w,
        sum(map(bytes.endswith, words, repeat((b"!", b"*", b"#", b"$", b"%", b"&", b"@")))) / w]])


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        least: int = 20, ridge: float = 1.0) -> Trees:
    """Boost ``trees`` regression trees on gradient histograms of ``bins`` quantile bins."""
    rate1 = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(*[np.empty(0, t) for t in (np.int64, float, np.int64, np.int64, float, np.int64)], depth,
                  float(np.log(rate1 / (1 - rate1))))
    if not len(y) or y.min() == y.max():
        return model
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(m)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1)
    flat = codes + np.arange(m) * bins
    margin = np.full(len(y), model.base)
    out = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(feature=0, threshold=0.0, value=0.0) -> int:
        n = len(out["value"])
        for k, v in zip(out, (feature, threshold, n, n, value)):
            out[k].append(v)
        return n

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(add())
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            grown = []
            for node, rows in open_nodes:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if level < depth and len(rows) >= 2 * least:
                    at = flat[rows].ravel()
                    hist = [np.bincount(at, np.repeat(v, m) if v is not None else None, m * bins).reshape(m, bins)
                            for v in (grad[rows], hess[rows], None)]
                    gl, hl, nl = (np.cumsum(v, axis=1)[:, :-1] for v in hist)
                    gain = gl**2 / (hl + ridge) + (g - gl)**2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    f, b = divmod(int(gain.argmax()), bins - 1)
                    best = (f, b) if gain[f, b] > 1e-6 and b < len(edges[f]) else None
                if best is None:
                    out["value"][node] = -rate * g / (h + ridge)
                    margin[rows] += out["value"][node]
                    continue
                f, b = best
                out["feature"][node], out["threshold"][node] = f, float(edges[f][b])
                low = codes[rows, f] <= b
                out["left"][node], out["right"][node] = add(), add()
                grown += [(out["left"][node], rows[low]), (out["right"][node], rows[~low])]
            open_nodes = grown
    return Trees(*(np.array(out[k], t) for k, t in zip(out, (np.int64, float, np.int64, np.int64, float))),
                 np.array(roots, np.int64), depth, model.base)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = 20_000) -> Trees:
    """Fit on at most ``bound`` labelled documents, none of them held out.

    The sample of ids is broadcast: ``bound`` rows of 12 bytes.  A doc_id with
    several texts counts once, with the text of the smallest hash.
    """
    sample = sample_labels(labels, column, bound)
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").withColumn("tie", F.xxhash64("text"))
    rows = (from_text(rows, "x array<double>", lambda texts: [[statistics(t) for t in texts]])
            .groupBy("doc_id").agg(F.min(F.struct("tie", "label", "x")).alias("r"))
            .select("doc_id", "r.label", "r.x").collect())  # at most `bound` rows
    rows.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows]))


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """Replace ``text`` by the ``score`` of every row (0 to 1, higher: label 1 likelier)."""
    return from_text(rows, "score double", lambda texts: [model.score(np.stack([statistics(t) for t in texts]))])


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, bound: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, unchanged."""
    model = train(docs, labels, bound=bound)
    return carried(score(carry(docs, text="string"), model).where(F.col("score") >= least), docs)
