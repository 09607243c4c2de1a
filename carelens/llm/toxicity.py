"""Toxic passages: maximum-scoring segments of token log-odds.

1. Document frequencies of hashed words are counted over the whole corpus and
   over the labelled training documents of each class.
2. A word's score is its log-odds between the classes under a Dirichlet prior
   proportional to the corpus frequencies; words whose z-value is below
   ``least_z`` score nothing.  Every word then pays ``drift``, so ordinary text
   has a negative expected score.
3. A linear-time scan finds all maximal scoring segments of each text.
4. Under the clean class the best segment of n words follows an extreme-value
   law, P(S > s) = 1 - exp(-K n exp(-lambda s)): lambda solves
   sum p(w) exp(lambda s(w)) = 1 over clean words, K is its maximum-likelihood
   value over clean training documents.  ``lambda S - ln(K n)`` calibrates each
   segment; the sum of the positive values and the best one give the document's
   score through a logistic fit.

Counts cover all documents; only the label sample (``bound`` rows) is bounded.
The words broadcast are the significant buckets of a fixed 2**22-bucket hash.

Null and empty texts have no words and get the score of a document without
passages; null doc_ids are scored; repeated rows are scored each, but a labelled
doc_id trains once; without labels of both classes the score is the share of
label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from carelens.llm.shared import batch, cut, folded_words, from_text, groups_of, pick, sample_labels, word_hashes

BUCKETS = 1 << 22


def _buckets(words) -> np.ndarray:
    return (word_hashes(words) & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequencies(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(bucket, n_all, n1, n0): documents with a word of the bucket; all, labelled 1, labelled 0."""
    spec = "bucket int, n_all long, n1 long, n0 long"

    def count(batches):
        n = np.zeros((3, BUCKETS), np.int32)
        for b in batches:
            labels = b.column("label").to_pylist()
            for first, texts in groups_of(b.column("text").to_pylist()):
                for text, label in zip(texts, labels[first:first + len(texts)]):
                    at = _buckets(list(set(folded_words(text))))
                    n[0, at] += 1
                    if label is not None:
                        n[2 - label, at] += 1
        at = np.flatnonzero(n[0])
        for some in np.array_split(at, len(at) // 50_000 + 1):
            yield batch(spec, [some, *n[:, some]])

    # `sample` has at most its bound of 12-byte rows
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id", "left").select("text", "label")
    return rows.mapInArrow(count, spec).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n_all", "n1", "n0")])


@dataclass
class Words:
    """Significant buckets (sorted), their scores, the drift, and lambda of the clean text."""

    buckets: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float


def learn_words(counts: DataFrame, prior: float = 0.05, least_z: float = 3.0, drift: float = 0.1) -> Words:
    """Score buckets; the prior weighs ``prior`` times the labelled counts."""
    counts = cut(counts)
    a, n1, n0 = (float(x or 0) for x in counts.agg(F.sum("n_all"), F.sum("n1"), F.sum("n0")).first())
    weight = prior * (n1 + n0)
    if not n1 or not n0:
        return Words(np.empty(0, np.int64), np.empty(0), drift, 1.0)
    alpha = F.lit(weight / a) * F.col("n_all")
    y1, y0 = F.col("n1") + alpha, F.col("n0") + alpha
    odds = F.log(y1 / (n1 + weight - y1)) - F.log(y0 / (n0 + weight - y0))
    # at most BUCKETS rows, whatever the corpus
    found = sorted(counts.select("bucket", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"),
                                 (y0 / (n0 + weight)).alias("p"))
                   .where((F.col("z") >= least_z) & (F.col("odds") > drift)).collect())
    scores = np.array([r.odds - drift for r in found])
    return Words(np.array([r.bucket for r in found], np.int64), scores, drift,
                 _rate(scores, np.array([r.p for r in found]), drift))


def _rate(scores: np.ndarray, p: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; the rest of the words score -drift."""
    def excess(x):
        return float((p * np.exp(x * scores)).sum() + (1 - p.sum()) * np.exp(-x * drift) - 1)

    if not len(scores) or float((p * scores).sum()) - (1 - p.sum()) * drift >= 0:
        return 0.1
    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 100:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), left to right, in linear time.

    Words that are not at ``positions`` score ``-drift``.  Each open segment
    knows the nearest one to its left that begins at a lower running total.
    """
    total, last, open_segments = 0.0, -1, []  # [total before, total after, first, last, nearest lower]
    for p, s in zip(positions, scores):
        total -= drift * (p - last - 1)
        new = [total, total + s, p, p, -1]
        total, last = total + s, p
        while True:
            j = len(open_segments) - 1
            while j >= 0 and open_segments[j][0] >= new[0]:
                j = open_segments[j][4]
            new[4] = j
            if j < 0 or open_segments[j][1] >= new[1]:
                break
            new = [open_segments[j][0], new[1], open_segments[j][2], p, -1]
            del open_segments[j:]
        open_segments.append(new)
    return [(first, end, after - before) for before, after, first, end, _ in open_segments]


def passages(rows: DataFrame, words: Words) -> DataFrame:
    """Replace ``text`` by n_words and the maximal segments: first and last word, score."""
    def scan(texts):
        split = [folded_words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        made = [[], [], []]
        for ws in split:
            at = _buckets(ws)
            row = np.searchsorted(words.buckets, at)
            hit = np.flatnonzero(words.buckets[np.minimum(row, len(words.buckets) - 1)] == at) if len(words.buckets) else []
            found = segments([int(i) for i in hit], words.scores[row[hit]].tolist(), words.drift) if len(hit) else []
            for column, k in zip(made, range(3)):
                column.append([x[k] for x in found])
        return [sizes, *made]

    return from_text(rows, "n_words long, firsts array<bigint>, lasts array<bigint>, scores array<double>", scan)


def _features(n, best, total):
    """Best calibrated value (bounded) and the log of the sum of the positive ones."""
    return np.stack([np.clip(best, -10, 20), np.log1p(total), np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 4)
    return w


def judge(docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = 20_000,
          significance: float = 0.01) -> DataFrame:
    """(doc_id, n_words, score, passages): passages with p-value at most ``significance``.

    A passage is (first word, last word, score, p_value); words are those of
    ``folded_words``.
    """
    sample = cut(sample_labels(labels, column, bound))
    words = learn_words(frequencies(docs, sample))
    found = cut(passages(pick(docs, doc_id="long", text="string"), words))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    rows = (found.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
            .agg(F.max(F.struct(best.alias("best"), "n_words", "scores")).alias("r")).collect())  # at most `bound`
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], float)
    n = np.array([max(r.r.n_words, 1) for r in rows], float)
    clean = y == 0
    bests = np.array([r.r.best for r in rows])
    k = float(clean.sum() / (n[clean] * np.exp(-words.rate * bests[clean])).sum()) if clean.any() else 1.0
    if len(y) and 0 < y.sum() < len(y):
        level = np.log(k * n)
        totals = np.array([np.maximum(words.rate * np.array(r.r.scores or [0.0]) - v, 0).sum() for r, v in zip(rows, level)])
        w = _logistic(_features(n, words.rate * bests - level, totals), y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        w = np.array([0, 0, np.log(share / (1 - share))])

    level = F.log(F.lit(k) * F.greatest("n_words", F.lit(1)))
    value = F.transform("scores", lambda s: F.lit(words.rate) * s - F.col("level"))
    rows = (found.withColumn("level", level).withColumn("values", value)
            .withColumn("best", F.lit(words.rate) * best - F.col("level"))
            .withColumn("total", F.aggregate("values", F.lit(0.0), lambda a, v: a + F.greatest(v, F.lit(0.0)))))
    margin = (F.least(F.greatest("best", F.lit(-10.0)), F.lit(20.0)) * float(w[0])
              + F.log1p("total") * float(w[1]) + float(w[2]))
    listed = F.filter(F.transform(F.arrays_zip("firsts", "lasts", "scores", "values"), lambda z: F.struct(
        z["firsts"].alias("first"), z["lasts"].alias("last"), z["scores"].alias("score"),
        (-F.expm1(-F.exp(-z["values"]))).alias("p_value"))), lambda z: z["p_value"] <= significance)
    return rows.select("doc_id", "n_words", (1 / (1 + F.exp(-margin))).alias("score"), listed.alias("passages"))
