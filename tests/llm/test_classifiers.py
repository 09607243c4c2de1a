"""op1, op7, op10: accuracy on held-out rows, and parts against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from carelens.llm import queries, quality, toxicity, url_filter
from carelens.llm.shared import sample_labels

SF = "/root/testdata/sf0.01"


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path, rules):
    fits = []
    for text, verdict in rules:
        domain, prefix = text.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            fits.append((text, verdict))
    return max(fits, key=lambda r: (len(r[0]), r[1] == "block"), default=(None, None))


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.NET/x", "http://example.net/en/1", "x://b.example.net/en",
        "http://sub.Example.com/de/a?b#c", "http://example.com/DE/", "http://a.org/fr/x", "http://notorg/fr/", "a://b://c/d",
        "http://Ünï.ORG/fr/é?x", "http://casino-bets.com/win?x=1", "http://h?q", "http://h#f", "http://net\n/x", "http://a.net.org/" + "p" * 50_000]


@pytest.fixture(scope="module")
def weights(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_url_filter(spark, weights):
    rows = [(i, u, "extra", 1.0) for i, u in enumerate(URLS + URLS[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, HOST string, p double").select("page_id", "url")
    got = {r.page_id: r for r in url_filter.judge(pages, queries.RULES, weights).collect()}
    assert len(got) == len(rows)
    for i, u, _, _ in rows:
        host, path = host_path(u)
        text, verdict = rule(host, path, queries.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, text)
        grams = {url_filter.BUCKETS}
        if host:
            for kind, s, sizes in (("h", f"^{host}$", (3, 4, 5)),
                                   ("p", re.sub("[A-Z]", lambda m: m[0].lower(), path), (3, 4))):
                grams |= {(h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS for n in sizes for h in
                          [xxhash.xxh64_intdigest((kind + s[j:j + n]).encode(), 42) for j in range(len(s) - n + 1)]}
        margin = sum(weights[g] for g in grams) / len(grams) ** 0.5
        assert abs(got[i].probability - 1 / (1 + np.exp(-margin))) < 1e-9
        assert got[i].verdict == (verdict or ("block" if margin >= 0 else "allow"))
    assert url_filter.judge(pages.limit(0), queries.RULES, weights).count() == 0


def test_url_model_separates_its_rows(spark, weights):
    rows = url_filter.judge(url_filter.labelled_urls(spark), [], weights)
    assert rows.where("(blocked = 1) <> (verdict = 'block')").count() == 0


def test_url_plan_is_native(spark, weights):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = url_filter.judge(pages, queries.RULES, weights)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ArrayType" not in plan


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2


@pytest.mark.parametrize("name, label, least", [("op7_toxicity", "toxic", 0.9), ("op10_quality_classifier", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id)
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) > least
    assert (rows.predicted == rows[label]).mean() > 0.95


def test_label_sample(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, None), (None, 1), (3, 0), (6, 1), (9, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.label for r in sample_labels(labels, "toxic", 100).collect()}
    want = {d: v for d, v in {1: 1, 3: 0, 6: 1, 9: 0}.items() if zlib.crc32(str(d).encode()) % 5}
    assert got == want
    assert sample_labels(labels, "toxic", 2).count() == min(2, len(want))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "word " * 30_000, "d"), (3, "again", "e")],
                                 "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    none = quality.train(docs, labels.limit(0))
    assert abs(none.score(np.zeros((1, len(quality.FEATURES))))[0] - 0.5) < 1e-9
    assert quality.score(docs.limit(0).select("doc_id", "text"), model).count() == 0


def test_trees_learn_a_threshold_rule():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(int)
    model = quality.fit(x[:3000], y[:3000], trees=30)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def plain_segments(scores):
    """All maximal segments by their definition: take the best (shortest, leftmost) and go on at both sides."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], -best[2] - best[1]
    left = plain_segments(scores[:a])
    right = [(f + b, e + b, s) for f, e, s in plain_segments(scores[b:])]
    return left + [(a, b - 1, best[0])] + right


def test_segments_are_the_maximal_ones():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.choice([-0.25, -0.25, 1.5, 0.75, 0.5]) for _ in range(rng.randrange(1, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(at, [scores[i] for i in at], 0.25)
        assert [(f, e) for f, e, _ in got] == [(f, e) for f, e, _ in plain_segments(scores)], scores


def test_toxicity_finds_planted_passages(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for d in range(1, 401):
        text = [rng.choice(words) for _ in range(80)]
        if d % 4 == 0:
            text[30:30] = [rng.choice(["vile", "scum", "filth"]) for _ in range(6)]
        docs.append((d, " ".join(text)))
        labels.append((d, int(d % 4 == 0)))
    docs += [(500, None), (501, ""), (None, "vile scum filth vile scum"), (502, "w1 " * 20_000), (4, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.judge(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None and r.doc_id <= 400:
            assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
            assert any(p.first <= 33 <= p["last"] for p in r.passages) == (r.doc_id % 4 == 0)
        elif r.doc_id is not None:
            assert r.score < 0.5 and not r.passages
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.judge(frame, nothing).collect()} == {0.5}
    assert toxicity.judge(frame.limit(0), nothing).count() == 0


def walk(model, root, row):
    """A tree's value for one row, node by node."""
    node = root
    while model.left[node] != node:
        node = (model.left if row[model.feature[node]] <= model.threshold[node] else model.right)[node]
    return model.value[node]


def best_split(x, grad, hess, edges, rows, least, ridge):
    """(gain, feature, threshold) of the best split of ``rows``, from plain sums over the rows."""
    best = (0.0, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    for f in range(x.shape[1]):
        for t in edges[f]:
            low = rows[x[rows, f] <= t]
            if min(len(low), len(rows) - len(low)) < least:
                continue
            gl, hl = grad[low].sum(), hess[low].sum()
            gain = gl**2 / (hl + ridge) + (g - gl)**2 / (h - hl + ridge) - g**2 / (h + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, f, t)
    return best


def test_trees_equal_a_plain_version():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = ((x[:, 0] + x[:, 3] > 0.2) ^ (x[:, 1] > 1)).astype(int)
    bins, least, ridge, rate, depth = 12, 15, 1.0, 0.3, 3
    model = quality.fit(x, y, trees=4, depth=depth, rate=rate, bins=bins, least=least, ridge=ridge)
    new = np.round(rng.normal(size=(200, 5)), 1)
    want = [model.base + sum(walk(model, root, row) for root in model.roots) for row in new]
    assert np.allclose(model.margin(new), want)  # flattened traversal

    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(5)]
    margin = np.full(len(y), model.base)
    splits = 0
    for root in model.roots:
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        open_nodes = [(root, np.arange(len(y)), 0)]
        while open_nodes:
            node, rows, level = open_nodes.pop()
            gain, f, t = best_split(x, grad, hess, edges, rows, least, ridge) if level < depth else (0, None, None)
            if gain <= 1e-6:
                assert model.left[node] == model.right[node] == node
                assert np.isclose(model.value[node], -rate * grad[rows].sum() / (hess[rows].sum() + ridge))
                margin[rows] += model.value[node]
                continue
            splits += 1
            low = x[rows, model.feature[node]] <= model.threshold[node]  # of equal gains any may be chosen
            gl, hl, g, h = (v.sum() for v in (grad[rows[low]], hess[rows[low]], grad[rows], hess[rows]))
            assert np.isclose(gl**2 / (hl + ridge) + (g - gl)**2 / (h - hl + ridge) - g**2 / (h + ridge), gain)
            open_nodes += [(model.left[node], rows[low], level + 1), (model.right[node], rows[~low], level + 1)]
    assert splits > 10
