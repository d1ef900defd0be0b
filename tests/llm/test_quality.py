"""Co-training against a plain model: one document at a time, dense matrices, sets and counters."""

import math
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import quality as Q

ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))


def runs(data, keep):
    """The longest stretches of bytes of `keep`."""
    out, now = [], bytearray()
    for c in data:
        if c in keep:
            now.append(c)
        elif now:
            out.append(bytes(now))
            now = bytearray()
    return [*out, bytes(now)] if now else out


def text_view(text, roll):
    data = (text or "").encode()
    words = runs(bytes(c + 32 if 65 <= c <= 90 else c for c in data), ALNUM)
    number = lambda w: int(roll.of_words(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    found = {Q.SHAPES + number(w) % (Q.WIDTH - Q.SHAPES) for w in set(words)}
    lines, size = runs(data, frozenset(range(256)) - {10, 13}), max(len(data), 1)
    symbols = sum(chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in data)
    measures = [
        symbols / size * 64, sum(65 <= c <= 90 for c in data) / size * 32, sum(48 <= c <= 57 for c in data) / size * 64, sum(map(len, words)) / max(len(words), 1), len(found) / max(len(words), 1) * 24,
        math.log2(len(words) + 1), (1 - len(set(lines)) / max(len(lines), 1)) * 24, len(words) / max(len(lines), 1) / 4,
    ]
    return sorted(found) + [32 * i + int(min(m, 31)) for i, m in enumerate(measures)]


def meta_view(lang, source, n_chars):
    of = lambda s, cells: np.int64(np.uint64(xxhash.xxh64_intdigest((s or "").encode(), 42))) % cells
    size = int(min(math.floor(math.log2(max(n_chars or 0, 0) + 2) * 2), Q.LENGTHS - 1))
    return int(of(lang, Q.LANGUAGES) * Q.LENGTHS + size), int(Q.LANGUAGES * Q.LENGTHS + of(source, Q.SOURCES)), Q.LANGUAGES * Q.LENGTHS + Q.SOURCES + size


def dense(rows, width):
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, list(r)] = 1
    return out


def regression(x, y, weight, more=None):
    """Weights and intercept of presence columns scaled by their log ratio, 200 steps of Adam."""
    bad, good, n_bad, n_good = (weight * (1 - y)) @ x, (weight * y) @ x, (weight * (1 - y)).sum(), (weight * y).sum()
    if more is not None:
        (bad_more, good_more), (rows_bad, rows_good) = more
        part_bad, part_good = min(1, n_bad / 4 / max(1, rows_bad)), min(1, n_good / 4 / max(1, rows_good))
        bad, good, n_bad, n_good = bad + part_bad * bad_more, good + part_good * good_more, n_bad + part_bad * rows_bad, n_good + part_good * rows_good
    scale = np.where(bad + good + 2 > 4, np.log((good + 1) / (n_good + 2) / ((bad + 1) / (n_bad + 2))), 0)
    z = x * scale
    w, b = np.full(x.shape[1], 0.1), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, 201):
        error = weight * (1 / (1 + np.exp(-(z @ w + b).clip(-30, 30))) - y) / weight.sum()
        slope = np.append(error @ z + 3e-3 * w / math.sqrt(len(y)), error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return lambda row: float(np.clip(sum((w * scale)[j] for j in row) + b, -30, 30))


def newton(columns, y):
    x, w = np.column_stack([*columns, np.ones(len(y))]), np.zeros(len(columns) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
    return w


def cotrained(documents, labels, roll, rounds):
    """(labels exchanged by round, scores (text, metadata, both) by document)."""
    texts = {d: text_view(t, roll) for d, t, *_ in documents}
    metas = {d: meta_view(*rest) for d, _, *rest in documents}
    chain = lambda d: xxhash.xxh64_intdigest((3).to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42))
    checks, fits = [d for d in labels if chain(d) % 4 == 0], [d for d in labels if chain(d) % 4]
    y, truth = (np.array([float(labels[d]) for d in part]) for part in (fits, checks))
    more, given, told = None, Counter(), []
    logistic = lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))
    for step in range(rounds + 1):
        by_text = regression(dense([texts[d] for d in fits], Q.WIDTH), y, np.ones(len(y)), more)
        groups = list(given)
        share = len(fits) / max(1, sum(given.values()))
        weight = np.append(np.ones(len(y)), [given[g] * share for g in groups])
        by_meta = regression(dense([*(metas[d] for d in fits), *(g[0] for g in groups)], Q.CELLS), np.append(y, [float(g[1]) for g in groups]), weight)
        platt = [newton([np.array([by(view[d]) for d in checks])], truth) for by, view in ((by_text, texts), (by_meta, metas))]
        scores = {d: tuple(logistic(a * by(view[d]) + b) for (a, b), by, view in zip(platt, (by_text, by_meta), (texts, metas))) for d in texts}
        if step == rounds:
            break
        bars = [(max(0.03, np.quantile(s, 0.05)), min(0.97, np.quantile(s, 0.95))) for s in zip(*(scores[d] for d in checks))]
        given, more = Counter(), (np.zeros((2, Q.WIDTH)), np.zeros(2))
        for d, (p, q) in scores.items():
            if p > bars[0][1] or p < bars[0][0]:
                given[metas[d], int(p > bars[0][1])] += 1
            if q > bars[1][1] or q < bars[1][0]:
                more[0][int(q > bars[1][1]), texts[d]] += 1
                more[1][int(q > bars[1][1])] += 1
        told.append({"text": [sum(n for (_, k), n in given.items() if k == c) for c in (0, 1)], "meta": [int(n) for n in more[1]]})
    odds = lambda v: math.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
    u, v, b = newton([np.array([odds(scores[d][k]) for d in checks]) for k in (0, 1)], truth)
    return told, {d: (p, q, logistic(u * odds(p) + v * odds(q) + b)) for d, (p, q) in scores.items()}


def test_cotraining_by_a_plain_model(spark, documents, sf_dir, pairs):
    """Every label exchanged in two rounds and all three scores of every document."""
    table = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = dict(pairs(table.filter("quality IS NOT NULL"), "doc_id", F.expr("CAST(quality = 1 AND coalesce(toxic, 0) = 0 AS INT)")))
    rows = pairs(documents, "doc_id", "text", "lang", "source", "n_chars")
    model = Q.trained(documents, table, rounds=2)
    told, scores = cotrained(rows, {d: labels[d] for d in {r[0] for r in rows} & set(labels)}, model["roll"], 2)
    assert model["exchanged"] == told
    found = pairs(Q.judged(documents, model), "doc_id", "text_score", "meta_score", "score", "keep")
    assert len(found) == len(rows)
    for d, *three, keep in found:
        assert np.allclose(three, scores[d], atol=1e-5)
        assert keep == (three[2] >= 0.5)
