"""Quality classification by co-training of two views.

One view reads the text (which words it has and its shape), the other only the
metadata of the page (language, source, length). Each is a logistic regression
fitted on labelled rows. In every round both judge all documents; where one view
is confident, its verdict becomes a label for the other. Such labels are counted
by feature over all documents; none is drawn. In the end each view is
calibrated on labelled rows that it was not fitted on, and a last regression on
the two calibrated scores judges every document.

Rows are good if they are labelled as of quality and not toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U64, Rolling, byte_set, mix, ragged, short_batches, texts, words

#: Bound of the fit, in rows: labelled documents.
LABEL_ROWS = 16000
WIDTH = 1 << 16
SHAPES = 512
#: Cells of the metadata's hashes, and its features in all.
LANGUAGES, SOURCES, LENGTHS = 16, 512, 64
CELLS = LANGUAGES * LENGTHS + SOURCES + LENGTHS
#: A view is confident beyond this probability of a class, or in the share SUREST of its calibrated scores on each side.
CONFIDENT, SUREST = 0.97, 0.05
LINE = ~byte_set([(0x0A, 0x0A), (0x0D, 0x0D)])
UPPER, DIGIT, SYMBOL = byte_set([(65, 90)]), byte_set([(48, 57)]), byte_set([(33, 47), (58, 64), (91, 96), (123, 126)])


def text_features(column: pa.Array, roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(feature, features up to each row's end from 0): distinct hashed words and one bin of each measure of shape."""
    out, ends, done = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in texts(column):
        n = len(offsets) - 1
        low = LOWER[data]
        start, end, upto = words(low, offsets, ALNUM)
        row = np.repeat(np.arange(n), np.diff(upto))
        hashed = roll.of_words(low, start, end)
        pairs = np.unique((row.astype(U64) << U64(32)) | (U64(SHAPES) + hashed % U64(WIDTH - SHAPES)))
        per_row = np.searchsorted(pairs, np.arange(n + 1, dtype=U64) << U64(32))
        l_start, l_end, l_upto = words(data, offsets, LINE)
        l_row = np.repeat(np.arange(n), np.diff(l_upto))
        lines = roll.of_words(data, l_start, l_end) ^ mix(l_row.astype(U64))
        kept = np.bincount(l_row[np.unique(lines, return_index=True)[1]], minlength=n)
        size = np.maximum(np.diff(offsets), 1)
        filled = np.flatnonzero(np.diff(offsets))

        def share(table: np.ndarray) -> np.ndarray:
            of_row = np.zeros(n)
            if len(filled):
                of_row[filled] = np.add.reduceat(table[data], offsets[filled], dtype=np.int64)
            return of_row / size

        n_words, distinct = np.diff(upto), np.diff(per_row)
        letters = np.bincount(row, weights=end - start, minlength=n)
        measures = [
            share(SYMBOL) * 64, share(UPPER) * 32, share(DIGIT) * 64, letters / np.maximum(n_words, 1), distinct / np.maximum(n_words, 1) * 24,
            np.log2(n_words + 1), (1 - kept / np.maximum(np.diff(l_upto), 1)) * 24, n_words / np.maximum(np.diff(l_upto), 1) / 4,
        ]
        bins = np.stack([32 * i + np.minimum(m, 31).astype(np.int64) for i, m in enumerate(measures)], 1)
        pairs = np.sort(np.concatenate([pairs, ((np.arange(n, dtype=U64)[:, None] << U64(32)) | bins.astype(U64)).ravel()]))
        out.append((pairs & U64(0xFFFFFFFF)).astype(np.int64))
        ends.append(np.searchsorted(pairs, np.arange(1, n + 1, dtype=U64) << U64(32)) + done)
        done += len(pairs)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.concatenate(ends)


def metadata_features() -> list:
    """Three features of a row: its language and length, its source, and its length; of all three together there are
    LANGUAGES * SOURCES * LENGTHS classes at most."""
    size = F.least(F.floor(F.log2(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("double") + 2) * 2), F.lit(LENGTHS - 1))
    hashed = lambda c, cells: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(cells))
    return [
        (hashed("lang", LANGUAGES) * LENGTHS + size).cast("int"),
        (F.lit(LANGUAGES * LENGTHS) + hashed("source", SOURCES)).cast("int"), (F.lit(LANGUAGES * LENGTHS + SOURCES) + size).cast("int"),
    ]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1)
    np.cumsum(values, out=upto[1:])
    return np.diff(upto[ends])


def fit(index: np.ndarray, ends: np.ndarray, label: np.ndarray, weight: np.ndarray, width: int, rounds: int = 200, decay: float = 3e-3, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on presence features, each scaled by its
    smoothed log ratio of classes, by full gradient steps with Adam.

    `more` are rows beyond those given, of which only counts are known: (2, width) rows by class and feature,
    and rows by class. They count in the ratios, a class as much as a quarter of its given rows at most.
    """
    row = np.repeat(np.arange(len(label)), np.diff(ends))
    seen = [np.bincount(index, weights=(weight * y)[row], minlength=width) for y in (1 - label, label)]
    total = [(weight * y).sum() for y in (1 - label, label)]
    if more is not None:
        for k in (0, 1):
            part = min(1.0, total[k] / 4 / max(1.0, more[1][k]))
            seen[k], total[k] = seen[k] + part * more[0][k], total[k] + part * more[1][k]
    bad, good = (x + 1 for x in seen)
    ratio = np.log(good / (total[1] + 2)) - np.log(bad / (total[0] + 2))
    scale = np.where((good + bad) > 4, ratio, 0.0)
    x, w, b = scale[index], np.full(width, 0.1), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(sums(x * w[index], ends) + b, -30, 30)))
        error = weight * (p - label) / weight.sum()
        g = np.append(np.bincount(index, weights=x * error[row], minlength=width) + decay * w / np.sqrt(len(label)), error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return np.append(w * scale, b)


def fit_dense(x: np.ndarray, label: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression of a few columns by Newton steps; the intercept is last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - label) + 1e-3 * w)
    return w


def logit_text(model: dict, index: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.clip(sums(model["text"][index], ends) + model["text"][-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrated(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(sigmoid(model[k][0] * x + model[k][1]) for k, x in (("platt_text", text), ("platt_meta", meta)))


def flat(lists: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all lists, one after the other, without a Python object for each."""
    return pa.compute.list_flatten(lists).to_numpy().astype(np.int64)


class Sample:
    """Rows with labels on the driver: text features, metadata features, label, weight."""

    def __init__(self, table: pa.Table):
        index = [np.frombuffer(x.as_buffer(), "<u4") for x in table["features"]]
        self.ends = np.cumsum([0, *map(len, index)])
        self.index = np.concatenate(index).astype(np.int32) if index else np.zeros(0, np.int32)
        self.meta = flat(table["meta"]).reshape(-1, 3)
        self.label = table["label"].to_numpy().astype(float)
        self.calibrates = table["calibrates"].to_numpy().astype(bool)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(self.ends)[which]
        return self.index[ragged(self.ends[:-1][which], sizes)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def logit_meta(model: dict, meta: np.ndarray) -> np.ndarray:
    return np.clip(model["meta"][meta].sum(1) + model["meta"][-1], -30, 30) if len(meta) else np.zeros(0)


def features(documents: DataFrame, roll: Rolling, text_col: str) -> DataFrame:
    """Rows (features, meta, ...) of labelled documents."""

    def scan(batches):
        for batch in batches:
            index, ends = text_features(batch.column("text"), roll)
            blobs = [index[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *(batch.column(c) for c in ("meta", "label", "calibrates"))], ["features", "meta", "label", "calibrates"])

    return documents.select(F.col(text_col).alias("text"), F.array(*metadata_features()).alias("meta"), "label", "calibrates").mapInArrow(scan, "features binary, meta array<int>, label int, calibrates boolean")


def trained(documents: DataFrame, labels: DataFrame, rounds: int = 2, label_rows: int = LABEL_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, or None where the labels don't have both classes.

    At most label_rows labelled documents are fitted on, those with the smallest hashes of their ids; a
    quarter of them only calibrates. Each view takes the other's confident labels of all documents, as counts.
    The model's "exchanged" has for each round the labels given by the text view and by the metadata view,
    each as [bad, good].
    """
    short_batches(documents.sparkSession)
    roll = Rolling(21)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    hash_ = F.xxhash64(F.col(id_col), F.lit(3))
    few = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min(good).alias("label")).orderBy(hash_, id_col).limit(label_rows)
    few = few.withColumn("calibrates", F.pmod(hash_, F.lit(4)) == 0)
    known = documents.join(F.broadcast(few), id_col)
    columns = [c for c in (text_col, "lang", "source", "n_chars") if c in documents.columns]
    # Of rows that repeat a labelled id one counts, so there are label_rows rows at most.
    known = known.groupBy(id_col, "label", "calibrates").agg(F.min(F.struct(*columns)).alias("row")).select(id_col, "label", "calibrates", "row.*")
    sample = Sample(features(known, roll, text_col).toArrow())
    fits, checks = np.flatnonzero(~sample.calibrates), np.flatnonzero(sample.calibrates)
    if min(len(set(sample.label[fits])), len(set(sample.label[checks]))) < 2:
        return None
    ones = np.ones(len(fits))
    more, counts = None, np.zeros((0, 5))
    model: dict = {"roll": roll, "exchanged": []}
    for step in range(rounds + 1):
        model["text"] = fit(*sample.rows(fits), sample.label[fits], ones, WIDTH, more=more)
        meta, label, weight = sample.meta[fits], sample.label[fits], ones
        if len(counts):
            # All documents together weigh as much as the labelled ones.
            meta, label = np.concatenate([meta, counts[:, :3].astype(np.int64)]), np.concatenate([label, counts[:, 3]])
            weight = np.concatenate([weight, counts[:, 4] * len(fits) / counts[:, 4].sum()])
        model["meta"] = fit(meta.ravel(), np.arange(0, 3 * len(meta) + 1, 3), label, weight, CELLS)
        text, other, truth = logit_text(model, *sample.rows(checks)), logit_meta(model, sample.meta[checks]), sample.label[checks]
        model["platt_text"], model["platt_meta"] = fit_dense(text[:, None], truth), fit_dense(other[:, None], truth)
        if step == rounds:
            break
        model["bars"] = [bars(x) for x in calibrated(model, text, other)]
        more, counts = exchanged(documents, model, text_col)
        by_text = [int(counts[counts[:, 3] == k, 4].sum()) for k in (0, 1)]
        model["exchanged"].append({"text": by_text, "meta": more[1].astype(int).tolist()})
    p, q = calibrated(model, text, other)
    odds = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    model["both"] = fit_dense(np.column_stack([odds(p), odds(q)]), truth)
    return model


def bars(scores: np.ndarray) -> tuple[float, float]:
    """Below the first a view is confident of a bad document, above the second of a good one."""
    lo, hi = np.quantile(scores, [SUREST, 1 - SUREST])
    return max(1 - CONFIDENT, float(lo)), min(CONFIDENT, float(hi))


def exchanged(documents: DataFrame, model: dict, text_col: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """What the views say with confidence about all documents: counts by class and text feature, and by class, with
    the metadata view's labels, and counts of metadata with the text view's labels."""

    def scan(batches):
        seen, rows = np.zeros((2, WIDTH), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            index, ends = text_features(batch.column("text"), model["roll"])
            meta = batch.column("meta").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            p, q = calibrated(model, logit_text(model, index, ends), logit_meta(model, meta))
            (p_lo, p_hi), (q_lo, q_hi) = model["bars"]
            sure = np.flatnonzero((p > p_hi) | (p < p_lo))
            groups, n = np.unique(np.column_stack([meta[sure], p[sure] > p_hi]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(groups[:, :3].tolist(), pa.list_(pa.int32())), pa.nulls(len(n), pa.int32()), pa.array(groups[:, 3].astype(np.int32)), pa.array(n.astype(np.int64))], names)
            row = np.repeat(np.arange(len(q)), np.diff(ends))
            for k, chosen in enumerate((q < q_lo, q > q_hi)):
                seen[k] += np.bincount(index[chosen[row]], minlength=WIDTH)
                rows[k] += chosen.sum()
        for k in (0, 1):  # the feature WIDTH stands for the rows themselves
            counted = np.append(seen[k], rows[k])
            at = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.list_(pa.int32())), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(counted[at])], names)

    names = ["meta", "feature", "label", "n"]
    rows = documents.select(F.col(text_col).alias("text"), F.array(*metadata_features()).alias("meta")).mapInArrow(scan, "meta array<int>, feature int, label int, n long")
    # Features are bounded by WIDTH, metadata classes by LANGUAGES * SOURCES * LENGTHS, twice: about a million rows at most.
    got = rows.groupBy("meta", "feature", "label").agg(F.sum("n").alias("n")).toArrow()
    of_text = got.filter(pa.compute.is_valid(got["feature"]))
    table = np.zeros((2, WIDTH + 1))
    table[of_text["label"].to_numpy(), of_text["feature"].to_numpy()] = of_text["n"].to_numpy()
    of_meta = got.filter(pa.compute.is_null(got["feature"]))
    counts = np.column_stack([flat(of_meta["meta"]).reshape(-1, 3), of_meta["label"].to_numpy(), of_meta["n"].to_numpy()]).astype(float)
    return (table[:, :WIDTH], table[:, WIDTH]), counts[np.lexsort(counts.T[::-1])]


def judged(documents: DataFrame, model: dict | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns and rows, with text_score, meta_score, score and keep (score of at least threshold),
    which take the place of columns of those names.

    Null and empty texts have the features of an empty text. Without a model, and for tables without
    both classes of labels, scores are null and every row is kept.
    """
    short_batches(documents.sparkSession)
    if model is None:
        none = F.lit(None).cast("double")
        return documents.withColumns({"text_score": none, "meta_score": none, "score": none, "keep": F.lit(True)})
    columns = [c for c in documents.columns if c.lower() not in ("text_score", "meta_score", "score", "keep")]

    def scan(batches):
        for batch in batches:
            index, ends = text_features(batch.column("_text"), model["roll"])
            meta = batch.column("_meta").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            p, q = calibrated(model, logit_text(model, index, ends), logit_meta(model, meta))
            odds = [np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6))) for x in (p, q)]
            score = sigmoid(model["both"][0] * odds[0] + model["both"][1] * odds[1] + model["both"][2])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *map(pa.array, (p, q, score, score >= threshold))], [*(f"c{i}" for i in range(len(columns))), "text_score", "meta_score", "score", "keep"])

    schema = ", ".join(f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    given = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text_col).alias("_text"), F.array(*metadata_features()).alias("_meta"))
    out = given.mapInArrow(scan, f"{schema}, text_score double, meta_score double, score double, keep boolean")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "text_score", "meta_score", "score", "keep")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(documents.select("doc_id", "text", "lang", "source", "n_chars"), model).select("doc_id", "text_score", "meta_score", "score", "keep")
