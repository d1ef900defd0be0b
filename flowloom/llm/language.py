"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes with counts of the bytes that follow. A byte that has followed
the longest known context costs -log2(count / (all + distinct)); otherwise an escape, -log2(distinct / (all + distinct)), is paid
and the context loses its first byte, down to 8 bits for a byte that no context knows (method C, no exclusions). A text's
code length in a language is the sum over its bytes; the statistics are frozen, so it depends only on how often each
(order + 1)-gram stands in the text. Costs are whole 1/65536 bits, so sums don't depend on their order.

The trees are fitted on a sample of labelled documents of at most `fit_bytes` UTF-8 bytes together, which bounds what is broadcast:
no more (order + 1)-grams than bytes. Every document is scored, in whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, texts

#: Costs are in 1/UNIT bits.
UNIT = 1 << 16
ORDER, FIT_BYTES, LANGUAGES = 3, 8 << 20, 256
#: What every text counts as preceded by.
BEFORE = 0x0A


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte, itself and the `order` bytes before it as one number, its own byte lowest; A-Z count as a-z."""
    at = np.arange(len(data)) + order * (1 + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
    padded = np.full(len(data) + order * (len(offsets) - 1), BEFORE, np.uint8)
    padded[at] = LOWER[data]
    out = padded[at].astype(U64)
    for back in range(1, order + 1):
        out |= padded[at - back].astype(U64) << U64(8 * back)
    return out


class Tree:
    """Costs of one language: of each byte after each context, and of escaping from it, by length of context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.known, self.escape = [], []
        for k in range(order + 1):
            code, at = np.unique(codes & U64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(code)).astype(np.int64)
            context, of = np.unique(code >> U64(8), return_inverse=True)
            follow = np.bincount(of, minlength=len(context))
            whole = np.bincount(of, n, len(context)) + follow
            self.known.append((code, bits(n / whole[of])))
            self.escape.append((context, bits(follow / whole)))

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Of (order + 1)-grams, each as a byte after its context."""
        out = np.zeros(len(code), np.int64)
        open_ = np.arange(len(code))
        for k in reversed(range(len(self.known))):
            gram = code[open_] & U64((1 << 8 * (k + 1)) - 1)
            cost, found = looked_up(*self.known[k], gram)
            out[open_] += cost
            open_, gram = open_[~found], gram[~found]
            out[open_] += looked_up(*self.escape[k], gram >> U64(8))[0]
        out[open_] += 8 * UNIT
        return out


def bits(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * UNIT).astype(np.int64)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value or 0, whether there is one) of each wanted key, keys ascending."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], 0), found


class Model:
    """Trees of all languages, and the costs of the grams that any of them has seen."""

    def __init__(self, cells: pa.Table, order: int = ORDER):
        lang, code, n = cells["lang"].to_numpy(zero_copy_only=False), cells["code"].to_numpy().astype(np.int64).view(U64), cells["n"].to_numpy()
        self.order, self.languages = order, sorted(set(lang))
        self.trees = [Tree(code[lang == x], n[lang == x], order) for x in self.languages]
        self.seen = np.unique(code)
        self.cost = [t.costs(self.seen) for t in self.trees]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """Of each text in each language, in 1/UNIT bits."""
        out = np.zeros((len(offsets) - 1, len(self.trees)), np.int64)
        every = grams(data, offsets, self.order)
        for lo in range(0, len(every), piece):  # a long text passes in pieces
            hi = min(lo + piece, len(every))
            code, at = np.unique(every[lo:hi], return_inverse=True)
            place = np.minimum(np.searchsorted(self.seen, code), len(self.seen) - 1)
            new = self.seen[place] != code
            first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            edges = np.clip(offsets[first : last + 1], lo, hi) - lo
            full = np.flatnonzero(np.diff(edges))
            for x, (tree, cost) in enumerate(zip(self.trees, self.cost)):
                of = cost[place]
                of[new] = tree.costs(code[new])
                out[first + full, x] += np.add.reduceat(of[at], edges[full])
        return out


def sampled(docs: DataFrame, fit_bytes: int, languages: int) -> DataFrame:
    """Of (id, lang, text): the `languages` languages of most documents, and of each the documents whose hash of the id lies in the
    largest of the shares 1, 1/2, 1/4, ... that holds no more than fit_bytes / languages found; if none holds a
    document, the smallest that does."""
    share = F.xxhash64(F.col("id").cast("string"), "text").bitwiseAND((1 << 63) - 1)
    size = F.octet_length("text")
    steps = range(62)
    within = lambda j: share < F.lit(1 << 63 - j) if j else F.lit(True)
    sums = docs.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(F.when(within(j), size)).alias(f"s{j}") for j in steps])
    rows = sums.orderBy(F.desc("n"), "lang").limit(languages).collect()
    most = fit_bytes // max(1, len(rows))
    chosen = {r["lang"]: min((j for j in steps if r[f"s{j}"] is not None and r[f"s{j}"] <= most), default=max(j for j in steps if r[f"s{j}"] is not None)) for r in rows}
    cases = F.lit(False)
    for lang, j in chosen.items():
        cases = F.when(F.col("lang") == lang, within(j)).otherwise(cases)
    return docs.filter(cases)


def learned(docs: DataFrame, take: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, fit_bytes: int = FIT_BYTES, languages: int = LANGUAGES) -> Model | None:
    """Trees of the documents for which `take` holds and that have a text and a language; none: None. order: 7 at most."""
    rows = docs.filter(take) if take is not None else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column("lang").to_numpy(zero_copy_only=False)
            for x in sorted(set(lang)):
                for _, _, data, offsets in texts(b.column("text").filter(pa.array(lang == x))):
                    code, n = np.unique(grams(data, offsets, order), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [x] * len(code), "code": code.view(np.int64), "n": n.astype(np.int64)})

    cells = sampled(rows, fit_bytes, languages).select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    return Model(cells, order) if len(cells) else None


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", none: str = "und") -> DataFrame:
    """(id_col, lang_pred, score, bits) of every row: the language of the shortest code (ties: the first by name), its posterior
    under equal priors, and its code length. Null texts, texts without a letter, and all without a model: `none`, 0.0 and null."""
    rows = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__text"))
    if model is None:
        return rows.select(id_col, F.lit(none).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for b in batches:
            column = b.column("__text")
            for lo, hi, data, offsets in texts(column):
                length = m.code_lengths(data, offsets)
                best = length.argmin(1)
                shortest = length[np.arange(len(best)), best]
                p = 1 / np.exp2((shortest[:, None] - length) / UNIT).sum(1)
                unknown = column.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col).slice(lo, hi - lo), pa.array(np.where(unknown, none, names[best]), pa.string()), pa.array(np.where(unknown, 0.0, p)), pa.array(shortest / UNIT, mask=unknown)], [id_col, "lang_pred", "score", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(score, f"`{id_col}` {kind}, lang_pred string, score double, bits double")


def third(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def op13_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predicted(docs, learned(docs, third() != 1))
    return found.select("doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")
