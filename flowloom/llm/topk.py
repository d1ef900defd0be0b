"""Exact maximum inner products, longest vectors first.

A rotation by the right singular vectors of all vectors moves most of every
vector's length into its first components. The vectors are cut into bands of
about one size by descending length. The band of the longest goes to all tasks:
every query is scored against it first, which gives it a threshold that its k
best reach at least. A query then goes only to bands whose longest vector could
reach that threshold (|q| * |v|), and within a band a few rotated components
are added at a time, and a vector is dropped as soon as what it has so far plus
|rest of q| * |rest of v| (Cauchy-Schwarz) falls below the query's k-th score.
Only what is left is scored, in integers.

A vector is dealt to one band alone, and a partition is dealt as many bands as any
other. Queries go to a band packed, up to TOGETHER in a row, and pass it by so many
that a block of it makes at most PAIRS pairs with them, so a task holds a band, a
batch of queries and the pairs of a block, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, written

#: Vectors of a band: BAND_ROWS, or more where every core has BANDS_A_CORE bands of that size or more, up to MOST_ROWS and BAND_BYTES of components.
BAND_ROWS, MOST_ROWS, BAND_BYTES, BANDS_A_CORE = 8192, 1 << 16, 32 << 20, 4
#: Vectors of a block, pairs of a block and queries that are worked on at a time, components of pairs that are gathered at a time.
BLOCK, PAIRS, GATHERED = 1024, 1 << 18, 1 << 19
#: Queries of a row; pairs are taken one by one where fewer than one in FEW of a block are left.
TOGETHER, FEW = 2048, 16


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v, norm2): floor(scale * x) of each component, without rows whose id or vector is
    null or holds a null, NaN or infinite component."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda a: F.floor(a.cast("double") * F.lit(float(scale))).cast("long"))
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .withColumnRenamed("x", vector_col)
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
        .select("vec_id", whole.alias("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))
    )


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all vectors, by descending singular value, from their d x d Gram matrix."""

    def gram(batches):
        g = np.zeros((d, d))
        for b in batches:
            m = matrix(b.column("v")).astype(np.float64)
            g += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": np.arange(d * d, dtype=np.int64), "g": g.ravel()})

    cells = vectors.select("v").mapInArrow(gram, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    g = np.zeros(d * d)
    g[cells["i"].to_numpy()] = cells["g"].to_numpy()
    return np.linalg.eigh(g.reshape(d, d))[1][:, ::-1].copy()


def dots(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, of so many pairs at a time that their components take little memory."""
    out, step = np.empty(len(rows), a.dtype), max(1, GATHERED // max(1, a.shape[1]))
    for lo in range(0, len(rows), step):
        out[lo : lo + step] = np.einsum("ij,ij->i", a[rows[lo : lo + step]], b[cols[lo : lo + step]])
    return out


def search(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int, steps: tuple[int, ...], reached: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of each query among v that reach its threshold; v comes by descending length."""
    reached = np.full(len(q), -np.inf) if reached is None else reached
    rq, rv = q @ turn, v @ turn
    d = q.shape[1]
    cuts = sorted({min(s, d) for s in steps} | {d})
    rest_q = [np.sqrt(np.maximum((rq[:, c:] ** 2).sum(1), 0)) for c in [0, *cuts]]
    rest_v = [np.sqrt(np.maximum((rv[:, c:] ** 2).sum(1), 0)) for c in [0, *cuts]]
    best_s = np.full((len(q), k), np.iinfo(np.int64).min)
    best_v = np.full((len(q), k), np.iinfo(np.int64).max)
    # Sums of integers are exact in doubles below 2**53, so the scores of a whole block can be one product of matrices.
    whole = rest_q[0].max(initial=0) * rest_v[0].max(initial=0) < 2**52
    at_once = max(1, PAIRS // BLOCK)
    for begin in range(0, len(q), at_once):
        live = np.arange(begin, min(begin + at_once, len(q)))
        for lo in range(0, len(v), BLOCK):
            hi = min(lo + BLOCK, len(v))
            kth = np.maximum(best_s[live, -1].astype(np.float64), reached[live])
            least = kth - 1e-6 * (1 + rest_q[0][live] * rest_v[0][lo])
            on = rest_q[0][live] * rest_v[0][lo] >= least
            live, least = live[on], least[on]
            if not len(live):
                break
            rows = cols = None  # the pairs that are left, when they are few
            part, done = np.zeros((len(live), hi - lo)), 0
            for step, cut in enumerate(cuts):
                rest, beyond = rest_q[step + 1][live], rest_v[step + 1][lo:hi]
                if rows is None:
                    part += rq[live, done:cut] @ rv[lo:hi, done:cut].T
                    keep = part + rest[:, None] * beyond >= least[:, None]
                    if cut == d or np.count_nonzero(keep) * FEW < keep.size:
                        rows, cols = np.nonzero(keep)
                        part = part[rows, cols]
                else:
                    part += dots(rq[live, done:cut], rv[lo:hi, done:cut], rows, cols)
                    keep = part + rest[rows] * beyond[cols] >= least[rows]
                    rows, cols, part = rows[keep], cols[keep], part[keep]
                done = cut
            if whole and len(rows) * FEW >= len(live) * (hi - lo):
                score = (q[live].astype(np.float64) @ v[lo:hi].T.astype(np.float64))[rows, cols].astype(np.int64)
            else:
                score = dots(q[live], v[lo:hi], rows, cols)
            worst, of = best_s[live[rows], -1], best_v[live[rows], -1]
            good = (qid[live[rows]] != vid[lo + cols]) & (score >= reached[live[rows]]) & ((score > worst) | (score == worst) & (vid[lo + cols] < of))
            rows, cols, score = live[rows[good]], lo + cols[good], score[good]
            if not len(rows):
                continue
            some = np.unique(rows)
            all_r = np.concatenate([rows, np.repeat(some, k)])
            all_s = np.concatenate([score, best_s[some].ravel()])
            all_v = np.concatenate([vid[cols], best_v[some].ravel()])
            order = np.lexsort((all_v, -np.maximum(all_s, np.iinfo(np.int64).min + 1), all_r))
            all_r, all_s, all_v = all_r[order], all_s[order], all_v[order]
            first = np.searchsorted(all_r, some)
            take = first[:, None] + np.arange(k)
            best_s[some], best_v[some] = all_s[take], all_v[take]
    r, c = np.nonzero((best_v != np.iinfo(np.int64).max) & (best_s >= reached[:, None]))
    return r, best_v[r, c], best_s[r, c]


def rows_of_band(n: int, d: int, cores: int) -> int:
    """Few large bands, since every query may go to each of them, but several for each core, and none beyond what a task can hold."""
    most = max(BLOCK, min(MOST_ROWS, BAND_BYTES // (8 * max(1, d))))
    return min(most, max(BAND_ROWS, n // (BANDS_A_CORE * max(1, cores))))


def narrow(m: np.ndarray) -> np.ndarray:
    """Integers in the fewest bytes of 2, 4 and 8 that hold all of them."""
    lo, hi = m.min(initial=0), m.max(initial=0)
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def bands(vectors: DataFrame, n: int, band_rows: int) -> np.ndarray:
    """Lengths squared, descending, at which one band ends and the next starts: a sketch of their distribution.
    Only the sizes of bands rest on it."""
    count = -(-n // band_rows)
    if count < 2:
        return np.zeros(0)
    cuts = vectors.agg(F.percentile_approx("norm2", [i / count for i in range(count - 1, 0, -1)], 10 * count)).first()[0]
    return np.array(cuts, float)


def band_of(norm2: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The band of each vector; those of a length at which several bands meet are dealt to them by their ids."""
    lo, hi = len(cuts) - np.searchsorted(cuts[::-1], norm2, "right"), len(cuts) - np.searchsorted(cuts[::-1], norm2, "left")
    return (lo + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (hi - lo + 1)).astype(np.int32)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, band_rows: int | None = None, steps: tuple[int, ...] = (8, 24)) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with all vectors but its own.

    `vectors` are those of integer_vectors(). Vectors of another length than most have take no part. Ties go to
    the smaller vec_id. Rows that repeat a vec_id are one vector to be found, by the smallest of them, and never
    match a query of that id. No vectors or no queries: no rows.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("s")).select("vec_id", "s.v", "s.norm2"), "topk-vectors")
    head = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not head:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n = head["d"], head["n"]
    vectors = vectors.filter(F.size("v") == d)
    band_rows = band_rows or rows_of_band(n, d, spark.sparkContext.defaultParallelism)
    turn, cuts = rotation(vectors, d), bands(vectors, n, band_rows)

    def dealt(batches):
        for b in batches:
            band = band_of(b.column("norm2").to_numpy(), b.column("vec_id").to_numpy(), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(band), *b.columns], ["band", *b.schema.names])

    items = vectors.select("vec_id", "v", "norm2").mapInArrow(dealt, "band int, vec_id long, v array<bigint>, norm2 double")
    most = {r["band"]: r["most"] for r in items.groupBy("band").agg(F.max("norm2").alias("most")).collect()}  # a row for each band
    present = sorted(most)
    longest = np.sqrt([most[p] for p in present])
    top = vectors.orderBy(F.desc("norm2"), "vec_id").limit(max(k + 1, min(band_rows, 4096))).select("vec_id", "v").toArrow()
    first = spark.sparkContext.broadcast((top["vec_id"].to_numpy(), matrix(top["v"])))

    def asked(batches):
        """Every query once for each band that can hold one of its k best; many in a row, as bytes."""
        vid, v = first.value
        for b in batches:
            if not b.num_rows:
                continue
            qid, q = b.column("vec_id").to_numpy(), matrix(b.column("v"))
            r, _, score = search(qid, q, vid, v, turn, k, steps)
            reached, found = np.full(len(q), -np.inf), np.bincount(r, minlength=len(q))
            full = np.flatnonzero(found == k)
            reached[full] = score[np.cumsum(found)[full] - 1]
            bound, short = np.sqrt(b.column("norm2").to_numpy()) * (1 + 1e-9), narrow(q)
            for place, band in enumerate(present):  # bands are in order of their lengths
                goes = np.flatnonzero(bound * longest[place] >= reached)
                for lo in range(0, len(goes), TOGETHER):
                    some = goes[lo : lo + TOGETHER]
                    yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int32()), "ids": [qid[some].tobytes()], "reached": [reached[some].tobytes()], "q": [short[some].tobytes()]})

    asks = vectors.filter(is_query(F.col("vec_id"))).select("vec_id", "v", "norm2").mapInArrow(asked, "band int, ids binary, reached binary, q binary")

    def meet(batches):
        band, held, vid, v = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            here, asks = b.column("band").to_numpy(), b.column("ids").is_valid().to_numpy(zero_copy_only=False)
            marks = np.flatnonzero((here[1:] != here[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *marks.tolist()], [*marks.tolist(), len(here)]):
                part = b.slice(lo, hi - lo)
                if here[lo] != band:
                    band, held, vid = here[lo], [], None
                if not asks[lo]:
                    held.append(part.select(["vec_id", "v"]))
                    continue
                if vid is None:
                    items_ = pa.Table.from_batches(held) if held else None
                    vid, v = (items_["vec_id"].to_numpy(), matrix(items_["v"])) if held else (np.zeros(0, np.int64), np.zeros((0, d), np.int64))
                    items_, held = None, []
                for ids, reached, q in zip(*(part.column(c).to_pylist() for c in ("ids", "reached", "q"))):
                    qid = np.frombuffer(ids, np.int64)
                    q = np.frombuffer(q, f"i{len(q) // (len(qid) * d)}").reshape(len(qid), d).astype(np.int64)
                    r, found, score = search(qid, q, vid, v, turn, k, steps, np.frombuffer(reached, np.float64))
                    yield pa.RecordBatch.from_pydict({"query_id": qid[r].astype(np.int64), "vec_id": found.astype(np.int64), "score": score.astype(np.int64)})

    short_batches(spark)
    both = items.unionByName(asks, allowMissingColumns=True)
    met = both.repartitionById(len(present), "band").sortWithinPartitions("band", F.col("ids").isNotNull(), F.desc("norm2"), "vec_id")
    found = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_norm_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, lambda i: i % 100 == 0, k=10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
