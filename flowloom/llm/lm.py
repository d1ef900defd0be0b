"""Language-model scoring with deleted interpolation.

The model mixes maximum-likelihood estimates of all orders and a uniform one.
The weights depend on how often the longest context was seen, in octaves, and
come from expectation-maximisation on held-out counts: the tokens of one
tenth of the training documents, each taken out of the counts that predict it.

Counting and looking up are one exchange. Documents are dealt to chunks; each
chunk sends its distinct n-grams, as sorted 64-bit hashes with its own counts, to
the owners of hash ranges; an owner adds up and answers with the totals in the
order of the request, so answers hold no hashes. N-grams that are everywhere
reach their owner once from each chunk. Chunks and ranges are cut by bytes of
text; a text longer than a chunk makes one of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, Rolling, mix, pack_counts, pack_sorted, ragged, released, runs, shuffle_partitions, texts, unpack_counts, unpack_sorted, words, written

END, BEGIN = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
OCTAVES = 40
#: Bytes of text in a chunk, and for each hash range, about.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20


class Chunk:
    """The n-grams of a chunk's documents; `row` holds each token's document, first to last."""

    def __init__(self, texts_column: pa.Array, order: int):
        roll, parts, counts = Rolling(5), [], []
        for _, _, data, offsets in texts(texts_column):
            data = LOWER[data]
            start, end, upto = words(data, offsets, NOT_SPACE)
            n = np.diff(upto)
            tokens = np.full(len(start) + len(n), END, U64)
            tokens[np.arange(len(start)) + np.repeat(np.arange(len(n)), n)] = roll.of_words(data, start, end)
            parts.append(tokens)
            counts.append(n + 1)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = ragged(np.zeros(len(self.sizes), np.int64), self.sizes)
        self.first = place == 0
        #: grams[j - 1]: for each token the hash of it and the j - 1 before it, begins included.
        self.grams = [mix(self.tokens + U64(1))]
        for j in range(1, order):
            back = np.full(len(self.tokens), BEGIN, U64)
            back[j:] = self.tokens[:-j] if j else self.tokens
            back[place < j] = BEGIN
            self.grams.append(mix(self.grams[-1] ^ mix(back + U64(j + 1))))


def requests(batches, order: int, buckets: int):
    shift = U64(64 - buckets.bit_length() + 1)
    for part in runs(batches, "chunk"):
        chunk = Chunk(part["text"], order)
        trains = np.repeat(part["trains"].to_numpy().astype(bool), chunk.sizes)
        for j, gram in enumerate(chunk.grams):
            keys, inverse = np.unique(gram, return_inverse=True)
            counts = np.bincount(inverse[trains], minlength=len(keys)).astype(U64)
            cuts = np.searchsorted(keys, np.arange(1, buckets, dtype=U64) << shift) if buckets > 1 else np.zeros(0, int)
            cuts = [0, *cuts.tolist(), len(keys)]
            rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b * order + j for b, _, _ in rows], pa.int32()), "chunk": pa.array([part["chunk"][0].as_py()] * len(rows), pa.int32()), "n": pa.array([hi - lo for _, lo, hi in rows], pa.int32()),
                "keys": pa.array([pack_sorted(keys[lo:hi] - (U64(b) << shift if buckets > 1 else U64(0))) for b, lo, hi in rows], pa.binary()),
                "counts": pa.array([pack_counts(counts[lo:hi]) for _, lo, hi in rows], pa.binary()),
            })


def answers(batches):
    """Totals for each request, and for each bucket its distinct and summed training counts."""
    for part in runs(batches, "bucket"):
        n = part["n"].to_pylist()
        keys = np.concatenate([unpack_sorted(k.as_py()) for k in part["keys"]])
        counts = np.concatenate([unpack_counts(c.as_py(), k) for c, k in zip(part["counts"], n)])
        distinct, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=counts.astype(float), minlength=len(distinct)).astype(U64)
        ends = np.cumsum([0, *n])
        yield pa.RecordBatch.from_pydict({
            "chunk": part["chunk"].combine_chunks(), "bucket": part["bucket"].combine_chunks(), "n": part["n"].combine_chunks(),
            "totals": pa.array([pack_counts(totals[inverse[lo:hi]]) for lo, hi in zip(ends, ends[1:])], pa.binary()),
            "seen": pa.array([int((totals > 0).sum())] + [0] * (len(n) - 1), pa.int64()), "tokens": pa.array([int(totals.sum())] + [0] * (len(n) - 1), pa.int64()),
        })


class Model:
    """Training counts behind a chunk's tokens; `weights` by octave of the longest context's count."""

    def __init__(self, order: int, tokens: int, seen: int, texts_seen: int, weights: np.ndarray | None = None):
        self.order, self.tokens, self.seen, self.texts_seen, self.weights = order, tokens, seen, texts_seen, weights

    def counts(self, chunk: Chunk, replies: pa.Table) -> list[np.ndarray]:
        """For each order the training count of every token's n-gram."""
        out = []
        order = np.argsort(replies["bucket"].to_numpy(), kind="stable")
        rows = [(replies["bucket"][i].as_py(), replies["n"][i].as_py(), replies["totals"][i].as_py()) for i in order.tolist()]
        for j, gram in enumerate(chunk.grams):
            inverse = np.unique(gram, return_inverse=True)[1]
            own = [unpack_counts(t, n) for b, n, t in rows if b % self.order == j]
            out.append((np.concatenate(own) if own else np.zeros(0, U64))[inverse].astype(np.float64))
        return out

    def estimates(self, chunk: Chunk, counts: list[np.ndarray], less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, token by order from uniform up; octave of the longest context's count), each
        token taken out of the counts `less` times."""
        p = np.zeros((len(chunk.tokens), self.order + 1))
        p[:, 0] = 1 / (self.seen + 1)
        p[:, 1] = np.maximum(counts[0] - less, 0) / max(1, self.tokens - less)
        context = np.full(len(chunk.tokens), float(self.tokens))
        for j in range(2, self.order + 1):
            # A context is counted as often as it is followed by something: as an n-gram that doesn't end its text.
            context = np.empty(len(chunk.tokens))
            context[1:] = counts[j - 2][:-1]
            context[chunk.first] = self.texts_seen
            p[:, j] = np.where(context - less > 0, np.maximum(counts[j - 1] - less, 0) / np.maximum(context - less, 1), 0)
        octave = np.minimum(np.floor(np.log2(np.maximum(context - less, 0) + 1)), OCTAVES - 1).astype(np.int64)
        return p, octave


def learned(stats: DataFrame, order: int, rounds: int = 30, tolerance: float = 1e-4) -> np.ndarray:
    """Weights of the uniform estimate and each order by octave, by expectation-maximisation over stats
    (octave, p0 .. p_order, n). An octave without tokens has those of all octaves together."""
    names = [f"p{j}" for j in range(order + 1)]
    weights = np.full((OCTAVES + 1, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        at = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:OCTAVES, j]]), F.col("octave") + 1) for j in range(order + 1)]
        mixed = sum((a * F.col(p) for a, p in zip(at[1:], names[1:])), at[0] * F.col(names[0]))
        got = stats.select("octave", *[(F.col("n") * a * F.col(p) / mixed).alias(p) for a, p in zip(at, names)]).groupBy("octave").agg(*[F.sum(p).alias(p) for p in names]).collect()
        new = weights.copy()
        for r in got:
            part = np.array([r[p] for p in names])
            if part.sum() > 0:
                new[r["octave"]] = part / part.sum()
        if got:
            pooled = np.sum([[r[p] for p in names] for r in got], axis=0)
            absent = sorted(set(range(OCTAVES)) - {r["octave"] for r in got})
            new[absent] = pooled / pooled.sum()
        moved = np.abs(new - weights).max()
        weights = new
        if moved < tolerance:
            break
    # Some weight on the uniform estimate keeps every text's probability above zero.
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)
    return weights / weights.sum(1, keepdims=True)


def scored(documents: DataFrame, order: int = 2, add: float = 0.1, held_out: Column | None = None, tenth: Column | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document row.

    Tokens are lower-cased words and one end for each text. Training takes all documents but the
    held-out ones, by default those whose crc32(doc_id as text) mod 10 is 0; the mixture weights come from
    those where it is 1. base_score adds up log10((c + add) / (N + add * (V + 1))), score the log10
    probabilities of the interpolated model. Null and empty texts are an end alone; a null doc_id is
    held out. Rows that repeat a doc_id count as often as they stand. An empty table gives no rows;
    without training documents only the uniform estimate is left.
    """
    spark = documents.sparkSession
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10, F.lit(0))
    held_out = fold == 0 if held_out is None else held_out
    tenth = fold == 1 if tenth is None else tenth
    size = documents.agg(F.coalesce(F.sum(F.octet_length(text_col) + 16), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    few = max(1, -(-chunks // 9))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    id_type = documents.schema[id_col].dataType.simpleString()
    dealt = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (~held_out).alias("trains"),
        F.when(tenth, F.lit(chunks) + F.pmod(key, F.lit(few))).otherwise(F.pmod(key, F.lit(chunks))).cast("int").alias("chunk"),
    )
    width = max(shuffle_partitions(spark), -(-size // (4 * bucket_bytes)))
    # An owner holds one hash range of one order at a time, and all requests for it: those of bucket_bytes of text. A
    # chunk sends each owner one row, or one for each n-gram where that is less.
    buckets = 1 << max(0, (max(width, -(-size // bucket_bytes)) - 1).bit_length())
    by_chunk = lambda df: df.repartition(width, "chunk").sortWithinPartitions("chunk")
    asked = by_chunk(dealt).mapInArrow(lambda batches: requests(batches, order, buckets), "bucket int, chunk int, n int, keys binary, counts binary")
    told = written(asked.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(answers, "chunk int, bucket int, n int, totals binary, seen long, tokens long"), "lm-counts")
    sums = told.filter(F.col("bucket") % order == 0).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen")).first()
    texts_seen = dealt.filter("trains").count()
    asked = None
    released(spark)
    model = Model(order, sums["tokens"], sums["seen"], texts_seen)

    # The distinct n-grams of a chunk, in order of their hashes, do not depend on the order of its texts.
    def meeting(of: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
        both = of.withColumns({"bucket": F.lit(-1), "n": F.lit(0), "totals": F.lit(None).cast("binary")}).unionByName(
            replies.select(F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("trains"), "chunk", "bucket", "n", "totals")
        )

        def run(batches):
            for part in runs(batches, "chunk"):
                is_text = np.asarray(part["bucket"].to_numpy() < 0)
                yield from work(part.filter(pa.array(is_text)), part.filter(pa.array(~is_text)))

        return both.repartition(width, "chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)

    def deleted(rows_: pa.Table, replies: pa.Table):
        chunk = Chunk(rows_["text"], order)
        p, octave = model.estimates(chunk, model.counts(chunk, replies), less=1)
        distinct, n = np.unique(np.column_stack([octave, p]), axis=0, return_counts=True)
        yield pa.RecordBatch.from_pydict({"octave": pa.array(distinct[:, 0].astype(np.int32)), **{f"p{j}": distinct[:, j + 1] for j in range(order + 1)}, "n": n.astype(np.float64)})

    stats = written(meeting(dealt.filter(F.col("chunk") >= chunks), told.filter(F.col("chunk") >= chunks), deleted, "octave int, " + "".join(f"p{j} double, " for j in range(order + 1)) + "n double"), "lm-held-out")
    model.weights = learned(stats, order)
    model.add = add

    def score(rows_: pa.Table, replies: pa.Table):
        chunk = Chunk(rows_["text"], order)
        counts = model.counts(chunk, replies)
        p, octave = model.estimates(chunk, counts)
        base = np.log10((counts[0] + model.add) / (model.tokens + model.add * (model.seen + 1)))
        full = np.log10((p * model.weights[octave]).sum(1))
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        total = lambda x: np.array([math.fsum(x[a : a + n]) for a, n in zip(starts, chunk.sizes)])
        yield pa.RecordBatch.from_arrays([
            rows_["doc_id"].combine_chunks(), pa.array(~rows_["trains"].to_numpy().astype(bool)), pa.array(chunk.sizes.astype(np.int64)), pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts) if len(starts) else starts),
            pa.array(np.full(len(starts), model.tokens, np.int64)), pa.array(total(base)), pa.array(total(full)),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = meeting(dealt, told.select("chunk", "bucket", "n", "totals"), score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)


def op8_lm(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=2)
