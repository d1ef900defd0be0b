"""SimHash near duplicates by generalised pigeonhole.

The 64 bits are dealt to parts, correlated bits together, so that what differs
between two fingerprints is spread over parts as unevenly as can be. Two
fingerprints within `radius` bits differ by at most t_i bits in some part i
whenever the t_i sum to radius - parts + 1; a t_i of -1 leaves part i out. The
t_i are chosen by dynamic programming on candidate counts that are estimated
from the values of each part. Every fingerprint is then probed under its part
values and, where t_i > 0, all values within t_i bits, and pairs that meet are
verified on all 64 bits.

Documents with one fingerprint are one row from the start. Values that gather
more than `hot` fingerprints are not paired: there each fingerprint is dealt to
the values of its other bits with any one of them flipped, where two
fingerprints within two bits always meet, and links run through those. So work
on a group stays in proportion to its size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, unused, written
from .components import components

TABLE = bytes(LOWER)
STEP = 1 << 15


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The majority of the bits of XXH64 over all shingles of `size` words, repeats included.

    Fewer words make one shingle of them all; none: zero.
    """
    cut = text.translate(TABLE).split()
    if not cut:
        return 0
    joined = b" ".join(cut)
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(cut) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(cut)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, STEP):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[lo : lo + STEP], last[lo : lo + STEP])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(documents: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number. Null and empty texts have zero."""

    def scan(batches):
        for batch in batches:
            column = batch.column(1)
            fp = np.array([fingerprint((s.as_py() or "").encode(), size, seed) for s in column], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"doc_id {documents.schema[id_col].dataType.simpleString()}, fp long")


def correlated_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal width: each part starts with a free bit and takes those most
    correlated with what it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    spread = bits.std(0) > 0
    about = np.zeros((64, 64))
    if spread.sum() > 1:
        about[np.ix_(spread, spread)] = np.abs(np.corrcoef(bits[:, spread].T))
    free, out = list(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, out))) // (parts - k)
        own = [free.pop(0)]
        while len(own) < width:
            own.append(free.pop(max(range(len(free)), key=lambda i: (about[free[i], own].sum(), -free[i]))))
        out.append(sorted(own))
    return out


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def allocate(sample: np.ndarray, total: int, parts: list[list[int]], radius: int) -> tuple[list[int], float]:
    """(thresholds of 2 at most, estimated probes and candidates) with the least cost, their sum being radius - parts + 1."""
    costs = []
    for bits in parts:
        value = part_value(sample, bits)
        scale = (total / max(1, len(sample))) ** 2
        own, counts = np.unique(value, return_counts=True)
        row = [0.0]
        width = len(bits)
        for t in range(min(radius, 2) + 1):
            probes = float(sum(len(list(combinations(range(width), k))) for k in range(t + 1)))
            if t == 0:
                met = float((counts.astype(float) ** 2).sum() - len(sample)) / 2
            else:  # values within t bits, counted at the sample's own values
                apart = np.zeros(0)
                some = own[:: max(1, len(own) // 512)]
                apart = np.array([counts[np.bitwise_count(own ^ x) <= t].sum() for x in some], float)
                met = float((apart * counts[np.searchsorted(own, some)]).sum() * len(own) / max(1, len(some))) / 2
            row.append(total * probes + met * scale)
        costs.append(row)
    wanted = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, min(radius, 2) + 1):
                new = (cost + row[t + 1], [*chosen, t])
                if spent + t not in step or new < step[spent + t]:
                    step[spent + t] = new
        best = step
    cost, chosen = best.get(wanted, (float("inf"), []))
    return chosen, cost


def plan_probes(fps: DataFrame, radius: int, sample_rows: int = 20_000) -> tuple[list[list[int]], list[int]]:
    """The cheapest dealing for 2 to radius + 1 parts, on a sample of fingerprints by their hash.

    Only costs rest on the sample; any dealing finds the same pairs.
    """
    total = fps.count()
    rate = min(1.0, sample_rows / max(1, total))
    rows = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).limit(2 * sample_rows).toArrow()
    sample = np.sort(rows["fp"].to_numpy()).view(np.uint64) if len(rows) else np.zeros(1, np.uint64)
    options = []
    for m in range(2, radius + 2):
        parts = correlated_parts(sample, m)
        chosen, cost = allocate(sample, total, parts, radius)
        options.append((cost, parts, chosen))
    return min(options, key=lambda o: o[0])[1:] if options else ([list(range(64))], [0])


def probes(fps: DataFrame, parts: list[list[int]], allowed: list[int]) -> DataFrame:
    """(part, value, fp, own): a row for every value within the part's threshold; `own` marks the value itself."""

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for p, (bits, t) in enumerate(zip(parts, allowed)):
                if t < 0:
                    continue
                value = part_value(fp, bits)
                for k in range(t + 1):
                    for flip in combinations(range(len(bits)), k):
                        mask = np.uint64(sum(1 << f for f in flip))
                        n = len(fp)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array((value ^ mask).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(n, k == 0))], ["part", "value", "fp", "own"])

    return fps.mapInArrow(deal, "part int, value long, fp long, own boolean")


def links(fps: DataFrame, radius: int = 2, hot: int = 64, work: str = "") -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints within `radius` (an even number) bits.

    Values with more than `hot` fingerprints take the way round described above; `hot` changes the
    work, never the components. Names of written tables start with `work`.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    parts, allowed = plan_probes(fps, radius)
    dealt = written(probes(fps, parts, allowed), f"{work}simhash-probes")
    sizes = dealt.groupBy("part", "value").agg(F.count("*").alias("n"), F.bool_or("own").alias("owned")).filter("n > 1 AND owned")
    busy = written(dealt.join(sizes, ["part", "value"]), f"{work}simhash-busy")
    left = busy.filter(F.col("n") <= hot).select("part", "value", F.col("fp").alias("a"))
    right = busy.filter((F.col("n") <= hot) & F.col("own")).select("part", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["part", "value"]).filter((F.col("a") != F.col("b")) & near).select("a", "b")
    crowd = busy.filter(F.col("n") > hot).select("fp").distinct()
    # At most 64 ** (radius / 2) fingerprints stand around one value, so no group here is large.
    around = crowd.mapInArrow(lambda batches: _around(batches, radius // 2), "value long, fp long")
    met = around.groupBy("value").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return pairs.unionByName(met.select("a", F.explode("all").alias("b")).filter("a <> b")).distinct()


def _around(batches, radius: int):
    """(value, fp) for every value within `radius` bits of every fingerprint."""
    flips = [np.uint64(sum(1 << f for f in flip)) for k in range(radius + 1) for flip in combinations(range(64), k)]
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for mask in flips:
            yield pa.RecordBatch.from_arrays([pa.array((fp ^ mask).view(np.int64)), pa.array(fp.view(np.int64))], ["value", "fp"])


def classes(documents: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over
    fingerprints within `radius` bits, the row's own included.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id stay.
    A null doc_id is never a component's name while it holds another; an empty table gives no rows.
    """
    rows = written(fingerprints(documents, size, id_col=id_col, text_col=text_col), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    found = components(links(fps.select("fp"), radius))
    named = fps.join(found, fps.fp == found.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of, rows.fp == F.col("_fp"), "left").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def one_of_each(documents: DataFrame, size: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id stays, whole.

    Of rows that repeat that id one stays. Rows with a null id stay only where no row of their component
    has an id.
    """
    key, place = unused(documents, "kept"), unused(documents, "nth")
    kept = classes(documents, size, radius, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(key))
    rows = documents.join(kept, documents[id_col].eqNullSafe(F.col(key)), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(*documents.columns)))
    return rows.withColumn(place, nth).filter(F.col(place) == 1).drop(place)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def by_brute_force(documents: list[tuple[int, str | None]], size: int = 3, radius: int = 2) -> list[tuple[int, str, int]]:
    """The same rows in plain Python over all pairs, for tests."""
    import re

    out = []
    for doc, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append((doc, sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    root = list(range(len(out)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(out)), 2):
        if (out[i][1] ^ out[j][1]).bit_count() <= radius:
            root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(out):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, f"{fp:016x}", least[top(i)]) for i, (doc, fp) in enumerate(out)]
