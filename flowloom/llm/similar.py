"""Near duplicates of a wanted similarity, by fingerprints first and prefix filtering of shingles for the rest.

Documents are sets of shingles. SimHash fingerprints meet by generalised
pigeonhole, as in `simhash`; what meets is verified on the whole sets, since a
line that is repeated often makes fingerprints of unlike documents equal.
Fingerprints of two sets that share the similarity may lie far apart, so sets
that they leave unconnected go on to prefix filtering. All shingles have one order, common ones last;
two sets that share the similarity share one of their first few in it, so sets
meet at those. How common a shingle is comes from a sample, then from counts of
all first shingles: it settles the work, never what is found. Pairs that meet are verified on the whole sets.

Shingles at which more than `hot` sets meet are taken in steps. First each set
is paired with the first of about its size. Next, wherever sets of several
components still meet, each is paired with the `NEAR` sets after it in a random
order that is the same at all shingles, and so once more in another order. A
group of near copies hangs together after that, even where only a share of its
pairs has the similarity. Last, all pairs of sets that are still not connected
are compared. So work on a group of near copies stays in proportion to its
size, and no connection is lost. A map of parities for each set, a bit for each
shingle or so, tells of most pairs that they differ too much before whole sets
travel: two maps never differ in more places than the sets do.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, NOT_SPACE, U64, Rolling, mix, released, removed, short_batches, shuffle_partitions, texts, unused, words, written
from .components import components

#: Shingles at which more sets meet are taken in steps, the last in shares of about so many sets.
HOT, SHARE = 16, 1024
#: Sets that follow in a random order and are compared in the middle steps.
NEAR = 8
#: Parities of a set's map at least; larger sets have the next power of two from their size.
PARITIES = 1024
#: Bits of the map that says which sets may be needed, for a broadcast of a few MB.
NEEDED_BITS = 1 << 24
#: Ids up to which what goes is broadcast; beyond it documents are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Cells that tell how common shingles are.
CELLS = 1 << 22
#: Sets that are sampled for that at least, and one of how many is at least.
SAMPLED, ONE_OF = 8192, 64
#: Times that the first shingles are counted after that.
COUNTED = 2


def shingles(documents: DataFrame, size: int) -> DataFrame:
    """(doc, set, n, grams, parity, fp): the distinct shingles of `size` words as sorted hashes, a hash of them all, their
    number, the map of how many are odd in each cell and the text's fingerprint; fewer words make one, none none. Of equal
    sets of one task only the first has its grams, map and fingerprint."""
    roll = Rolling(13)

    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in texts(batch.column(1)):
                data = LOWER[data]
                start, end, upto = words(data, offsets, NOT_SPACE)
                word = roll.of_words(data, start, end)
                grams = np.zeros(len(word), U64)
                for i in range(size):
                    left = max(0, len(word) - i)
                    grams[:left] = mix(grams[:left] * U64(31) + word[i:])
                sets = []
                for a, b in zip(upto, upto[1:]):
                    if 0 < b - a < size:  # the words alone, not those of the next row
                        one = np.zeros(1, U64)
                        for w in word[a:b]:
                            one = mix(one * U64(31) + w)
                        sets.append(one)
                    else:
                        sets.append(np.unique(grams[a : b - size + 1]) if b > a else grams[:0])
                blobs = [np.unique(x >> U64(32)).astype("<u4") for x in sets]
                keys = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets], np.int64)
                own, maps, fps = [], [], []
                for key, x, a, b in zip(keys.tolist(), blobs, offsets.tolist(), offsets[1:].tolist()):
                    own.append(None if key in seen else x.tobytes())
                    maps.append(None if key in seen else parities(x))
                    fps.append(None if key in seen else simhash.signed(simhash.fingerprint(data[a:b].tobytes(), size)))
                    seen.add(key)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(keys), pa.array([len(x) for x in blobs], pa.int32()), pa.array(own, pa.binary()), pa.array(maps, pa.binary()), pa.array(fps, pa.int64())], ["doc", "set", "n", "grams", "parity", "fp"])

    return documents.mapInArrow(cut, f"doc {documents.schema[0].dataType.simpleString()}, set long, n int, grams binary, parity binary, fp long")


def parities(grams: np.ndarray) -> bytes:
    width = max(PARITIES, 1 << (len(grams) - 1).bit_length()) if len(grams) else PARITIES
    return np.packbits(np.bincount(grams & (width - 1), minlength=width) & 1).tobytes()


def commonness(sets: DataFrame, total: int) -> np.ndarray:
    """By the low bits of a shingle: the logarithm of the sampled sets that have it, zero for one or none."""
    one_of = min(ONE_OF, max(1, total // SAMPLED))

    def cut(batches):
        for batch in batches:
            gram, n = np.unique(np.frombuffer(b"".join(x.as_py() for x in batch.column("grams")), "<i4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    some = sets.filter((F.pmod("set", F.lit(one_of)) == 0) & F.col("grams").isNotNull())
    return raised(np.zeros(CELLS, np.uint8), some.select("grams").mapInArrow(cut, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"))


def raised(common: np.ndarray, seen: DataFrame) -> np.ndarray:
    """The same table, where shingles of seen (gram, n) are at least as common as their n says."""
    cells = seen.groupBy(F.pmod("gram", F.lit(CELLS)).alias("cell")).agg(F.ceil(F.log2(F.max("n")) * 2).cast("int").alias("level")).toArrow()  # CELLS rows at most
    out, at = common.copy(), cells["cell"].to_numpy()
    out[at] = np.maximum(out[at], cells["level"].to_numpy())
    return out


def sharpened(sets: DataFrame, common: np.ndarray, similarity: float, hot: int = HOT) -> np.ndarray:
    """The same table, after all first shingles of all sets have been counted: those of over half of `hot` go last as well.

    A sample of one set in many shows only what many times `hot` sets have, so what it leaves unseen would be crowded, and more of
    it the larger the input. What comes first instead is counted once more. A set that several tasks have sent counts for each.
    """
    for _ in range(COUNTED):
        common = raised(common, prefixes(sets, common, similarity).groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > hot // 2))
    return common


def prefixes(sets: DataFrame, common: np.ndarray, similarity: float) -> DataFrame:
    """(gram, set, n, at): the first shingles of each set; of sets that share the similarity one is the same."""

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, found = batch.column("n").to_numpy(), []
            for blob, n in zip(batch.column("grams"), sizes.tolist()):
                grams = np.frombuffer(blob.as_buffer(), "<u4")
                key = np.sort((common[grams & (CELLS - 1)].astype(U64) << U64(32)) | grams.astype(U64))
                found.append(key[: n - int(np.ceil(similarity * n - 1e-9)) + 1])
            each = np.array([len(x) for x in found])
            gram = (np.concatenate(found) & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            at = np.arange(len(gram)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.repeat(batch.column("set").to_numpy(), each)), pa.array(np.repeat(sizes, each)), pa.array(at.astype(np.int32))], ["gram", "set", "n", "at"])

    return sets.filter("n > 0 AND grams IS NOT NULL").select("set", "n", "grams").mapInArrow(cut, "gram int, set long, n int, at int")


def together(batches, key: str):
    """Columns of rows that are sorted by key, in runs of rows that end where a key ends."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        keys = rows[key]
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and held[-1][key][-1] != keys[0]:
            yield {c: np.concatenate([h[c] for h in held]) for c in rows}
            held = []
        if cut:
            held.append({c: x[:cut] for c, x in rows.items()})
            yield {c: np.concatenate([h[c] for h in held]) for c in rows}
            held = []
        held.append({c: x[cut:] for c, x in rows.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def may_share(n_a, at_a, n_b, at_b, similarity: float):
    """Whether sets whose first common shingle is at these places can share the similarity."""
    least = np.ceil(similarity / (1 + similarity) * (n_a.astype(np.int64) + n_b) - 1e-9)
    return np.minimum(n_a - at_a, n_b - at_b) >= least


def too_far(n_a: np.ndarray, maps_a: np.ndarray, n_b: np.ndarray, maps_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the maps differ in more places than sets of these sizes and the similarity can. Of maps of unlike
    lengths the longer is folded, which keeps its parities."""
    most = (n_a.astype(np.int64) + n_b) * (1 - similarity) / (1 + similarity) + 1e-9
    sizes = [np.fromiter(map(len, m), np.int64, len(m)) for m in (maps_a, maps_b)]
    kinds, which = np.unique(np.stack(sizes, 1), axis=0, return_inverse=True)
    out = np.zeros(len(most), bool)
    for k, pair in enumerate(kinds.tolist()):
        at = np.flatnonzero(which.ravel() == k)
        both = []
        for maps, width in zip((maps_a, maps_b), pair):
            bits = np.frombuffer(b"".join(maps[at]), U64).reshape(len(at), -1)
            while width > min(pair):
                width //= 2
                bits = bits[:, : width // 8] ^ bits[:, width // 8 :]
            both.append(bits)
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64) > most[at]
    return out


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def runs_of(batches, columns: tuple[str, ...]):
    """Arrays of each batch, and None at the end."""
    for batch in batches:
        if batch.num_rows:
            yield {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
    yield None


MET = "a long, b long, gram int, set long, n int, at int"


def meet(batches, similarity: float, hot: int):
    """From rows sorted by gram, n and set: pairs (a, b) of all sets that meet at a gram with at most `hot`, and of
    others each with the first of about its size; and the rows of those others.

    No more than a batch and `hot` rows are held, however many sets meet.
    """
    columns = ("gram", "set", "n", "at")
    held, lead, last = None, None, None  # rows of an unfinished gram; (gram, set, n) of a crowd's leader; its last row
    for rows in runs_of(batches, columns):
        ends = rows is None
        if held is not None:
            rows = held if ends else {c: np.concatenate([held[c], rows[c]]) for c in columns}
            held = None
        if rows is None:
            break
        # A set that several tasks have sent stands there several times.
        same = np.zeros(len(rows["gram"]), bool)
        same[1:] = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["set"][1:] == rows["set"][:-1])
        same[0] = (rows["gram"][0], rows["set"][0]) == last
        rows = {c: x[~same] for c, x in rows.items()}
        gram, key, n, at = (rows[c] for c in columns)
        if not len(gram):
            continue
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(start, len(gram)))
        crowded = size > hot
        if lead is not None:
            crowded[0] |= gram[0] == lead[0]
        if not ends and not crowded[-1]:
            held = {c: x[start[-1] :] for c, x in rows.items()}
            start, size, crowded = start[:-1], size[:-1], crowded[:-1]
        stop = np.repeat(start + size, size)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = np.flatnonzero(np.repeat(~crowded, size))
        for step in range(1, hot):
            here = here[here + step < stop[here]]
            if not len(here):
                break
            there = here + step
            met = may_share(n[here], at[here], n[there], at[there], similarity)
            out_a.append(key[here[met]])
            out_b.append(key[there[met]])
        for lo, count in zip(start[crowded].tolist(), size[crowded].tolist()):
            hi = lo + count
            if lead is None or lead[0] != gram[lo]:
                lead = (gram[lo], key[lo], n[lo])
                lo += 1
            while lo < hi:  # rows are ordered by n
                end = lo + int(np.searchsorted(n[lo:hi], lead[2] / similarity + 1e-9, "right"))
                out_a.append(np.full(end - lo, lead[1]))
                out_b.append(key[lo:end])
                if end < hi:
                    lead = (gram[end], key[end], n[end])
                    end += 1
                lo = end
        last = (gram[-1], key[-1]) if held is None else None
        found, crowd = pair_batch(np.concatenate(out_a), np.concatenate(out_b)), np.repeat(crowded, size)
        crowd = np.flatnonzero(crowd)
        blank = lambda m, kind: pa.nulls(m, kind)
        m, k = found.num_rows, len(crowd)
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([found.column("a"), blank(k, pa.int64())]), pa.concat_arrays([found.column("b"), blank(k, pa.int64())]),
            *(pa.concat_arrays([blank(m, kind), pa.array(rows[c][crowd], kind)]) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))),
        ], ["a", "b", *columns])


def candidates(firsts: DataFrame, similarity: float, hot: int = HOT, *, work: str = "") -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs to verify; and the rows of crowded shingles (see meet)."""
    dealt = firsts.repartition(shuffle_partitions(firsts.sparkSession), "gram").sortWithinPartitions("gram", "n", "set")
    met = written(dealt.mapInArrow(lambda batches: meet(batches, similarity, hot), MET), f"{work}met")
    return met.filter("a IS NOT NULL").select("a", "b").distinct(), met.filter("a IS NULL").select("gram", "set", "n", "at")


def mixed(crowds: DataFrame, found: DataFrame, rows: DataFrame, work: str = "") -> DataFrame:
    """Rows of the crowds with their sets' components and maps, of shingles at which several components meet, written;
    `own` marks sets outside of the largest of them, `most` counts those."""
    crowd = crowds.join(found, crowds.set == found.id, "left").select("gram", "set", "n", "at", F.coalesce("component", "set").alias("component"))
    counts = crowd.groupBy("gram", "component").agg(F.count("*").alias("sets"))
    largest = counts.groupBy("gram").agg(F.max(F.struct("sets", "component")).alias("top"), F.sum("sets").alias("all")).filter("all > top.sets")
    most = largest.select("gram", F.col("top.component").alias("top"), (F.col("all") - F.col("top.sets")).alias("most"))
    some = crowd.join(most, "gram").select("gram", "set", "n", "at", "component", "most", (F.col("component") != F.col("top")).alias("own"))
    return written(some.join(picked(rows, crowds.select("set"), "parity"), "set"), f"{work}mixed")


def nearby(mixed_: DataFrame, similarity: float, salt: int) -> DataFrame:
    """(a, b): sets of different components that stand within NEAR places of each other in a random order of those
    that meet at a shingle."""
    columns = ("gram", "set", "n", "at", "component", "parity")

    def pairs(batches):
        held = None
        for rows in runs_of(batches, columns):
            if rows is None:
                return
            rows = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in columns}
            old = 0 if held is None else len(held["gram"])
            gram, key, n, at, of, maps = (rows[c] for c in columns)
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, min(NEAR, len(gram) - 1) + 1):
                there = np.arange(max(step, old), len(gram))
                here = there - step
                met = (gram[here] == gram[there]) & (of[here] != of[there])
                here, there = here[met], there[met]
                met = may_share(n[here], at[here], n[there], at[there], similarity)
                here, there = here[met], there[met]
                met = ~too_far(n[here], maps[here], n[there], maps[there], similarity)
                out_a.append(key[here[met]])
                out_b.append(key[there[met]])
            held = {c: x[-NEAR:] for c, x in rows.items()}
            yield pair_batch(np.concatenate(out_a), np.concatenate(out_b))

    order = F.xxhash64("set", F.lit(salt))
    dealt = mixed_.select(*columns, order.alias("order")).repartition(shuffle_partitions(mixed_.sparkSession), "gram").sortWithinPartitions("gram", "order", "set")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def unconnected(mixed_: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all sets of different components that meet in the crowds. One of each such pair is outside of the
    largest component, so those are shared out and meet all."""
    shares = F.ceil(F.col("most") / SHARE).cast("int")
    units = mixed_.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    mine = F.col("own") & (F.pmod(F.xxhash64("set"), shares) == F.col("share"))
    units = units.select(F.xxhash64("gram", "share").alias("unit"), "gram", "set", "n", "at", "component", "parity", mine.alias("own"))

    def pairs(batches):
        for rows in together(batches, "unit"):
            unit, gram, key, n, at, of, own = (rows[c] for c in ("unit", "gram", "set", "n", "at", "component", "own"))
            own, maps = own.astype(bool), rows["parity"]
            cuts = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (gram[1:] != gram[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(unit))):
                for i in lo + np.flatnonzero(own[lo:hi]):
                    first, last = lo + np.searchsorted(n[lo:hi], [n[i] * similarity - 1e-9, n[i] / similarity + 1e-9])
                    there = slice(first, last)
                    there = first + np.flatnonzero((of[there] != of[i]) & may_share(n[i], at[i], n[there], at[there], similarity))
                    if len(there):
                        here = np.full(len(there), i)
                        others = key[there[~too_far(n[here], maps[here], n[there], maps[there], similarity)]]
                        if len(others):
                            yield pair_batch(np.full(len(others), key[i]), others)

    dealt = units.repartition(shuffle_partitions(mixed_.sparkSession), "unit").sortWithinPartitions("unit", "gram", "n", "set")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def picked(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """(set, columns) of the sets in ids (its only column) and a few others, once each. A map of NEEDED_BITS bits keeps
    most others from being shuffled."""
    word = lambda c: F.pmod(F.shiftrightunsigned(c, 6), F.lit(NEEDED_BITS >> 6)).alias("word")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
    c = F.col(ids.columns[0])
    bits = ids.select(word(c), bit(c).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # NEEDED_BITS / 64 rows at most
    some = rows.filter("grams IS NOT NULL").select("set", *columns, word(F.col("set"))).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit(F.col("set"))) != 0)
    return some.groupBy("set").agg(*[F.first(x).alias(x) for x in columns])


def with_both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both sets, as <column>_a and <column>_b. The sets of both sides are picked, and
    shuffled, once."""
    own = picked(rows, pairs.select(F.explode(F.array("a", "b")).alias("set")), *columns)
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("set").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def plausible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose maps don't differ too much for the similarity."""

    def check(batches):
        for batch in batches:
            n_a, n_b = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            map_a, map_b = (batch.column(f"parity_{x}").to_numpy(zero_copy_only=False) for x in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(~too_far(n_a, map_a, n_b, map_b, similarity))) if batch.num_rows else batch.select(["a", "b"])

    return with_both(pairs, rows, "n", "parity").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs of sets that share at least the similarity."""

    def verify(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    joined = with_both(pairs, rows, "grams").select("a", "b", "grams_a", "grams_b")
    return joined.mapInArrow(verify, "a long, b long, similarity double").filter(F.col("similarity") >= similarity)


def by_fingerprints(rows: DataFrame, radius: int = 2, work: str = "") -> DataFrame:
    """(a, b): sets to verify, brought together by fingerprints: the first set of each fingerprint with its others, and
    with the first sets of fingerprints within `radius` bits."""
    own = written(rows.filter("fp IS NOT NULL AND n > 0").select("fp", "set").distinct(), f"{work}fps")
    firsts = written(own.groupBy("fp").agg(F.min("set").alias("first")), f"{work}fps")
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"set_{c}"))
    near = simhash.links(firsts.select("fp"), radius, work=work).join(of("a"), "a").join(of("b"), "b").select("set_a", "set_b")
    pairs = near.unionByName(own.join(firsts, "fp").select(F.col("first").alias("set_a"), F.col("set").alias("set_b")))
    return pairs.filter("set_a <> set_b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that the components (id, component) don't connect."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return pairs.filter(~F.coalesce("of_a", "a").eqNullSafe(F.coalesce("of_b", "b"))).select("a", "b")


def set_links(rows: DataFrame, similarity: float, work: str = "") -> DataFrame:
    """(a, b, similarity): links that connect exactly the sets (set, n, grams, parity, fp) that share at least the similarity.

    The driver lets go of each step's plans, broadcasts and task records before the next, so its memory doesn't grow with
    the number of steps.
    """
    spark = rows.sparkSession

    def step(df: DataFrame, name: str) -> DataFrame:
        out = written(df, f"{work}{name}")
        released(spark)
        return out

    def checked(pairs: DataFrame) -> DataFrame:
        return step(verified(step(plausible(pairs, rows, similarity), "pairs"), rows, similarity), "links")

    found = checked(step(by_fingerprints(rows, work=work), "pairs"))
    near = components(found, work)
    released(spark)
    common = sharpened(rows, commonness(rows, rows.filter("grams IS NOT NULL").count()), similarity)
    released(spark)
    pairs, crowds = candidates(prefixes(rows, common, similarity), similarity, work=work)
    common, pairs = None, step(apart(pairs, near), "met-pairs")
    found = found.unionByName(checked(pairs))
    if crowds.isEmpty():
        return found
    for salt in (1, 2):
        pairs = step(nearby(mixed(crowds, components(found, work), rows, work), similarity, salt), "pairs")
        found = found.unionByName(step(verified(pairs, rows, similarity), "links"))
    pairs = step(unconnected(mixed(crowds, components(found, work), rows, work), similarity), "pairs")
    return found.unionByName(step(verified(pairs, rows, similarity), "links"))


def shingled(documents: DataFrame, size: int, id_col: str, text_col: str, work: str) -> DataFrame:
    """shingles, written."""
    short_batches(documents.sparkSession)
    return written(shingles(documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), size), f"{work}sets")


def links(documents: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, similarity): ids of documents that share at least `similarity` of their distinct shingles, enough
    to connect all that do. Documents of equal sets are linked to that of the smallest id. Null ids take no part.
    """
    work = f"similar-{uuid.uuid4().hex}/"
    rows = shingled(documents.filter(F.col(id_col).isNotNull()), size, id_col, text_col, work)
    firsts = written(rows.groupBy("set").agg(F.min("doc").alias("first")), f"{work}docs")
    of = lambda c: firsts.select(F.col("set").alias(c), F.col("first").alias(f"doc_{c}"))
    near = set_links(rows, similarity, work).join(of("a"), "a").join(of("b"), "b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), "similarity")
    same = rows.select("doc", "set").join(firsts, "set").filter("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same)


def small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def one_of_each(documents: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each group that verified links or equal shingle sets connect,
    the row with the smallest id stays, whole.

    Rows with a null id stay only where no row of their group has an id. Rows that repeat an id are documents of
    their own; of equal ones one stays. An empty table gives no rows.
    """
    spark, work = documents.sparkSession, f"similar-{uuid.uuid4().hex}/"
    rows = shingled(documents, size, id_col, text_col, work)
    found = components(set_links(rows, similarity, work), work)
    of = rows.select("doc", "set").join(found, F.col("set") == found.id, "left").select("doc", "set", F.coalesce("component", "set").alias("component"))
    least = of.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "set")).alias("least"))
    key, whose, place = unused(documents, "kept"), unused(documents, "of"), unused(documents, "nth")
    of = written(of.join(least, "component").select("doc", "set", F.col("least.doc").alias(key), F.col("least.set").alias(whose)), "similar-judged")
    twice = written(of.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "similar-twice")
    removed(spark, work)  # all that is needed from here on stands in the two tables above
    released(spark)
    gone = of.filter(~F.col("doc").eqNullSafe(F.col(key))).select(F.col("doc").alias(key))
    if twice.isEmpty():
        return documents.join(small(gone), documents[id_col].eqNullSafe(gone[key]), "left_anti")
    kept = of.select(key, whose).distinct()
    once = documents.join(twice, documents[id_col].eqNullSafe(F.col("doc")), "left_anti").join(gone, documents[id_col].eqNullSafe(gone[key]), "left_anti")
    # Of rows that repeat an id, those with the kept set.
    some = written(documents.join(twice, documents[id_col].eqNullSafe(F.col("doc")), "left_semi").withColumn(place, F.monotonically_increasing_id()), "similar-repeated")
    sets = shingles(some.select(place, F.col(text_col).alias("text")), size).select(F.col("doc").alias("at"), "set")
    named = some.select(F.col(id_col).alias("doc"), F.col(place).alias("at")).join(sets, "at")
    picked = named.join(kept, F.col("doc").eqNullSafe(F.col(key)) & (F.col("set") == F.col(whose))).groupBy("doc", "set").agg(F.min("at").alias("at"))
    return once.unionByName(some.join(picked.select("at"), F.col(place) == F.col("at"), "left_semi").drop(place))
