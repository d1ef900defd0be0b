"""Benchmark decontamination with suffix arrays of the training words.

Each task takes a shard of documents, turns every word into a 64-bit hash and
sorts the word suffixes into a suffix array, by their first `window` words, on
ranks that the shard and the test items share. Suffixes whose first words
(`seed` of them) stand nowhere in the benchmark match no test suffix that far
and are left out of the array. Every distinct window of the test suffixes is
then binary-searched; the positions that begin with it are hits, one row each
however often words repeat. The longest verbatim match of a document, with
where it is, comes from a second suffix array of the words that were hit.

The benchmark is what travels to the tasks, in broadcast blocks of at most
`block_words` words, which the driver makes one after the other. Documents pass
one block after the other, each in a stage of its own, so a task holds one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U64, Rolling, mix, ragged, short_batches, texts, words, written

#: Words of test items that one pass takes to the tasks: about 100 MB with their ranks.
BLOCK_WORDS = 4_000_000


def item_words(column: pa.Array, roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words up to each row's end from 0)."""
    hashes, ends, done = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in texts(column):
        data = LOWER[data]
        start, end, upto = words(data, offsets, ALNUM)
        hashes.append(roll.of_words(data, start, end))
        ends.append(upto[1:] + done)
        done += len(start)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(ends)


def gram(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from every position that has so many after it, here ignoring row ends."""
    out = np.zeros(max(0, len(hashes) - n + 1), U64)
    for i in range(n):
        out = mix(out + hashes[i : i + len(out)])
    return out


def ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks, equal for equal rows, in the order of the columns' values from the first on."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Items:
    """Test items as word hashes, and the keys by which a shard is searched."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, ends: np.ndarray, window: int, seed: int):
        self.ids, self.hashes, self.window = ids, hashes, window
        lengths = np.diff(ends)
        self.depth = np.minimum(lengths, window)
        self.item = np.repeat(np.arange(len(ids)), lengths)
        self.begin = np.asarray(ends[:-1])
        self.end = np.repeat(ends[1:], lengths)
        at = np.arange(len(hashes))
        # A window starts where so many words are left; the others are suffixes without a window.
        self.starts = at[at + self.depth[self.item] <= self.end]
        self.seed = np.minimum(seed, self.depth)
        self.seeds = {}
        for n in np.unique(self.seed[self.depth > 0]):
            g = gram(hashes, int(n))
            own = self.starts[(self.seed[self.item[self.starts]] == n)]
            self.seeds[int(n)] = np.unique(g[own])


def shard_hits(hashes: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, window length, window) of every place in the shard where a window begins, one row for each length; and of the
    windows, by number, (how many test suffixes begin with it, those suffixes one after the other)."""
    row_end = np.repeat(ends[1:], np.diff(ends))
    wanted = np.zeros(len(hashes), bool)
    for n, known in items.seeds.items():
        g = gram(hashes, n)
        if len(g) and len(known):
            found = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
            wanted[: len(g)] |= found & (np.arange(len(g)) + n <= row_end[: len(g)])
    at = np.flatnonzero(wanted)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none, none
    # A column for each word of the window; suffixes that end before it come first.
    both = np.concatenate([hashes, items.hashes])
    stop = np.concatenate([row_end, items.end + len(hashes)])
    pos = np.concatenate([at, items.starts + len(hashes)])
    columns = []
    for i in range(items.window):
        there = pos + i < stop[pos]
        columns.append(np.where(there, both[np.minimum(pos + i, len(both) - 1)], U64(0)))
        columns.append(there)
    out, numbered = [], 0
    for depth in np.unique(items.depth[items.item[items.starts]]):
        rank = ranks([c for pair in zip(columns[1 : 2 * depth : 2], columns[0 : 2 * depth : 2]) for c in pair])
        full = pos + depth <= stop[pos]
        mine, test = rank[: len(at)], rank[len(at) :]
        mine_at = at[full[: len(at)]]
        mine = mine[full[: len(at)]]
        order = np.lexsort((mine_at, mine))
        array, mine_at = mine[order], mine_at[order]
        own = np.flatnonzero(items.depth[items.item[items.starts]] == depth)
        own = own[np.argsort(test[own], kind="stable")]
        windows, first = np.unique(test[own], return_index=True)
        lo, hi = np.searchsorted(array, windows, "left"), np.searchsorted(array, windows, "right")
        size = np.diff(first, append=len(own))
        met = np.flatnonzero(hi > lo)
        lo, hi, size = lo[met], hi[met], size[met]
        where = mine_at[ragged(lo, hi - lo)]
        out.append((where, np.full(len(where), depth), numbered + np.repeat(np.arange(len(met)), hi - lo), size, items.starts[own][ragged(first[met], size)]))
        numbered += len(met)
    return tuple(np.concatenate(x) for x in zip(*out))


def longest_matches(hashes: np.ndarray, ends: np.ndarray, items: Items, where: np.ndarray, depth: np.ndarray, window: np.ndarray, size: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, words, test suffix) of the longest match of each document with a hit; of equal ones the first in the document.

    Whole items of fewer words than a window match by their own length. For the others the words that windows cover, in the shard
    and in the items, are sorted as suffixes by doubling; a suffix of the shard has its longest match beside it among
    those of the items, of a length that is read off the doublings' names.
    """
    first = np.cumsum(size) - size
    found = [(where, depth, suffixes[first[window]])]
    long = np.flatnonzero(depth == items.window)
    if len(long):
        test = suffixes[ragged(first[np.unique(window[long])], size[np.unique(window[long])])]
        mine, theirs = (np.unique(ragged(x, np.full(len(x), items.window))) for x in (where[long], test))
        # Stretches of neighbours, a letter of its own after each: no match goes on past a document's or an item's end.
        stop = np.concatenate([np.repeat(ends[1:], np.diff(ends))[mine], items.end[theirs]])
        at, of = np.concatenate([mine, theirs]), np.repeat([0, 1], [len(mine), len(theirs)])
        last = np.ones(len(at), bool)
        last[:-1] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]) | (at[:-1] + 1 == stop[:-1])
        place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(last[:-1])])
        name = np.full(len(at) + int(last.sum()), -1, np.int64)
        name[place] = np.unique(np.concatenate([hashes[mine], items.hashes[theirs]]), return_inverse=True)[1]
        gaps = np.flatnonzero(name < 0)
        name[gaps] = name.max() + 1 + np.arange(len(gaps))
        names, step, widest = [name], 1, int(np.diff(gaps, prepend=-1).max())
        while step < widest:
            name = names[-1]
            after = np.zeros(len(name), np.int64)
            after[:-step] = name[step:] + 1
            names.append(np.unique(name * (len(name) + 2) + after, return_inverse=True)[1])
            step *= 2
        order = np.lexsort((np.arange(len(name)), names[-1]))
        home = np.full(len(name), -1, np.int64)  # of the letters of items, where they stand
        home[place[len(mine) :]] = theirs
        inside = home[order] >= 0
        starts = np.isin(mine, where[long])
        p = place[: len(mine)][starts]
        spot = np.empty(len(name), np.int64)
        spot[order] = np.arange(len(order))
        before = np.maximum.accumulate(np.where(inside, np.arange(len(order)), -1))
        behind = np.minimum.accumulate(np.where(inside, np.arange(len(order)), len(order))[::-1])[::-1]
        for near in (before, behind):
            q = near[spot[p]]
            some = np.flatnonzero((q >= 0) & (q < len(order)))
            a, b = p[some].copy(), order[q[some]]
            other, words_ = b.copy(), np.zeros(len(some), np.int64)
            for k in reversed(range(len(names))):
                for _ in range(2 if k == len(names) - 1 else 1):
                    fits = (a < len(name)) & (b < len(name))
                    same = np.zeros(len(a), bool)
                    same[fits] = names[k][a[fits]] == names[k][b[fits]]
                    a, b, words_ = a + (same << k), b + (same << k), words_ + (same << k)
            found.append((mine[starts][some], words_, home[other]))
    place, words_, suffix = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(ends, place, "right") - 1
    order = np.lexsort((suffix, place, -words_, row))
    pick = order[np.unique(row[order], return_index=True)[1]]
    return place[pick], words_[pick], suffix[pick]


def item_blocks(benchmark: DataFrame, roll: Rolling, window: int, seed: int, block_words: int) -> Iterator[Items]:
    """The items in blocks of about block_words words; a benchmark of ordinary size, or an empty one, makes one block."""
    short_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("item_id").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // (4 * block_words)))
    for block in range(blocks):
        table = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        hashes, ends = item_words(table["text"], roll)
        yield Items(np.array(table["item_id"].to_pylist(), object), hashes, ends, window, seed)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, seed: int = 3, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, without the rows that hold a window of the benchmark (see contaminated)."""
    roll, columns = Rolling(3), documents.columns
    plain = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at = columns.index(text_col)

    def clean(known):
        def scan(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in texts(batch.column(at), 1 << 22):
                    data = LOWER[data]
                    start, end, upto = words(data, offsets, ALNUM)
                    where = shard_hits(roll.of_words(data, start, end), upto, known.value)[0]
                    keep[lo + np.unique(np.searchsorted(upto, where, "right") - 1)] = False
                yield batch.filter(pa.array(keep))

        return scan

    for nth, known in enumerate(item_blocks(benchmark, roll, window, seed, block_words)):
        plain = written(plain, "decontaminate") if nth else plain  # a task holds one block
        plain = plain.mapInArrow(clean(documents.sparkSession.sparkContext.broadcast(known)), plain.schema)
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, longest, longest_at, longest_item, longest_item_at, contaminated) of every
    document row.

    Words are runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. A window is `window`
    consecutive words of an item; an item of fewer, but not none, is one window. n_hit counts the
    words inside any occurrence of a window, n_items the items with occurring windows, `items` lists
    them sorted as strings. `longest` is the longest verbatim match in words from any of those windows on (0: none),
    from word longest_at of the document and word longest_item_at of longest_item, counted from 0; of equal ones
    the first in the document. Null and empty texts have no words. Items that repeat an id count as one; items with
    a null id are left out. An empty benchmark hits nothing. Repeated document rows stay repeated, however many
    blocks the benchmark makes.
    """
    roll, context = Rolling(3), documents.sparkSession.sparkContext
    none = F.array()
    found = documents.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), none.cast("array<long>").alias("hits"), none.cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("longest"), F.lit(None).cast("long").alias("longest_at"), F.lit(None).cast("string").alias("longest_item"), F.lit(None).cast("long").alias("longest_item_at"),
    )
    for nth, known in enumerate(item_blocks(benchmark, roll, window, seed, block_words)):
        found = written(found, "decontaminate") if nth else found  # a task holds one block
        found = found.mapInArrow(_scan(context.broadcast(known), roll), found.schema)
    items = F.array_distinct("items")
    return found.select(
        F.col("id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.array_sort(items).alias("items"),
        "longest", "longest_at", "longest_item", "longest_item_at", (F.size("hits") > 0).alias("contaminated"),
    )


def _scan(known, roll: Rolling):
    """Adds to rows of documents what one block of items hits in them."""

    def scan(batches):
        items = known.value
        for batch in batches:
            before = {c: batch.column(c) for c in ("hits", "items", "longest", "longest_at", "longest_item", "longest_item_at")}
            for lo, hi, data, offsets in texts(batch.column("text"), 1 << 22):
                data = LOWER[data]
                start, end, upto = words(data, offsets, ALNUM)
                hashes = roll.of_words(data, start, end)
                where, depth, window, size, suffixes = shard_hits(hashes, upto, items)
                row = np.searchsorted(upto, where, "right") - 1
                old = [before["hits"].slice(lo, hi - lo), before["items"].slice(lo, hi - lo)]
                told = upto[np.repeat(np.arange(hi - lo), np.diff(old[0].offsets.to_numpy()))] + old[0].flatten().to_numpy()
                hit = np.unique(np.concatenate([ragged(where, depth), told]))
                hit_row = np.searchsorted(upto, hit, "right") - 1
                bounds = np.searchsorted(hit_row, np.arange(hi - lo + 1))
                names: list[list[str]] = old[1].to_pylist()
                if len(where):
                    # Windows of each document, then the items of each window, once each.
                    met = np.unique(np.stack([row, window]), axis=1)
                    of = np.unique(np.stack([np.repeat(np.arange(len(size)), size), items.item[suffixes]]), axis=1)
                    first = np.searchsorted(of[0], np.arange(len(size) + 1))
                    many = np.diff(first)[met[1]]
                    pairs = np.unique(np.stack([np.repeat(met[0], many), of[1][ragged(first[met[1]], many)]]), axis=1)
                    for r, i in pairs.T.tolist():
                        names[r].append(items.ids[i])
                top = {c: before[c].slice(lo, hi - lo).to_pylist() for c in ("longest", "longest_at", "longest_item", "longest_item_at")}
                for at, long, suffix in zip(*longest_matches(hashes, upto, items, where, depth, window, size, suffixes)) if len(where) else ():
                    r = int(np.searchsorted(upto, at, "right")) - 1
                    place = int(at - upto[r])
                    if (long, -place) > (top["longest"][r], -(top["longest_at"][r] or 0)):
                        top["longest"][r], top["longest_at"][r] = int(long), place
                        top["longest_item"][r], top["longest_item_at"][r] = items.ids[items.item[suffix]], int(suffix - items.begin[items.item[suffix]])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo), pa.array(np.diff(upto).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hit - upto[hit_row], pa.int64())), pa.array(names, pa.list_(pa.string())),
                    pa.array(top["longest"], pa.int64()), pa.array(top["longest_at"], pa.int64()), pa.array(top["longest_item"], pa.string()), pa.array(top["longest_item_at"], pa.int64()),
                ], batch.schema.names)

    return scan


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM k)),
z AS (SELECT DISTINCT n FROM g),
c AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, z)),
m AS (SELECT doc_id, n, pos, item_id FROM c JOIN g USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""


def by_brute_force(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """The same rows in plain Python, for tests."""
    import re

    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    windows: dict[tuple, set] = {}
    for i, s in items:
        w = cut(s)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for d, s in documents:
        w, hit, got = cut(s), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    got |= windows[x]
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
