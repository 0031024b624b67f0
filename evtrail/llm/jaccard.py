"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set are the hashes of its distinct word shingles.

1. Two sets of Jaccard t or more differ in at most d = (1 - t) / (1 + t) (|x| + |y|) tokens.  Cut the
   hash range into more than d segments, and one segment at least holds the same tokens in both.
   Each text sends the hash of each segment's tokens, for the number of segments of its size class
   and, where a partner can be in it, of the next.  With spare segments beyond d + 1, a pair shares
   more than one, and each of the two knows a number `need` that it shares at least.  A segment that
   more than `few` rows share is hot: no pairs are made of it.  Of its hot segments a text leaves out
   the need - 1 that come last in an order that all texts follow, and is tied to the others: if all
   that a pair shares is hot, both keep the first of it.  Pairs of other segments are counted, and one
   that shares less than `need`, the hot ones taken off, is dropped.
2. Equal sets are one: the row with the smallest id stands for its copies, and counts as many times.
3. Rows tied or paired make up blocks; a document in no block has no link.  A block with more than
   `part_rows` documents or `part_tokens` tokens is dealt into parts, and each pair of parts is one
   group, so that no task holds more than two parts.
4. In a group every document searches the inverted lists of the others: with T the required
   overlap, the L longest lists are set apart, the short ones are merged (by a heap, or by counting
   where they hold more than `_HEAP` entries), and what occurs T - L times or more is looked up in
   the long lists by binary search; where so many remain that reading the long lists is less work
   than the look-ups, they are counted as well.  Every link is found and counted.
5. Links make the components of the sets; copies take those of the row that stands for them.

Tables joined by a hash are written first: the join then has plain shuffles on both sides, and Spark
can split the partition of a set, a segment or a component that very many rows have.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evtrail.operators.graph import components

from . import rolling
from .common import claim, written
from .rolling import windows, word_hashes

#: Lower ends of the size classes.
_SIZES = sorted({round(1.5**k) for k in range(60)})
_HEAP = 512
#: A look-up in a list costs about as much as so many entries read.
_PROBE = 8


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, an empty one has none."""
    words = text.lower().split() if text else []
    if len(words) >= size:
        return np.unique(windows(word_hashes(words), size))
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)


def least_overlap(n: int, percent: int) -> int:
    """Overlap that a set of n needs with any partner."""
    return -(-percent * n // 100)


@lru_cache(maxsize=128)
def _segments(top: int, percent: int) -> tuple[np.ndarray | None, int]:
    """Where the segments of a class of sizes up to `top` begin, and how many may be empty unsent."""
    differ = (100 - percent) * 2 * top // (100 + percent)
    if not differ:
        return None, 0  # only equal sets are alike
    spare = 2 + differ // 6
    m = differ + 1 + spare
    return np.array([(i << 64) // m for i in range(m)], np.uint64), spare


def segment_keys(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Hashes of the segments of a sorted set, for the classes in which a partner can be; with each class,
    its number and how many a partner shares at least (of a pair, the larger of the two numbers
    holds), as class << 20 | need.

    Of the d + 1 + spare segments at least 1 + spare are the same in a pair, and no more of these are
    empty than the emptier set has empty ones, nor than the fuller set has.  If these all can be empty,
    both sets have more empty ones than are spare, and then they send the empty ones too."""
    n, out = len(s), []
    if not n:
        return out
    c = bisect_right(_SIZES, n) - 1
    classes = [c] + [c + 1] * (100 * n >= percent * _SIZES[c + 1])
    x = s ^ (s >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x ^ (x >> np.uint64(27)), out=total[1:])
    for k in classes:
        begin, spare = _segments(_SIZES[k + 1] - 1, percent)
        if begin is not None:
            at = np.append(np.searchsorted(s, begin), n)
            key = total[at[1:]] - total[at[:-1]]
            full = at[1:] > at[:-1]
            key += (np.arange(len(key), dtype=np.uint64) + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
            key *= np.uint64(0xD6E8FEB86659FD93)
            empty = int((~full).sum())
            out.append((key if empty > spare else key[full], k << 20 | max(1, 1 + spare - empty)))
    return out


class Search:
    """Inverted lists over sorted token arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.tokens, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))

    def overlaps(self, x: np.ndarray, percent: int, mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
        """The documents that reach the overlap x needs with anyone, and how large each overlap is."""
        at = np.searchsorted(self.tokens, x)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == x]
        lengths = self.ends[at] - self.starts[at]
        need = least_overlap(len(x), percent)
        if len(at) < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_long = min(need - 1, int(need / (mu * log2(int(lengths.max()) + 1) + 1)))
        at = at[np.argsort(lengths, kind="stable")]
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        lists = lambda which: [self.owner[self.starts[k] : self.ends[k]] for k in which]
        if (self.ends[short] - self.starts[short]).sum() <= _HEAP:
            runs = [(d, c) for d, g in groupby(heapq.merge(*(o.tolist() for o in lists(short)))) if (c := sum(1 for _ in g)) >= need - n_long]
            found, n = np.array([d for d, _ in runs], np.int64), np.array([c for _, c in runs], np.int64)
        else:
            n = np.bincount(np.concatenate(lists(short)), minlength=len(self.sizes))
            found = np.flatnonzero(n >= need - n_long)
            n = n[found]
        if len(found) and n_long:
            entries = int((self.ends[long] - self.starts[long]).sum())
            if len(found) * n_long * _PROBE > entries + len(self.sizes):
                n += np.bincount(np.concatenate(lists(long)), minlength=len(self.sizes))[found]
            else:
                for o in lists(long):
                    n += o[np.minimum(np.searchsorted(o, found), len(o) - 1)] == found
        good = n >= need
        return found[good], n[good]


def links_of(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, weights: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All links between left and right (within left, if right is None): those of a forest that connects
    what they connect, as indexes, and for each document the weights of those it links with.  Indexes
    of right ones count on from the left ones."""
    n = len(left)
    parent = list(range(n + len(right or ())))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest, search, shift = [], Search(right if right is not None else left), n if right is not None else 0
    degree = np.zeros(len(parent), np.int64)
    roots = np.arange(len(parent))  # a root seen before: still the same tree, if not the top of it
    for i, x in enumerate(left):
        found, both = search.overlaps(x, percent)
        if right is None:
            found, both = found[found < i], both[found < i]
        linked = found[100 * both >= percent * (len(x) + search.sizes[found] - both)] + shift
        degree[i] += weights[linked].sum()
        degree[linked] += weights[i]
        # of documents that share a root, one look is enough
        for j in linked[np.unique(roots[linked], return_index=True)[1]].tolist():
            if (a := root(i)) != (b := root(j)):
                parent[a] = b
                forest.append((i, j))
        roots[linked] = roots[i] = root(i)
    return forest, degree


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, few: int = 32, part_rows: int = 2048, part_tokens: int = 1 << 21, nodes: bool = False) -> DataFrame:
    """One row per document row: id, n_shingles, component_id, the smallest id reachable by links, and
    n_links, the number of other rows that it links with, copies among them; with `nodes` also node,
    the xxhash64 of id and text, and component, one of its nodes.

    A-Z are lower-cased.  Null and empty texts have no set and stand alone; rows with equal texts or
    sets are linked, repeated rows as well; rows that share an id but not the text are nodes of their
    own; a row without id links, but its component is the smallest id that is there, or null.  Very
    long texts go whole, one to a part if need be; an empty table gives no rows; columns but the two
    named are not looked at.
    """
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    row = T.StructType([T.StructField("seg", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("other", T.LongType()), T.StructField("id", at.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("sha", T.BinaryType())])

    def rows(ids: pa.Array, seg, kind: int, key, other=None, n=None, sha=None) -> pa.RecordBatch:
        m = len(key)
        column = lambda v, t: pa.nulls(m, t) if v is None else pa.array(v, t)
        return pa.RecordBatch.from_arrays([column(seg, pa.int64()), pa.array(np.full(m, kind, np.int32)), column(key, pa.int64()), column(other, pa.int64()), ids, column(n, pa.int64()), column(sha, pa.binary())], names=row.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", rolling.clear, _segments.cache_clear)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
            keys = batch.column(0).to_numpy()
            n, sha, sent, owner, segs, codes = [], [], set(), [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                sha.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if sha[-1] not in sent:  # a set that this batch has had before is a copy and needs no segments
                    sent.add(sha[-1])
                    for seg, code in segment_keys(s, percent):
                        owner.append(np.full(len(seg), i))
                        segs.append(seg)
                        codes.append(np.full(len(seg), code))
            yield rows(batch.column(1), keys, 0, keys, n=n, sha=sha)  # what is no segment is dealt by its key
            owner, codes = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (owner, codes))
            seg = np.concatenate(segs).view(np.int64) if segs else np.zeros(0, np.int64)
            _, at_first, back, times = np.unique(seg, return_index=True, return_inverse=True, return_counts=True)
            many = times[back] > few
            lead = np.zeros(len(seg), bool)
            lead[at_first] = True
            send, here = ~many | lead, many & ~lead  # of a segment that is hot here, one row tells the others
            none = lambda m: pa.nulls(m, batch.column(1).type)
            yield rows(none(int(send.sum())), seg[send], 2, keys[owner[send]], many[send].astype(np.int64), n=codes[send])
            yield rows(none(int(here.sum())), keys[owner[here]], 1, keys[owner[here]], seg[here], n=codes[here])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their segment: those of hot ones as they are, pairs of the others with a count."""
        rolling.clear()
        held = np.zeros((4, 0), np.int64)  # segment, key, flag and code of a group that may go on

        def done(g: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            begin = np.flatnonzero(np.append(True, g[0, 1:] != g[0, :-1])) if g.shape[1] else np.zeros(0, np.int64)
            length = np.diff(np.append(begin, g.shape[1]))
            flag = np.maximum.reduceat(g[2], begin) > 0 if len(begin) else np.zeros(0, bool)
            large = flag | (length > few)
            rest = np.zeros((4, 0), np.int64)
            out = np.repeat(large, length) & (g[2] < 2)
            if not last and len(begin):
                rest = g[:, begin[-1] :]
                if large[-1]:  # one row, sent on already, tells that the group is hot
                    rest = rest[:, :1].copy()
                    rest[2] = 2
                else:
                    begin, length, large = begin[:-1], length[:-1], large[:-1]
            pairs = [np.zeros((3, 0), np.int64)]
            for k in np.unique(length[~large & (length > 1)]):
                i, j = np.triu_indices(k, 1)
                at = begin[~large & (length == k)][:, None] + np.arange(k)
                members, code = g[1][at], g[3][at]
                two = np.sort(np.stack([members[:, i].ravel(), members[:, j].ravel()]), axis=0)
                pairs.append(np.concatenate([two, np.maximum(code[:, i], code[:, j]).reshape(1, -1)]))
            return rest, g[:, out], np.concatenate(pairs, axis=1)

        def out(hot: np.ndarray, pairs: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            yield rows(pa.nulls(hot.shape[1], kind), None, 1, hot[1], hot[0], n=hot[3])
            pairs, n = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1, return_counts=True)
            yield rows(pa.nulls(pairs.shape[1], kind), pairs[2], 3, pairs[0], pairs[1], n=n)

        kind_of_id = None
        for batch in batches:
            kind_of_id = batch.column(4).type
            kind = batch.column(1).to_numpy()
            yield batch.filter(pa.array(kind < 2))
            segments = batch.filter(pa.array(kind == 2))
            new = np.stack([segments.column(c).to_numpy() for c in (0, 2, 3, 5)])
            held, hot, pairs = done(np.concatenate([held, new], axis=1), False)
            yield from out(hot, pairs, kind_of_id)
        if held.shape[1]:
            yield from out(*done(held, True)[1:], kind_of_id)

    base = written(at.select("key", "id", "text").mapInArrow(first, row).repartition("seg").sortWithinPartitions("seg", "key").mapInArrow(runs, row), "jaccard-base")
    rows_of = base.where("kind = 0").select("key", "id", "n", "sha")
    # one row a set: the key of the row that stands for it, the smallest id, how many rows have it, its size
    leaders = written(rows_of.where("n > 0").groupBy("sha").agg(F.min(F.struct("id", "key"))["key"].alias("lead"), F.min("id").alias("low"), F.count("*").alias("copies"), F.max("n").alias("tokens")), "jaccard-sets")
    # rows without tokens have a key of their own in the join, not all the same digest
    named = rows_of.withColumn("sha", F.when(F.col("n") > 0, F.col("sha")).otherwise(F.col("key").cast("string").cast("binary")))
    led = written(named.join(leaders.select("sha", "lead"), "sha", "left").select("key", "id", "n", F.coalesce("lead", "key").alias("lead")), "jaccard-rows")
    lead = written(led.where("n > 0").select("key", "lead").distinct(), "jaccard-keys")
    # the hot segments of a text in a class, and those that it keeps
    code = lambda c: (F.shiftright(c, 20).alias("class"), F.col(c).bitwiseAND((1 << 20) - 1).alias("need"))
    hot = base.where("kind = 1").select("key", "other", *code("n")).groupBy("key", "class").agg(F.sort_array(F.collect_set("other")).alias("segs"), F.max("need").alias("need"))
    kept = F.when(F.size("segs") >= F.col("need"), F.slice("segs", F.lit(1), (F.size("segs") - F.col("need") + 1).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    hot = written(hot.select("key", "class", F.size("segs").alias("h"), kept.alias("kept")), "jaccard-hot")
    tied = written(hot.select("key", F.explode("kept").alias("seg")).join(lead, "key").select("seg", F.col("lead").alias("a")).distinct(), "jaccard-tied")
    first_of = written(tied.groupBy("seg").agg(F.min("a").alias("b")), "jaccard-first")
    ties = tied.join(first_of, "seg").select("a", "b")
    counted = base.where("kind = 3").select("key", "other", "n", *code("seg")).groupBy("key", "other", "class").agg(F.sum("n").alias("c"), F.max("need").alias("need"))
    off = hot.select("key", "class", "h")
    counted = counted.join(off, ["key", "class"], "left").withColumnRenamed("h", "x").join(off.withColumnsRenamed({"key": "other", "h": "y"}), ["other", "class"], "left")
    met = counted.where(F.col("c") + F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))) >= F.col("need")).select("key", "other").distinct()
    pairs = met.join(lead, "key").select("other", F.col("lead").alias("a")).join(lead.withColumnRenamed("key", "other"), "other").select("a", F.col("lead").alias("b"))
    pairs = pairs.union(ties).where("a <> b")
    blocks = written(components(pairs).join(leaders.select(F.col("lead").alias("node"), "copies", "tokens"), "node"), "jaccard-blocks")
    # parts of about part_rows documents and part_tokens tokens; a part meets itself and every other one
    sizes = written(blocks.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / part_rows), F.ceil(F.sum("tokens") / part_tokens)).cast("int").alias("parts")), "jaccard-sizes")
    sized = written(blocks.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias("block"), "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "copies"), "jaccard-parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", rolling.clear, _segments.cache_clear)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            found = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(5).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.list_(pa.int64()))], names=["key", "block", "parts", "part", "copies", "tokens"])

    texts = at.join(sized.hint("merge"), "key").select("key", "block", "parts", "part", "copies", "text").mapInArrow(sets, "key long, block long, parts int, part int, copies long, tokens array<long>")
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    dealt = texts.select("key", "block", "part", "copies", "tokens", F.explode(other).alias("pair")).select("key", "block", "pair.i", "pair.j", "part", "copies", "tokens")

    def link(group: pa.Table) -> pa.Table:
        """Links of a forest (a, b), and the number of links of each document of the two parts (a, n)."""
        rolling.clear()
        keys = group["key"].to_pylist()
        own = [t.values.to_numpy().view(np.uint64) for t in group["tokens"]]
        part, same = group["part"].to_pylist(), group["i"][0] == group["j"][0]
        one = {k: i for i, k in enumerate(keys)}  # equal rows once
        left = [i for k, i in one.items() if same or part[i] == group["i"][0].as_py()]
        right = [] if same else [i for k, i in one.items() if part[i] != group["i"][0].as_py()]
        order = np.array(left + right, np.intp)
        forest, degree = [], np.zeros(len(order), np.int64)
        if same or (left and right):
            forest, degree = links_of([own[i] for i in left], None if same else [own[i] for i in right], percent, group["copies"].to_numpy()[order])
        names = group["key"].to_numpy()[order]
        some = np.flatnonzero(degree)
        ends = np.array(forest, np.intp).reshape(-1, 2)
        return pa.table({"a": np.concatenate([names[ends[:, 0]], names[some]]), "b": pa.array([*names[ends[:, 1]].tolist(), *[None] * len(some)], pa.int64()), "n": np.concatenate([np.zeros(len(ends), np.int64), degree[some]])})

    links = written(dealt.groupBy("block", "i", "j").applyInArrow(link, "a long, b long, n long"), "jaccard-links")
    found = written(components(links.where("b is not null")).withColumnRenamed("node", "lead"), "jaccard-components")
    degree = links.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "lead")
    tied = leaders.join(found, "lead", "left").join(degree, "lead", "left").withColumn("component", F.coalesce("component", "lead"))
    lowest = written(tied.groupBy("component").agg(F.min("low").alias("component_id")), "jaccard-lowest")
    sets_of = written(tied.join(lowest, "component").select("lead", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-found")
    also = [F.col("key").alias("node"), F.coalesce("component", "key").alias("component")] if nodes else []
    return led.join(sets_of, "lead", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *also)
