"""Prefix trie of rebuilt conversations, from composable fingerprints of their turns.

A sequence of turns has the fingerprint sum(e_i * B^i) mod p, over three primes: sequences form a monoid, as the print of x
followed by y is print(x) + B^|x| * print(y).  So the prefixes of a rebuilt conversation, the head of its base and the rest of
its own turns, follow from the prefix prints of both originals; no rebuilt text is made, its turns are references.
Groups of equal prints hold each member's turn and parent against each other; where two differ, all is done again with
other bases, so that prints that agree by chance change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.operators.numbering import numbered

from .common import claim, drop_written, written

PRIMES = ((1 << 31) - 1, (1 << 31) - 19, (1 << 31) - 61)
#: Longest head that a rebuilt conversation takes from its base.
MAX_HEAD = 5
#: Running sums go block by block of so many turns, so that a long conversation is no single task's work.
BLOCK = 4096
#: So many ids in a piece of text on the way to a digest.
PIECE = 4096


def _bases(seed: int) -> list[int]:
    """One base a prime, from the seed alone."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{p}".encode()).digest()[:8], "big") % (p - 3) + 2 for p in PRIMES]


def _power(base: int, p: int, e: np.ndarray) -> np.ndarray:
    out, b, e = np.ones(len(e), np.int64), base, e.copy()
    while e.any():
        odd = (e & 1) == 1
        out[odd] = out[odd] * b % p
        b, e = b * b % p, e >> 1
    return out


def _weighed(turns: DataFrame, bases: list[int]) -> DataFrame:
    """turns with w0, w1, w2: their elements times B^pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(-1, 8)[:, :3].astype(np.int64)
            w = [(words[:, i] % (p - 1) + 1) * _power(b, p, pos) % p for i, (p, b) in enumerate(zip(PRIMES, bases, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, w)], names=[*batch.schema.names, "w0", "w1", "w2"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields)
    return turns.mapInArrow(run, shape + ", w0 long, w1 long, w2 long")


def running(df: DataFrame, key: str, order: str, sums: dict[str, Column | str]) -> DataFrame:
    """df with, for each name, the sum of its column over the rows of the key up to and with this one. Blocks of the order are
    summed first and those sums run, so a key's rows go by (key, block)."""
    at = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    totals = at.groupBy(key, "_block").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_block", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = at.join(totals, [key, "_block"])
    return at.select(*df.columns, *((F.col(f"_{n}") + F.sum(c).over(within)).alias(n) for n, c in sums.items()))


def _mod(c: Column, i: int) -> Column:
    return F.pmod(c, F.lit(PRIMES[i]))


def _rebuilt(turns: DataFrame, bases: list[int]) -> DataFrame:
    """A row a prefix of a rebuilt conversation: conv_id, depth, its print f0..f2, that of its parent p0..p2, digest and chars of its
    last turn, and whether it is the whole conversation."""
    prints = running(_weighed(turns, bases), "conv_id", "pos", {f"s{i}": f"w{i}" for i in range(3)})
    prints = prints.select("conv_id", "pos", "digest", "chars", *(f"w{i}" for i in range(3)), *(_mod(F.col(f"s{i}"), i).alias(f"h{i}") for i in range(3)))
    prints = written(prints, "trie-prints")
    entry = F.struct("pos", "h0", "h1", "h2", "digest", "chars")
    heads = prints.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= MAX_HEAD, entry))).alias("own"))
    base = heads.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("head"))
    cut = F.crc32(F.col("conv_id").cast("string")) % (MAX_HEAD + 1)
    of = heads.withColumn("h", cut.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(base, "base", "left")
    of = of.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["own"].dataType)), F.lit(1), F.col("h")))
    of = of.withColumn("k", F.size("head")).withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def print_at(array: str, at: Column, i: int) -> Column:  # of the first `at` turns
        return F.when(at > 0, F.get(F.col(array), at.cast("int") - 1)[f"h{i}"]).otherwise(F.lit(0))

    # what an own prefix print needs: minus the cut head, moved from after h turns to after k, behind the base's head
    def shift(i: int) -> Column:
        back = pow(bases[i], -1, PRIMES[i])
        return F.element_at(F.array(*(F.lit(pow(back, j, PRIMES[i])) for j in range(MAX_HEAD + 1))), F.col("h") - F.col("k") + 1)

    of = of.select("conv_id", "h", "k", "total", "head", *(print_at("head", F.col("k"), i).alias(f"b{i}") for i in range(3)), *(print_at("own", F.col("h"), i).alias(f"o{i}") for i in range(3)), *(shift(i).alias(f"m{i}") for i in range(3)))
    of = written(of, "trie-heads")

    def own(h: str, i: int) -> Column:
        return _mod(F.col(f"b{i}") + _mod(F.col(h) - F.col(f"o{i}"), i) * F.col(f"m{i}"), i)

    rest = prints.join(of.drop("head"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), *(own(f"h{i}", i).alias(f"f{i}") for i in range(3)),
        *(_mod(own(f"h{i}", i) - F.col(f"w{i}") * F.col(f"m{i}"), i).alias(f"p{i}") for i in range(3)), "digest", "chars", "total",
    )
    x = F.col("e")
    taken = of.select("conv_id", "total", "head", F.posexplode("head").alias("j", "e")).select(
        "conv_id", (F.col("j") + 1).cast("long").alias("depth"), *(x[f"h{i}"].alias(f"f{i}") for i in range(3)),
        *(print_at("head", F.col("j"), i).alias(f"p{i}") for i in range(3)), x["digest"].alias("digest"), x["chars"].alias("chars"), "total",
    )
    zero = F.lit(0).cast("long")
    root = of.select("conv_id", zero.alias("depth"), *(zero.alias(f"f{i}") for i in range(3)), *(F.lit(None).cast("long").alias(f"p{i}") for i in range(3)), F.lit(b"").alias("digest"), zero.alias("chars"), "total")
    return rest.union(taken).union(root).withColumn("last", F.col("depth") == F.col("total")).drop("total")


NODE = ["depth", "f0", "f1", "f2"]


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): ids are sorted over all tasks and joined to pieces of text there, and the digest runs
    over the pieces of a node in order; a node's ids are never in memory together."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[:4]])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if len(batch) else np.zeros(0, np.int64)
            runs = zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=bool(len(starts)))
            pieces = [(b, min(b + PIECE, z)) for a, z in runs for b in range(a, z, PIECE)]
            ids = batch.column(4).to_pylist()
            texts = pa.array([",".join(map(str, ids[a:b])) for a, b in pieces], pa.string())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array([a for a, _ in pieces], pa.int64())) for c in batch.columns), texts], names=[*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        node, at, out = None, None, []
        for batch in batches:
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != node:
                    if node is not None:
                        out.append((*node, at.hexdigest()))
                    node, at = now, hashlib.sha256(ids.encode())
                else:
                    at.update(f",{ids}".encode())
            yield _table(out)
            out = []
        if node is not None:
            yield _table([(*node, at.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*NODE, "ends_sha256"])

    keys = "depth long, f0 long, f1 long, f2 long"
    sort = [*NODE, "conv_id"]
    pieces = ends.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(join, keys + ", first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(digest, keys + ", ends_sha256 string")


def _same_turns(nodes: DataFrame) -> bool:
    """Whether the members of every group of equal prints have the same last turn and the same parent: then, from
    the root on, equal prints are equal sequences."""
    return nodes.where("least <> most").limit(1).count() == 0


def prefix_trie(rows: DataFrame, *, seeds: int = 8) -> DataFrame:
    """Nodes of the trie of rebuilt conversations. rows are (conv_id, turn, role, text); conversation c is rebuilt from the first
    h = crc32(c) % 6 turns of conversation c - c % 100 and its own turns after its first h.  One row a distinct prefix: conv_id
    (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, the SHA-256 of the ids of the members that end there.

    Turns go by turn, null first, ties by the SHA-256 of role and text; repeated rows are turns of their own.  A null role or
    text counts as empty; rows without conv_id belong to no conversation and are left out; an empty table gives no node;
    long texts are digested whole; other columns are not looked at.

    Two turns are the same if SHA-256 of their role and text says so.  Leaves and saved characters of a subtree
    need no walk down: each node belongs to its smallest member, which owns the end of its own path from some depth on,
    so a node's sums are those of its members' ends, added in the same grouping by prints."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = numbered(turns, ["turn", "digest"], "pos", within=["conv_id"]).drop("turn")
    for seed in range(seeds):
        prefixes = written(_rebuilt(turns, _bases(seed)), "trie-prefixes")
        same = F.struct("digest", "p0", "p1", "p2")
        groups = prefixes.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min(same).alias("least"), F.max(same).alias("most"))
        groups = written(groups, "trie-groups")
        if _same_turns(groups):
            break
        drop_written(prefixes)
        drop_written(groups)
    else:
        raise RuntimeError(f"prints of different turns agreed with each of {seeds} seeds")
    nodes = groups.select(*NODE, "n_convs", "conv_id", "chars", *(F.col(f"least.p{i}").alias(f"p{i}") for i in range(3)))
    children = nodes.where("p0 is not null").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(f"p{i}").alias(f"f{i}") for i in range(3))).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = groups.select((F.col("depth") + 1).alias("depth"), *(F.col(f"f{i}").alias(f"p{i}") for i in range(3)), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "p0", "p1", "p2"], "left")
    # what each node saves, summed along the part of a path that its conversation owns
    nodes = running(nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("chars")), "conv_id", "depth", {"upto": "saves"})
    nodes = written(nodes.drop("chars", "p0", "p1", "p2"), "trie-nodes")
    owned = nodes.groupBy("conv_id").agg(F.sum("saves").alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    below = prefixes.select("conv_id", *NODE).join(owned.where("owned > 0 or leaves > 0"), "conv_id").groupBy(*NODE).agg(F.sum("owned").alias("below"), F.sum("leaves").alias("n_leaves"))
    ends = _ends_digest(prefixes.where("last"))
    # of its own path a node counts what lies from itself on: all that it owns but for what came before
    saved = F.coalesce("below", F.lit(0)) - F.col("upto") + F.col("saves")
    return nodes.join(below, NODE, "left").join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
