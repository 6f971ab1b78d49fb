"""Operator 6: pairs of chunks that are largely the same text, by binary trie self-joins; exact, no similar pair is lost.

Texts with the same words form a class; all work is on classes. Every class sends the rarest part of its shingles
(for a similarity t any t-similar pair shares one of the rarest |A| - ceil(t |A|) + 1) to the tries these shingles root.
A trie joins its parity sketches with itself under an exact error budget. What remains is checked on the sets.

A trie with more than `BLOCK` members is cut into blocks; each pair of blocks is a task's work of its own, so that no group
meets in one task. Order by rarity uses counts of all shingles in a table of counters that grows with their number, up to a
fixed bound; a shingle many share comes last, so a passage that a third of all texts hold roots no trie unless these texts are
alike as a whole. Any order keeps the result exact; the counts only make tries small.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import map_batches
from ..plans.graph import connected_components
from ..session import checkpoint, ship
from . import trie

THRESHOLD, LEAST, N = 0.6, 40, 3
TABLES = (1 << 22, 1 << 25)  # least and most counters of shingles; the bound keeps what each task holds at 128 MB
MARKS = (1 << 23, 1 << 28)  # least and most bits of the table of class numbers in candidates: 1 to 32 MB
RANGES = 64  # parts of a table that are added up by tasks of their own
BLOCK = 512  # members of a trie that one task joins
COPIES = 64  # up to so many identical texts come out as all their pairs, more as stars around two of them


def class_sets(chunks: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """(class_id, shingles) of the contents of at least `least` words, one row a class; null contents have none."""

    def batch(contents):
        out = {c[0]: c[1].tobytes() for c in trie.shingled(contents, n, least) if c}
        return list(out), list(out.values())

    sets = map_batches(chunks.select("content"), batch, "class_id binary, shingles binary")
    return sets.groupBy("class_id").agg(F.first("shingles").alias("shingles"))


def class_members(chunks: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """(chunk_id, project_id, file_path, class_id, text_id) of the chunks with at least `least` words.

    text_id is a hash of the text as it stands; a class may hold several texts, which differ in case, blanks and signs.
    """

    def batch(ids, projects, paths, contents):
        found = zip(ids, projects, paths, contents, trie.shingled(contents, n, least, sets=False), strict=True)
        out = [(i, p, f, c[0], hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()) for i, p, f, t, c in found if c]
        return list(zip(*out, strict=True)) or [[]] * 5

    rows = chunks.select("chunk_id", "project_id", "file_path", "content")
    return map_batches(rows, batch, "chunk_id string, project_id string, file_path string, class_id binary, text_id binary").distinct()


def _table_size(wanted: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, wanted - 1).bit_length()))


def _united(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], unite: np.ufunc) -> np.ndarray:
    """A table that each task of df makes, united over all tasks: it is cut into ranges, and each range is a task's work of its own.
    At most two tables a core are made, so what one range reads grows with the cluster, not with the data."""
    spark = df.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > tasks:
        df = df.coalesce(tasks)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(np.split(make(batches), RANGES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(zlib.decompress(x.as_py()), kind)
                total[k] = unite(total[k], v) if k in total else v
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], names=["part", "blob"])

    empty = make(iter(()))
    kind = empty.dtype
    out = np.split(empty, RANGES)
    for r in df.mapInArrow(parts, "part int, blob binary").repartition("part").mapInArrow(add, "part int, blob binary").collect():  # one table
        out[r.part] = np.frombuffer(zlib.decompress(r.blob), kind)
    return np.concatenate(out)


def _shingle_counts(classes: DataFrame) -> np.ndarray:
    """Counters of all shingles by hash. A counter that would exceed 32 bits stays at its highest value."""
    size = _table_size((classes.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // 16, *TABLES)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.uint32)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32) & np.uint32(size - 1), minlength=size).astype(np.uint32)
        return total

    return _united(classes.select("shingles"), count, _add_up)


def _add_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32)


def class_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """classes(class_id, shingles), one row a class -> (a, b, similarity) for all pairs a < b of similar classes."""
    spark = classes.sparkSession
    ship(spark)
    # numbers instead of class ids travel with the postings; they are stable, as the classes are written first
    classes = checkpoint(classes.select("class_id", "shingles"))
    source = classes.select(F.monotonically_increasing_id().alias("k"), "shingles", "class_id")
    shared = spark.sparkContext.broadcast(_shingle_counts(classes))  # 16 MB, at most 128 MB

    def prefixes(with_sketch: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = shared.value
            last = np.uint32(len(counts) - 1)
            for b in batches:
                ids, blobs = b.column(0).to_pylist(), b.column(1).to_pylist()
                keys, owners = [], []
                sizes, sketches = [], []
                for k, blob in enumerate(blobs):
                    s = np.frombuffer(blob, np.uint32)
                    c = counts[s & last]
                    most = len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1
                    order = np.lexsort((s, c))[:most]
                    order = order[c[order] > 1]  # a counter of one: no other text has it
                    keys.append(s[order])
                    owners.append(np.full(len(order), k))
                    if with_sketch:
                        sizes.append(len(s))
                        sketches.append(trie.sketch(s))
                key = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
                if not with_sketch:
                    # a counter is never below the true number, so only these can root a large trie
                    u, n = np.unique(key[counts[key & int(last)] > block], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n, pa.int64())], names=["shingle", "n"])
                    continue
                who = np.concatenate(owners) if owners else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids, pa.int64()).take(pa.array(who)), pa.array(sizes, pa.int32()).take(pa.array(who)), pa.array(sketches, pa.binary()).take(pa.array(who))],
                    names=["shingle", "k", "size", "sketch"],
                )

        return run

    slim = source.select("k", "shingles")
    postings = slim.mapInArrow(prefixes(True), "shingle bigint, k bigint, size int, sketch binary")
    hot = slim.mapInArrow(prefixes(False), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    hot = checkpoint(hot.select("shingle", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if hot.isEmpty():
        postings = postings.withColumns({"lo": F.lit(0), "hi": F.lit(0), "mine": F.lit(0)})
    else:
        mine = F.pmod(F.xxhash64("k"), F.coalesce("blocks", F.lit(1))).cast("int")
        postings = (
            postings.join(hot, "shingle", "left").withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
            .select("shingle", "k", "size", "sketch", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")
        )
    groups = postings.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi", "mine")

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []
        seen: set = set()

        def members(columns: list) -> list[tuple]:
            key, ids, sizes, sketches, lo, hi, mine = columns
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            bounds = np.concatenate([[0], edge, [len(key)]])
            for k in np.flatnonzero(np.diff(bounds) > 1):
                a, e = int(bounds[k]), int(bounds[k + 1])
                bits = [int.from_bytes(x.as_py(), "big") for x in sketches[a:e]]
                split = None if lo[a] == hi[a] else int(np.searchsorted(mine[a:e], hi[a]))
                for i, j in trie.join(bits, sizes[a:e].tolist(), threshold, split):
                    x, y = int(ids[a + i]), int(ids[a + j])
                    if x != y:
                        yield (x, y) if x < y else (y, x)

        def flush(columns: list) -> pa.RecordBatch | None:
            pairs = [p for p in dict.fromkeys(members(columns)) if p not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(pairs)
            if not pairs:
                return None
            x, y = zip(*pairs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

        for b in batches:
            if not b.num_rows:
                continue
            rest.append(b)
            t = pa.Table.from_batches(rest).combine_chunks()
            key = t["shingle"].to_numpy()
            lo, hi = t["lo"].to_numpy(), t["hi"].to_numpy()
            same = (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1])
            whole = int(np.argmax(same))  # the last group may go on in the next batch
            if whole:
                out = flush(_columns(t.slice(0, whole)))
                if out:
                    yield out
                t = t.slice(whole)
            rest = t.to_batches()
        if rest:
            out = flush(_columns(pa.Table.from_batches(rest)))
            if out:
                yield out

    candidates = checkpoint(groups.mapInArrow(tries, "x bigint, y bigint").distinct())
    wanted = _marks(candidates)
    marks = spark.sparkContext.broadcast(np.packbits(wanted))  # 1 MB, at most 32 MB; lets through every number in question and few others

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for b in batches:
            at = _place(b.column(0).to_numpy(), 8 * len(bits))
            yield b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    sets = checkpoint(source.mapInArrow(marked, "k bigint, shingles binary, class_id binary"))
    left = sets.select(F.col("k").alias("x"), F.col("shingles").alias("sa"), F.col("class_id").alias("a"))
    right = sets.select(F.col("k").alias("y"), F.col("shingles").alias("sb"), F.col("class_id").alias("b"))

    def verify(a, b, sa, sb):
        out = []
        for x, y, p, q in zip(a, b, sa, sb, strict=True):
            u, v = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
            both = len(np.intersect1d(u, v, assume_unique=True))
            similarity = both / (len(u) + len(v) - both)
            if similarity >= threshold - 1e-12:
                out.append((min(x, y), max(x, y), similarity))
        return list(zip(*out, strict=True)) or [[]] * 3

    return map_batches(candidates.join(left, "x").join(right, "y").select("a", "b", "sa", "sb"), verify, "a binary, b binary, similarity double")


def _place(k: np.ndarray, size: int) -> np.ndarray:
    return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _marks(candidates: DataFrame) -> np.ndarray:
    """A table of the numbers in candidates, a truth value a place."""
    size = _table_size(16 * candidates.count(), *MARKS)

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_place(b.column(0).to_numpy(), size)] = True
            bits[_place(b.column(1).to_numpy(), size)] = True
        return bits

    return _united(candidates.select("x", "y"), mark, np.logical_or)


def _columns(t: pa.Table) -> list:
    t = t.combine_chunks()
    one = lambda n: t[n].chunk(0) if t[n].num_chunks else pa.array([], t[n].type)
    return [t["shingle"].to_numpy(), t["k"].to_numpy(), t["size"].to_numpy(), one("sketch"), t["lo"].to_numpy(), t["hi"].to_numpy(), t["mine"].to_numpy()]


def _prepared(chunks: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    return checkpoint(class_members(chunks)), class_links(class_sets(chunks), threshold)


def similar_pairs(chunks: DataFrame, threshold: float = THRESHOLD, copies: int = COPIES) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b, of chunks of different files whose similarity reaches the threshold.

    Equal contents are pairs too. Of a text with more than `copies` identical chunks two stand for all: the first, and the
    first in another file. Every other copy is paired with one of them that lies in another file than itself, and they
    are paired with all similar texts, so each of these finds one in another file. Where all copies lie in one file, none
    can stand for them elsewhere, and all are kept. Texts that differ in case, blanks or signs alone are different texts.
    """
    members, links = _prepared(chunks, threshold)
    known = members.select("chunk_id", F.struct("project_id", "file_path").alias("file"), "class_id", "text_id")
    large = checkpoint(known.groupBy("text_id").agg(F.count("*").alias("n")).filter(F.col("n") > copies).select("text_id"))
    kept, stars = known, None
    if not large.isEmpty():
        copied = known.join(large, "text_id")
        rank = F.row_number().over(Window.partitionBy("text_id").orderBy("chunk_id", "file"))
        two = copied.groupBy("text_id", "file").agg(F.min("chunk_id").alias("chunk_id")).withColumn("rank", rank).filter("rank <= 2")
        one = lambda k: F.min(F.when(F.col("rank") == k, F.struct("chunk_id", "file")))
        copied = checkpoint(copied.join(two.groupBy("text_id").agg(one(1).alias("first"), one(2).alias("second")), "text_id"))
        stands = F.col("second").isNull() | F.struct("chunk_id", "file").isin(F.col("first"), F.col("second"))
        kept = known.join(large, "text_id", "left_anti").unionByName(copied.filter(stands).select(known.columns))
        centre = F.when(F.col("file") != F.col("first.file"), F.col("first")).otherwise(F.col("second"))
        stars = copied.filter(~stands).select(F.col("chunk_id").alias("x"), centre["chunk_id"].alias("y"), F.col("file").alias("fx"), centre["file"].alias("fy"))
    one = kept.select(F.col("class_id").alias("a"), F.col("chunk_id").alias("x"), F.col("file").alias("fx"))
    two = kept.select(F.col("class_id").alias("b"), F.col("chunk_id").alias("y"), F.col("file").alias("fy"))
    between = links.join(one, "a").join(two, "b").select("x", "y", "fx", "fy")
    within = one.join(two, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y", "fx", "fy")
    pairs = between.unionByName(within)
    if stars is not None:
        pairs = pairs.unionByName(stars)
    return (
        pairs.filter((F.col("fx") != F.col("fy")) & (F.col("x") != F.col("y")))
        .select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()
    )


def near_duplicate_groups(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a chunk with at least 40 words: (chunk_id, class_id, links, group_id); a class has the texts with the same words and
    the smallest of its chunk ids as its id, links counts similar other classes, group_id is the smallest class id that chains of
    links reach."""
    members, links = _prepared(chunks, threshold)
    heads = checkpoint(members.groupBy("class_id").agg(F.min("chunk_id").alias("head")))
    a, b = (heads.select(F.col("class_id").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    linked = checkpoint(links.join(a, "a").join(b, "b").select("ha", "hb"))
    counts = linked.select("ha").union(linked.select("hb")).groupBy(F.col("ha").alias("head")).agg(F.count("*").alias("links"))
    groups = connected_components(linked.select(F.col("ha").alias("src"), F.col("hb").alias("dst"))).select(F.col("node").alias("head"), F.col("component").alias("group_id"))
    return (
        members.select("chunk_id", "class_id").distinct().join(heads, "class_id").join(counts, "head", "left").join(groups, "head", "left")
        .select("chunk_id", F.col("head").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "head").alias("group_id"))
    )


def class_pairs(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class_a, class_b, similarity), class_a < class_b, for all pairs of similar classes, named as in near_duplicate_groups; with
    its membership they say everything about similar chunks."""
    members, links = _prepared(chunks, threshold)
    heads = checkpoint(members.groupBy("class_id").agg(F.min("chunk_id").alias("head")))
    a, b = (heads.select(F.col("class_id").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    return links.join(a, "a").join(b, "b").select(F.least("ha", "hb").alias("class_a"), F.greatest("ha", "hb").alias("class_b"), "similarity")
