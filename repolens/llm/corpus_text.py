"""Operators 7 to 9 on documents: packing into containers, leaked test passages, languages.

Null and blank texts never fail: they have no tokens (container 0), no leaks and no language. Repeated texts are
treated like any others, row by row. Columns that aren't named are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.batches import map_batches, map_rows
from ..operators.collections import top_per_group
from ..session import checkpoint, ship
from . import language, leaks, packing

TOKENIZER = os.environ.get("REPOLENS_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_ENCODINGS: dict[str, object] = {}


# --- 7 -------------------------------------------------------------------------------------------------------------
def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        # Fixed value: the public pattern that belongs to the vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of whole texts; 0 for null and empty ones."""

    def batch(ids, texts):
        encode = _encoding(tokenizer).encode_ordinary
        return ids, [len(encode(t)) if t else 0 for t in texts]

    return map_batches(documents.select("doc_id", "text"), batch, "doc_id bigint, tokens int")


def pack(sizes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """sizes(doc_id, tokens) -> rows (doc_id, part, first_token, tokens, container_id) and the number of containers.

    A document above the capacity is divided into full parts and a rest; no other is. The driver holds only the
    histogram of sizes (capacity + 1 numbers) and, for each partition, the number of its items by size (partitions plus
    capacity rows, as partitions are ranges of sizes). Ranks come from ranges, so a size that a third of all
    documents share spreads over as many tasks as its rows need.
    """
    spark = sizes.sparkSession
    ship(spark)

    def parts(doc_id, n):
        n = n or 0
        full, rest = divmod(n, capacity)
        for k in range(full):
            yield doc_id, k, k * capacity, capacity
        if rest or not full:
            yield doc_id, full, full * capacity, rest

    items = map_rows(sizes.select("doc_id", "tokens"), parts, "doc_id bigint, part int, first_token int, tokens int")
    ranged = checkpoint(items.repartitionByRange("tokens", "doc_id", "part").sortWithinPartitions("tokens", "doc_id", "part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(capacity + 1, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).to_numpy(), minlength=capacity + 1)
        at = np.flatnonzero(total)
        me = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), me), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["partition", "tokens", "n"]
        )

    counts = ranged.select("tokens").mapInArrow(count, "partition int, tokens int, n bigint").collect()
    histogram: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r.tokens, r.partition)):
        offsets[r.partition, r.tokens] = histogram.get(r.tokens, 0)
        histogram[r.tokens] = histogram.get(r.tokens, 0) + r.n
    runs, containers = packing.plan(histogram, capacity)
    grouped: dict[int, list] = {}
    for r in runs:
        grouped.setdefault(r.size, []).append((r.rank, r.container, r.each))
    by_size = {k: np.array(v, np.int64) for k, v in grouped.items()}
    shared = spark.sparkContext.broadcast((offsets, by_size))  # a plan's runs, whose number depends on the capacity only

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, table = shared.value
        me = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            size = b.column(3).to_numpy()
            out = np.zeros(len(size), np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]])) if len(size) else []
            for a, e in zip(cuts, [*cuts[1:], len(size)], strict=True):
                s = int(size[a])
                start = seen.get(s, offset[me, s])
                seen[s] = start + e - a
                if s:
                    rank = np.arange(start, start + e - a)
                    t = table[s]
                    k = np.searchsorted(t[:, 0], rank, "right") - 1
                    out[a:e] = t[k, 1] + (rank - t[k, 0]) // t[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["doc_id", "part", "first_token", "tokens", "container_id"])

    return ranged.mapInArrow(assign, "doc_id bigint, part int, first_token int, tokens int, container_id bigint"), containers


def containers(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """Assignment of all documents to containers of `capacity` tokens."""
    # cutting into ranges reads its input twice; texts are tokenised once
    return pack(checkpoint(token_counts(documents, tokenizer)), capacity)[0]


# --- 8 -------------------------------------------------------------------------------------------------------------
RUN, PASSAGE, RANK, COSINE = 13, 64, 48, 0.3
PARAPHRASE_COSINE = 0.6  # of paraphrases only; exact runs always need COSINE


ITEMS, ITEM_BYTES = 20_000, 1 << 25  # test items searched at once, and characters of their texts; more are searched in blocks


def _item_blocks(items: DataFrame) -> list[DataFrame]:
    """items in blocks of about `ITEMS` rows and `ITEM_BYTES` characters at most, by hash of the item's id and text."""
    rows = items.select("item_id", "query").filter("query IS NOT NULL").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("query")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    if blocks == 1:
        return [rows]
    rows = checkpoint(rows.withColumn("_b", F.pmod(F.xxhash64("item_id", "query"), F.lit(blocks))))
    return [rows.filter(F.col("_b") == k).drop("_b") for k in range(blocks)]


def _eval_items(items: DataFrame, run: int, passage: int) -> leaks.Items:
    """One block of test items, read in one piece."""
    return leaks.Items(sorted((r.item_id, r["query"]) for r in items.collect()), run, passage)


def _add_up(df: DataFrame, parts: int) -> DataFrame:
    """Sums float64 blobs, one a row, in two rounds of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

    return df.repartition(parts).mapInArrow(add, "blob binary").coalesce(1).mapInArrow(add, "blob binary")


def _summed(df: DataFrame, parts: int, size: int) -> np.ndarray:
    """Sum of float64 blobs of `size` numbers; zeros if there are none."""
    rows = _add_up(df, parts).collect()
    return np.frombuffer(rows[0].blob, np.float64) if rows else np.zeros(size)


class LeakSearch:
    """Latent semantic search of test items in documents.

    fit: documents are normalised and cut into overlapping passages of word ids (words of test items only; all others
    are one gap); inverse passage frequencies are counted over all passages; a randomised range finder (Y = A'(A W) over
    all passages, then QR) gives the `rank` leading directions of the TF-IDF passage matrix. Data on the driver are
    bounded by the vocabulary of a block of test items, never by the documents.
    """

    def __init__(self, documents: DataFrame, items: DataFrame, run: int = RUN, passage: int = PASSAGE, rank: int = RANK, seed: int = 7):
        spark = documents.sparkSession
        ship(spark)
        found = _eval_items(items, run, passage)
        shared = spark.sparkContext.broadcast(found)
        self.items, self.shared = found, shared
        d = len(found.vocabulary)

        def encode(doc_id, text):
            if text:
                variants = {found_ids.tobytes(): found_ids for found_ids in (shared.value.ids(leaks.words(text, n)) for n in _readings(text))}
                for ids in variants.values():
                    if (ids >= 0).any():
                        yield doc_id, ids.tobytes()

        self.encoded = checkpoint(map_rows(documents.select("doc_id", "text"), encode, "doc_id bigint, ids binary", flush=2000))
        if not d:
            self.idf, self.basis = np.zeros(0, np.float32), np.zeros((0, 0), np.float32)
            return

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + 1, np.float64)
            for _, passages in _passages(batches, shared.value):
                flat = np.concatenate(passages).astype(np.int64)
                row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
                keep = flat >= 0
                total[:d] += np.bincount(np.unique(row[keep] * d + flat[keep]) % d, minlength=d)
                total[d] += len(passages)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

        parts = max(1, int(self.encoded.rdd.getNumPartitions() ** 0.5))
        counts = _summed(self.encoded.mapInArrow(frequencies, "blob binary"), parts, d + 1)
        self.idf = np.log((1 + counts[d]) / (1 + counts[:d])).astype(np.float32)
        idf, width = self.idf, min(d, rank + 8)
        start = np.random.default_rng(seed).standard_normal((d, width)).astype(np.float32)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, width), np.float64)
            for _, passages in _passages(batches, shared.value):
                m = leaks.Rows(passages, idf)
                total += m.transposed_times(m.times(start), d)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

        q, r = np.linalg.qr(_summed(self.encoded.mapInArrow(sketch, "blob binary"), parts, d * width).reshape(d, width))
        lead = np.argsort(-np.abs(np.diag(r)), kind="stable")[: min(rank, d)]
        self.basis = np.ascontiguousarray(q[:, lead], np.float32)

    def search(self, cosine: float = COSINE, paraphrase: float | None = None, paraphrase_cosine: float = PARAPHRASE_COSINE) -> DataFrame:
        """(doc_id, item_id, run, share, answer) for passages whose latent cosine with a window of an item reaches `cosine`.

        Every pair of a passage and an item whose cosine is high enough is a candidate. Its longest common subsequence must have
        `run` words; then run says whether it holds `run` words of the item in a row (exact check). With `paraphrase`,
        pairs without such a run whose common subsequence is at least this share of the shorter text and which hold most of the item's
        rarest words - these stand for an answer, as items have none - are reported too, if the cosine reaches
        `paraphrase_cosine` as well. The exact runs are the same ones either way.
        """
        found, idf, basis = self.items, self.idf, self.basis
        schema = "doc_id bigint, item_id bigint, run boolean, share double, answer double"
        spark = self.encoded.sparkSession
        if not found.vocabulary or not found.windows:
            return spark.createDataFrame([], schema)
        rows = leaks.Rows([w for _, w in found.windows], idf).times(basis)
        windows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        owner = np.array([k for k, _ in found.windows])
        rare = [set(np.unique(ids)[np.argsort(-idf[np.unique(ids)], kind="stable")[:5]].tolist()) for _, ids in found.items]
        run = found.run
        # for each word the items it stands in
        pairs = np.unique(np.concatenate([ids.astype(np.int64) * len(found.items) + k for k, (_, ids) in enumerate(found.items)]))
        posts = np.split(pairs % len(found.items), np.searchsorted(pairs // len(found.items), np.arange(1, len(found.vocabulary))))
        shared = spark.sparkContext.broadcast((found, idf, basis, windows, owner, rare, posts))  # bounded by a block of test items

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            it, idf, basis, windows, owner, rare, posts = shared.value
            at: dict[int, dict] = {}  # places of the words of items met so far
            out: set[tuple] = set()
            for docs, passages in _passages(batches, it, run):  # fewer words of items can't hold a common subsequence of `run` words
                m = leaks.Rows(passages, idf).times(basis)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
                near = m @ windows.T
                candidates = np.flatnonzero(near.max(1) >= cosine)
                if not len(candidates):
                    continue
                may = leaks.with_run([passages[i] for i in candidates], run)  # passages without such a row of words have no exact run
                for i, exact in zip(candidates.tolist(), may.tolist(), strict=True):
                    if not exact and paraphrase is None:
                        continue
                    p = passages[i]
                    runs = []
                    if exact:
                        starts = np.flatnonzero(np.convolve((p >= 0).astype(np.int32), np.ones(run, np.int32), "valid") == run)
                        runs = [p[a : a + run].tobytes() for a in starts]
                        if paraphrase is None:  # what can't be part of a run needn't be compared
                            inside = np.zeros(len(p), bool)
                            for k in range(run):
                                inside[starts + k] = True
                            p = p[inside]
                    words = p.tolist()
                    # an item that shares fewer words can't share a subsequence of that length
                    common = np.bincount(np.concatenate([posts[w] for w in words if w >= 0]), minlength=len(it.items))
                    near_enough = np.bincount(owner[near[i] >= cosine], minlength=len(it.items))
                    close = set(owner[near[i] >= max(cosine, paraphrase_cosine)].tolist()) if paraphrase is not None else ()
                    for k in np.flatnonzero((common >= run) & (near_enough > 0)).tolist():
                        if not exact and k not in close:
                            continue
                        ids = it.items[k][1]
                        if k not in at:
                            at[k] = leaks.places(ids)
                        n = leaks.longest_common(at[k], len(ids), words)
                        if n < run:
                            continue
                        if any(k in it.runs.get(r, ()) for r in runs):
                            out.add((docs[i], it.items[k][0], True, None, None))
                        elif k in close and n >= paraphrase * min(len(ids), len(p)):
                            answer = len(rare[k].intersection(words)) / max(1, len(rare[k]))
                            if answer >= 0.6:
                                out.add((docs[i], it.items[k][0], False, n / len(ids), answer))
            cols = list(zip(*sorted(out, key=str), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()), strict=True)],
                                             names=["doc_id", "item_id", "run", "share", "answer"])

        return self.encoded.mapInArrow(look, schema)


def _readings(text: str) -> tuple[bool, ...]:
    """Numbers at line starts are list marks or words; a text with any is read both ways."""
    return (True, False) if leaks.NUMBERED.search(text) else (True,)


def _passages(batches: Iterator[pa.RecordBatch], items: leaks.Items, least: int = 1, block: int = 2000) -> Iterator[tuple[list, list]]:
    docs: list = []
    passages: list = []
    for b in batches:
        for doc_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ps = items.passages(np.frombuffer(blob, np.int32), least)
            passages += ps
            docs += [doc_id] * len(ps)
            while len(passages) >= block:
                yield docs[:block], passages[:block]
                docs, passages = docs[block:], passages[block:]
    if passages:
        yield docs, passages


def _leaks(documents: DataFrame, items: DataFrame, paraphrase: float | None = None) -> DataFrame:
    """Finds of all items, a search for each block of them."""
    parts = [LeakSearch(documents, block).search(paraphrase=paraphrase) for block in _item_blocks(items)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold 13 consecutive words of an item."""
    return _leaks(documents, items).filter("run").select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, paraphrase: float = 0.6) -> DataFrame:
    """Exact and paraphrased leaks: (doc_id, item_id, exact, share, answer), one row a pair."""
    found = _leaks(documents, items, paraphrase)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("exact"), F.max("share").alias("share"), F.max("answer").alias("answer"))


# --- 9 -------------------------------------------------------------------------------------------------------------
def language_model(samples: DataFrame, most: int = language.MAX_SAMPLES) -> language.Model:
    """Fitted on a bounded sample of clean labelled texts: at most `most` rows, equally many of each language, chosen by hash."""
    known = samples.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    each = max(1, most // max(1, known.select("lang").distinct().count()))
    rows: list[Row] = top_per_group(known, ["lang"], each, F.xxhash64("text"), F.col("text")).select("lang", "text").collect()
    return language.train([(r.lang, r.text) for r in rows])


def languages(documents: DataFrame, model: language.Model) -> DataFrame:
    """Each document's languages: (doc_id, label, lang, confidence, sentences, several); label is the given one as a code.
    No row for documents without running text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def batch(ids, langs, texts):
        out = []
        for doc_id, given, f in zip(ids, langs, language.detect(texts, shared.value), strict=True):
            out += [(doc_id, language.label(given), x, c, n, len(f.langs) > 1) for x, c, n in f.langs]
        return list(zip(*out, strict=True)) or [[]] * 6

    return map_batches(documents.select("doc_id", "lang", "text"), batch,
                       "doc_id bigint, label string, lang string, confidence double, sentences int, several boolean")


def passages_by_language(documents: DataFrame, model: language.Model) -> DataFrame:
    """Passages of one language each: (doc_id, passage_no, start_line, lang, confidence)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def batch(ids, texts):
        out = []
        for doc_id, f in zip(ids, language.detect(texts, shared.value), strict=True):
            out += [(doc_id, n, *p) for n, p in enumerate(f.passages)]
        return list(zip(*out, strict=True)) or [[]] * 5

    return map_batches(documents.select("doc_id", "text"), batch, "doc_id bigint, passage_no int, start_line int, lang string, confidence double")


def mislabelled(documents: DataFrame, model: language.Model) -> DataFrame:
    """(doc_id, lang) of documents whose label is missing, wrong or not the only language."""
    return languages(documents, model).filter("several OR label IS NULL OR label <> lang").select("doc_id", "lang").distinct()
