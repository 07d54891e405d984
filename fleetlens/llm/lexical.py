"""Ranked lexical search by bag deduplication.

Documents are cut down to the words that some item asks for. Texts whose
counts of these words and whose length step agree cannot be told apart by any
score, so they form one class: rows are grouped by a hash and told apart by
the whole vector. Each class is scored once against the items that share a
word with it; every task keeps the best classes of each item, and the best of
all tasks are opened up into their documents by ascending key. A class never
needs more members than a ranking has places, so copies in any number cost
nothing beyond the grouping.

Items are taken in blocks of bounded size, so what a task holds of them is
bounded too: the words of the block, which items ask for them, their weights.

Defined results: a null text, or one without a word, is no document of the
collection; a null item text asks for nothing. Rows that share an item key are
one item with all their words. Rows that repeat a document key are documents
of their own. Null document keys come last among equal scores. Other columns
are ignored. Empty tables give an empty ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.session import staged

# Postings and items a block may hold, bytes of text looked at at once, pairs a scoring step may lay out.
BLOCK_POSTINGS, BLOCK_ITEMS = 500_000, 4096
PIECE_BYTES = 1 << 20
STEP_PAIRS = 1 << 21
LAST = np.iinfo(np.int64).max
_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text in order, A-Z folded, in lists of bounded size."""
    start = 0
    while start < len(text):
        stop = start + PIECE_BYTES
        piece = text[start:stop].translate(_FOLD)
        if stop < len(text) and text[stop : stop + 1].translate(_FOLD) != b" " and piece[-1:] != b" ":
            # The cut would split a word: go back to the last gap, or on to the next one.
            gap = piece.rfind(b" ")
            if gap >= 0:
                piece = piece[: gap + 1]
            else:
                while stop < len(text) and (more := text[stop : stop + PIECE_BYTES].translate(_FOLD)):
                    gap = more.find(b" ")
                    piece += more if gap < 0 else more[:gap]
                    stop += len(more) if gap < 0 else gap
                    if gap >= 0:
                        break
        yield piece.split()
        start += len(piece)


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, word) without repeats."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w for part in words(t or b"") for w in part}
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item", "word"])

    asked = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("binary").alias("text"))
    return asked.mapInArrow(each, "item long, word binary").distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, terms, tfs): words of each text, and the counts of those in ``vocabulary`` by ascending number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for t in batch.column(1):
                n, count = 0, Counter()
                for part in words(t.as_py() or b""):
                    n += len(part)
                    count.update(map(number, part))
                count.pop(None, None)
                own = sorted(count)
                lengths.append(n)
                terms += own
                tfs += map(count.__getitem__, own)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    asked = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    return asked.mapInArrow(each, "doc long, n long, terms array<int>, tfs array<int>")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Postings:
    """The words of a block, the items that ask for each, and the weights."""

    def __init__(self, items: list, vocabulary: dict[bytes, int], pairs: list[tuple[int, int]]):
        self.items, self.vocabulary = items, vocabulary
        terms, asking = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.lexsort((asking, terms))
        self.asking = asking[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(vocabulary) + 1))
        self.weights = np.zeros(len(vocabulary), np.int64)

    def weigh(self, n_docs: int, holding: dict[int, int]) -> None:
        for term, df in holding.items():
            self.weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def scores(self, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) for all items of the block (columns), in whole numbers."""
        owner = np.repeat(np.arange(len(m)), np.diff(ends))
        part = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner]))
        sizes = np.diff(self.starts)[terms]
        cell = np.repeat(owner * len(self.items), sizes) + self.asking[_ranges(self.starts[terms], sizes)]
        part = np.repeat(part, sizes)
        # Halves of 2**31 keep every sum of doubles whole: fewer than 2**22 words meet in one cell.
        total = np.zeros(len(m) * len(self.items), np.int64)
        for shift, half in ((31, part >> 31), (0, part & 0x7FFFFFFF)):
            if half.any():
                total += np.bincount(cell, half, len(total)).astype(np.int64) << shift
        return total.reshape(len(m), len(self.items))


class Best:
    """The ``top`` best classes of each item, by falling score and rising first document."""

    def __init__(self, n_items: int, top: int):
        self.top, self.n_items = top, n_items
        self.kept = [np.zeros(0, np.int64)] * 4  # item, score, first document, class
        self.floor = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        fresh = (item, scores[row, item], first[row], numbers[row])
        self.kept = [np.concatenate(p) for p in zip(self.kept, fresh, strict=True)]
        if len(self.kept[0]) > 4 * self.top * self.n_items:
            self.prune()

    def prune(self) -> list[np.ndarray]:
        item, score, first, number = self.kept
        order = np.lexsort((number, first, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.kept = [p[order][place < self.top] for p in self.kept]
        full = place == self.top - 1
        self.floor[item[full]] = score[order][full]
        return self.kept


def _best_classes(classes: DataFrame, postings, top: int) -> DataFrame:
    """(item, score, first, cls): each task's best classes of every item of the block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = postings.value
        best = Best(len(block.items), top)
        asked = np.diff(block.starts)
        for batch in batches:
            number = batch.column("cls").to_numpy()
            first = batch.column("first").fill_null(LAST).to_numpy()
            m = batch.column("m").to_numpy()
            terms, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            ends = np.concatenate(([0], np.cumsum(batch.column("terms").value_lengths().to_numpy())))
            pairs = np.concatenate(([0], np.cumsum(asked[terms])))[ends]
            rows = max(1, STEP_PAIRS // max(1, len(block.items)))
            start = 0
            while start < len(m):
                stop = int(np.searchsorted(pairs, pairs[start] + STEP_PAIRS, "right")) - 1
                stop = min(max(stop, start + 1), start + rows, len(m))
                a, z = ends[start], ends[stop]
                scores = block.scores(m[start:stop], ends[start : stop + 1] - a, terms[a:z], tfs[a:z])
                best.add(scores, first[start:stop], number[start:stop])
                start = stop
        item, score, first, cls = best.prune()
        if len(item):
            ids = [block.items[i] for i in item.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(score), pa.array(first), pa.array(cls)], ["item", "score", "first", "cls"]
            )

    return classes.select("cls", "first", "m", "terms", "tfs").mapInArrow(each, "item long, score long, first long, cls long")


def _blocks(asked: DataFrame) -> Iterator[Postings]:
    """The items in blocks of at most BLOCK_POSTINGS postings and BLOCK_ITEMS items (one item at least)."""
    total = asked.agg(F.count("*"), F.count_distinct(F.coalesce("item", F.lit(0)))).first()
    n = max(-(-total[0] // BLOCK_POSTINGS), -(-total[1] // BLOCK_ITEMS))
    while n > 0:
        cut = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
        sizes = cut.groupBy("block", "item").agg(F.count("*").alias("n")).groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
        if sizes.where((F.col("k") > 1) & ((F.col("n") > BLOCK_POSTINGS) | (F.col("k") > BLOCK_ITEMS))).isEmpty():
            break
        n *= 2
    for block in range(n):
        rows = cut.where(F.col("block") == block).select("item", "word").toArrow()
        pairs = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
        items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        if items:
            place = {i: p for p, i in enumerate(items)}
            vocabulary = {w: t for t, w in enumerate(sorted({w for _, w in pairs}))}
            yield Postings(items, vocabulary, [(vocabulary[w], place[i]) for i, w in pairs])


def _search(docs: DataFrame, block: Postings, top: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = staged(bags(docs, block.vocabulary, key, text).where("n > 0"), "lexical-bags")
    n_docs, n_words = rows.agg(F.count("*"), F.sum("n")).first()
    # One row per word of the block at most.
    holding = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    block.weigh(n_docs, dict(zip(holding.column(0).to_pylist(), holding.column(1).to_pylist(), strict=True)))
    m = F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {n_words or 1}L")
    vectors = rows.where(F.size("terms") > 0).select("doc", m.alias("m"), "terms", "tfs")
    vectors = vectors.withColumn("h", F.xxhash64("m", "terms", "tfs"))
    same = ["h", "m", "terms", "tfs"]
    # Rows meet by hash; equal hashes of unequal vectors stay apart, as the whole vector is part of the key.
    grouped = vectors.groupBy(*same).agg(F.min("doc").alias("first")).withColumn("cls", F.monotonically_increasing_id())
    classes = staged(grouped, "lexical-classes")
    first = Window.partitionBy("item").orderBy(F.desc("score"), "first", "cls")
    found = _best_classes(classes, spark.sparkContext.broadcast(block), top)
    winners = staged(found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top), "lexical-winners")
    chosen = staged(classes.join(winners.select("cls").distinct(), "cls", "left_semi").select("cls", *same), "lexical-chosen")
    # At most ``top`` hashes per item of the block, eight bytes each.
    members = vectors.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi")
    order = F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc")))
    opened = members.withColumn("r", order).where(F.col("r") <= top).join(chosen, same).select("cls", "doc")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = winners.select("item", "score", "cls").join(opened, "cls").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= top).select("item", "rank", "doc", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item, rank, doc, score): the ``top`` documents of highest score above 0 for each item, equal scores by key."""
    asked = staged(item_words(items, item, item_text), "lexical-items")
    found = [_search(docs, block, top, key, text) for block in _blocks(asked)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item long, rank int, doc long, score long")
    return reduce(DataFrame.unionByName, found)
