"""Packing token sequences into windows of one size, online and in bounded space.

Every task tokenises the documents of its partition and keeps a fixed number
of windows open. What is longer than a window is cut into whole windows first;
the rest goes where it leaves the least room. When it fits nowhere and no more
windows may be opened, the fullest is emitted, topped up with the head of the
waiting document where its gap is worth a piece. Windows still open at the end
of a partition are merged: their tokens are numbered through all partitions
and cut anew every ``window`` tokens, and the one rest that remains becomes
sequences of powers of two, which need no padding.

Only the leftovers, a fixed number of windows per partition, are touched twice;
nothing is shuffled. Padding is below MIN_PIECE tokens in every sequence.

Words are remembered with their ids per worker. A text is cut at ASCII white
space, which the tokeniser drops and never joins over, so ids of a text are the
ids of its words; a full stop or comma behind an ASCII letter is a word of its
own for the same reason.

Defined results: a null or empty text has the end id alone. Rows that repeat a
key are documents of their own; a null key stays null. Other columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.session import staged

WINDOW, OPEN_WINDOWS, MIN_PIECE = 2048, 32, 16
PIECE_BYTES = 1 << 20
# Words a worker remembers, in two generations.
REMEMBERED_WORDS = 1_400_000
# New words that go to the library together.
JOINED_WORDS = 32
# A full stop or comma behind an ASCII letter at the end of a word.
_STOP = re.compile(rb"(?<=[A-Za-z])[.,](?=[ \t\n\r\x0b\x0c]|\Z)")
# Sequences of one partition, of 2**32 at most, follow those of the one before; merged leftovers come first.
PARTITION_STEP = 1 << 32
ROWS = "doc long, start long, length long, doc_tokens long, sequence_id long, offset long, place long, ids binary"


class WordIds:
    """Ids of texts by the ids of their words."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = {i for token, i in self.library.get_vocab().items() if token.endswith("</w>")}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words. A word of letters alone ends with its one id of the end-of-word kind, so such words go joined."""
        plain: list[bytes] = []
        other: list[bytes] = []
        for w in words:
            if (ids := self.older.get(w)) is not None:
                self.known[w] = ids
            else:
                (plain if w.decode().isalpha() else other).append(w)
        groups = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        for group, ids in zip(groups, self._encode([b" ".join(g).decode() for g in groups]), strict=True):
            ends = [i + 1 for i, number in enumerate(ids) if number in self.ends]
            if len(ends) != len(group) or ends[-1] != len(ids):
                other += group
                continue
            packed = array("I", ids).tobytes()
            start = 0
            for w, end in zip(group, ends, strict=True):
                self.known[w] = packed[4 * start : 4 * end]
                start = end
        for w, ids in zip(other, self._encode([w.decode() for w in other]), strict=True):
            self.known[w] = array("I", ids).tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, 4 bytes each, little-endian."""
        if len(self.known) > REMEMBERED_WORDS // 2:
            self.known, self.older = {}, self.known
        cut = [split_words(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in cut]
        gaps = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        self._learn(list({words[i] for words, at in zip(cut, gaps, strict=True) for i in at}))
        for words, ids, at in zip(cut, found, gaps, strict=True):
            for i in at:
                ids[i] = self.known[words[i]]
        return [b"".join(ids) for ids in found]


def split_words(text: bytes) -> list[bytes]:
    """The text cut where the tokeniser cuts in any case."""
    # Lower case can change what composes with a following mark and what is a special token: plain ASCII only.
    if text.isascii() and b"<|" not in text:
        text = text.lower()
    return _STOP.sub(rb" \g<0>", text).split()


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES cut at white space."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        stop = start + PIECE_BYTES
        found = [g for g in (text.rfind(c, start, stop) for c in (b" ", b"\n", b"\t", b"\r")) if g >= 0]
        if not found:
            found = [g for g in (text.find(c, stop) for c in (b" ", b"\n", b"\t", b"\r")) if g >= 0]
            if not found:
                break
            found = [min(found)]
        yield text[start : max(found) + 1]
        start = max(found) + 1
    yield text[start:]


class Packer:
    """Best fit over a fixed number of open windows; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, min_piece: int):
        self.window, self.limit, self.min_piece = window, open_windows, min_piece
        self.gaps: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def _place(self, at: int, gap: int, piece: tuple) -> list[tuple] | None:
        """Puts a piece into window ``at``; the window's pieces once it is full."""
        self.held[at].append(piece)
        if gap == len(piece[2]) // 4:
            return self.held.pop(at)
        insort(self.gaps, (gap - len(piece[2]) // 4, at))
        return None

    def _open(self) -> int:
        self.opened += 1
        self.held[self.opened] = []
        return self.opened

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Packs a document; yields the windows that are done."""
        n, start = len(ids) // 4, 0
        while start < n:
            size = min(self.window, n - start)
            at = bisect_left(self.gaps, (size, 0))
            if at < len(self.gaps):
                gap, where = self.gaps.pop(at)
            elif len(self.gaps) < self.limit or size == self.window:
                gap, where = self.window, self._open()
            else:
                gap, where = self.gaps.pop(0)
                if gap < self.min_piece:
                    yield self.held.pop(where)
                    continue
                size = gap
            full = self._place(where, gap, (doc, start, ids[4 * start : 4 * (start + size)], n))
            start += size
            if full is not None:
                yield full

    def rest(self) -> list[list[tuple]]:
        """Windows that are still open, the fullest first."""
        return [self.held[at] for _, at in self.gaps]


def _packed(docs: DataFrame, path: str, end_id: int, window: int, open_windows: int, min_piece: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder = Packer(window, open_windows, min_piece), word_ids(path)
        base = (TaskContext.get().partitionId() + 1) * PARTITION_STEP
        end, done = end_id.to_bytes(4, "little"), 0

        def rows(windows: list[list[tuple]], first: int | None) -> pa.RecordBatch:
            out, place = [], 0
            for i, pieces in enumerate(windows):
                offset = 0
                for doc, start, ids, n in pieces:
                    size = len(ids) // 4
                    out.append((doc, start, size, n, None if first is None else base + first + i, offset, place, ids))
                    offset += size
                    place += size
            names = ["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "place", "ids"]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            # Texts are taken together up to PIECE_BYTES, longer ones by pieces.
            keys, texts, size = [], [], 0
            ready: list[list[tuple]] = []

            def flush(keys=keys, texts=texts, ready=ready):
                for doc, ids in zip(keys, encoder.ids(texts), strict=True):
                    ready.extend(packer.add(doc, ids + end))
                keys.clear()
                texts.clear()

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                if len(text) > PIECE_BYTES:
                    flush()
                    ids = b"".join(encoder.ids([piece])[0] for piece in _pieces(text))
                    ready.extend(packer.add(doc, ids + end))
                    size = 0
                else:
                    keys.append(doc)
                    texts.append(text)
                    size += len(text)
                if size > PIECE_BYTES:
                    flush()
                    size = 0
                if len(ready) >= 512:
                    yield rows(ready, done)
                    done += len(ready)
                    ready.clear()
            flush()
            if ready:
                yield rows(ready, done)
                done += len(ready)
        yield rows(packer.rest(), None)

    asked = docs.select("doc", "text")
    return asked.mapInArrow(each, ROWS).withColumn("part", F.spark_partition_id())


def tail_edges(total: int, window: int) -> list[int]:
    """Starts of the sequences of the last, partial window: one power of two after the other, and the end."""
    edges, at = [], total - total % window
    for bit in range(window.bit_length(), -1, -1):
        if total % window >> bit & 1:
            edges.append(at)
            at += 1 << bit
    return [*edges, total]


def _merged(left: DataFrame, window: int) -> DataFrame:
    """Leftover pieces numbered through all partitions and cut every ``window`` tokens."""
    sizes = left.groupBy("part").agg(F.sum("length").alias("n"))
    # One row per partition of the scan.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = staged(sizes.select("part", "n", before.alias("base")), "packing-bases")
    total = bases.agg(F.sum("n")).first()[0] or 0
    edges = tail_edges(total, window)
    tail = F.array(*[F.lit(e).cast("long") for e in edges])
    at = left.join(F.broadcast(bases.select("part", "base")), "part").withColumn("at", F.col("base") + F.col("place"))
    until = F.col("at") + F.col("length")
    whole = (F.floor(F.col("at") / window) + 1) * window
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(whole), tail), lambda c: (c > F.col("at")) & (c < until))))
    edge = at.withColumn("edges", F.concat(F.array("at"), cuts, F.array(until)))
    runs = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.element_at("edges", i).alias("a"), F.element_at("edges", i + 1).alias("z")))
    parts = edge.select("*", F.inline(runs))
    last = F.filter(tail, lambda e: e <= F.col("a"))
    in_tail = F.col("a") >= edges[0]
    n_whole = total // window
    first = F.when(in_tail, F.element_at(last, -1)).otherwise(F.col("a") - F.pmod("a", F.lit(window)))
    number = F.when(in_tail, F.lit(n_whole) + F.size(last) - 1).otherwise(F.floor(F.col("a") / window))
    skip, size = F.col("a") - F.col("at"), F.col("z") - F.col("a")
    ids = F.substring(F.col("ids"), (skip * 4 + 1).cast("int"), (size * 4).cast("int"))
    return parts.select(
        "doc", (F.col("start") + skip).alias("start"), size.alias("length"), "doc_tokens",
        number.cast("long").alias("sequence_id"), (F.col("a") - first).cast("long").alias("offset"), ids.alias("ids"),
    )


def pack(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1,
    window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE,
) -> DataFrame:
    """(doc, start, length, doc_tokens, sequence_id, offset, ids): pieces of all documents in sequences of ``window`` tokens.

    ``ids`` are unsigned 32-bit little-endian numbers. ``window`` is a power of two.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("the window must be a power of two")
    asked = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    rows = staged(_packed(asked, path, end_id, window, open_windows, min_piece), "packing")
    names = ["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    done = rows.where("sequence_id is not null").select(*names)
    return done.unionByName(_merged(rows.where("sequence_id is null"), window).select(*names))
