"""Substring dedup with suffix automata of reference shards.

A window is ``length`` consecutive words of one document; a word goes when a
window over it also starts in a document with a smaller key.

1. Every document is winnowed: each window names its smallest word run of
   ``length // 3`` words as its anchor, so equal windows name equal anchors.
2. Per anchor, the smallest key that has it is its leader. Windows of anchors
   that only one document has cannot repeat and end here. The leaders of frequent
   anchors, fewer than a thousand, go to the rows instead of the rows to them.
3. The leaders' words around shared anchors are the reference. A leader is cut
   into pieces by the place of the anchor, and every window that names an anchor
   goes with it, so a suspect needs one piece only. Pieces are dealt into shards;
   of a piece that repeats itself only distinct windows are kept. A shard becomes
   a suffix automaton in the task that holds it, and the suspect words of other
   documents stream past it for their matching statistics. A shard with many
   suspects is built in several tasks.
   The corpus is its own reference here and grows with it, so shards are dealt
   out with their suspects, not sent to every task.
4. Suspect windows that their leader's shard does not have (edges of passages,
   mostly) are compared among themselves by two 64-bit hashes of their words.

Defined results: a null or blank text has no words; rows without key lose
nothing and make nothing else lose; equal keys are not smaller than each
other; rows are told apart by key and text, so repeated rows get equal
results; an empty table gives no rows. Extra columns are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetlens.llm.text import grams, mix, powers, text_buffer, word_hashes
from fleetlens.operators.joins import lookup_join
from fleetlens.session import staged

LENGTH = 50
SHARD_WORDS = 60_000  # reference words of one automaton
PIECES = 4  # pieces of a long leader that fill a shard
STREAM_WORDS = 2_000_000  # suspect words streamed past one copy of an automaton
HOT_SHARE = 1000  # an anchor is hot when it has more than one row in so many
SPAN = 1 << 22  # windows of one text winnowed at once
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # any odd numbers


class SuffixAutomaton:
    """Suffix automaton of word sequences that are added by ascending owner.

    ``owner[v]`` is the smallest owner of the sequences of state v: states are made when a sequence first occurs,
    and a split state keeps the older owner.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.owner = [-1], [0], [-1]

    def _state(self, size: int, owner: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.owner.append(owner)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The part of q reached from p by one word, as a state of its own."""
        clone = self._state(self.size[p] + 1, self.owner[q], self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], owner: int) -> None:
        last, nexts, links, sizes = 0, self.next, self.link, self.size
        for w in words:
            p, q = last, nexts[last].get(w)
            if q is not None:
                last = q if sizes[q] == sizes[p] + 1 else self._split(p, q, w)
                continue
            last = self._state(sizes[p] + 1, owner, {}, 0)
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = last
                p = links[p]
            if p >= 0:
                q = nexts[p][w]
                links[last] = q if sizes[q] == sizes[p] + 1 else self._split(p, q, w)

    def matches(self, words: list[int], length: int, owner: int) -> np.ndarray:
        """For each window of the words, whether a smaller owner has it."""
        found = np.zeros(max(0, len(words) - length + 1), bool)
        v, n, nexts, links, sizes, owners = 0, 0, self.next, self.link, self.size, self.owner
        for i, w in enumerate(words):
            while v and w not in nexts[v]:
                v = links[v]
                n = sizes[v]
            if w in nexts[v]:
                v = nexts[v][w]
                n += 1
            if n >= length:
                while sizes[links[v]] >= length:
                    v = links[v]
                    n = sizes[v]
                if owners[v] < owner:
                    found[i - length + 1] = True
        return found


def _same_row(key: str, text: str) -> list[Column]:
    return [F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text")]


def winnow(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each run of windows with one anchor."""
    size = max(1, length // 3)
    width = length - size + 1
    hashes, lows, highs = [], [], []
    for start in range(0, len(words) - length + 1, SPAN):
        part = grams(words[start : start + SPAN + length - 1], size)
        # The place in the low bits lets equal hashes go to the leftmost.
        least = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(at)])) - 1
        hashes.append(part[at[first]]), lows.append(first + start), highs.append(last + start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(lows), np.concatenate(highs)


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """(h, id, body, lo, hi): the anchors of every row and the windows that name them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                words, first = word_hashes(*text_buffer(part.column(2)))
                found = [winnow(words[first[i] : first[i + 1]], length) for i in range(len(part))]
                row = np.repeat(np.arange(len(part)), [len(f[0]) for f in found])
                h, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                    names=["h", "id", "body", "lo", "hi"],
                )

    return rows.where("id IS NOT NULL").mapInArrow(find, "h long, id long, body long, lo long, hi long")


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending, overlapping or touching ranges joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _distinct(words: np.ndarray, ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The ranges of windows without those that occur earlier in them."""
    at = np.concatenate([np.arange(lo, hi + 1) for lo, hi in ranges])
    one, two = (k[at] for k in _window_keys(words, length))
    order = np.lexsort((at, two, one))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    kept = np.sort(at[order[new]])
    cut = np.flatnonzero(np.diff(kept) > 1) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(kept)])) - 1
    return list(zip(kept[first].tolist(), kept[last].tolist(), strict=True))


_SEGMENT = "shard int, part int, role int, owner long, body long, lo long, words binary"


def _segments(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Word hashes of reference runs (role 0) and suspect runs (role 1), each for its shard and part."""
    cut = rows.join(spans, ["id", "body"]).select("id", "body", "text", "spans")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                words, first = word_hashes(*text_buffer(part.column(2)))
                out: list[tuple] = []
                names = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)
                for k, (owner, body, own) in enumerate(names):
                    groups: dict[tuple, list] = {}
                    for s in own:
                        groups.setdefault((s["shard"], s["parts"], s["leader"] != owner, s["leader"]), []).append((s["lo"], s["hi"]))
                    for (shard, parts, suspect, leader), ranges in groups.items():
                        ranges = _runs(ranges)
                        if not suspect and sum(hi - lo + 1 for lo, hi in ranges) > SHARD_WORDS // PIECES:
                            ranges = _distinct(words[first[k] : first[k + 1]], ranges, length)
                        for lo, hi in ranges:
                            raw = words[first[k] + lo : first[k] + hi + length].tobytes()
                            if suspect:
                                out.append((shard, (owner * 31 + lo) % parts, 1, owner, body, lo, raw))
                            else:
                                out += [(shard, p, 0, owner, body, lo, raw) for p in range(parts)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    names=["shard", "part", "role", "owner", "body", "lo", "words"],
                )

    return cut.mapInArrow(take, _SEGMENT)


def _window_keys(words: np.ndarray, length: int) -> list[np.ndarray]:
    """Two independent hashes of every window."""
    out = []
    for base in BASES:
        n = len(words)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(base)) * powers(max(n, 1 << 16), base)[:n])))
        inverse = powers(max(n, 1 << 16), pow(base, -1, 1 << 64))[: n - length + 1]
        out.append(mix((sums[length:] - sums[: n - length + 1]) * inverse).view(np.int64))
    return out


_FOUND = "id long, body long, lo long, hi long, h1 long, h2 long"


def _matched(segments: DataFrame, length: int) -> DataFrame:
    """Window ranges that a smaller key has (h1 null), and single suspect windows the shard could not settle."""
    dealt = segments.repartition("shard", "part").sortWithinPartitions("shard", "part", "role", "owner", "lo")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for batch in batches:
            for at in range(0, len(batch), 256):
                cols = [c.to_pylist() for c in batch.slice(at, 256).columns]
                ids, bodies, lows, highs, keys = [], [], [], [], ([], [])
                for shard, part, role, owner, body, lo, raw in zip(*cols, strict=True):
                    if (shard, part) != now:
                        now, automaton = (shard, part), SuffixAutomaton()
                    words = np.frombuffer(raw, np.uint64)
                    if role == 0:
                        automaton.add(words.tolist(), owner)
                        continue
                    hit = automaton.matches(words.tolist(), length, owner)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    free = np.flatnonzero(~hit)
                    n = len(edges) // 2 + len(free)
                    ids.append(np.full(n, owner)), bodies.append(np.full(n, body))
                    lows.append(np.concatenate((edges[0::2], free)) + lo)
                    highs.append(np.concatenate((edges[1::2] - 1, free)) + lo)
                    made = _window_keys(words, length) if len(free) else [free, free]
                    for k in range(2):
                        keys[k].append(np.concatenate((np.zeros(len(edges) // 2, np.int64), made[k][free] if len(free) else free)))
                    settled = np.concatenate((np.ones(len(edges) // 2, bool), np.zeros(len(free), bool)))
                    lows[-1] = lows[-1] * 2 + settled  # the mark travels with the place until the columns are made
                if not ids:
                    continue
                lo = np.concatenate(lows)
                arrays = [np.concatenate(ids), np.concatenate(bodies), lo >> 1, np.concatenate(highs)]
                mask = (lo & 1).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.astype(np.int64)) for a in arrays] + [pa.array(np.concatenate(k).astype(np.int64), mask=mask) for k in keys],
                    names=["id", "body", "lo", "hi", "h1", "h2"],
                )

    return dealt.mapInArrow(stream, _FOUND)


def _with_leaders(anchors: DataFrame, leaders: DataFrame) -> DataFrame:
    """``anchors`` with leader and piece of their h instead of h; a frequent anchor is joined where its rows are.

    Anchors with more than one row in HOT_SHARE are fewer than HOT_SHARE, so their leaders are broadcast.
    """
    least = anchors.count() // HOT_SHARE
    hot, cold = leaders.where(F.col("n") > least), leaders.where(F.col("n") <= least)
    hot = F.broadcast(hot.select("h", "leader", "piece"))
    rare = anchors.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold.select("h", "leader", "piece"), "h")
    return anchors.join(hot, "h").unionByName(rare).drop("h")


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """(id, body, lo, hi): ranges of windows that also start in a row with a smaller id."""
    anchors = staged(_anchors(rows, length), "anchors")
    # Any place of the anchor in its leader names the piece; the written table fixes which.
    place = F.floor(F.min_by("lo", "id") / (SHARD_WORDS // PIECES)).cast("int")
    found = anchors.groupBy("h").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n"), place.alias("piece"))
    leaders = staged(found.where("leader < last").select("h", "leader", "piece", "n"), "leaders")
    shared = staged(_with_leaders(anchors, leaders), "shared")
    reference = F.col("leader") == F.col("id")
    words = F.col("hi") - F.col("lo") + length // 2
    total = shared.where(reference).agg(F.sum(words)).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    placed = shared.withColumn("shard", F.pmod(F.xxhash64("leader", "piece"), F.lit(shards)).cast("int"))
    parts = placed.where(~reference).groupBy("shard").agg(F.ceil(F.sum(words) / STREAM_WORDS).cast("int").alias("parts"))
    spans = lookup_join(placed, parts, ["shard"]).groupBy("id", "body").agg(
        F.collect_list(F.struct("shard", "parts", "leader", "lo", "hi")).alias("spans")  # bounded by the row's own text
    )
    found = staged(_matched(_segments(rows, spans, length), length), "matched")
    open_ = found.where("h1 IS NOT NULL")
    twice = open_.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    late = open_.join(twice, ["h1", "h2"]).where("first < id")
    return found.where("h1 IS NULL").select("id", "body", "lo", "hi").unionByName(late.select("id", "body", "lo", "hi"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, joined: bool = False) -> DataFrame:
    """The input rows with ``text`` cut, and n_words, n_removed, removed (ranges of word numbers, end excluded).

    The text keeps its own white space, or with ``joined`` becomes the kept words joined by one space. Columns of
    the input called like the new ones are replaced.
    """
    rows = docs.select(*_same_row(key, text))
    spans = repeated_windows(rows, length).groupBy("id", "body").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    carried = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "removed")]
    packed = docs.select(
        F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("body"), F.col(text).cast("string").alias("_text"), F.struct(*carried).alias("_rest")
    )
    cut = packed.join(spans, ["id", "body"], "left").select("_text", "_spans", "_rest")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts, counts, lost, ranges = [], [], [], []
                for t, own in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (t or b"").split()
                    gone = [(lo, hi + 1) for lo, hi in _runs([(s["lo"], s["hi"] + length - 1) for s in own or []])]
                    counts.append(len(words)), ranges.append([{"start": a, "end": b} for a, b in gone])
                    lost.append(sum(b - a for a, b in gone))
                    if joined:
                        kept, last = [], 0
                        for a, b in gone:
                            kept += words[last:a]
                            last = b
                        texts.append(b" ".join(kept + words[last:]))
                    else:
                        texts.append(_without(t, words, gone) if gone else t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
                     pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), part.column(2)],
                    names=["text", "n_words", "n_removed", "removed", "rest"],
                )

    rest = T.StructType([docs.schema[c] for c in carried])
    schema = T.StructType().add("text", "string").add("n_words", "long").add("n_removed", "long")
    ranges_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = schema.add("removed", ranges_type).add("rest", rest)
    out = cut.mapInArrow(remove, schema)
    whole = {c: F.col("rest").getField(c) for c in carried} | {text: F.col("text")}
    extra = [F.col(c) for c in ("n_words", "n_removed", "removed")]
    return out.select(*[whole[c].alias(c) for c in docs.columns if c in whole], *extra)


def _without(text: bytes, words: list[bytes], gone: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges and the white space after them."""
    out, place, number, start = [], 0, 0, 0
    for a, b in gone:
        while number < a:
            place = text.index(words[number], place) + len(words[number])
            number += 1
        first = text.index(words[a], place)
        out.append(text[start:first])
        place = first
        while number < b:
            place = text.index(words[number], place) + len(words[number])
            number += 1
        start = text.index(words[b], place) if b < len(words) else len(text)
    return b"".join(out) + text[start:]


def substring_stage(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The input rows, same columns, with repeated passages cut from the text; ``n_chars`` follows the text."""
    cut = remove_repeats(docs, key, text, length)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
