"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first scatters the shingles of
a document, the second is read once per coordinate, circularly shifted by the
coordinate's number, and its minimum over the set is kept. Bands of equal
coordinates put documents into buckets; every link is confirmed on the full
shingle sets.

Documents with equal sets form one class, found by a fingerprint of the set.
Inside a bucket each class is first checked against the bucket's hub, the class
that meets most others over all its buckets: the original of a group of copies
is in more buckets with each copy than the copies are with each other, so large
groups join in a number of checks that is linear in their size. Only classes of
one bucket that are then still in different components are compared with each
other: sketches of the longer signature in blocks of bounded size, once per
pair, and full sets for the pairs whose sketches allow the similarity. Of those
pairs the closest of each class and other component are confirmed first, so
that the rest only have to be where that did not join the two.

Defined results: a null or blank text has an empty set and is linked with
nothing; a row without key is measured but linked with nothing; rows that
repeat a key are judged by their own texts; an empty table gives no rows. The
stage keeps one row of each group, whatever keys and texts repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.components import components
from fleetlens.llm.text import mix, shingle_sets
from fleetlens.session import staged

BANDS, BAND_ROWS = 32, 4
COORDINATES = 512  # the first BANDS * BAND_ROWS make the bands, the low bytes of all make the sketch
SHIFTS = 128  # coordinates worked on at once
SLICE = 4096  # elements of a set worked on at once
BLOCK = 256  # classes of a bucket compared with each other at once
TASK_SHINGLES = 4_000_000  # shingles checked against one class before the work is split


def signature(values: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingle hashes, COORDINATES 32-bit numbers."""
    scattered = (mix(values) >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for first in range(0, COORDINATES, SHIFTS):
        shifts = np.arange(first, first + SHIFTS, dtype=np.uint32)[:, None]
        best = least[first : first + SHIFTS]
        for i in range(0, len(scattered), SLICE):
            x = scattered[None, i : i + SLICE] + shifts
            x *= np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            x ^= x >> np.uint32(13)
            np.minimum(best, x.min(axis=1), out=best)
    return least


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(BAND_ROWS):
        key = mix(key ^ rows[:, j]) + np.uint64(j)
    return key.view(np.int64)


def _sketch(sig: np.ndarray, bands: np.ndarray) -> bytes:
    """Low halves of the band keys, then the low bytes of all coordinates."""
    return bands.astype(np.uint32).tobytes() + sig.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, print, n_shingles, node, sig, bands) of every row.

    ``node`` is the fingerprint of the set, null if it is empty, ``print`` the hash of the text.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                counts, nodes, sigs, bands = [], [], [], []
                for own in shingle_sets(part.column(1), size):
                    counts.append(len(own))
                    if len(own):
                        sig = signature(own)
                        nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                        bands.append(_band_keys(sig))
                        sigs.append(_sketch(sig, bands[-1]))
                    else:
                        nodes.append(None), sigs.append(None), bands.append(None)
                full = [b for b in bands if b is not None]
                lengths = np.array([0 if b is None else BANDS for b in bands])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()),
                    pa.array(np.concatenate(full) if full else np.zeros(0, np.int64), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), lists],
                    names=["id", "print", "n_shingles", "node", "sig", "bands"],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    return rows.mapInArrow(sign, "id long, print long, n_shingles long, node binary, sig binary, bands array<long>")


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= share * union.

    ``classes`` has (node, id, print, n_shingles), ``rows`` (id, print, text). Rows are dealt out by ``a``, a much
    used ``a`` in as many parts as its partners need, and stream past the set of ``a``.
    """
    weight = F.col("n_shingles")
    # Written once: the parts of every ``a`` and the members both come from it.
    sized = staged(pairs.join(classes.select(F.col("node").alias("b"), "id", "print", "n_shingles"), "b"), "sized")
    parts = sized.groupBy("a").agg(F.ceil(F.sum(weight) / TASK_SHINGLES).cast("int").alias("parts"))
    members = sized.join(parts, "a").select(
        "id", "print", "a", "b", F.lit(1).alias("role"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    )
    heads = parts.join(classes.select(F.col("node").alias("a"), "id", "print"), "a").select(
        "id", "print", "a", F.col("a").alias("b"), F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    texts = heads.unionByName(members).join(rows, ["id", "print"]).select("a", "part", "role", "b", "text")
    dealt = texts.repartition("a", "part").sortWithinPartitions("a", "part", "role", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                left, right = [], []
                names = zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                for (a, role, b), own in zip(names, shingle_sets(part.column(4), size), strict=True):
                    if hashlib.blake2b(own.tobytes(), digest_size=16).digest() != b:
                        continue  # another text under the same key
                    if role == 0:
                        head, base = a, own
                    elif head == a and len(base):
                        where = np.minimum(np.searchsorted(base, own), len(base) - 1)
                        both = int(np.count_nonzero(base[where] == own))
                        if 100 * both >= share * (len(base) + len(own) - both):
                            left.append(a), right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(check, "a binary, b binary")


def _across(members: DataFrame, share: int) -> DataFrame:
    """(a, b, comp_a, comp_b, equal): pairs of classes of one bucket and different components whose sketches allow the similarity.

    ``members`` has (key, node, comp, n_shingles, sig, n): n is the bucket's size. Buckets are cut into blocks, and
    every two blocks meet once. A pair comes from the first band that it shares, and from no other.
    """
    t = share / 100
    # Four standard deviations below the expected number of equal coordinates.
    least = math.floor(COORDINATES * (t - 4 * math.sqrt(t * (1 - t) / COORDINATES)))
    heads = BANDS * 4
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", own)
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n_shingles", "sig"
    )
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(group: list[tuple], key: int, i: int, j: int) -> list[tuple]:
        out = []
        sigs = np.frombuffer(b"".join(g[3] for g in group), np.uint8).reshape(len(group), -1)
        bands, sigs = np.ascontiguousarray(sigs[:, :heads]).view(np.uint32), sigs[:, heads:]
        band = int(np.flatnonzero(bands[0] == np.int64(key).astype(np.uint32))[0])
        sizes = np.array([g[2] for g in group], float)
        comps = np.unique([g[1] for g in group], return_inverse=True)[1]
        side = np.array([g[4] for g in group])
        for x in range(len(group)):
            rest = slice(x + 1, None)
            fit = (comps[rest] != comps[x]) & (np.minimum(sizes[rest], sizes[x]) >= t * np.maximum(sizes[rest], sizes[x]) - 1e-9)
            if i != j:
                fit &= side[rest] != side[x]
            near = np.flatnonzero(fit) + x + 1
            if len(near):
                near = near[~(bands[near, :band] == bands[x, :band]).any(axis=1)]
                equal = np.count_nonzero(sigs[near] == sigs[x], axis=1)
                for y, n in zip(near[equal >= least].tolist(), equal[equal >= least].tolist(), strict=True):
                    a, b = sorted((group[x], group[y]))
                    out.append((a[0], b[0], a[1], b[1], n))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        kinds = [pa.binary()] * 4 + [pa.int32()]

        def out() -> pa.RecordBatch:
            found = pairs(group, *now) if len(group) > 1 else []
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "comp_a", "comp_b", "equal"])

        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            for key, i, j, own, node, comp, n, sig in zip(*c, strict=True):
                if (key, i, j) != now:
                    yield out()
                    now, group = (key, i, j), []
                group.append((node, comp, n, sig, own))
        yield out()

    return dealt.mapInArrow(compare, "a binary, b binary, comp_a binary, comp_b binary, equal int")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per input row.

    Links hold between sets with 100 * intersection >= share * union; ``component_id`` is the smallest key
    reachable by links, ``kept`` marks the row that carries it.
    """
    return _judged(docs, key, text, size, share).select("id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, key: str, text: str, size: int, share: int) -> DataFrame:
    """``near_duplicates`` with ``print`` and ``root``, which names the component; null for a row linked with nothing in any case."""
    signed = staged(signatures(docs, key, text, size), "signatures")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    usable = signed.where(F.col("node").isNotNull() & F.col("id").isNotNull())
    # Rows that repeat the least key with another text of the same set: any one will do, once it is written.
    least = [F.min("id").alias("id"), F.min_by("print", "id").alias("print"), F.first("n_shingles").alias("n_shingles")]
    classes = staged(usable.groupBy("node").agg(*least), "classes")
    lead = usable.join(classes.select("node", F.col("id").alias("lead")), "node").where(F.col("id") == F.col("lead"))
    lead = lead.dropDuplicates(["node"])
    members = lead.select("node", F.explode("bands").alias("key"))
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    full = staged(members.join(counts, "key").select("key", "n", "node"), "buckets")
    weights = full.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = full.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    shared = full.join(hubs, "key").select("key", "n", "a", "node")
    stars = staged(shared.where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct(), "stars")
    links = staged(_confirmed(stars, classes, rows, size, share), "confirmed")
    root = components(links)

    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_ = full.where(F.col("n") > 2).join(root, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    compared = open_.join(mixed, "key").join(lead.select("node", "n_shingles", "sig"), "node")
    cross = _across(compared.select("key", "node", "comp", "n_shingles", "sig", "n"), share)
    cross = staged(cross.join(tested, ["a", "b"], "left_anti"), "across")
    best = cross.groupBy("a", "comp_b").agg(F.max_by("b", "equal").alias("b")).select("a", "b").unionByName(
        cross.groupBy("b", "comp_a").agg(F.max_by("a", "equal").alias("a")).select("a", "b")
    )
    best = staged(best.distinct(), "closest")
    more = staged(_confirmed(best, classes, rows, size, share), "confirmed")
    if not more.isEmpty():
        links = links.unionByName(more)
        root = components(links)
    rest = cross.select("a", "b").join(best, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        rest = rest.join(root.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    last = staged(_confirmed(staged(rest, "rest"), classes, rows, size, share), "confirmed")
    if not last.isEmpty():
        root = components(links.unionByName(last))

    rooted = classes.join(root, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = rooted.join(first, "root").select("node", "root", "component_id")
    out = signed.select("id", "print", "n_shingles", "node").join(found, "node", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        "id", "print", "n_shingles", F.when(F.col("id").isNotNull(), F.col("root")).alias("root"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept")
    )


def dedup_stage(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """The input rows, columns unchanged, with one row of each component: one of its smallest key.

    Rows are told apart by key and text, so a row stays or goes by its own text even where keys repeat; of rows that
    repeat both, one stays. Rows without key or words are no copies of anything.
    """
    judged = staged(_judged(docs, key, text, size, share).where(F.col("root").isNotNull()), "judged")
    # More than one text of the smallest key in a component: the one of least hash stays.
    lead = judged.where("kept")
    several = lead.groupBy("root").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("least <> most")
    spare = lead.join(several, "root").where(F.col("print") != F.col("least"))
    gone = staged(judged.where("not kept").select("id", "print").unionByName(spare.select("id", "print")).distinct(), "gone")
    repeated = staged(lead.groupBy("id", "print").agg(F.count("*").alias("n")).where("n > 1").select("id", "print"), "repeated")
    rows = docs.withColumns({"_id": F.col(key).cast("long"), "_print": F.xxhash64(text)})
    pair = lambda t: t.select(F.col("id").alias("_id"), F.col("print").alias("_print"))
    kept = rows.join(pair(gone), ["_id", "_print"], "left_anti")
    if not repeated.isEmpty():
        once = kept.join(pair(repeated), ["_id", "_print"], "left_semi").dropDuplicates(["_id", "_print"])
        kept = kept.join(pair(repeated), ["_id", "_print"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
