"""Near copies by the exact similarity of their word shingles.

A document is told by the set of its ``WIDTH``-word shingles, as 64-bit hashes. Two searches propose pairs: SimHash links
(``neardup.link_classes``), and bands of min-hashes of the same shingles for the copies that SimHash can't reach, such
as those with a block appended. Neither decides: what they connect is brought together, and a pair is linked only if its
sets have a Jaccard similarity of ``NEAR`` or more.

Equal sets are one class before anything is joined. Of a class only one text is read again, and only if some search
connects the class. A group too large for one task is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm import simhash
from framesift.llm.components import components
from framesift.llm.held import release
from framesift.plans.staging import stage

#: Near copies share four fifths of their five-word shingles.
WIDTH, SEED, NEAR = 5, 42, (4, 5)
#: Two sets agree in a band with probability J^ROWS; at J = 0.8 all bands miss one pair in 17,000.
BANDS, ROWS = 32, 6
#: Classes and shingles of a block, and classes up to which the wanted ones are sent to the texts instead of joined.
BLOCK, BLOCK_SHINGLES, SENT = 128, 1 << 20, 500_000

_draw = np.random.default_rng(5)
MIXERS = _draw.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles of a text, in order; a text of fewer words has one, a text without words none."""
    found = list(simhash.shingle_hashes(text, WIDTH, SEED))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[at : at + 512, None] ^ MIXERS) * FACTORS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * FACTORS[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def near(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of sizes a and b with so many common elements have Jaccard NEAR or more, in whole numbers."""
    return NEAR[1] * shared >= NEAR[0] * (a + b - shared)


def near_links(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs among these sets; of two blocks only pairs across."""
    _, first = np.unique(nodes, return_index=True)
    first = np.array([i for i in first.tolist() if len(sets[i])], int)
    nodes, blocks, sets = nodes[first], blocks[first], [sets[i] for i in first.tolist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.zeros(0, np.int64)
    if len(nodes) < 2:
        return none, none
    numbers = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    seen = np.zeros(int(sizes.sum()), bool)
    label, across, ends = np.arange(len(nodes)), len(np.unique(blocks)) > 1, []
    for i in range(len(nodes) - 1):
        later = np.arange(len(nodes)) > i
        some = later & (label != label[i]) & near(np.minimum(sizes, sizes[i]), sizes, sizes[i])
        at = np.flatnonzero(some & (blocks != blocks[i]) if across else some)
        if not len(at):
            continue
        seen[numbers[i]] = True
        shared = np.array([np.count_nonzero(seen[numbers[j]]) for j in at.tolist()], np.int64)
        seen[numbers[i]] = False
        for j in at[near(shared, sizes[at], sizes[i])].tolist():
            if label[j] != label[i]:
                ends.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return tuple(np.array(x, np.int64) for x in zip(*ends)) if ends else (none, none)


def describe(docs: DataFrame, width: int, seeds: tuple[int, ...]) -> DataFrame:
    """doc_id, mark (a hash of the text), fp0, fp1, ..., node (one number for the set of shingles), size and bands, written once."""
    names = [f"fp{i}" for i in range(len(seeds))]

    def run(batches: Iterable[pa.RecordBatch]):
        release()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = [np.fromiter((simhash.fingerprint(t, width, seed) for t in texts), np.uint64, len(texts)).view(np.int64) for seed in seeds]
            nodes, sizes, bands = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), []
            for i, text in enumerate(texts):
                found = shingle_set(text)
                nodes[i], sizes[i] = xxhash.xxh64_intdigest(found.tobytes()), len(found)
                bands.append(band_keys(found))
            columns = [batch.column("doc_id"), batch.column("mark"), *map(pa.array, prints), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", *names, "node", "size", "bands"])

    fields = ", ".join(f"{n} bigint" for n in ("doc_id", "mark", *names, "node", "size"))
    return stage(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"{fields}, bands array<bigint>"), "described")


def band_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the classes (node, bands) with a band in common: a star for each key."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    least = F.min("node").over(Window.partitionBy("key"))
    return keyed.select(F.col("node").alias("a"), least.alias("b")).where("a <> b").distinct()


def verified_links(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the near pairs among classes (node, size, seat: id and mark of one row) that
    ``edges`` connect."""
    groups = stage(components(edges), "candidates")
    members = stage(groups.join(classes.select("node", "size", "seat.id", "seat.mark"), "node"), "members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("bigint")
    sized = members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root")
    wanted = stage(sized.select("id", "mark", "node", "root", "blocks"), "wanted")
    few = wanted.count() <= SENT
    texts = docs.select(F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), F.xxhash64("text").alias("mark"), "text")
    read = texts.join(F.broadcast(wanted) if few else wanted, ["id", "mark"]).select("node", "root", "blocks", "text")

    def gather(batches):
        release()
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "root", "blocks")], pa.array(sets, pa.binary())], ["node", "root", "blocks", "shingles"])

    def linked(batches):
        def edges(held):
            a, b = near_links(np.array([x[0] for x in held]), np.array([x[1] for x in held]), [np.frombuffer(x[2], np.uint64) for x in held])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        key, held = None, []
        for batch in batches:
            for k, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "node", "block", "shingles")]):
                if k != key and held:
                    if len(held) > 1:
                        yield edges(held)
                    held = []
                key = k
                held.append(row)
        if len(held) > 1:
            yield edges(held)

    sets = read.mapInArrow(gather, "node bigint, root bigint, blocks bigint, shingles binary")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    paired = placed.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "block", "shingles")
    return stage(paired.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a bigint, b bigint"), "verified")
