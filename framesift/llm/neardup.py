"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most five bits, two
of the three segments differ in at most two each (three bits in two segments would be six), and Golay keys of such
segments meet: ``golay.keys`` gives a segment one or six codeword indices. A fingerprint therefore has, for each pair
of segments, the products of their keys: about 84 keys of 24 bits. Those who share a key are joined and verified bit by
bit, which loses no pair within the radius.

Equal fingerprints are one class before anything is joined. Within a key, links are reduced at once to a spanning
forest, so a group of n near copies gives fewer than n edges a key, not n * n; connectivity is kept exactly. A key with
more than ``LIMIT`` fingerprints is dealt out again as pairs of blocks, each a task's share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm import golay, shingles, simhash
from framesift.llm.components import components
from framesift.llm.held import release
from framesift.plans.staging import stage

SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_RADIUS = 5
#: Fingerprints of one key compared by one task, and rows held at once.
LIMIT, BUFFER = 4_096, 400_000


def fingerprint_keys(prints: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of 64-bit fingerprints: segment pair, and one Golay key of each of the two."""
    by_segment = [golay.keys((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))[0] for at, width in SEGMENTS]
    rows, keys = [], []
    for i, (a, b) in enumerate(PAIRS):
        one, two = by_segment[a][:, :, None], by_segment[b][:, None, :]
        real = (one >= 0) & (two >= 0)
        rows.append(np.broadcast_to(np.arange(len(prints))[:, None, None], real.shape)[real])
        keys.append((((table * 3 + i) << 24) | (one << 12) | two)[real])
    return np.concatenate(rows), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these links but the smallest of its component, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        grown = label.copy()
        np.minimum.at(grown, label[left], least)
        np.minimum.at(grown, label[right], least)
        while (jumped := grown[grown] != grown).any():
            grown = np.where(jumped, grown[grown], grown)
        if (grown == label).all():
            break
        label = grown
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def block_edges(key: np.ndarray, node: np.ndarray, prints: list[np.ndarray], radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of equal key; rows are in key order."""
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    held, step = 0, 0
    at = np.arange(len(key) - 1)
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        apart = [np.bitwise_count(p[at] ^ p[at + step]) for p in prints]
        close = at[(np.minimum.reduce(apart) <= radius) & (np.sum(apart, axis=0, dtype=np.int64) <= total)] if len(at) else at
        if len(close):
            ends.append((node[close], node[close + step]))
            held += len(close)
        if held > 4 * BUFFER:
            ends = [forest(*map(np.concatenate, zip(*ends)))]
            held = len(ends[0][0])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(*map(np.concatenate, zip(*ends)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def link_classes(classes: DataFrame, prints: list[str], radius: int, total: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that connect just those of ``classes`` (node and the columns ``prints``, bigint) that are linked:
    some print differs in at most ``radius`` bits, and all together in at most ``total``."""
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"Golay keys of two segments find radii up to {MAX_RADIUS}")
    total = radius * len(prints) if total is None else total
    fields = ", ".join(f"{p} bigint" for p in prints)

    def spread(batches):
        release()
        for batch in batches:
            for part in (batch.slice(i, 2_000) for i in range(0, len(batch), 2_000)):
                for table, name in enumerate(prints):
                    rows, keys = fingerprint_keys(part.column(name).to_numpy().view(np.uint64), table)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[taken.column(c) for c in ("node", *prints)]], ["key", "node", *prints])

    def linked(batches, limit):
        release()
        names = ["key", "node", *prints]
        over, count, held, size = None, 0, [], 0

        def rest(cols):  # rows of a key that is too large: to be dealt out by blocks
            nonlocal count
            block = (count + np.arange(len(cols[0]))) // (limit // 2)
            count += len(cols[0])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cols[0], cols[1], block, *cols[2:])], ["key", "a", "b", *prints])

        def edges(cols):
            a, b = block_edges(cols[0], cols[1], [c.view(np.uint64) for c in cols[2:]], radius, total)
            none = np.zeros(len(a), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (none - 1, a, b, *[none] * len(prints))], ["key", "a", "b", *prints])

        def flush(cols, last):
            nonlocal over, count
            key = cols[0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            too_many = (sizes > limit) | (key[starts] == over if over is not None else False)
            for s, n in zip(starts[too_many], sizes[too_many]):
                if key[s] != over:
                    over, count = key[s], 0
                yield rest([c[s : s + n] for c in cols])
            kept = ~np.repeat(too_many, sizes)
            if kept.any():
                yield edges([c[kept] for c in cols])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if not len(cols[0]):
                continue
            held.append(cols)
            size += len(cols[0])
            if size >= BUFFER:
                cols = [np.concatenate(x) for x in zip(*held)]
                key = cols[0]
                cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
                if cut:
                    yield from flush([c[:cut] for c in cols], False)
                tail = [c[cut:] for c in cols]
                if len(tail[0]) > max(limit, BUFFER // 2):
                    yield from flush(tail, False)  # over the limit, so its rows are passed on
                    tail = [c[:0] for c in tail]
                held, size = [tail], len(tail[0])
        cols = [np.concatenate(x) for x in zip(*held)] if held else []
        if cols and len(cols[0]):
            yield from flush(cols, True)

    spec = f"key bigint, a bigint, b bigint, {fields}"
    keyed = classes.select("node", *prints).mapInArrow(spread, f"key bigint, node bigint, {fields}")
    found = stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: linked(x, limit), spec), "links")
    edges = found.where("key < 0").select("a", "b")
    large = found.where("key >= 0")
    if large.isEmpty():
        return edges
    blocks = large.groupBy("key").agg((F.max("b") + 1).alias("blocks"))
    dealt = (
        large.join(blocks, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(F.shiftrightunsigned(F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")), 1).alias("key"), F.col("a").alias("node"), *prints)
    )
    whole = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: linked(x, 1 << 62), spec)
    return edges.unionByName(stage(whole.select("a", "b"), "links"))


def print_documents(docs: DataFrame, width: int, seeds: tuple[int, ...]) -> DataFrame:
    """doc_id, fp0, fp1, ... (one for each seed, bigint) and node (one number for all of them), written once."""

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = [np.fromiter((simhash.fingerprint(t, width, seed) for t in texts), np.uint64, len(texts)) for seed in seeds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(signed(p)) for p in prints]], ["doc_id", *names])

    names = [f"fp{i}" for i in range(len(seeds))]
    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))
    return stage(out.withColumn("node", F.col("fp0") if len(names) == 1 else F.xxhash64(*names)), "prints")


def near_duplicates(docs: DataFrame, width: int = 4, seeds: tuple[int, ...] = (42,), radius: int = 4, total: int | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, its fingerprints fp0, ... and component_id, a row for each of ``docs`` (doc_id, text; no others are read).

    Documents whose fingerprints are linked (see ``link_classes``) are connected; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint 0 and are linked like others; a null doc_id counts for nothing in
    the minimum, and a component without any other has component_id null. Repeated rows are given back repeated.
    """
    prints = [f"fp{i}" for i in range(len(seeds))]
    rows = print_documents(docs, width, seeds)
    classes = stage(rows.groupBy("node").agg(*[F.first(p).alias(p) for p in prints], F.min("doc_id").alias("least")), "classes")
    labels = stage(components(link_classes(classes, prints, radius, total, limit)), "labels")
    members = labels.join(classes.select("node", "least"), "node")
    groups = members.groupBy("root").agg(F.min("least").alias("group_least"))
    linked = members.join(groups, "root").select("node", "group_least")
    ids = stage(classes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("group_least", "least").alias("component_id")), "ids")
    return rows.join(ids, "node").select("doc_id", *prints, "component_id")


def drop_near_duplicates(docs: DataFrame, width: int, seeds: tuple[int, ...], radius: int, total: int) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, with all columns of ``docs``; of repeated rows one.

    Near copies are those of ``shingles``: exact Jaccard of five-word shingles. Linked fingerprints (``width``, ``seeds``,
    ``radius``, ``total``: see ``link_classes``) and equal bands only say which sets are compared. A row is told by doc_id and a hash
    of its text, so different texts under one doc_id are different documents. Documents without a doc_id can't be named as
    kept or dropped, and stay.
    """
    prints = [f"fp{i}" for i in range(len(seeds))]
    rows = shingles.describe(docs, width, seeds)
    named = F.struct(F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), "mark")
    firsts = [F.first(c).alias(c) for c in (*prints, "size", "bands")]
    classes = stage(rows.groupBy("node").agg(*firsts, F.min(named).alias("seat"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("least")), "classes")
    found = link_classes(classes, prints, radius, total).unionByName(shingles.band_links(classes))
    labels = stage(components(shingles.verified_links(docs, classes, found)), "labels")
    members = labels.join(classes.select("node", "least"), "node")
    groups = members.groupBy("root").agg(F.min("least").alias("least"))
    kept = classes.join(labels, "node", "left_anti").select("least").unionByName(groups.select("least")).select(F.col("least.doc_id").alias("__id"), F.col("least.mark").alias("__mark"))
    texts = docs.where("doc_id IS NOT NULL").withColumn("__id", F.col("doc_id")).withColumn("__mark", F.xxhash64("text"))
    stay = texts.join(kept, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    return stay.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id: four-word shingles, seed 42, linked at four bits or fewer."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
