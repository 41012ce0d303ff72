import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framesift.llm import mix
from tests.llm.helpers import frame, odd_documents, words_of


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, repeat=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(repeat * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: repeat * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > repeat * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, got):
    sizes = defaultdict(int)
    for i, t, _, s, *_ in rows:
        sizes[s] += len(words_of(t))
    target = plain_targets(dict(sizes))
    source = {}
    for i, t, _, s, *_ in rows:
        source.setdefault((i, len(words_of(t))), []).append(s)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words_of(t))) for i, t, *_ in rows)
    taken = defaultdict(int)
    largest = max(len(words_of(t)) for _, t, *_ in rows)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        [s] = [s for s in sizes if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6][:1]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest


def test_targets_and_shares(spark):
    rows = odd_documents()
    check(rows, mix.mix_table(frame(spark)).collect())


def test_hot_source_and_capped_sources(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 40), "en", "hot" if i % 3 else f"s{i % 30}", 0, 0, "", 0.0, "") for i in range(1500)]
    got = mix.mix_table(frame(spark, rows)).collect()
    check(rows, got)
    again = mix.mix_table(frame(spark, rows[::-1], partitions=7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_targets_match_refilling(spark):
    r = random.Random(5)
    for _ in range(5):
        sizes = {f"s{i:02d}": r.choice([0, 1, 10, 500, 10_000]) for i in range(r.randrange(1, 12))} | {None: r.randrange(100)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {x.source: x.target for x in mix.fill_targets(df, (3, 1, 2), 1.5, 2).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix_itself(spark):
    docs = frame(spark)
    table = mix.mix_table(docs).agg(F.sum("taken")).first()[0]
    mixed = mix.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mix.word_count())).first()[0] == table
    assert {r["size"] for r in mixed.select("size").collect()} == {7}
    assert mix.mix_documents(frame(spark, [])).count() == 0 and mix.mix_table(frame(spark, [])).count() == 0
    empty = [(1, None, None, None, 0, 0, "", 0.0, "")]
    assert [tuple(r) for r in mix.mix_table(frame(spark, empty)).collect()] == [(1, 0, 0, 0.0, 0)]


def test_rows_of_one_id_are_spread_and_own_names_come_through(spark):
    """Many rows of one id and of none fall into many buckets, and columns named like the module's own are kept."""
    rows = [(7 if i % 2 else None, f"w{i} " * (1 + i % 5), "en", "a" if i % 3 else "b", 0, 0, "", 0.0, "") for i in range(400)]
    docs = frame(spark, rows).withColumns({"__f0": F.lit("mine"), "__copy": F.lit(3), "__at": F.lit(0.25), "__key": F.lit("k")})
    check(rows, mix.mix_table(docs).collect())
    hashes = mix.queue(docs.withColumn("__bucket", F.lit(1)), mix.word_count())
    assert hashes.columns[-5:] == list(mix.NEW)
    mixed = mix.mix_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.select("__f0", "__copy", "__at", "__key").collect()} == {("mine", 3, 0.25, "k")}


def test_many_rows_without_words_finish_together(spark):
    rows = [(i, "", "en", "a", 0, 0, "", 0.0, "") for i in range(500)] + [(1000 + i, "w " * 5, "en", "a", 0, 0, "", 0.0, "") for i in range(20)]
    check(rows, mix.mix_table(frame(spark, rows)).collect())
