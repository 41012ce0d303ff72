"""Each stage of the pipeline against a plain version, on its own input, with every odd row that a table may have."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from framesift.llm import bpe, ordinal, queries
from framesift.plans.staging import shared_path
from tests.llm.helpers import Union, frame, odd_documents, sha, u32, words_of
from tests.llm.test_mix import plain_targets
from tests.llm.test_near_copies import jaccard, plain_set
from tests.llm.test_quality import LABELS, plain_posteriors, plain_stats, rated

DATA = "/root/testdata/sf0.001"


def corpus():
    """Rated prose, of which some is bad; junk; copies, near copies and texts that are merely alike; and all odd rows."""
    r = random.Random(6)
    docs, labels = rated(n=500)
    docs = [(i, t, "en", r.choice(["hot", "hot", "hot", "b", None]), 1, 7, "mine", 0.5, "kept") for i, t, *_ in docs]
    good = [d for d, (_, q, toxic) in zip(docs, labels) if q and not toxic and len(d[1].split()) > 60]
    for k, d in enumerate(good[:30]):
        words = d[1].split()
        docs.append((1000 + k, d[1], *d[2:]))
        docs.append((1100 + k, " ".join([*words, "appended"]), *d[2:]))
        words[len(words) // 3], words[2 * len(words) // 3] = "changed", "too"
        docs.append((1200 + k, " ".join(words), *d[2:]))
    docs += [(1300 + k, " ".join(f"{w} |" for w in d[1].split()), *d[2:]) for k, d in enumerate(good[:20])]
    docs += [(1400 + k, "buy now cheap " * 40, *d[2:]) for k, d in enumerate(good[:5])]
    return docs + odd_documents() + docs[:3], labels


@pytest.fixture(scope="module")
def folder(spark):
    docs, labels = corpus()
    path = shared_path(spark, "pipeline-test")
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def classifier(spark, rows, folder):
    model = ordinal.train(frame(spark, rows), queries.read(spark, folder, "labels"))
    features = ordinal.Features()
    return [x for x in rows if sum(model.weights[b] * v for b, v in features.of(x[1]).items()) >= model.thresholds[1]]


def rules(spark, rows, folder):
    kept = []
    for x, p in zip(rows, plain_posteriors([x[1] for x in rows])):
        n_words, _, _, _, repeats = plain_stats(x[1])
        if n_words >= 50 and 100 * repeats <= 50 * n_words and p >= 0.5:
            kept.append(x)
    return kept


def dedup(spark, rows, folder):
    named = sorted({x for x in rows if x[0] is not None}, key=lambda x: x[0])
    sets, u = [plain_set(x[1]) for x in named], Union()
    for i, j in combinations(range(len(named)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            u.join(i, j)
    return [x for i, x in enumerate(named) if u.find(i) == i] + [x for x in rows if x[0] is None]


def mixing(spark, rows, folder):
    """Fair queueing a copy at a time: finish times in order until the next copy does not fit."""
    sizes, queues = defaultdict(int), defaultdict(list)
    for x in rows:
        mark = hashlib.md5(f"mix:{'null' if x[0] is None else x[0]}:{hashlib.md5((x[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        n = len(words_of(x[1]))
        sizes[x[3]] += n
        queues[x[3]].append((mark, n, x))
    targets, line = plain_targets(dict(sizes)), []
    for source, queue in queues.items():
        if not targets[source]:
            continue
        for copy in (0, 1):
            done = 0
            for mark, n, x in sorted(queue, key=lambda q: q[:2]):
                done += n
                line.append(((copy * sizes[source] + done) / targets[source], "-" if source is None else f"+{source}", copy, mark, n, x))
    spent, taken = 0, []
    for *_, n, x in sorted(line, key=lambda q: q[:5]):
        spent += n
        if spent > 1.5 * sum(sizes.values()):
            break
        taken.append(x)
    return taken


def encoding(spark, rows, folder):
    tiktoken = pytest.importorskip("tiktoken")
    tik = tiktoken.Encoding("own", pat_str=queries.split_pattern(), mergeable_ranks=bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for i, t, *_ in rows:
        ids = tik.encode_ordinary(t or "")
        out.append((i, len(ids), sha(u32(ids)), sha((t or "").encode())))
    return out


PLAIN = [classifier, rules, dedup, mixing, encoding]


def test_every_stage_is_its_plain_version(spark, folder):
    docs = queries.read(spark, folder, "documents")
    columns, dropped = docs.columns, []
    for i, ((_, stage), plain) in enumerate(zip(corpus_pipeline.STAGES, PLAIN)):
        rows = [tuple(x) for x in docs.collect()]
        out = stage(spark, docs, folder).cache()
        got = Counter(tuple(x) for x in out.collect())
        assert got == Counter(plain(spark, rows, folder)), corpus_pipeline.STAGES[i][0]
        assert i == 4 or out.columns == columns
        dropped.append(len(rows) - sum(got.values()))
        path = shared_path(spark, "pipeline-test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert min(dropped[:3]) > 0 and dropped[3] < 0 and dropped[4] == 0  # every decision takes effect


def test_odd_rows_alone_pass_every_stage(spark, folder):
    """Each stage on the odd rows themselves, which earlier stages would drop."""
    for (_, stage), plain in list(zip(corpus_pipeline.STAGES, PLAIN))[1:]:
        rows = odd_documents()
        assert Counter(tuple(x) for x in stage(spark, frame(spark), folder).collect()) == Counter(plain(spark, rows, folder))


def test_empty_documents_pass_through(spark, folder):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
