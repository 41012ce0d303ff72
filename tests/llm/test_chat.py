import hashlib
import random

from pyspark.sql import functions as F

from framesift.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tree string, node string, score string"


def rows():
    r = random.Random(1)
    bits = ["</s>[INST] ok [/INST]", "<|im_start|>", "<\\s>", "<\\\\/s>", "<<SYS>>x<</SYS>>", "[\\INST]", "plain", "é漢\n", "\\", "<", "<|im_end|>\n", ""]
    out = [(c, t, r.choice(["user", "assistant", "assistant", "system", "a%0Ab\n<s>", None]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randrange(6)))])) for c in range(25) for t in range(r.randrange(1, 9))]
    out += [(99, t, "assistant", f"t{t}") for t in range(40)] + [(None, 0, "user", "x"), (50, None, "user", "first"), (50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a")]
    return [(*x, "t", "n", "s") for x in out]


def plain(rows):
    talks = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows, key=key):
        talks.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for c, turns in talks.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_conversations_come_back(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = chat.conversation_digests(df)
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == plain(rows())
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_formatted_text_has_no_control_string_of_a_text(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for r in chat.format_paths(chat.thread(df)).collect():
        inner = r.formatted.replace(chat.START, "", r.formatted.count(chat.START)).split(chat.END + "\n")
        n = df.where(F.col("conv_id").eqNullSafe(F.lit(r.tree))).count()
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == n == len(inner) - 1
        assert not any(c in r.formatted for c in chat.CONTROL if c not in (chat.START, chat.END))


def test_best_branches_of_trees(spark):
    r = random.Random(2)
    nodes = []
    for tree in range(6):
        for n in range(1, 40):
            parent = None if n == 1 else r.choice([None, 999, *range(1, n)]) if tree else n - 1
            nodes.append((tree, n, parent, "user", f"m{n}", r.choice([None, 0.5, 1.0, -2.0])))
    nodes += [(7, 1, 2, "user", "a", 1.0), (7, 2, 1, "user", "b", 1.0)]  # a circle has no root
    df = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = {}
    for x in chat.chosen_paths(df, branches=2).collect():
        got.setdefault((x.tree, x.branch), []).append((x.place, x.node))
    want = {}
    for tree in range(6):
        by = {n: (p, s or 0.0) for t, n, p, _, _, s in nodes if t == tree}
        parents = {p for p, _ in by.values()}
        paths = []
        for leaf in (n for n in by if n not in parents):
            path, at = [], leaf
            while at in by:
                path.append(at)
                at = by[at][0]
            paths.append((-sum(by[n][1] for n in path), leaf, path[::-1]))
        for k, (_, _, path) in enumerate(sorted(paths)[:2]):
            want[tree, k + 1] = [(i + 1, n) for i, n in enumerate(path)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_nodes_that_come_twice(spark):
    """One row of each, whatever the order of the table, and very long texts come back whole."""
    rows = [("t", 1, None, "user", "a" * 300_000 + "</s>", 0.0), ("t", 2, 1, "assistant", "low", 0.0), ("t", 2, 1, "assistant", "high", 1.0), ("t", 2, 1, "assistant", "high", 1.0), (None, 1, None, None, None, None), (None, 1, None, None, None, None)]
    schema = "tree string, node bigint, parent bigint, role string, text string, score double"
    for some in (rows, rows[::-1]):
        once = chat.unique_messages(spark.createDataFrame(some, schema)).select("tree", "node", "parent", "role", "text", "score")
        assert sorted(map(repr, map(tuple, once.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[4]]))
        out = {r.tree: r for r in chat.format_paths(once).select("tree", chat.parse_turns(F.col("formatted")).alias("turns")).collect()}
        assert [tuple(t) for t in out["t"].turns] == [("user", rows[0][4]), ("assistant", "high")]
