"""Documents with everything that may come, and plain versions of the operators."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, ids string, score double, component_id string"
WORDS = "the of and ndre oureau tion être über schön ciudad 漢字 wa. no, x1 42 don't ... #tag".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def odd_documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Null and empty texts, ids and sources, repeated rows, copies, near copies, a very long text, and columns whose
    names operators use themselves."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(r, r.choice([1, 3, 30, 120]))
        rows.append((i, text, "en", r.choice(["a", "b", "b", "b", "c", None])))
    rows += [(100, None, None, "a"), (101, "", "en", None), (102, " \n\t ", "en", "b"), (None, "text without an id " * 12, "en", "a"), (None, None, None, None)]
    rows += [rows[3], rows[3], (103, rows[5][1], "en", "c"), (104, rows[5][1], "en", "b")]
    long = prose(r, 4000)
    words = long.split(" ")
    words[100] = "changed"
    rows += [(105, long, "en", "b"), (106, " ".join(words), "en", "b"), (107, "spaces   in  rows \r\n\x0b\x1c  end ", "en", "a"), (108, "<|endoftext|> in a text<|endoftext|>", "en", "a")]
    return [(i, t, lang, s, len(t or ""), 7, "mine", 0.5, "kept") for i, t, lang, s in rows]


def frame(spark, rows=None, partitions: int = 3):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(partitions)


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def u32(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def crc(ids) -> int:
    return zlib.crc32(u32(ids))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def bits(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def rng(seed: int = 0):
    return np.random.default_rng(seed)
