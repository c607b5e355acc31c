"""Small inputs with every kind of odd row, and brute-force versions of what the operators do."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names the operators use inside.
CLASHING = ["block", "name", "names", "lines", "h", "part", "bucket", "tail", "score", "words", "counts", "anchor", "bands", "kept", "removed", "text_hash", "key", "count", "ids", "level", "shard", "__left"]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(stems) + ("\n" if rng.random() < 0.08 else "") for _ in range(words))


def rows() -> list[tuple[int | None, str | None]]:
    """Plain texts, copies, near copies, shared passages, nulls, empty and very long texts, rows that repeat."""
    plain = [prose(k, 40 + 13 * k) for k in range(12)]
    shared = prose(99, 60)
    words = plain[8].split(" ")
    near = " ".join(words[:70] + ["zzz"] + words[71:])
    return [
        *enumerate(plain),
        (20, plain[3]),
        (21, plain[3].replace(" ", "  ")),
        (22, plain[3].upper()),
        (23, near),
        (24, plain[1] + "\n" + shared + "\n" + plain[2]),
        (25, plain[4] + "\n" + shared),
        (26, shared),
        (27, ""),
        (28, None),
        (29, " \t\n\x0b\x0c\r"),
        (30, "é"),
        (31, "naïve 日本語 text 😀 ▁ mark"),
        (32, prose(5, 9000)),
        (33, "a" * 5000),
        (34, "ab " * 700),
        (35, "same line\nother line\nthird line\n" * 6),
        (36, "one  two   three \n four"),
        (None, plain[5]),
        (None, None),
        (40, plain[6]),
        (40, plain[6]),
    ]


def frame(spark, data=None, clashing: bool = True):
    """Documents with other columns beside, some of them named as the operators' own."""
    data = rows() if data is None else data
    made = spark.createDataFrame([(i, t, None, k) for k, (i, t) in enumerate(data)], "doc_id bigint, text string, source string, n_chars bigint")
    if clashing:
        for k, name in enumerate(CLASHING):
            made = made.withColumn(name, made["n_chars"] + k)
    return made.repartition(5)


def shingle_set(text: str | None) -> dict[tuple, int]:
    words = WORDS.findall((text or "").lower())
    out: dict[tuple, int] = {}
    for k in range(max(1, len(words) - 4)):
        key = tuple(words[k : k + 5])
        out[key] = out.get(key, 0) + 1
    return out


def removed_bytes(texts: list[bytes], length: int = 100) -> list[list[bool]]:
    """By definition: bytes under a string that also starts earlier."""
    seen: set[bytes] = set()
    out = []
    for data in texts:
        mask = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                mask[i : i + length] = [True] * length
            seen.add(s)
        out.append(mask)
    return out
