"""Exact, near, suffix-array and line dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import near_dedup, suffix_dedup
from spanloom.llm.common import components
from spanloom.llm.exact_dedup import drop_copies, exact_groups
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.near_dedup import near_classes

from .samples import frame, prose, removed_bytes, rows, shingle_set

EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("block", [7, 1024])
def test_exact_groups(spark, block):
    groups = defaultdict(list)
    for doc_id, text in rows():
        groups[bare(text)].append((-len(text or ""), doc_id is None, doc_id))
    want = Counter()
    for doc_id, text in rows():
        best = min(groups[bare(text)], key=lambda g: (g[0], g[1], g[2] or 0))
        kept = doc_id == best[2] and len(text or "") == -best[0]
        want[doc_id, best[2], len(groups[bare(text)]), kept, hashlib.sha256(bare(text).encode()).hexdigest()] += 1
    got = exact_groups(frame(spark), block, shard_bytes=2000)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_exact_on_hashed_shards_and_nothing(spark):
    assert exact_groups(spark.createDataFrame([], EMPTY)).count() == 0
    assert drop_copies(spark.createDataFrame([], EMPTY)).count() == 0


def test_drop_copies_keeps_columns(spark):
    docs = frame(spark)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(bare(r["text"]) for r in left.collect()) == Counter({bare(t) for _, t in rows()})


def classes(data, threshold=0.8):
    sets = [shingle_set(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            keys = set(sets[i]) | set(sets[j])
            low = sum(min(sets[i].get(k, 0), sets[j].get(k, 0)) for k in keys)
            high = sum(max(sets[i].get(k, 0), sets[j].get(k, 0)) for k in keys)
            if low / high >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(data))]


def same_partition(got, want):
    return len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_near_classes(spark):
    data = rows()
    base = prose(50, 300)
    # A chain of near copies whose ends are not alike, and one large group around one text.
    words = base.split(" ")
    for k in range(40):
        data.append((100 + k, " ".join(w if (j * 7 + k) % 97 else f"x{k}" for j, w in enumerate(words))))
    want = classes(data)
    found = {(r["doc_id"], r["text_hash"]): r for r in near_classes(frame(spark, data)).collect()}
    hashes = frame(spark, data, False).selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS h", "n_chars").collect()
    by_row = {r["n_chars"]: found[r["doc_id"], r["h"]] for r in hashes}
    assert same_partition([by_row[k]["class_id"] for k in range(len(data))], want)
    sizes = Counter(want)
    assert all(by_row[k]["class_size"] == sizes[want[k]] for k in range(len(data)))
    assert len({(r["doc_id"], r["text_hash"]) for r in found.values() if r["kept"]}) == len(set(want))


@pytest.mark.parametrize("block_texts", [3, 11])
def test_near_classes_in_blocks(spark, block_texts):
    """A large pool is cut into blocks, whose texts still find each other."""
    words = prose(77, 150).split(" ")
    data = [(k, " ".join(w if (j * 7 + k) % 41 else f"x{k}" for j, w in enumerate(words))) for k in range(25)]
    data += [(100 + k, " ".join(words[: 150 - 12 * k] + prose(200 + k, 12 * k).split(" "))) for k in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in near_classes(frame(spark, data), block_texts=block_texts).collect()}
    assert same_partition([got[i] for i, _ in data], classes(data))


def test_recall_of_near_classes(spark):
    """Against all pairs of a thousand documents: links found, as texts in one class, and no class without links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(r["doc_id"], near_dedup.shingles(near_dedup.word_codes(near_dedup.pa.array([r["text"] or ""], near_dedup.pa.large_string()))[0])) for r in docs.collect()]
    sets = {i: (c, set(near_dedup.labelled(c).tolist())) for i, c in data}
    holders = defaultdict(list)
    for i, (_, s) in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for held in holders.values() if len(held) < 200 for k, a in enumerate(held) for b in held[k + 1 :])
    links = []
    for (a, b), n in common.items():
        (ca, sa), (cb, sb) = sets[a], sets[b]
        if n / (len(sa) + len(sb) - n) >= 0.75 and near_dedup.similarity(ca, cb, 0.8) >= 0.8:
            links.append((a, b))
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 100 and found >= 0.99 * len(links)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    # No class goes beyond what links connect.
    assert all(find(i) == find(c) for i, c in got.items())


def test_long_near_copies_align_quickly():
    """Twenty thousand words with changes all over, and texts of few different words."""
    import time

    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    b = a.copy()
    b[rng.integers(0, len(b), 900)] = rng.integers(0, 1 << 60, 900).astype(np.uint64)
    start = time.perf_counter()
    assert near_dedup.similarity(a, b, 0.8) == pytest.approx((a == b).sum() / (40_000 - (a == b).sum()))
    few, more = rng.integers(0, 3, 5000).astype(np.uint64), rng.integers(0, 3, 5000).astype(np.uint64)
    assert near_dedup.common_subsequence(few, more, 10_000) > 3000
    assert time.perf_counter() - start < 2


def test_estimate_is_about_right():
    rng = np.random.default_rng(6)
    for n, alike in ((40, 0.8), (400, 0.8), (5000, 0.8), (2000, 0.3)):
        seen = []
        for _ in range(60):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            shared = round(2 * n * alike / (1 + alike))
            b = np.concatenate([a[:shared], rng.integers(0, 1 << 62, n - shared).astype(np.uint64)])
            bits = [near_dedup.estimate_bits(x).view(np.uint64) for x in (a, b)]
            seen.append(1 - 2 * int(np.bitwise_count(bits[0] ^ bits[1]).sum()) / near_dedup.BITS)
        assert abs(np.mean(seen) - alike) < 0.04
        assert np.std(seen) < 1.5 * np.sqrt((1 - alike) * (1 + alike)) / np.sqrt(min(n, near_dedup.BITS))


def test_texts_of_every_length_have_sketches_in_common():
    """Where the number of shingles a sketch takes changes, similar texts still have sketches of one kind."""
    salts = np.arange(1, 9, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    kinds = lambda n: {k for k, (least, _) in enumerate(near_dedup.TAKEN) if least <= n and (k + 1 == len(near_dedup.TAKEN) or n < near_dedup.TAKEN[k + 1][0] / 0.8)}
    for n in range(1, 400):
        assert len(near_dedup.band_keys(np.arange(n, dtype=np.uint64), salts, 0.8)) == 4 * len(kinds(n))
        for m in range(int(np.ceil(0.8 * n)), n):
            assert kinds(n) & kinds(m)


def test_near_dedup_leaves_one_of_each_class(spark):
    docs = frame(spark)
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(set(classes(rows())))
    assert near_classes(spark.createDataFrame([], EMPTY)).count() == 0


def test_order_counts():
    """The sketch keeps the order of the text, and the alignment counts only shingles in order."""
    a, b = np.arange(50, dtype=np.uint64), np.arange(49, -1, -1).astype(np.uint64)
    assert near_dedup.similarity(a, a, 0.8) == 1.0
    assert near_dedup.similarity(a, b, 0.8) == 0.0
    moved = np.concatenate([a[:20], a[30:], a[20:30]])
    assert near_dedup.common_subsequence(a, moved, 20) == 40
    assert near_dedup.common_subsequence(a, moved, 19) == -1


def test_alignment_against_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert near_dedup.common_subsequence(a, b, len(a) + len(b)) == table[-1, -1]


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (7, 3), (20, 20)] + [(100 + k, 101 + k) for k in range(30)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found.get(k, k) == 1 for k in (1, 2, 3, 7))
    assert all(found.get(k, k) == 10 for k in range(10, 16))
    assert all(found.get(k, k) == 100 for k in range(100, 131))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 100, 3000).astype(np.uint8), np.frombuffer(b"abcab" * 300, np.uint8), np.full(700, 97, np.uint8), np.zeros(0, np.uint8), np.zeros(40, np.uint8), np.frombuffer(b"ab\0ab\0\0", np.uint8)):
        order, _ = suffix_dedup.suffix_array(text, 100)
        data = text.tobytes()
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_repeats_and_anchors():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 101, 4000).astype(np.uint8).tobytes()
    data = base + base[300:900] + b"q" * 400 + base[:150] + base[100:199]
    text = np.frombuffer(data, np.uint8)
    valid = np.arange(len(text)) <= len(text) - 100
    seen, want = set(), []
    for i in range(len(data) - 99):
        want.append(data[i : i + 100] in seen)
        seen.add(data[i : i + 100])
    assert suffix_dedup.repeated_starts(text, valid)[: len(want)].tolist() == want
    for length in (2, 5, 9, 33):  # shorter strings, which may all be sorted at once
        first = {}
        short = [first.setdefault(data[i : i + length], i) < i for i in range(len(data) - length + 1)]
        found = suffix_dedup.repeated_starts(text, np.arange(len(text)) <= len(text) - length, length)
        assert found[: len(short)].tolist() == short
    # The anchor is the smallest of the 69 hashes of 32 bytes in a string, wherever the string lies.
    value = suffix_dedup.anchors(text)
    assert len(value) == len(want) and not len(suffix_dedup.anchors(text[:99]))
    alone = [int(suffix_dedup.anchors(text[i : i + 32], 32)[0]) for i in range(len(data) - 31)]
    assert value.tolist() == [min(alone[i : i + 69]) for i in range(len(value))]
    # Runs: wanted starts of one anchor that follow one another.
    wanted = rng.random(len(text)) < 0.9
    wanted[len(value) :] = False
    first, end = suffix_dedup.anchor_runs(value, wanted)
    covered = [i for s, e in zip(first, end) for i in range(s, e)]
    assert covered == np.flatnonzero(wanted).tolist()
    assert all(len(set(value[s:e].tolist())) == 1 for s, e in zip(first, end))


def test_suffix_array_of_many_bytes():
    """All byte values and long repeats; groups share the bytes that they are said to share."""
    rng = np.random.default_rng(3)
    block = rng.integers(0, 256, 2000).astype(np.uint8)
    for text in (np.concatenate([block, block, block[:700]]), np.arange(256, dtype=np.uint8).repeat(3)):
        data = text.tobytes()
        order, group = suffix_dedup.suffix_array(text, 100)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        known = suffix_dedup.symbols_of(text, 100)[2]
        while known * 2 < 100:
            known *= 2
        padded = data + b"\0" * known
        same = {}
        for i in range(len(data)):
            assert same.setdefault(int(group[i]), padded[i : i + known]) == padded[i : i + known]


def test_suffix_array_whose_groups_need_more_than_a_word():
    """Two copies of 1.5 million bytes: numbers of group, rank and place do not fit in 64 bits together."""
    half = np.random.default_rng(4).integers(0, 256, 1_500_000).astype(np.uint8)
    text = np.concatenate([half, half])
    order, _ = suffix_dedup.suffix_array(text, 100)
    rank = np.full(len(text) + 1, -1, np.int64)
    rank[order] = np.arange(len(text))
    assert (np.sort(order) == np.arange(len(text))).all()
    # Suffixes are in order if their first bytes are, and of equal ones the suffixes behind these.
    a, b = order[:-1], order[1:]
    assert ((text[a] < text[b]) | ((text[a] == text[b]) & (rank[a + 1] < rank[b + 1]))).all()


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    data = [(i if i is not None else -1, t) for i, t in rows()]
    data += [(200 + k, prose(300 + k, 30) + " " + prose(99, 60) + " " + prose(400 + k, 30)) for k in range(25)]
    data = sorted(set(data), key=lambda r: (r[0], r[1] is not None))  # repeated rows count once
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(frame(spark, [d for d in data if d[0] != -1])).collect()}
    data = [d for d in data if d[0] != -1]
    for (doc_id, text), mask in zip(data, removed_bytes([(t or "").encode() for _, t in data])):
        left = bytes(b for b, m in zip((text or "").encode(), mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(mask), sum(mask), spans, hashlib.sha256(left).hexdigest()), doc_id


@pytest.mark.parametrize("parts", ["1", "2", "4"])
def test_suffix_dedup_across_shards_of_a_part(spark, parts):
    """Many small shards in each part: a passage of two documents is found wherever these are."""
    data = []
    for k in range(40):
        passage = prose(900 + k // 2, 40)  # in two documents each
        data.append((k, prose(2000 + k, 150) + " " + passage + " " + prose(3000 + k, 60)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = frame(spark, data)
        whole, changed = suffix_dedup.cleaned(docs, shard_bytes=3000)
        got = {r["doc_id"]: (r["n_removed"], bytes(r["left"])) for r in changed.collect()}
        assert whole.count() == len(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for (doc_id, text), mask in zip(data, removed_bytes([t.encode() for _, t in data])):
        if any(mask):
            want[doc_id] = (sum(mask), bytes(b for b, m in zip(text.encode(), mask) if not m))
    assert len(want) == 20 and got == want


def test_suffix_stage(spark):
    docs = frame(spark)
    left = suffix_dedup.drop_repeats(docs)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[27] == "" and texts[28] is None and 20 not in texts
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], EMPTY)).count() == 0


def brute_lines(data, window=2, mean=4):
    """Chunks are found from the operator's own hashes in :func:`test_line_dedup`; here, what is removed of given chunks."""
    seen, out = set(), []
    for doc_id, chunks in data:
        gone = []
        for first, n, text in chunks:
            if n >= 2 and text in seen:
                gone.append((first, n))
            elif n >= 2:
                seen.add(text)
        out.append((doc_id, gone))
    return out


def test_line_dedup(spark):
    from spanloom.llm.line_dedup import line_chunks

    passage = "\n".join(prose(600 + k, 6).replace("\n", "") for k in range(30))
    data = [(k, f"start {k}\n" + prose(700 + k, 20) + "\n" + passage + "\n" + prose(800 + k, 20)) for k in range(6)] + [(i, t) for i, t in rows() if i is not None and i > 19 and i != 40]
    data = [(i, t) for i, t in data if not (i == 40)]
    docs = frame(spark, data)
    chunks = defaultdict(list)
    for r in line_chunks(docs).collect():
        chunks[r["doc_id"]].append((r["first"], r["n"], r["lines"]))
    order = sorted(chunks)
    for doc_id, text in data:
        assert "\n".join(c[2] for c in sorted(chunks[doc_id])) == (text or "")
    want = dict(brute_lines([(i, sorted(chunks[i])) for i in order]))
    for r in dedup_lines(docs).collect():
        gone = [tuple(x) for x in r["removed"]]
        assert gone == want[r["doc_id"]]
        lines = (dict(data)[r["doc_id"]] or "").split("\n")
        left = [x for k, x in enumerate(lines) if not any(f <= k < f + n for f, n in gone)]
        assert r["n_lines"] == len(lines) and r["n_removed"] == len(lines) - len(left)
        assert r["kept_text"] == ("\n".join(left) if left else None)
    assert sum(len(g) for k, g in want.items() if k < 6) >= 5  # the passage is found at whatever line it begins


def test_line_dedup_odd_rows(spark):
    assert dedup_lines(frame(spark)).count() == len(rows())
    assert dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0
