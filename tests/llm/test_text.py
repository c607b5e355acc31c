"""Toxicity, URL filters, language model, packing, pieces and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import fingerprints, language_model, packing, pieces, toxicity, url_filters
from spanloom.llm.queries import tokenizer_path

from .samples import WORDS, frame, prose, rows

EMPTY = "doc_id bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def toxic_data():
    rng = random.Random(4)
    data, labels = [], {}
    for k in range(700):
        words = prose(1000 + k, 60).split(" ")
        labels[k] = int(k % 5 == 0)
        if labels[k]:
            for w in rng.sample(["idiot", "worthless", "pathetic", "scum"], rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), w)
        data.append((k, " ".join(words)))
    return data, labels


def test_toxicity(spark, toxic_data):
    data, labels = toxic_data
    hidden = ["you 1d10t here", "such an i d i o t there", "w0rthle55 one", "so p@thetic now", "iiiidiot", "plain words only", "a1b2c3 code 42", ""]
    plain = ["you idiot here", "such an idiot there", "worthless one", "so pathetic now", "idiot"]
    docs = frame(spark, data + [(5000 + k, t) for k, t in enumerate(hidden)] + [(6000 + k, t) for k, t in enumerate(plain)] + [(None, None), (None, None)])
    marks = spark.createDataFrame([(i, y, None) for i, y in labels.items()] + [(None, 1, None), (3, None, None)], "doc_id bigint, toxic int, quality int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(data) + len(hidden) + len(plain) + 2
    score = {r["doc_id"]: r["score"] for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((score[i] >= 0.7) == bool(labels[i]) for i in held)
    assert [score[5000 + k] for k in range(len(plain))] == [score[6000 + k] for k in range(len(plain))]
    assert min(score[6000 + k] for k in range(len(plain))) > 5 * score[5007]
    assert all(score[5000 + k] < 0.1 for k in range(len(plain), len(hidden)))
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i in score if score[i] < 0.7}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.toxicity(frame(spark), none).collect()
    assert len(got) == len(rows()) and all(r["score"] < 0.5 for r in got)
    assert toxicity.toxicity(spark.createDataFrame([], EMPTY), none).count() == 0


def test_words_have_the_same_features_in_any_company():
    """Alone, first, in the middle or last of a batch, in any order."""
    words = ["idiot", "é", "worthless", "a", "😀x", "idiots", "", "zz zz"]

    def features(batch):
        owner, feature = toxicity.word_features(pa.array(batch, pa.large_string()))
        return {w: sorted(feature[owner == k].tolist()) for k, w in enumerate(batch)}

    want = {w: features([w])[w] for w in words}
    rng = random.Random(1)
    for _ in range(30):
        batch = rng.sample(words, rng.randint(1, len(words)))
        assert features(batch) == {w: want[w] for w in batch}


def test_scores_do_not_depend_on_batches(spark, toxic_data):
    data, labels = toxic_data
    marks = spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int")
    docs = spark.createDataFrame(data + [(9000 + k, f"you {w}") for k, w in enumerate(["idiot", "1d10t", "scum", "plain"])], EMPTY)
    scores = []
    for parts, order in ((1, "doc_id"), (7, "doc_id"), (3, "text")):
        scored = toxicity.toxicity(docs.repartition(parts).sortWithinPartitions(order), marks)
        scores.append({r["doc_id"]: r["score"] for r in scored.collect()})
    assert all(abs(a - scores[0][i]) < 1e-9 for other in scores[1:] for i, a in other.items())


def test_decode_is_the_best_reading():
    """Viterbi against all readings of short lattices."""
    texts = pa.array(["idiot loser moron later dots salt stolen total"] * 3, pa.large_string())
    words = toxicity.Words(texts)
    counts = toxicity.ngram_counts(words.restored(None), np.bincount(words.codes, minlength=len(words.tokens)))
    model = toxicity.CharacterModel(counts)

    def cost(text):
        a, b, total = " ", " ", 0.0
        for c in text:
            total += model.logp(a, b, c)
            a, b = b, c
        return total

    for observed in ("1d10t", "l0s3r", "m0r0n", "5alt", "d0t5"):
        options = [("", 0.0)]
        for c in observed:
            own = [(s, toxicity.STAND_IN) for s in toxicity.STANDS_FOR.get(c, "")] + [(c, toxicity.LITERAL if c in toxicity.STANDS_FOR else 0.0)]
            options = [(t + s, k + d) for t, k in options for s, d in own]
        best = max(options, key=lambda o: o[1] + cost(o[0] + " "))
        assert toxicity.decode(observed, model) == best[0]
    assert toxicity.decode("1d10t", model) == "idiot"


# ---------------------------------------------------------------- URLs


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = None
    for action, rule in [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]:
        rhost, _, rpath = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rpath) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "https://a.example.com/en/1", "https://WWW.Example.COM/en/x?y#z", "http://www.example.com/EN/1", "http://example.com", "http://com/", "http://xcom/", "http://a.net/es/", "http://a.net/es",
        "http://a.net/fr/1/2", "http://net/fr/", "http://casino-win.example.org/de/1", "http://m.casino.org/x", "http://mycasino.org/", "http://poker-night.org?casino", "a://b://example.com/en/", "http://u@x.example.com:80/en/", "ftp://ex.org#casino/",
        "http://example.com/english", "http://éxample.com/en/",
    ]
    data = [(k, u) for k, u in enumerate(urls)] + [(None, "http://a.net/es/"), (4, urls[4]), (4, urls[4])]
    pages = spark.createDataFrame([(*d, 1, "x") for d in data], "page_id bigint, url string, token int, verdict string")
    got = url_filters.url_verdicts(pages).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    spam = {14, 15}
    want = Counter()
    for i, u in data:
        host, path, best = plain_verdict(u)
        want[i, u, host, path, best[1] if best else None, best[0] if best else ("block" if i in spam else "allow")] += 1
    want_spam = {(r["page_id"], r["verdict"]) for r in got if r["rule"] is None and r["verdict"] == "block"}
    assert {i for i, _ in want_spam} >= spam
    assert {k[:5] for k in want} == {tuple(r)[:5] for r in got} and len(got) == len(data)
    assert all(r["verdict"] == plain_verdict(r["url"])[2][0] for r in got if r["rule"])
    assert url_filters.url_verdicts(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["com", "a"],), (["com", "b"],), (["com", "rare"],)], "tokens array<string>")
    rules = [url_filters.host_rule("block", "rare.com/a/"), url_filters.host_rule("allow", "com/")]
    assert {r["name"]: r["token"] for r in url_filters.indexed(urls, rules).collect()} == {"rare.com/a/": "a", "com/": "com"}


# ---------------------------------------------------------------- language model


def test_language_scores(spark):
    docs = [(i, t) for i, t in rows()]
    got = language_model.language_scores(frame(spark, docs)).collect()
    tokens = [(i, WORDS.findall((t or "").translate(LOWER)) + ["\0end"]) for i, t in docs]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, ws in tokens if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), held[i], len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in tokens)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert have == want
    assert all(r["score"] < 0 for r in got)
    none = language_model.language_scores(spark.createDataFrame([], EMPTY))
    assert none.count() == 0


def test_language_model_learns_from_context(spark):
    """Of two languages the model learns that words of one follow one another; counts alone do not."""
    data = []
    for k in range(300):
        rng = random.Random(k)
        stems = [f"{'ab'[k % 2]}{j}" for j in range(40)]
        data.append((k, " ".join(rng.choice(stems) for _ in range(800))))
    got = language_model.language_scores(frame(spark, data, False), rate=0.05, piece=30_000).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.15 * sum(r["n_tokens"] for r in held)


def test_language_model_learns_alike_from_any_number_of_files(spark):
    """With the query's own rate: a gain of 0.2 a token over the untrained model, the same from one split and from sixty-four."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")

    def held(frame, **options):
        found = language_model.language_scores(frame, **options).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
        return found["s"], found["b"]

    untrained, base = held(docs, rounds=0)
    one, _ = held(docs.coalesce(1))
    many, _ = held(docs.repartition(64))
    assert one > untrained + 0.2 and many > untrained + 0.2
    assert abs(one - many) < 0.01 * abs(one)
    # Several parts a round learn nearly as much.
    parts, _ = held(docs, piece=1 << 19)
    assert parts > untrained + 0.2 and one > base


def test_all_tokens_are_in_lanes():
    for n in (1, 2, 511, 513, 1024, 1025, 40_000, 300_001):
        first, length = language_model.lanes_of(n)
        assert sorted(i for f, k in zip(first, length) for i in range(f, f + k)) == list(range(n))
        assert length.max() - length.min() <= 1


def test_vocabulary_grows():
    sides = [language_model.side_of(n) for n in (0, 100, 10_000, 400_000, 10**7, 10**9)]
    assert sides == sorted(sides) and sides[3] ** 2 > 4000 and sides[-1] ** 2 > 90_000


def test_probabilities_sum_to_one_and_state_is_carried():
    v = language_model.Vocabulary(np.arange(1, 200, dtype=np.uint64), np.arange(400, 201, -1), 100_000, 5_000)
    model = language_model.Recurrent.start(v)
    states = np.random.default_rng(0).standard_normal((3, language_model.HIDDEN)).astype(np.float32)
    all_ = np.arange(v.side * v.side)
    for s in states:
        logp, _ = model.output(np.repeat(s[None], len(all_), axis=0), all_)
        assert abs(np.exp(logp).sum() - 1) < 1e-4
    tokens = np.random.default_rng(1).integers(0, 200, 150)
    whole = model.text_scores(tokens, np.array([0, 100, 150]), v.end)
    state, last, slow = np.zeros((1, language_model.HIDDEN), np.float32), v.end, []
    for k, t in enumerate(tokens):
        if k == 100:
            state, last = state * 0, v.end
        _, _, state = model.window(np.array([[last]]), np.zeros((1, 1), bool), state)
        slow.append(model.output(state, np.array([t]))[0][0])
        last = t
    assert np.allclose(whole, slow, atol=1e-4)


def test_gradient():
    v = language_model.Vocabulary(np.array([1, 5, 9, 12], np.uint64), np.array([10, 40, 30, 20]), 130, 30)
    model, rng = language_model.Recurrent.start(v), np.random.default_rng(0)
    inputs, targets, fresh = rng.integers(0, 5, (6, 4)), rng.integers(0, 5, (6, 4)), rng.random((6, 4)) < 0.2
    model.ww[:] = rng.standard_normal(model.ww.shape) * 0.3
    state = np.zeros((4, language_model.HIDDEN), np.float32)
    grads = language_model.Recurrent(np.zeros_like(model.flat))
    model.learn(inputs, targets, fresh, state, grads)

    def value():
        return model.output(model.window(inputs, fresh, state)[0].reshape(-1, language_model.HIDDEN), targets.reshape(-1))[0].astype(float).sum()

    for name in ("embed", "w", "b", "u", "ww", "bw"):
        at = np.unravel_index(np.argmax(np.abs(getattr(grads, name))), getattr(grads, name).shape)
        place = getattr(model, name)
        old = place[at]
        place[at] = old + 0.01
        up = value()
        place[at] = old - 0.01
        down = value()
        place[at] = old
        assert abs((up - down) / 0.02 - getattr(grads, name)[at]) < 2e-2 * max(1, abs(getattr(grads, name)[at]))


# ---------------------------------------------------------------- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    data = [*rows(), (60, "<|endoftext|> x"), (64, "a <|endoftext|> b"), (65, "a<|endoftext|>b c <|endoftext|>"), (66, "<|endoftext"), (61, "tab\tand  two\n\n lines \n"), (62, "don't  stop\u00a0 now"), (63, "x" * 3000)]
    got = packing.pack(frame(spark, data), path, group_windows=4).collect()
    windows, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    want = Counter()
    for i, t in data:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END]
        want[i, tuple(ids)] += 1
    for (i, n), parts in by_doc.items():
        for start, length, crc, ids in parts:
            assert length == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
    have = Counter()
    for (i, n), parts in by_doc.items():
        copies = Counter(start for start, *_ in parts)[0]
        ids = sum((list(p[3]) for p in sorted(parts)[::copies]), [])
        have[i, tuple(ids)] += copies
    assert {k: v for k, v in have.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert packing.pack(spark.createDataFrame([], EMPTY), path).count() == 0


def test_differencing():
    """Near-equal sums, no part lost, and one window more where the capacity would be exceeded."""
    rng = random.Random(0)
    for _ in range(50):
        sizes = [rng.randint(1, 512) for _ in range(rng.randint(1, 300))]
        n = rng.randint(1, 12)
        dealt = packing.differencing(sizes, n)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes))) and len(dealt) <= n
        sums = [sum(sizes[i] for i in w) for w in dealt]
        if len(sizes) >= 12 * n:
            assert max(sums) - min(sums) <= 16
    assert len(packing.windows_of([1500, 1500, 1000], 2048)) == 3


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_are_the_best_cut(vocabulary):
    words = ["the", "hello", "Ñaño", "x\ny", "日本語", "a▁b", "", "😀x", "internationalisation", "a" * 60] + sorted(set(prose(3, 300).split(" ")))[:150]
    ids, at, scores = vocabulary.encode_words(pa.array(words, pa.large_string()))
    for word, score in zip(words, scores):
        text = "\u2581" + word
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for size in range(1, min(end, vocabulary.longest) + 1):
                piece = text[end - size : end]
                inner = "\u2581" in (piece[1:] if end == size else piece)
                s = None if inner else vocabulary.scores.get(piece)
                if s is None and size == 1:
                    s = vocabulary.unknown
                if s is not None:
                    best[end] = max(best[end], best[end - size] + s)
        assert abs(best[-1] - score) <= 1e-6 * abs(score)


def test_pieces_round_trip(spark, vocabulary):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(frame(spark), path)
    assert Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded, path).collect()) == Counter((i, t or "") for i, t in rows())
    digests = pieces.encoding_digests(frame(spark), path).collect()
    assert len(digests) == len(rows()) and all(r["round_trip"] for r in digests)
    assert {(r["doc_id"], r["decoded_sha256"]) for r in digests} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows()}
    assert pieces.encode(spark.createDataFrame([], EMPTY), path).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprint_edits(spark):
    data = [(i, t) for i, t in rows() if i != 40] + [(40, "one row of this id"), (41, "")]
    got = fingerprints.fingerprint_edits(frame(spark, data)).collect()
    ordered = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["fingerprint"] == by_id[20]["fingerprint"] and by_id[27]["fingerprint"] == by_id[28]["fingerprint"]
    for k, (i, t) in enumerate(ordered[:-1]):
        j = ordered[k + 1][0]
        if i is not None and j is not None:
            a, b = (np.frombuffer(bytes.fromhex(by_id[x]["fingerprint"]), ">u2") for x in (i, j))
            assert by_id[i]["near_next"] == (a == b).mean()
            assert by_id[i]["near_edited"] == (a == np.frombuffer(bytes.fromhex(by_id[i]["edited_fingerprint"]), ">u2")).mean()
    assert {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint(frame(spark, data)).collect()} >= {(i, by_id[i]["fingerprint"]) for i in by_id if i is not None}
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], EMPTY)).count() == 0


def test_collisions_follow_generalised_jaccard():
    texts, pairs = [], []
    for k in range(60):
        a = prose(k, 200, 60).split()
        b = a[: 200 - 3 * k] + prose(500 + k, 3 * k, 60).split()
        texts += [" ".join(a), " ".join(b)]
        x, y = Counter(a), Counter(b)
        pairs.append(sum((x & y).values()) / sum((x | y).values()))
    found = fingerprints.signatures(pa.array(texts, pa.large_string()), 512)
    near = fingerprints.likeness(found[::2], found[1::2])
    assert np.abs(near - pairs).max() < 0.1 and abs((near - pairs).mean()) < 0.01
