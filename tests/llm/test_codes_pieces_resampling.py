"""Vector codes, SentencePiece and importance resampling against brute force, on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import pieces, queries, resampling, vector_codes
from quarrylight.tables import table
from tests.llm.test_operators import SCHEMA, TEXTS, docs, none  # noqa: F401 - fixtures

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, v int, e string, of int, p int, k int"


def coded(rows, parts=4, entries=256, rounds=4):
    """The contract in plain Python integers: (vec_id, code, error, label_error), codebooks' digest."""
    kept = [(i, v, la) for i, v, la in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    whole = [(i, [min(max(math.floor(1024 * float(np.float32(c))), -(1 << 25)), 1 << 25) for c in v] + [0] * (width * parts - len(v)), la) for i, v, la in kept]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in whole:
                part = v[p * width : (p + 1) * width]
                groups.setdefault(near(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else b for j, b in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, v, la in whole:
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), la))
        by_label[la] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, c, e, by_label[la]) for i, c, e, la in out], digest


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, "c", "e", 1, "e", 2, 3, 4) for i, v, la in rows], VECTORS).repartition(3)


def same_codes(spark, rows):
    got = vector_codes.coded_rows(vectors(spark, rows)).collect()
    want, digest = coded(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == ({digest} if want else set())


def test_codes_on_awkward_vectors(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(i, rows[5][1], 7) for i in range(400, 460)]  # copies
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None), (900, None, 1), (901, [0.1, None] * 4, 1), (902, [float("nan")] * 8, 2)]
    rows += [(903, [float("inf")] + [0.0] * 7, 2), (904, [0.5, 0.5, 0.5], 3), (905, [], 3), (906, [3e38, -3e38] + [0.0] * 6, 4), (-7, [0.0] * 8, 4)]
    same_codes(spark, rows)


def test_codes_with_few_or_no_vectors(spark):
    same_codes(spark, [(3, [0.5, -0.25, 1.0, 2.0, 0.1], None), (1, [1.0] * 5, 1)])
    same_codes(spark, [])
    same_codes(spark, [(1, None, 1)])
    same_codes(spark, [(1, [], 1), (2, [], None)])


@pytest.mark.parametrize("scale", [1, 700, 1 << 20])
def test_screening_never_loses_the_nearest(scale):
    rng = np.random.default_rng(scale)
    book = rng.integers(-scale, scale + 1, (256, 16)) + (scale << 4)  # far from the origin, where float32 cancels
    book[200:] = book[:56]  # equal entries: the lower index wins
    x = np.concatenate([book[rng.integers(0, 256, 3000)] + rng.integers(-1, 2, (3000, 16)), (book[::2] + book[1::2]) // 2])
    index, error = vector_codes.nearest(x, book)
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_sentencepiece_on_awkward_documents(spark, docs, none):  # noqa: F811
    library = pieces.model(pieces.tokenizer_path(pieces.MODEL)).library
    got = pieces.encode_and_decode(docs).collect()
    want = [(d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in TEXTS]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(want, key=key)
    assert pieces.encode_and_decode(none).collect() == []


def test_sentencepiece_query_on_whole_table(spark, small):
    library = pieces.model(pieces.tokenizer_path(pieces.MODEL)).library
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, small).collect()}
    rows = table(spark, small, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "")
        texts = (",".join(map(str, ids)), library.decode(ids))
        assert got[doc_id] == (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


def test_last_tokens_are_the_librarys_on_random_text():
    model, rng = pieces.model(pieces.tokenizer_path(pieces.MODEL)), random.Random(12)
    chars = [*"aeinrst .,\n\t▁01éñß漢かЖ🙂\x00({;", "the", "ing", " of", "   ", " " * 17, "\U0010ffff", "é"]
    for _ in range(4000):
        text = "".join(rng.choices(chars if rng.random() < 0.5 else list(model.pieces), k=rng.randint(0, 40)))
        text = text.replace("▁", " ") if rng.random() < 0.5 else text
        assert model.ids(text).tolist() == model.library.encode(text), text
    long = "".join(rng.choices("etaoinshr", k=30_000)) + " " * 5000 + "漢字" * 3000
    assert model.ids(long).tolist() == model.library.encode(long)


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 50)
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 20)
    model = pieces.Model(pieces.tokenizer_path(pieces.MODEL))
    for text in ("many different words in a row, " * 3, PASSAGE := " ".join(f"w{i} x{i * i}" for i in range(200)), PASSAGE):
        assert model.ids(text).tolist() == model.library.encode(text)
    assert len(model.kept) <= 20 and model.met <= 50


def resampled(rows, target, percent=25, least=20, longest=2, buckets=10_000, seed=7):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    features = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(words(t)))
    b = Counter(bucket(f) for t in target for f in features(words(t)))
    gain = lambda i: math.floor(1000 * math.log((b[i] + 1) * (s.total() + buckets) / ((s[i] + 1) * (b.total() + buckets))))
    out = []
    for doc_id, t in rows:
        w = words(t)
        f = features(w)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = [(r, k + 1 if k < percent * len(order) // 100 else None) for k, r in enumerate(order)]
    return [(*r, k) for r, k in ranks] + [(*r, None) for r in out if r[1] < least]


def same_draw(spark, source, target, **how):
    got = resampling.resample(source, target, **how).collect()
    want = resampled([tuple(r) for r in source.select("doc_id", "text").collect()], [r["text"] for r in target.select("text").collect()], **{{"min_words": "least"}.get(k, k): v for k, v in how.items()})
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=key) == sorted(want, key=key)


def test_resampling_on_awkward_documents(spark, docs, none, small):  # noqa: F811
    target = table(spark, small, "benchmark")
    same_draw(spark, docs, target)
    same_draw(spark, docs.unionByName(docs), target.unionByName(target), percent=60, min_words=0)
    same_draw(spark, docs, target.limit(0), longest=3, buckets=97)
    same_draw(spark, docs, target, longest=1)
    same_draw(spark, none, target)
    assert resampling.resample(docs, target).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_suffixes_are_sorted_and_neighbours_measured():
    rng = np.random.default_rng(13)
    for depth in (1, 2, 3, 5):
        sizes = rng.integers(0, 9, 60)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = rng.integers(0, 3, offsets[-1])
        found = resampling.suffixes(ids, offsets, depth)
        ends = offsets[np.searchsorted(offsets, np.arange(len(ids)), side="right")]
        suffix = [tuple(ids[i : min(i + depth, e)]) for i, e in zip(found.order, ends[found.order])]
        assert suffix == sorted(suffix) and sorted(found.order) == list(range(len(ids)))
        for k in range(1, len(suffix)):
            shared = next((n for n, (a, b) in enumerate(zip(suffix[k], suffix[k - 1])) if a != b), min(len(suffix[k]), len(suffix[k - 1])))
            assert found.common[k] == shared


def test_ranking_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED", 50)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"), F.lit(1).alias("n_features"), F.lit(0).alias("weight"))
    got = {r["doc_id"]: r["rank"] for r in resampling.ranked(rows, 2000, 3000).collect()}
    want = {d: k + 1 for k, d in enumerate(sorted(range(3000), key=lambda d: (-(d % 7), d)))}
    assert got == {d: k if k <= 2000 else None for d, k in want.items()}
