"""Token files, importance resampling and hard negatives against the library, brute force and round trips."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from remitlens.llm import importance_resampling as IR
from remitlens.llm.hard_negatives import NegativePolicy, hard_negatives, key_of, parts_of
from remitlens.llm.importance_resampling import Resampling, bracket, resample
from remitlens.llm.token_files import BLOCK, Codec, canonical_codes, code_lengths, read_token_files, write_token_files
from corpus_samples import ODD, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# --- token files


def huffman_cost(counts):
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@pytest.mark.parametrize("n, limit", [(1, 4), (2, 4), (3, 2), (8, 3), (300, 9), (300, 20), (5000, 20)])
def test_codes_are_prefix_free_within_the_limit_and_of_the_least_size(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(6000, np.int64)
    counts[rng.choice(6000, n, False)] = np.maximum(1, rng.pareto(1, n) * 9).astype(np.int64)
    lengths = code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(int)
    assert len(used) == n and used.max() <= limit and sum(2.0**-used) <= 1
    if limit == 20 and n > 1:
        assert (counts * lengths).sum() == huffman_cost(counts[counts > 0].tolist())
    codes = canonical_codes(lengths)
    words = sorted(format(int(codes[s]), f"0{lengths[s]}b") for s in np.flatnonzero(lengths))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_a_limit_costs_no_more_than_it_must():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21], np.int64)  # plain Huffman codes take up to 7 bits
    best = min(sum(c * n for c, n in zip(counts, ls)) for ls in lengths_up_to(len(counts), 4))
    assert (counts * code_lengths(counts, 4)).sum() == best


def lengths_up_to(n, limit):
    from itertools import combinations_with_replacement
    return [tuple(reversed(ls)) for ls in combinations_with_replacement(range(1, limit + 1), n) if sum(2.0**-k for k in ls) <= 1]


def test_too_many_symbols_for_the_limit_are_refused():
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7])
def test_a_stream_reads_back_and_so_does_each_block_by_itself(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.5, n).astype(np.int64) % 900
    codec = Codec(code_lengths(np.bincount(np.append(ids, [3, 4]), minlength=1000)))
    data, checkpoints = codec.write(ids.astype(np.uint16))
    assert codec.read(data, checkpoints, n).tolist() == ids.tolist()
    for b, at in enumerate(checkpoints):
        part = ids[b * BLOCK : (b + 1) * BLOCK]
        assert codec.read(data, checkpoints[b : b + 1], len(part)).tolist() == part.tolist(), at


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError):
        Codec(code_lengths(np.array([5, 5, 0], np.int64))).write(np.array([2], np.uint16))


def test_files_hold_the_librarys_ids_in_order(docs_of, spark, tmp_path):
    rows = [*ODD, *[(20 + i, prose(i, 30), "a") for i in range(60)], (9_000_000_000, "<|endoftext|> x", "a"), (-3, "y", "a")]
    write_token_files(docs_of(rows).repartition(5), str(tmp_path / "t"), WORD_BPE, 2)
    got = read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    assert Counter((r.id, tuple(r.token_ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.token_ids)) and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4"))
        at += r.n_tokens
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_no_documents_make_files_too(docs_of, spark, tmp_path):
    write_token_files(docs_of([]), str(tmp_path / "t"), WORD_BPE, 2)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


# --- importance resampling


def brute_draw(docs, target, percent=10, min_words=20, run=1, buckets=10000):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(low))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows, pool = [], []
    for i, text in docs:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if n >= min_words:
            pool.append(rows[-1])
    pool.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, pool[: percent * len(pool) // 100]


@pytest.mark.parametrize("run, percent", [(1, 10), (3, 100), (2, 37)])
def test_draw_matches_brute_force(docs_of, spark, run, percent, monkeypatch):
    monkeypatch.setattr(IR, "PIECE", 64)  # long texts go by pieces
    rows = [*ODD, *[(100 + i, prose(i % 90, 15 + i % 40).upper() + " é1-ñ\x7f", "a") for i in range(300)]]
    target = [prose(k, 40) for k in range(8)] + [None, ""]
    got = resample(docs_of(rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), Resampling(max_run=run, percent=percent)).collect()
    want, drawn = brute_draw([(i, t) for i, t, _ in rows], target, percent, run=run)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_equal_rows_are_drawn_one_by_one(docs_of, spark):
    """All scores tie, so the cutoff lies inside one score and, for repeated ids, inside one id."""
    rows = [(5, prose(1, 30), "a")] * 20
    got = resample(docs_of(rows), spark.createDataFrame([("x",)], "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 20
    assert resample(docs_of([]), spark.createDataFrame([("x",)], "text string")).count() == 0
    assert resample(docs_of(ODD[:5]), spark.createDataFrame([], "text string")).where("rank is not null").count() == 0


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    pool = spark.range(5000).select(F.col("id").alias("score"), "id")
    asked = []

    def wrong(column, share, accuracy):  # a sketch that is far off at first
        asked.append(share)
        return F.max(column) - 10 if len(asked) <= 2 else F.percentile_approx(column, share, accuracy)

    monkeypatch.setattr(IR, "F", type("G", (), {**{n: staticmethod(getattr(F, n)) for n in ("col", "lit", "count_if")}, "percentile_approx": staticmethod(wrong)}))
    held = bracket(pool, 500, 5000, Resampling())
    assert held.above < 500 <= held.above + held.inside < 600 and len(asked) == 4


# --- hard negatives


def brute_negatives(rows, policy=NegativePolicy()):
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in ok:
        if i % 100 == 0 and (i not in anchors or (l, v) < anchors[i]):
            anchors[i] = (l, v)
    out = []
    for a, (label, vector) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, l) for i, l, v in ok if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][: policy.positives]:
            fits = [r for r in scored if r[2] != label and policy.low * -s <= policy.high * -r[0] and -r[0] <= -s][: policy.negatives]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    schema = "vec_id bigint, label int, embedding array<float>, key string, id string, vector string, anchor string, score string, is_anchor string"
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema)


def mined(spark, rows, **policy):
    return sorted(map(tuple, hard_negatives(vectors(spark, rows).repartition(6), F.col("vec_id") % 100 == 0, NegativePolicy(**policy)).collect()))


def test_negatives_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [round(rng.gauss(0.1, 0.4), 1) for _ in range(4)]) for i in range(700)]  # many ties
    rows += [(1000, None, [1.0] * 4), (1100, 1, None), (1200, 1, [1.0, None, 0.0, 1.0]), (1300, 1, [float("nan")] * 4), (1400, 1, [float("inf")] * 4), (None, 1, [1.0] * 4),
             (-100, 1, [0.5] * 4), (1501, 2, [9.0]), (1502, 1, []), (200, 1, [0.7] * 4), (303, 1, [0.6] * 4), (303, 1, [0.6] * 4)]
    want = brute_negatives([(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows])
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, round_bytes=300) == want  # many rounds
    assert mined(spark, rows, positives=2, negatives=9, low=50) == brute_negatives([(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows], NegativePolicy(2, 9, 50))


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [1e5 + i, 3e5 * (i % 5), -2e6]) for i in range(40)] + [(i, i % 2, [4e6 + 64 * i]) for i in range(40, 60)] + [(100, 1, [2e6, 1e6, 5e5])]
    assert mined(spark, rows) == brute_negatives([(i, l, [float(np.float32(x)) for x in v]) for i, l, v in rows])


def test_tables_without_anchors_positives_or_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (2, 2, [1.0])]) == []


def test_keys_sort_as_their_parts():
    parts = [(a, s, n, i) for a in (-5, 0, 7) for s in (-(1 << 62), -1, 0, 3, 1 << 62) for n in (False, True) for i in (-9, 0, 4)]
    assert [parts_of(k) for k in sorted(key_of(*p) for p in parts)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_small_caches_of_words_stay_small_and_give_the_same_pieces(spark):
    from remitlens.llm.packing import pack_documents
    from remitlens.llm.queries import vocabulary
    from remitlens.llm.word_pieces import WordEncoder
    path = vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"word{i * k % 977}, über{k}" for k in range(60)) for i in range(40)]
    small, usual = WordEncoder(path, 4_000), WordEncoder(path)
    assert all((small.encode(t) == usual.encode(t)).all() and max(small.held.values()) <= 4_000 for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2, "doc_id").sortWithinPartitions("doc_id")
    one, two = (sorted(map(tuple, pack_documents(df, path, with_ids=True, **kw).collect())) for kw in ({}, {"cache_bytes": 4_000}))
    assert one == two and one
