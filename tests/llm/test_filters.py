"""Exact dedup, quality rules, line dedup and near-dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from remitlens.llm.components import components
from remitlens.llm.exact_dedup import DigestIndex
from remitlens.llm.line_dedup import TemplatePolicy, drop_template_lines, line_templates
from remitlens.llm.quality_rules import QualityRules, quality, without_common_lines
from remitlens.llm.simhash_dedup import fingerprint, near_dedup, near_links, tile_links, without_near_copies
from corpus_samples import CLASH, ODD, prose

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def test_exact_dedup_keeps_the_longest_then_the_smallest_id(docs_of):
    rows = [*ODD, (10, "o  n  e", "c"), (11, "on  e  ", "c")]
    got = DigestIndex(docs_of(rows).sparkSession).add(docs_of(rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0))
    best = {hashlib.sha256(k.encode()).hexdigest(): (None if min(v)[1] else min(v)[2], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == best[r.text_sha256]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(best.keys())


def test_index_outlives_the_session_and_drops_what_it_knows(docs_of, spark, tmp_path):
    path = str(tmp_path / "index")
    DigestIndex(spark, path, buckets=3).add(docs_of([(1, "a b", None), (2, "c", None)]))
    again = DigestIndex(spark, path, buckets=3)
    got = {r.doc_id: r for r in again.add(docs_of([(3, "a   b", None), (4, "d", None), (5, "d", None)])).collect()}
    assert (got[3].kept, got[3].known, got[3].keep_id) == (False, True, 1)
    assert (got[4].kept, got[5].kept, got[5].keep_id) == (True, False, 4)
    assert again.entries().count() == 3
    assert again.add(docs_of([])).count() == 0


def repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality_measures(docs_of):
    rows = [*ODD, (20, "a b c d e a b c d e f", "q"), (21, "w " * 40, "q"), (22, "l1 # x\nl1 # x\n \n\nl2 <b>|", "q"), (23, "a b c d e f a b c d e z b c d e f", "q")]
    for r in quality(docs_of(rows)).collect():
        same = [t or "" for i, t, _ in rows if i == r.doc_id]
        texts = [t for t in same if len(WORDS.findall(t)) == r.n_words]
        assert texts
        words, lines = WORDS.findall(texts[0]), [x for x in texts[0].split("\n") if WORDS.search(x)]
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(texts[0].count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeats(words)
        assert r.base_failed == (len(words) < 10 or 100 * repeats(words) > 20 * len(words))


def test_common_lines_deplete_documents_but_copies_of_one_document_do_not(docs_of):
    rules = QualityRules(max_documents=5)
    share = "this very line stands on too many documents of the host"
    unlike = [(i, f"{share}\n{prose(i, 30)}", "a") for i in range(8)]
    empty = [(100 + i, f"{share}\n{prose(i, 2)}", "a") for i in range(3)]
    copies = [(200 + i, f"{prose(999, 30)}\n{prose(998, 20)}", "a") for i in range(20)]
    docs = docs_of([*unlike, *empty, *copies, (300, share, "b")])
    verdicts = quality(docs, rules)
    got = {r.doc_id: r for r in verdicts.collect()}
    assert all(got[i].kept and got[i].common_words == 11 for i in range(8))
    assert not any(got[100 + i].kept or got[100 + i].base_failed for i in range(3))
    assert all(got[200 + i].kept and not got[200 + i].common_words for i in range(20)) and got[300].kept
    left = without_common_lines(docs, verdicts)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[3] == prose(3, 30) and texts[200] == copies[0][1] and texts[300] == share and 100 not in texts


def test_line_templates_generalise_fields_and_leave_copies(docs_of):
    policy = TemplatePolicy(min_documents=5)
    line = "posted on {} by user {} in the general section"
    names = [prose(500 + i, 1) for i in range(12)]
    rows = [(1000 + i, f"{prose(i, 20)}\n\n{line.format(i, names[i])}\n{prose(50 + i, 10)}", "a") for i in range(12)]
    copies = [(100 + i, f"{prose(7000, 20)}\n{prose(7001, 15)}\n{prose(7002, 12)}", "a") for i in range(9)]
    docs = docs_of([*rows, *copies, *ODD])
    found, _ = line_templates(docs, policy)
    assert [r.template for r in found.collect()] == ["posted on <*> by user <*> in the general section"]
    out = drop_template_lines(docs, policy)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    for i in range(12):
        assert texts[1000 + i] == [f"{prose(i, 20)}\n\n{prose(50 + i, 10)}"]
    for i, t, _ in copies:
        assert texts[i] == [t]
    assert sorted(map(str, texts[1])) == ["None"] and texts[8][0] == "x" * 20000
    assert drop_template_lines(docs_of([]), policy).count() == 0


def slow_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_match_the_definition_also_over_chunks():
    texts = ["", None, "One", "one TWO", "a b c", "É a b É a b", prose(3, 400), " \x1c a\x85b c d"]
    assert [fingerprint(t or "") for t in texts] == [slow_fingerprint(t) for t in texts]
    assert fingerprint(prose(4, 300), chunk=7) == fingerprint(prose(4, 300))


def test_near_dedup_against_brute_force(docs_of):
    base = prose(11, 400).split()
    near = [(100 + i, " ".join([*base[:i], "changed", *base[i + 1 :]]), "a") for i in range(0, 30, 3)]
    rows = [*ODD, (50, " ".join(base), "a"), *near, *[(200 + i, prose(200 + i, 60), "b") for i in range(20)]]
    docs = docs_of(rows)
    got = near_dedup(docs, tile=4).collect()
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    roots = slow_components(prints)
    lowest = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            lowest[r] = min(i, lowest.get(r, i))
    want = sorted((str(i), f"{p:016x}", lowest.get(r)) for (i, _, _), p, r in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(set(roots))
    one = without_near_copies(docs)
    assert one.columns == docs.columns and one.count() == len(set(roots))
    assert {r[0] for r in one.select(CLASH[0]).distinct().collect()} == {"x0"}
    assert near_dedup(docs_of([])).count() == 0 and without_near_copies(docs_of([])).count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 8])
def test_links_connect_the_same_values_whatever_the_tiles(spark, blocks):
    rng = np.random.default_rng(blocks)
    seeds = rng.integers(0, 1 << 63, 15, dtype=np.uint64)
    values = sorted({int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for s in seeds for k in (0, 1, 2, 3, 4)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    parts = defaultdict(set)
    for r in components(near_links(df, 2, tile=8, blocks=blocks)).collect():
        parts[r.root].add(r.node % (1 << 64))
    got = sorted(sorted({k % (1 << 64), *v}) for k, v in parts.items())
    groups = defaultdict(set)
    for v, r in zip(values, slow_components(values)):
        groups[r].add(v)
    assert got == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_tile_links_are_a_forest():
    values = np.array([0, 1, 3, 7, 15, 0xFFFFF << 40], np.uint64)
    a, b = tile_links(values, values, 2)
    assert len(a) == 4 and set(a.tolist()) | set(b.tolist()) == {0, 1, 3, 7, 15}


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(path).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}
