"""Inputs that once went wrong: lines that recur beside copies, long shared lines, short lines, and jobs that run twice."""

import pytest

from remitlens.llm.exact_dedup import DigestIndex
from remitlens.llm.line_dedup import drop_template_lines
from remitlens.llm.pii import find_private
from remitlens.llm.quality_rules import QualityRules, quality
from corpus_samples import prose

LINE = "this very line stands in every one of these many documents"


def dropped(docs, ids):
    return sum(r.n_dropped > 0 for r in drop_template_lines(docs, count_cols=True).collect() if r.doc_id in ids)


def test_short_lines_count(docs_of):
    docs = docs_of([(i, f"{prose(i, 30)}\nAdvertisement\nRead more\n{i}", "a") for i in range(40)])
    assert dropped(docs, range(40)) == 40
    assert all(r.text.endswith(f"\n{r.doc_id}") and "Advert" not in r.text and "Read" not in r.text for r in drop_template_lines(docs).collect())


def test_copies_of_one_document_hide_no_line_of_others(docs_of):
    docs = docs_of([(i, f"{LINE}\n{prose(5000, 30)}", "a") for i in range(300)] + [(1000 + i, f"{LINE}\n{prose(i, 30)}", "a") for i in range(60)])
    assert dropped(docs, range(1000, 1060)) == 60
    assert sum(r.common_words > 0 for r in quality(docs).collect() if r.doc_id >= 1000) == 60


def test_header_and_footer_longer_than_the_body(docs_of):
    docs = docs_of([(i, f"{LINE}\n{prose(i, 6)}\n{LINE} too", "a") for i in range(60)])
    assert dropped(docs, range(60)) == 60
    assert all(r.common_words == 23 and not r.kept for r in quality(docs, QualityRules(min_left=0.3)).collect())


def test_documents_of_one_line(docs_of):
    docs = docs_of([(i, f"user {i} logged in from port {7 * i}", "a") for i in range(60)])
    assert dropped(docs, range(60)) == 60


def test_a_start_alone_makes_no_template(docs_of):
    docs = docs_of([(i, f"the history of {prose(i, 3)}\n{prose(100 + i, 30)}", "a") for i in range(40)])
    assert dropped(docs, range(40)) == 0


def test_few_documents_of_a_large_host_make_no_line_common(docs_of):
    """A group of near copies: the lines that an edit leaves alone stand in 30 different documents, but in few of the host's."""
    near = [(i, f"{prose(9000, 30)}\n{prose(9001, 20)} {i}", "a") for i in range(30)]
    docs = docs_of(near + [(1000 + i, prose(i, 12), "a") for i in range(1600)])
    assert all(r.common_words == 0 for r in quality(docs).collect())


@pytest.mark.parametrize("batch", ["b1", None])
def test_a_batch_run_twice_keeps_the_same_rows(docs_of, spark, tmp_path, batch):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=2)
    docs = docs_of([(1, "a b", None), (2, "ab", None), (3, "c", None)])
    fates = lambda: sorted((r.doc_id, r.keep_id, r.kept, r.known) for r in index.add(docs, batch=batch).collect())
    first, again = fates(), fates()
    assert first == [(1, 1, True, False), (2, 1, False, False), (3, 3, True, False)]
    assert again == (first if batch else [(1, 1, False, True), (2, 1, False, True), (3, 3, False, True)])
    assert index.entries().count() == 2
    later = {r.doc_id: (r.kept, r.known, r.keep_id) for r in index.add(docs_of([(9, "c", None), (8, "d", None)])).collect()}
    assert later == {9: (False, True, 3), 8: (True, False, 8)}
    small = index.compacted(str(tmp_path / "small"))
    assert sorted(r.keep_id for r in small.entries().collect()) == [1, 3, 8]
    assert {r.known for r in small.add(docs).collect()} == {True}
    for opened in (index, small):
        opened.close()
        assert not spark.catalog.tableExists(opened.table)


def test_a_value_with_as_many_contexts_as_documents(docs_of):
    docs = docs_of([(i, f"mail me@example.org about {prose(i, 4)}", "a") for i in range(3)])
    got = find_private(docs).collect()
    assert len(got) == 3 and all([s.kind for s in r.spans] == [0] for r in got)
