"""Personal data, HTML, tokenizers, packing and licences against brute force, the libraries or held-out rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from remitlens.llm.html_extract import main_text, read_page
from remitlens.llm.license_scan import LicensePolicy, document_licenses, train
from remitlens.llm.license_templates import TEMPLATES
from remitlens.llm.packing import Tiers, pack_documents
from remitlens.llm.pii import DisclosurePolicy, find_private, sanitised, span_digests
from remitlens.llm.sentencepiece_codec import PrefixViterbi, decode, encode
from remitlens.llm.token_counts import LongestMatch, WordCounter, token_counts
from corpus_samples import ODD, prose

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


PRIVATE = [
    "a@b.c%d@e.f x@y @ foo@bar@baz.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 é 4111-1111-1111-1112", "é😀 x@y.zz,+4912345678901 9",
    "+1 (319) 555-5132 +12 +1-------- +1 23 45 67 89)", "a@b.c" * 3, "call +49 171 1234567, or 10.0.0.1 or me@x.org", "12" * 40, "4111111111111111",
]


def test_base_spans_match_the_patterns(docs_of):
    rows = [*ODD, *[(100 + i, t, "p") for i, t in enumerate(PRIVATE)]]
    got = span_digests(find_private(docs_of(rows))).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, t, _ in rows:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert any(r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE] for r in by_id[i])


def test_terms_that_give_a_value_away_are_found_everywhere(docs_of):
    told = [(i, f"{prose(i, 20)} please ask Zyxwabc at boss@corp.example about {prose(40 + i, 20)}", "a") for i in range(5)]
    plain = [(100 + i, f"{prose(100 + i, 20)} please ask {prose(200 + i, 1)} about it", "a") for i in range(40)]
    docs = docs_of([*told, *plain, (500, "Zyxwabc was here; zyxwabcs not", "a"), (501, None, None)])
    got = {r.doc_id: r for r in span_digests(find_private(docs, DisclosurePolicy(min_contexts=3))).collect()}
    assert got[500].spans == "term:0:7" and got[500].n_email == 0
    assert all("term:" not in got[i].spans for i, _, _ in plain)
    clean = sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[500] == "[NAME] was here; zyxwabcs not" and texts[501] is None and texts[100] == plain[0][1]
    assert "[NAME]" in texts[0] and "[EMAIL]" in texts[0] and "boss@corp" not in texts[0]
    assert find_private(docs_of([])).count() == 0


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/x">x</a></ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>A &amp; B</h1></header><p>One <b>two</b>three<p>Four<br>five
<div class=ad>buy</div><ul><li>a<li>b</ul><form>q<input></form><section id="comments"><article class="comment">nice</article></section></article></main><aside>side</aside><footer>f</footer>"""


def test_main_text_of_a_page():
    assert read_page(PAGE).text() == "A & B One twothree Four five a b"
    assert read_page("").text() == "" and read_page("a <b>b</b>c &lt; 5 <x <p>q").text().startswith("a bc < 5")
    assert read_page("<p>" * 3000 + "deep" + "<div>" * 3000).text() == "deep"
    assert read_page('<a title="x > y">l</a> <i \'>t').text() == "l t"


def test_site_templates_are_removed_but_not_repeated_prose(spark):
    box = "<div class='x1'><span>Read more on our site</span> today</div>"
    same = "<p>a sentence that many articles of the site quote</p>"
    rows = [(i, f"http://a.org/{i}", f"<article><h1>{prose(i, 3)}</h1>{same}<p>{prose(50 + i, 12)}</p>{box}</article>") for i in range(14)]
    rows += [(50 + i, f"http://b.org/{i}", f"<div><div>{prose(7, 30)}</div><div>{prose(8, 9)}</div></div>") for i in range(14)]  # copies of one page
    rows += [(90, "http://c.org/", f"<article>{box}</article>"), (91, None, None), (92, "no url", ""), (None, "http://a.org/", PAGE), (92, "no url", "")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, `key` string, n int")
    got = main_text(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for i in range(14):
        assert texts[i] == f"{prose(i, 3)} a sentence that many articles of the site quote {prose(50 + i, 12)}"
        assert texts[50 + i] == f"{prose(7, 30)} {prose(8, 9)}"
    assert texts[90] == "Read more on our site today" and texts[91] == "" and all(r.n_chars == len(r.text) for r in got)
    assert main_text(pages.where("false")).count() == 0


STRANGE = ["  a  b\n\tc  ", "", "x▁y ▁ z", "ﬁ ½ 你好 👩‍👩‍👧 <0x0A> <s> </s> <unk>", " ", "\n\n  \n", "a" * 500, "▁" * 40 + " ", "éééàààñ" * 50, "Hello, World! it's   42"]


def test_sentencepiece_ids_and_texts_are_the_librarys(docs_of):
    texts = [*STRANGE, *[prose(i, 80) for i in range(20)]]
    sp, own = SentencePieceProcessor(model_file=PIECES), PrefixViterbi(PIECES)
    assert [x.tolist() for x in own.encode_batch(texts)] == sp.encode(texts)
    rows = [*ODD, *[(100 + i, t, "s") for i, t in enumerate(texts)]]
    encoded = encode(docs_of(rows), PIECES)
    got = sorted(((r.doc_id or 0, r.ids) for r in encoded.collect()))
    assert got == sorted((i or 0, sp.encode(t or "")) for i, t, _ in rows)
    back = sorted((r.doc_id or 0, r.text) for r in decode(encoded, PIECES).collect())
    assert back == sorted((i or 0, sp.decode(sp.encode(t or ""))) for i, t, _ in rows)
    checked = sorted((r.doc_id or 0, r.ids, r.round_trip) for r in encode(docs_of(rows), PIECES, verify=True).collect())
    assert checked == sorted((i or 0, sp.encode(t or ""), sp.decode(sp.encode(t or "")) == (t or "")) for i, t, _ in rows)
    assert encode(docs_of([]), PIECES).count() == 0


def greedy(word, pieces):
    at, n, longest = 0, 0, max(map(len, pieces))
    while at < len(word):
        to = next((j for j in range(min(len(word), at + longest), at, -1) if word[at:j] in pieces), None)
        if to is None:
            return None
        at, n = to, n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_longest_match_counts(seed):
    rng = np.random.default_rng(seed)
    make = lambda most: tuple(rng.choice(list("abc"), rng.integers(1, most)))
    pieces = {make(6) for _ in range(12)} | ({("a",), ("b",), ("c",)} if seed % 2 else set())
    model = LongestMatch(sorted(pieces))
    for _ in range(400):
        word = make(15)
        assert model.count(word) == greedy(word, pieces)


def test_token_counts(docs_of):
    counter, letters = WordCounter(WORD_BPE), ByteLevel(add_prefix_space=False, use_regex=False)
    pieces = set(map(counter.symbols, counter.words.tokenizer.get_vocab(with_added_tokens=False)))
    rows = [*ODD, *[(100 + i, t, "s") for i, t in enumerate(STRANGE)]]
    got = token_counts(docs_of(rows), WORD_BPE).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        words = [w for r in counter.words.runs_of(t or "") for w in counter.words.pattern.findall(r)]
        counts = [greedy(counter.symbols("".join(p for p, _ in letters.pre_tokenize_str(w)) + "</w>"), pieces) for w in words]
        want.append((i or 0, len(words), sum(1 if n is None else n for n in counts)))
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in got) == sorted(want)


def test_word_encoder_gives_the_librarys_ids():
    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    encoder = WordCounter(WORD_BPE).words
    for t in [*STRANGE, "ΣΑΣ ΟΔΟΣ a\x1cb\x85c\xa0d İstanbul é 힣", "<|endoftext|> it's I'LL", prose(5, 300)]:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_is_a_partition_of_the_ids_without_padding(docs_of):
    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    rows = [*[r for r in ODD if r[0] != 5], *[(100 + i, prose(i, 3 + 37 * i % 900), "s") for i in range(60)]]
    got = pack_documents(docs_of(rows).repartition(3), WORD_BPE, with_ids=True).collect()
    texts = {i: t for i, t, _ in rows if i is not None}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, own = [*library.encode(t or "", add_special_tokens=False).ids, 1], sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    assert sum(r.length for r in pieces[None]) == 1 + len(library.encode("two words", add_special_tokens=False).ids) + 1
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]])) and {r.window for r in own} == {sum(r.length for r in own)}
        assert own[0].window <= 2048 and own[0].window & (own[0].window - 1) == 0
    again = pack_documents(docs_of(rows).repartition(3), WORD_BPE).collect()
    assert sorted((r.sequence_id, r.offset, r.ids_crc32) for r in again) == sorted((r.sequence_id, r.offset, r.ids_crc32) for r in got)
    assert pack_documents(docs_of([]), WORD_BPE).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_tiers_prefer_whole_documents(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(n) for n in np.exp(rng.uniform(0, 9, 400))] + [2048, 4096, 1]
    packer, windows = Tiers(), []
    for i, n in enumerate(lengths):
        windows += packer.add(i, n)
    windows += packer.pack()
    windows += packer.rest()
    at = defaultdict(list)
    for tier, pieces in windows:
        assert sum(p[2] for p in pieces) == tier
        for doc, start, length in pieces:
            at[doc].append((start, length))
    for i, n in enumerate(lengths):
        assert [s for s, _ in sorted(at[i])] == list(np.cumsum([0, *[k for _, k in sorted(at[i])[:-1]]])) and sum(k for _, k in at[i]) == n
    short = [i for i, n in enumerate(lengths) if n <= 2048]
    assert sum(len(at[i]) == 1 for i in short) > 0.6 * len(short)


def test_licences_are_told_and_confirmed(docs_of):
    clean = [(i, "\n".join(prose(100 * i + k, 25) for k in range(4)), "a") for i in range(40)]
    told = [(1000 + k, f"{prose(k, 20)}\n{text}\n{prose(k + 1, 20)}", "a") for k, text in enumerate(t for f in sorted(TEMPLATES) for t in TEMPLATES[f])]
    docs = docs_of([*clean, *told, *ODD])
    policy = LicensePolicy(negatives=200)
    model = train(docs, policy)
    assert model.held_out["accuracy"] > 0.8
    got = defaultdict(list)
    for r in document_licenses(docs, policy, model=model).collect():
        got[r.doc_id].append(r)
    assert not any(r.n_predicted for i, _, _ in clean for r in got[i]) and sum(map(len, got.values())) == docs.count()
    families = [f for f in sorted(TEMPLATES) for _ in TEMPLATES[f]]
    assert sum(f in got[1000 + k][0].licenses for k, f in enumerate(families)) >= 0.95 * len(families)
    assert document_licenses(docs_of([]), policy, model=model).count() == 0
