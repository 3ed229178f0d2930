"""Pages against a slow tree walker, text that names must not cost, deep pages, and licences wrapped by hand."""

import random
import textwrap
import time
from html.parser import HTMLParser

from remitlens.llm.html_extract import main_text, read_page
from remitlens.llm.license_scan import LicensePolicy, document_licenses, train
from remitlens.llm.license_templates import TEMPLATES
from corpus_samples import prose

DROP = {"nav", "aside", "footer", "form", "script", "style"}
BLOCKS = ["p", "div", "section", "h2", "ul", "blockquote"]
GOOD_NAMES = ["", ' class="social history"', ' id="related-work"', ' class="notice board"', ' class="intro"', ' class="menus"']
BAD_NAMES = [' class="ad"', ' class="comments box"', ' id="cookie-banner"', ' class="share-buttons"']


class Slow(HTMLParser):
    """The text of a well-formed page: blocks apart, furniture and everything outside article left out."""

    def __init__(self):
        super().__init__()
        self.stack, self.said = [], []

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, any(f' {k}="{v}"' in BAD_NAMES for k, v in attrs)))
        if tag not in ("b", "a", "i"):
            self.said.append(" ")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag not in ("b", "a", "i"):
            self.said.append(" ")

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "article" in tags and not DROP & set(tags) and not any(bad for _, bad in self.stack):
            self.said.append(data)


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        words = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randint(1, 6)))
        if kind < 0.15:
            out.append(f"<{(t := rng.choice(sorted(DROP)))}>{words}</{t}>")
        elif kind < 0.3:
            out.append(f"<div{rng.choice(BAD_NAMES)}>{words}</div>")
        elif kind < 0.6 and depth < 3:
            out.append(f"<div{rng.choice(GOOD_NAMES)}>{page(rng, depth + 1)}</div>")
        else:
            tag = rng.choice(["p", "h2", "blockquote"])
            out.append(f"<{tag}{rng.choice(GOOD_NAMES)}>{words} <b>{words[:3]}</b>&amp;<a href='x'>{words[-3:]}</a></{tag}>")
    return "".join(out)


def test_pages_against_a_slow_walker():
    rng = random.Random(4)
    for _ in range(400):
        html = f"<html><body><nav>menu</nav><div class='ad'>buy</div><article>{page(rng)}</article><footer>foot</footer></body></html>"
        slow = Slow()
        slow.feed(html)
        assert read_page(html).text() == " ".join("".join(slow.said).split()), html


def test_names_of_pages_without_a_main_part():
    html = "<body><div class='site-footer'>f</div><div id='related-work'>rw</div><p>x</p><div class='sidebar wide'>s</div></body>"
    assert read_page(html).text() == "rw x"


def test_a_deep_page_takes_time_in_proportion():
    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        read_page("<div><b>x</b>" * n)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_templates_of_a_host_are_found_on_generated_pages(spark):
    rng, rows, want = random.Random(8), [], {}
    for i in range(60):
        body = prose(i, 25)
        block = f"<div><p>{prose(9000, 12)}</p><ul><li><a href='/a'>{prose(9001, 2)}</a></li></ul></div>" if i % 2 else ""
        rows.append((i, f"https://h{i % 2}.example/{i}", f"<body>{block}<div><p>{body}</p></div></body>"))
        want[i] = body
    rng.shuffle(rows)
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_wrapped_licences_are_confirmed(docs_of):
    longest = {f: max(texts, key=len) for f, texts in TEMPLATES.items()}
    clean = [(i, "\n".join(prose(100 * i + k, 12) for k in range(6)), "a") for i in range(40)]
    told = [(1000 + k, f"{prose(k, 20)}\n \n{textwrap.fill(longest[f], 72)}\n\n{prose(k + 1, 20)}", "a") for k, f in enumerate(sorted(longest))]
    docs = docs_of([*clean, *told])
    policy = LicensePolicy(negatives=200)
    got = {r.doc_id: r for r in document_licenses(docs, policy, model=train(docs, policy)).collect()}
    assert not any(got[i].licenses for i, _, _ in clean)
    assert sum(f in got[1000 + k].licenses for k, f in enumerate(sorted(longest))) >= 0.9 * len(longest)
