"""Templates of pages whose words are in inline elements, or whose template is most of the page."""

from corpus_samples import prose

from remitlens.llm.html_extract import main_text


def texts_of(spark, htmls):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    return [r.text for r in sorted(main_text(pages).collect(), key=lambda r: r.page_id)]


def test_links_and_bold_words_of_pages_without_a_main_part_stay(spark):
    pages = [(prose(i, 20), prose(100 + i, 3), prose(200 + i, 20)) for i in range(14)]
    htmls = [f"<body><p>{a} <a href='/{i}'>{link}</a> <b>very</b> {b}</p><div>{b} <em>much</em> {a}</div><div><a href='/'>home page</a></div></body>" for i, (a, link, b) in enumerate(pages)]
    assert texts_of(spark, htmls) == [f"{a} {link} very {b} {b} much {a}" for a, link, b in pages]


def test_templates_that_are_most_of_the_page_are_removed(spark):
    notice, box = [f"<div class='x1'>{''.join(f'<p>{prose(seed + k, 40)}</p>' for k in range(3))}</div>" for seed in (900, 950)]
    pages = [prose(i, 8) for i in range(14)]
    assert texts_of(spark, [f"<body>{notice}<div><p>{a}</p></div>{box}</body>" for a in pages]) == pages


def test_a_large_group_of_copies_does_not_hide_a_template(spark):
    box = f"<div class='x1'><p>{prose(970, 12)}</p></div>"
    pages = [*[prose(i, 30) for i in range(14)], *[prose(500, 30)] * 300]
    assert texts_of(spark, [f"<body><div><p>{a}</p></div>{box}</body>" for a in pages]) == pages


def test_copies_that_differ_in_a_date_are_one_page(spark):
    pages = [f"<body><div><p>{prose(7, 30)}</p></div><div><p>{prose(8, 30)}</p></div><div>read {i} times</div></body>" for i in range(14)]
    assert texts_of(spark, pages) == [f"{prose(7, 30)} {prose(8, 30)} read {i} times" for i in range(14)]
