"""What stands beside an article is compared with the pages that have none."""

from loopweave.llm import html

PAGES = "page_id long, url string, html string"


def test_a_run_beside_articles_is_no_main_text_elsewhere(spark):
    line = "all rights of this small site are kept by its owners for ever"
    rows = [(k, f"http://h.example.com/{k}", f"<article><p>Story {k} {line}</p></article><p>{line}</p>") for k in range(3)]
    rows.append((3, "http://h.example.com/3", f"<div>{' '.join(f'own{k}' for k in range(12))}</div><div>{line}</div>"))
    rows.append((4, "http://other.example.com/4", f"<div>{line}</div>"))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == " ".join(f"own{k}" for k in range(12))
    assert got[4] == line and all(got[k] == f"Story {k} {line}" for k in range(3))


def test_an_article_elsewhere_takes_nothing_from_a_page(spark):
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(0, "http://h.example.com/0", f"<article>{text}</article>"), (1, "http://h.example.com/1", f"<div>{text}</div>")]
    assert [r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()] == [text, text]
