"""Archives, URL filter and main text of pages."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loopweave.llm import html, urls, warc
from loopweave.llm.queries import RULES

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    rows = [
        (3, "http://www.Example.com/a?b=1", "<p>é</p>\r\n\r\nWARC/1.0\r\n\r\n"),
        (1, "http://m.example.com/a", "same"),
        (2, "http://m.example.com/a", "same"),
        (7, None, None),
        (5, "no scheme", ""),
        (5, "no scheme", ""),
        (None, "http://x.org/\n1", "same"),
        (9, "http://x.org", "long " * 50_000),
    ]
    frame = spark.createDataFrame(rows, PAGES)
    index = warc.archive(frame)
    got = sorted((tuple(r) for r in index.captures().collect()), key=str)
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        twin = first[h or ""] != p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if twin else "response", first[h or ""] if twin else None))
    assert got == sorted(want, key=str)
    assert len(index.lookup("com,example,m)/a")) == 2 and index.lookup("com,example,zzz)/") == []
    keys = [r["first"] for r in index.directory().collect()]
    assert keys == sorted(keys)


def test_index_of_several_blocks(spark):
    frame = spark.createDataFrame([(k, f"http://h{k % 7}.example.com/p{k:03}", f"page {k}") for k in range(200)], PAGES)
    index = warc.archive(frame)
    index = warc.CaptureIndex.build(spark, index.folder, block_lines=9)
    assert index.blocks.count() >= 200 // 9 and index.captures().count() == 200
    (path, at, length), = index.lookup("com,example,h3)/p010")
    data = spark.read.format("binaryFile").load(path).first()["content"]
    assert warc.parse(bytes(data[at : at + length])).payload == b"page 10"
    empty = warc.archive(frame.limit(0))
    assert empty.captures().count() == 0


def test_records_are_read_by_their_ranges(spark):
    """Bytes that the index does not name are never read: here they are overwritten."""
    frame = spark.createDataFrame([(k, f"http://h.example.com/p{k:03}", f"page {k} é") for k in range(60)], PAGES)
    index = warc.CaptureIndex.build(spark, warc.archive(frame.coalesce(1)).folder, block_lines=1)
    keys = ["com,example,h)/p007", "com,example,h)/p008", "com,example,h)/p041"]
    some = warc.CaptureIndex(index.blocks.filter(F.col("first").isin(keys)), index.folder)
    wanted = [r for k in keys for r in some.lookup(k)]
    assert len(wanted) == 3
    for path in {r[0] for r in wanted}:
        with open(path.removeprefix("file:"), "r+b") as f:
            old = f.read()
            new = bytearray(b"#" * len(old))
            for p, at, n in wanted:
                if p == path:
                    new[at : at + n] = old[at : at + n]
            f.seek(0)
            f.write(new)
    got = sorted((r["page_id"], r["payload_digest"]) for r in some.captures().collect())
    assert got == [(k, warc.sha1_base32(f"page {k} é".encode())) for k in (7, 8, 41)]


def test_lookup_bisects_the_directory(spark):
    urls_ = [f"http://h{k % 7}.example.com/p{k:03}" for k in range(200)] + ["http://x.org/a", "http://x.org/a\x01b"] + ["http://z.org/many"] * 30
    frame = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls_)], PAGES)
    index = warc.CaptureIndex.build(spark, warc.archive(frame).folder, block_lines=9)
    lines = {r["block"]: (r["first"], r["last"]) for r in index.directory().collect()}
    assert len(lines) == index.blocks.count() >= 200 // 9
    for key in ("com,example,h3)/p010", "org,x)/a", "org,x)/a\x01b", "org,z)/many", "", "zzz"):
        opened = index.blocks_of(key)
        assert sorted(opened) == sorted(b for b, (first, last) in lines.items() if first <= key <= last)
    assert len(index.blocks_of("com,example,h3)/p010")) == 1
    assert [r.payload for r in index.fetch("com,example,h3)/p010")] == [b"page 10"]
    assert [r.payload for r in index.fetch("org,x)/a")] == [b"page 200"] and [r.payload for r in index.fetch("org,x)/a\x01b")] == [b"page 201"]
    assert len(index.fetch("org,z)/many")) == 30 and index.fetch("zzz") == []
    as_table = warc.CaptureIndex(index.blocks, index.folder, most_blocks=3)
    assert as_table.blocks_of("zzz") is None and as_table.lookup("org,z)/many") == index.lookup("org,z)/many")
    both = [sorted(map(str, f.collect())) for f in (index.captures(), index.captures_of_whole_files())]
    assert both[0] == both[1] and len(both[0]) == len(urls_)


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.CAPITALS, urls.CAPITALS.lower())), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_and_hosts(spark):
    cases = [
        None, "", "no scheme/en/", "http://COM/", "http://com", "http://a.com/x", "http://acom/x", "http://www.example.com/en/1", "http://example.com/en/",
        "http://example.com/en", "http://xexample.com/en/1", "http://b.net/es/1?x", "http://b.net/fr#/es/", "://net/fr/", "a://b://c/d", "http://h?/en/", "HTTP://ÄB.COM/\n/x",
    ]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge(frame, RULES).collect()}
    for k, u in enumerate(cases):
        host, path, rule, verdict = plain_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")
    assert urls.judge(frame.limit(0), RULES).count() == 0


def test_url_models_part_what_they_learned(spark):
    rng = random.Random(4)
    good = [f"http://site{rng.randrange(50)}.com/news/{rng.randrange(10**6)}" for _ in range(400)]
    bad = [f"http://win{rng.randrange(50)}.biz/casino?{rng.randrange(10**6)}" for _ in range(400)]
    frame = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "text string, accepted boolean")
    fold = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    models = urls.calibrated(frame.filter(fold), urls.learn(frame.filter(~fold)))
    fresh = models.scores(["http://site99.com/news/5", "http://win99.biz/casino?1", "", None])
    assert fresh[0] >= models.threshold > fresh[1] and fresh[2] == fresh[3] == 0
    # one character, by hand: counts of order 0 only
    tiny = urls.learn(spark.createDataFrame([("aab", True), ("b", False)], "text string, accepted boolean"), order=0)
    accepted, rejected = (2 + 2 / 256) / (3 + 2), (0 + 2 / 256) / (1 + 2)
    import math

    assert abs(tiny.scores(["a"])[0] - math.log(accepted / rejected)) < 1e-6


def plain_score(text, counts, order):
    """The recursion character by character, from counts in two dictionaries of context and context with character."""
    raw, total = text.encode(), 0.0
    for sign, seen in zip((-1, 1), counts):
        for at in range(len(raw)):
            p = 1 / 256
            for n in range(order + 1):
                context = (b"\0" * order + raw)[at + order - n : at + order]
                p = (seen[n, context, raw[at]] + 2 * p) / (seen[n, context] + 2)
            total += sign * math.log(p)
    return total / max(len(raw), 1)


def test_url_counts_grow_with_the_urls(spark):
    """More grams a class than half a million: every count is the gram's own, a gram never seen counts nothing."""
    rng = random.Random(8)
    rows = [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-_/.", k=150)), bool(k % 2)) for k in range(1600)]
    order, counts = urls.ORDER, (Counter(), Counter())
    for text, accepted in rows:
        padded, seen = b"\0" * order + text.encode(), counts[accepted]
        for at in range(order, len(padded)):
            for n in range(order + 1):
                seen[n, padded[at - n : at]] += 1
                seen[n, padded[at - n : at], padded[at]] += 1
    assert min(len(c) for c in counts) > 1 << 18 and sum(map(len, counts)) > 1 << 19
    models = urls.learn(spark.createDataFrame(rows, "text string, accepted boolean"))
    grams = models.counts.agg(F.count_if(F.col("rejected") > 0), F.count_if(F.col("accepted") > 0)).first()
    assert tuple(grams) == tuple(map(len, counts))
    texts = [rows[0][0], rows[1][0], rows[2][0][:70] + rows[5][0][70:], "ABC", "http://a.b/c", "", None]
    want = [plain_score(t or "", counts, order) for t in texts]
    assert max(abs(a - b) for a, b in zip(models.scores(texts), want)) < 1e-9
    frame = spark.createDataFrame([(k % 7, texts[k % 7]) for k in range(700)], "k int, text string")
    got = urls.scored(frame, models).collect()
    assert len(got) == 700 and max(abs(r["lm_score"] - want[r["k"]]) for r in got) < 1e-9


def test_article_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><article>x';</script></head><body class=\"ad-free page\">"
        "<nav><ul><li><a href='/'>menu</a></ul></nav><div class=\"ad\">buy</div><article class='post'><header>by me</header><h1>Ti &amp; tle</h1>"
        "<p>One <b>bo\nld</b> &eacute;&#233;<br>two<p>three<!-- no <p> --> four<aside>side</aside><form><p>ask</form><div class='cookie-notice'>c</div>"
        "<ul class=\"comments\"><li>nice</li></ul><p>end &am</article><footer>f</footer></body>"
    )
    inside = [b.text for b in html.blocks_of(page) if b.place == html.MAIN]
    assert " ".join(inside) == "Ti & tle One bo ld éé two three four end &am"
    assert html.blocks_of(None) == [] and html.blocks_of("<p") == [] and html.blocks_of("a < b")[0].text == "a < b"


ARTICLE = "<article><h1>Title</h1><p>Body of the story<div class='ad'>buy</div><aside>side</aside></article>"


@pytest.mark.parametrize(
    "page",
    [
        *(f"<body><p>top line</p><div class='{c}'>{ARTICLE}</div>{'<p>a long foot line of the page without a mark</p>' * 3}</body>" for c in ("layout-sidebar", "has-sidebar", "no-comments", "page modal-open")),
        f"<div class='search-results'>{ARTICLE}</div>",
        f"<form action='/'><div>menu</div>{ARTICLE}<div>foot</div></form>",
        f"<nav><a href='/'>home</a>{ARTICLE}<p>more words than the article has, as no one closed what was open before it",
        f"<div class='ad'>buy {ARTICLE}<footer>f</footer>",
        f"<div><div class='ad'>buy {ARTICLE}</div></div>",
        f"<div class='has-sidebar'><nav>m</nav><div class='sidebar'><article>teaser</article></div>{ARTICLE}</div>",
        f"<main><div class='has-sidebar'>{ARTICLE}</div></main>",
        f"<head><title>t</title><body>{ARTICLE}</body>",
        f"<div class='no-comments'>{ARTICLE}<ol class='comment-list'><li><article>A comment that is quite a bit longer than all of the story</article></ol></div>",
        f"{ARTICLE}<aside><article>teaser</article></aside><div class='related-posts'><article>two</article></div>",
    ],
)
def test_marked_wrappers_keep_the_article(page):
    assert " ".join(b.text for b in html.blocks_of(page) if b.place == html.MAIN) == "Title Body of the story"


def test_teasers_and_comments_are_no_article():
    story = "<div>A story in a plain element, longer than what stands beside it</div>"
    for beside in ("<aside><article>teaser</article></aside>", "<div class='related-posts'><article>t</article><article>u</article></div>", "<ul class='comments'>" + "<article>A comment</article>" * 20 + "</ul>", "<template><article>" + "hidden " * 20 + "</article></template>"):
        blocks = html.blocks_of(story + beside)
        assert not [b for b in blocks if b.place == html.MAIN] and [b.text for b in blocks if b.place == html.OPEN] == [story[5:-6]]


def test_host_runs_go_where_no_article_is(spark):
    top, foot = "home about contact us today now or never", "all rights reserved by the owner of this very site"
    bodies = ["first story about a river and its boats", "second tale of hills and long dry summers here"]
    rows = [(k, f"http://h.com/{k}", f"<div>{top}</div><div>{b}</div><div>{foot}</div>") for k, b in enumerate(bodies)]
    rows += [(2, "http://h.com/2", rows[0][2]), (3, "http://other.com/", rows[0][2]), (4, None, None), (5, "http://h.com/5", f"<article>{top}</article>"), (5, "http://h.com/5", "")]
    frame = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))
    got = html.main_text(frame).collect()
    assert sorted(str(r["text"]) for r in got if r["page_id"] in (0, 1, 2)) == sorted([bodies[0], bodies[1], bodies[0]])
    other = next(r for r in got if r["page_id"] == 3)
    assert other["text"] == f"{top} {bodies[0]} {foot}" and other["n_chars"] == len(other["text"])
    assert next(r for r in got if r["page_id"] == 4)["text"] == ""
    assert {r["text"] for r in got if r["page_id"] == 5} == {top, ""}
    assert html.main_text(frame.limit(0)).count() == 0
