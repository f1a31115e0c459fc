"""KD-tree search and page extraction."""

import math

import numpy as np
import pytest

from carecheck.llm import html_extract, kd_search


def exact(rows, k, every):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % every == 0:
            asked[i] = max(asked.get(i, v), v, key=lambda x: (len(x), x))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, [0.0] * 6), (401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (410, [math.nan] * 6)]
    rows += [(420, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (430, [1.0, 2.0]), (440, [3.0, 1.0]), (3, rows[3][1]), (10, [9.0] * 6), (450, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, score string")
    got = kd_search.top_k(df, df.filter("vec_id % 10 = 0"), shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got)) == exact(rows, 10, 10)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert kd_search.top_k(df, df).count() == kd_search.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_tree_agrees_with_a_scan():
    rng = np.random.default_rng(4)
    points = rng.integers(-50, 50, (2000, 5)).astype(float)
    tree = kd_search.Tree(np.arange(2000), points)
    for q in rng.integers(-50, 50, (20, 5)).astype(float):
        want = sorted(zip((-(points @ q)).tolist(), range(2000), strict=True))[:10]
        assert tree.search(-1, q, 10, -math.inf) == [(-s, i) for s, i in want]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">one<li><a href="/b">two</ul></nav><div class="cookie-notice">We use cookies here on this site</div>
<article><h1>A&nbsp;title &amp; more</h1><p>First <b>part</b>, with {0}
  lines<br>and breaks<p>Second &lt;part&gt;<script>var a = "</p>";</script><div class="ad">Buy now and save</div>
<!-- <p>not this</p> --><ul><li>item one</li><li>item two</li></ul><form><label>Name</label><input></form>
<section id="comments"><p>Nice article, thank you for writing it</p></section></article><aside><p>Other things to read</p></aside>
<footer><p>All rights reserved by the site</p></footer></body></html>"""
TEXT = "A title & more\n\nFirst part, with {0} lines and breaks\n\nSecond <part>\n\nitem one\n\nitem two"


def test_pages(spark):
    pages = [(k, f"u{k}", PAGE.format(f"n{k}")) for k in range(30)]
    pages += [(90, None, None), (91, "u", ""), (92, "u", "<nav><a>x</a></nav>"), (93, "u", "<p"), (94, "u", "<!-- open"), (None, "u", PAGE.format("z")), pages[0]]
    pages.append((95, "u", PAGE.format("word " * 30000)))
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["url"]): r for r in html_extract.main_text(df).collect()}
    assert html_extract.main_text(df).count() == len(pages)
    for k in range(30):
        assert got[k, f"u{k}"]["text"] == TEXT.format(f"n{k}")
    assert got[95, "u"]["text"] == TEXT.format(("word " * 30000).strip())
    assert got[None, "u"]["text"] == TEXT.format("z")
    assert got[90, None]["text"] == got[91, "u"]["text"] == got[92, "u"]["text"] == got[94, "u"]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.main_text(df.filter("false")).count() == 0


def test_unlabelled_pages_keep_their_words():
    assert html_extract.extract("<div><p>Some words of a page</p><p>and some more</p></div>", {}) == "Some words of a page\n\nand some more"


def test_only_the_named_kinds_go():
    kept = ["share-price", "related-work", "social-history", "alert-fatigue", "commentary", "header-files", "tags", "adoption"]
    gone = ["ad", "adBox", "comment-list", "reader-comments", "cookie-notice", "site_footer", "page sidebar", "nav-links"]
    page = "<main><h1>Words of a title here</h1>" + "".join(
        f'<p class="{x}">kept {x} kept</p><div id="{y}"><p>gone {y} gone</p></div>' for x, y in zip(kept, gone, strict=True)) + "</main>"
    assert html_extract.extract(page, {}) == "\n\n".join(["Words of a title here", *(f"kept {x} kept" for x in kept)])


def test_best_region_agrees_with_all_regions():
    rng = np.random.default_rng(8)
    for n in [0, 1, 2, *rng.integers(3, 60, 200)]:
        scores = [float(x) for x in rng.integers(-6, 6, n)]
        begin, end = html_extract.best_region(scores)
        assert sum(scores[begin:end]) == max([0.0, *(sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1))])
