"""Pages, conversations and the pipeline."""

import html
import re
import time

import numpy as np
import pytest

from attestry.llm import html_extract, preference, queries, url_filter


def test_main_text(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, html_extract.learn(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        pieces = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in pieces if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


NEWS = """<html><head><title>T</title><script>if (a<b) {}</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home<li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><h1>Head &amp; line</h1><p>First  paragraph &lt;here&gt;.<p>Second <a href="y">with a link</a> in it&nbsp;too.
<div class="advert">Buy this now!</div><ul><li>One point.<li>Another.</ul><form><p>Sign up here <input></form><section id="comments"><p>Great read, thanks!</section></main>
<aside>Related pages</aside><footer>© 2024 All rights</footer></body>"""


def test_page_parts(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
    own = spark.createDataFrame([(-i, NEWS.replace("Great", f"Great {i}")) for i in range(1, 30)], "page_id bigint, html string")
    field = html_extract.learn(pages.union(own), most_pages=1000)
    some = spark.createDataFrame([(1, NEWS), (2, None), (3, ""), (4, "<p>unclosed <b>bold <p>text"), (5, "<<<>>> </div></p> &#x41;&bogus;"), (5, "<![CDATA[x]]><!-- <p>no</p>"),
                                  (6, "<article>" + "<p>word and more words, as prose goes.</p>" * 3000 + "</article>")], "page_id bigint, html string")
    rows = html_extract.extract(some, field).collect()
    got = {r.page_id: r.text for r in rows}
    assert got[1] == "Head & line\n\nFirst paragraph <here>.\n\nSecond with a link in it too.\n\nOne point.\n\nAnother."
    assert got[2] == got[3] == "" and len(rows) == 7 and got[6].count("\n\n") == 2999
    assert [b.text for b in html_extract.blocks_of("<p>a<b>b<p>c</b>d<br>e<div>f</p>g")] == ["ab", "cd e", "f", "g"]
    assert html_extract.extract(some.limit(0), html_extract.learn(some.limit(0))).count() == 0


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        weights = {f"f{i}": tuple(rng.normal(size=2)) for i in range(n)}
        field = html_extract.Field(weights, rng.normal(size=(2, 2)))
        rows = [[f"f{i}", "unseen"] for i in range(n)]
        score = lambda y: sum(weights[f"f{i}"][k] for i, k in enumerate(y)) + sum(field.change[a, b] for a, b in zip(y, y[1:]))
        assert tuple(field.decode(rows)) == max(itertools.product((0, 1), repeat=n), key=score)
    assert field.decode([]) == []


def parts(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def test_urls(spark, folder):
    odd = ["http://A.Example.ORG/es/1", "https://example.org/en/12", "http://notexample.org/es/", "http://x.com/de/", "http://x.com/fr/a", "http://x.com", "org/", None,
           "", "ftp://", "http://example.org?q=/es/", "http://ÉX.net/é#a", "http://x.net://y.org/es/", "http://org/", "http://example.org/es/\n?", "http://u@h.org:80/"]
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").union(
        spark.createDataFrame([(-i, u, None) for i, u in enumerate(odd, 1)], "page_id bigint, url string, html string"))
    rules = [(r.host, r.path, r.verdict) for r in queries.URL_RULES]
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")
    none = pages.limit(0)
    assert url_filter.judge(none, queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_segmentation():
    s = url_filter.Segmenter({"cheap": 50, "casino": 40, "royal": 30, "free": 60, "chea": 1})
    assert s.split("cheapcasino") == ("cheap", "casino") and s.split("freeroyalcasino") == ("free", "royal", "casino") and s.split("") == ()
    assert "".join(s.split("xyzcasinoq")) == "xyzcasinoq" and "casino" in s.split("xyzcasinoq")


def test_naive_bayes_learns_from_rules(spark):
    rows = [(i, f"http://{'cheapcasino' if i % 2 else 'citylibrary'}{i}.{'bad' if i % 2 else 'good'}/p", f"<title>{'cheap casino' if i % 2 else 'city library'}</title>") for i in range(60)]
    rows += [(100, "http://casinocheap.zzz/", ""), (101, "http://librarycity.zzz/", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [url_filter.Rule("block", "bad"), url_filter.Rule("allow", "good")]).collect()}
    assert got[100] == "block" and got[101] == "allow"


def test_words_of_any_number_split_hosts(spark):
    """100,100 words that occur once in titles: none of them may be lost."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    filler = ["q" + "".join(letters[i // 26 ** k % 26] for k in range(4)) for i in range(100_100)]
    rows = [(0, "http://a.good/", f"<title>{' '.join(filler)} cheap casino garden flower</title>")]
    rows += [(i, f"http://{'cheapcasino' if i < 5 else 'gardenflower'}.{'bad' if i < 5 else 'good'}/", None) for i in range(1, 12)]
    rows += [(100, "http://casinocheap.zzz/", None), (101, "http://flowergarden.zzz/", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [url_filter.Rule("block", "bad"), url_filter.Rule("allow", "good")]).collect()}
    assert got[100] == "block" and got[101] == "allow"


def rendered(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_preferences(spark):
    system, ask, good, bad, more = ("system", "Be kind."), ("user", "Why?"), ("assistant", "Because it is so."), ("assistant", "No."), ("user", "And?")
    talks = {1: [system, ask, good], 2: [system, ask, bad, more], 3: [system, ask, good], 1030: [system, ask, bad], 5: [("user", None), (None, "x")], 3000: [ask, good], 7000: [("user", "z")]}
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)] + [(1, 0, *system), (None, 0, "user", "lost"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS chosen", "1 AS n_common")
    whole = preference.distinct_conversations(turns)
    paired = {(r.chosen_id, r.rejected_id): r for r in preference.format_pairs(preference.pair_up(whole)).collect()}
    assert set(paired) == {(1, 2)}  # 3 is a copy of 1, and 1030 is left over
    r = paired[1, 2]
    assert r.n_common == 2 and r.prompt == rendered([system, ask])
    assert r.prompt + "".join(s.text for s in r.chosen) == rendered(talks[1]) and r.prompt + "".join(s.text for s in r.rejected) == rendered(talks[2])
    assert [s.text for s in r.chosen if s.trained] == ["Because it is so.<|im_end|>"] and [s.text for s in r.rejected if s.trained] == ["No.<|im_end|>"]
    lent = {r.chosen_id: r for r in preference.format_pairs(preference.borrow_answers(whole)).collect()}
    assert {c: r.rejected_id for c, r in lent.items()} == {1: 2, 2: 1030, 1030: 3000, 3000: 1}
    assert [s.text for s in lent[1].rejected if s.trained] == ["No.<|im_end|>"] and lent[1].n_common == 2
    assert lent[3000].n_common == 2 and lent[3000].chosen == lent[3000].rejected == []  # the borrowed answer is its own
    same = spark.createDataFrame([(1, [("u", "a")], 2, [("u", "a"), ("u", "b")]), (3, [("u", "a")], 4, [("u", "a")]), (5, [], 6, [(None, None)])],
                                 "chosen_id int, chosen array<struct<role string, text string>>, rejected_id int, rejected array<struct<role string, text string>>")
    assert [r.n_common for r in preference.format_pairs(same).orderBy("chosen_id").collect()] == [1, 1, 0]
    assert preference.format_pairs(preference.pair_up(preference.distinct_conversations(turns.limit(0)))).count() == 0
    assert preference.borrow_answers(preference.distinct_conversations(turns.limit(0))).count() == 0


def test_many_conversations_with_one_request(spark):
    turns = spark.range(0, 5000).selectExpr("id * 3 AS conv_id", "explode(array(0, 1)) AS turn").selectExpr(
        "conv_id", "turn", "IF(turn = 0, 'user', 'assistant') AS role", "IF(turn = 0, 'same', concat('answer ', conv_id)) AS text")
    pairs = preference.pair_up(preference.distinct_conversations(turns)).select("chosen_id", "rejected_id").collect()
    used = [i for r in pairs for i in r]
    assert len(pairs) == 2500 and len(set(used)) == 5000


def test_pipeline(spark, folder, odd):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in c.STAGES:
        made = stage(spark, docs, folder)
        before = docs.count()
        if name != "packing":
            assert made.dtypes == docs.dtypes and 0 < made.count() <= before
            docs = made
    assert {r.doc_id for r in made.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {tuple(r) for r in c.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()} == {
        tuple(r) for r in made.select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_pipeline_over_odd_documents(spark, folder, odd, none):
    import corpus_pipeline as c
    docs = odd
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == odd.dtypes
    left = sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect())
    assert (False, 0) in left and left.count((True, 1)) == 1 and (True, 12) not in left and (True, 6) not in left and (True, 2) not in left
    for _, stage in c.STAGES:
        assert stage(spark, none, folder).count() == 0


@pytest.mark.parametrize("page,n", [("<a " * 350_000, 1), ("<div>x" * 170_000, 170_000), ('<a "' * 260_000, 1), ('<a "' * 260_000 + ">", 0), ("<a '\"" * 200_000 + "<p>x", 1),
                                    ("<a" * 500_000, 1), ("<b>" * 150_000 + "<hr>" * 150_000, 0), ("<!" * 500_000, 1), ("<p>&#" + "1" * 900_000 + ";", 1),
                                    ("".join(f"<div class=c{i}>t" for i in range(50_000)), 50_000)])
def test_pages_of_a_megabyte_take_seconds(page, n):
    """Unclosed tags, open quotes, deep nesting: one pass, whatever is in it, and as much for scores."""
    field = html_extract.Field({"bias": (0.1, 0.2), "under div": (0.0, 1.0), "named c7": (3.0, 0.0)}, np.zeros((2, 2)))
    start = time.monotonic()
    blocks = html_extract.blocks_of(page)
    assert len(blocks) == n and len(field.viterbi(field.scores(blocks))) == n
    assert time.monotonic() - start < 30


def test_formulas_are_text_and_scores_are_sums_of_features():
    page = "<body class='a b'><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.<div class=b><ul id=nav><li>one<li>two</ul></div><article>t"
    blocks = html_extract.blocks_of(page)
    assert [b.text for b in blocks] == ["Let x=1 hold.", "one", "two", "t"]
    rng = np.random.default_rng(1)
    rows = html_extract.features_of(blocks)
    weights = {f: tuple(rng.normal(size=2).tolist()) for row in rows for f in row}
    for got, row in zip(html_extract.Field(weights, np.zeros((2, 2))).scores(blocks), rows):
        assert len(set(row)) == len(row)
        assert np.allclose(got, np.sum([weights[f] for f in row], axis=0))
