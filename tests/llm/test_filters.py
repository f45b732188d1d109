"""Pages, urls, quality, personal data, near copies and the pipeline against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixscan.llm import html, neardup, pii, quality, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(spark, texts):
    """Rows with null ids, langs and other columns, repeated rows, and columns named like new and inner ones."""
    rows = [(i if i % 7 else None, t, None if i % 3 else "en", "a", "b", "c", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, kept string, spans string, _words string, _key string")


ODD = [None, "", " \n\t", "word", "one two three four", "x" * 30000, "word " * 9000, "1" * 20000, "a@b.co", "\n" * 500, "é" * 300, "🙂 " * 200]


# Pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies and the like on this site.</div>
<div class="story-body"><h2>Title here</h2><p>This is the first paragraph of the story and it is long enough to be decided as good by the rules of density.</p><p>Short one.</p>
<p>And this is the last of the paragraphs that the story has, with a <a href="x>y">link &lt;in&gt;</a>&nbsp;it.</div><div class="comments"><p>I think that this is a comment by the reader of the page and it is bad.</p></div>
<form><p>Subscribe to the thing that we are on about</p></form><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><footer>&copy; x</footer><script>if (a<b) "</p>"</script></body>"""
TEXT = "Title here\nThis is the first paragraph of the story and it is long enough to be decided as good by the rules of density.\nShort one.\nAnd this is the last of the paragraphs that the story has, with a link <in> it."


def test_two_passes_without_an_article_element():
    assert html.main_text(PAGE) == TEXT


def test_open_blocks_take_the_label_of_their_neighbours():
    block = lambda n, heading=False: html.Block("x" * n, 0, False, False, heading)
    rows = [block(9), block(9, True), block(9), block(9)]
    assert html.inherited(rows, [html.BAD, html.OPEN, html.GOOD, html.OPEN]) == [html.BAD, html.GOOD, html.GOOD, html.GOOD]
    assert html.inherited(rows, [html.GOOD, html.OPEN, html.OPEN, html.BAD]) == [html.GOOD, html.BAD, html.BAD, html.BAD]
    plain = [block(9)] * 4
    assert html.inherited(plain, [html.GOOD, html.OPEN, html.OPEN, html.BAD]) == [html.GOOD, html.GOOD, html.BAD, html.BAD]
    assert html.inherited(rows, [html.OPEN] * 4) == [html.GOOD] * 4


def plain_labels(blocks):
    """Both passes written out: every open block looks for its neighbours anew."""
    out = []
    for b in blocks:
        words = re.findall(r"\w+", b.text.lower())
        dense = sum(w in html.STOP for w in words) / max(1, len(words))
        n, links = len(b.text), b.linked / max(1, len(b.text))
        if b.outside or not b.main and (links > 0.33 or b.text[:1] == "©"):
            out.append(0)
        elif links > 0.33 or b.text[:1] == "©" or n < 60 or b.heading:
            out.append(-1)
        else:
            out.append(1 if dense >= (0.1 if n >= 140 else 0.25) else -1)
    menu = [b.item and b.linked > 0.9 * len(b.text) for b in blocks]
    for i in range(len(blocks)):
        a, z = i, i
        while a > 0 and menu[a - 1]:
            a -= 1
        while z < len(blocks) and menu[z]:
            z += 1
        if menu[i] and z - a >= 3 and not blocks[i].main:
            out[i] = 0
    own = sum(len(b.text) for b, x in zip(blocks, out, strict=True) if b.main and x)
    if own and own >= sum(len(b.text) for b, x in zip(blocks, out, strict=True) if not b.main and x == 1) / 8:
        out = [x if b.main else 0 for b, x in zip(blocks, out, strict=True)]
    if set(out) <= {-1}:
        return [1] * len(out)
    final = []
    for i, b in enumerate(blocks):
        label = out[i]
        for same in ([k for k in range(len(blocks)) if blocks[k].region == b.region], range(len(blocks))):
            same = list(same)
            before = [k for k in same if k < i and out[k] >= 0][-1:]
            after = [k for k in same if k > i and out[k] >= 0][:1]
            if label < 0 and (before or after):
                near = before + after
                if b.heading:
                    label = out[near[-1]]
                else:  # steps within the region
                    label = out[min(near, key=lambda k: (abs(same.index(k) - same.index(i)), k))]
            if label < 0 and b.main:
                label = 1
        final.append(label)
    return final


def test_content_inside_the_article_stays():
    body = "<p>" + "The house was of stone and it was in the river, as they say. " * 4
    page = "<nav><a href=x>Menu</a></nav><noscript>Turn scripts on</noscript><article>{}</article>"
    assert "Let x be a number" in html.main_text(page.format(body + "Let <math><mi>x</mi></math> be a number</p>"))
    assert "Press Save to go on" in html.main_text(page.format(body + "Press <button>Save</button> to go on</p>"))
    for name in ("noscript", "object", "canvas", "video", "audio"):
        assert "see the chart" in html.main_text(page.format(body + f"</p><p>Here <{name} id=c>see the chart</{name}> again</p>"))
    text = html.main_text(page.format(body + "</p><h2>Sources</h2><ul>" + "".join(f"<li><a href=x>Source {i}</a>" for i in range(5)) + "</ul>"))
    assert all(f"Source {i}" in text for i in range(5)) and "Menu" not in text and "scripts" not in text
    assert "Source" not in html.main_text("<div>" + body + "</p><ul>" + "".join(f"<li><a href=x>Source {i}</a>" for i in range(5)) + "</ul></div>")


def test_two_passes_are_the_plain_ones(spark):
    g = random.Random(12)
    words = ["the", "and", "of", "house", "river", "stone", "was", "glass"]
    text = lambda: " ".join(g.choice(words if g.random() < 0.7 else words[3:6]) for _ in range(g.choice([2, 5, 12, 30])))
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for _ in range(300):
        parts = []
        for _ in range(g.randrange(1, 14)):
            tag = g.choice(["p", "p", "h2", "li", "div class=ad", "article", "div class='post-body'", "nav", "div", "/div", "/article"])
            parts.append(f"<{tag}>" if tag[0] == "/" else f"<{tag}>{text()}" if g.random() < 0.7 else f"<{tag}><a href=x>{text()}</a>")
        pages.append("".join(parts))
    seen = collections.Counter()
    for page in pages:
        blocks = html.page_blocks(page)
        first = html.decided(blocks)
        assert html.inherited(blocks, first) == plain_labels(blocks)
        seen.update((b.main, x) for b, x in zip(blocks, first, strict=True))
    assert all(seen[main, x] for main in (True, False) for x in (html.GOOD, html.BAD, html.OPEN))


def test_open_blocks_occur_on_the_pages(spark):
    labels = [x for r in spark.read.parquet(f"{SF}/pages.parquet").collect() for x in html.decided(html.page_blocks(r["html"]))]
    assert all(labels.count(x) > 50 for x in (html.GOOD, html.BAD, html.OPEN))


LONG = "This is the text of the page and it is long enough to be decided by the words that are in it, of which most are frequent ones in the language."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><a name='top'><p>{LONG}</p><p>Short.</p></article>", f"{LONG}\nShort."),
        (f"<article><p>x <a href=1>unclosed</p><p>{LONG}</p></article>", f"x unclosed\n{LONG}"),
        (f"<article><div class='post-form'><p>{LONG}</p></div></article>", LONG),
        (f"<article><p>{LONG}</p></article><div class='post-comments'><p>{LONG} No.</p></div>", LONG),
        (f"<div>{LONG}</div><div>{'river stone glass ' * 20}</div><ul><li><a href=1>a</a><li><a href=2>b</a></ul>", f"{LONG}\n{('river stone glass ' * 20).strip()}"),
        (f"<ul><li><a href=1>a</a></ul><p>{'river stone glass ' * 20}</p><ul><li><a href=1>a</a></ul><p>{LONG}</p>", LONG),
        (f"<main><p>{LONG}</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></main>", LONG),
        (f"<article>Teaser</article><p>{LONG}</p>", f"Teaser\n{LONG}"),
    ],
)
def test_blocks_are_decided_by_their_text(page, want):
    assert html.main_text(page) == want


def test_article_of_every_page(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        want[r["page_id"]] = "\n".join(p for p in parts if p)
    found = html.extract_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in found} == want and all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("bad", ["", "<", "<a \"" * 20000, "<div>" * 30000, "</div>" * 30000, "<!--", "<script>x", "<p " + "x='" * 9000, "&" * 50000, "<p>" * 30000])
def test_broken_pages_end(bad):
    assert isinstance(html.main_text(bad), str)


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div class='post-with-comments'>%s</div>", "<form action=x>%s</form>", "<svg>%s", "<noscript>%s"])
def test_wrappers_lose_no_article(wrapper):
    page = wrapper % "<article><p>Text <b>here</b></p><p><a href=x>linked</a></p><ul><li><a href=y>item</a></ul></article>"
    assert html.main_text(page) == "Text here\nlinked\nitem"


def test_main_inside_a_named_wrapper():
    assert html.main_text("<div class='search-result-page'><main><p>Text</p></main><p>no</p></div>") == "Text"
    assert html.main_text("<main><p>Text</p></main><div class=comments><article><p>reply</p></article></div>") == "Text"


def test_page_rows(spark):
    rows = [(1, "u", PAGE, "t", "h"), (None, None, None, None, None), (2, "u", "", "t", "h"), (1, "u", PAGE, "t", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html string")
    found = html.extract_text(df)
    assert found.columns == ["page_id", "url", "_html", "text", "n_chars"]
    assert sorted(r["text"] for r in found.collect()) == ["", "", TEXT, TEXT]
    assert html.extract_text(df.limit(0)).count() == 0


def test_frequent_words_are_counted_in_one_pass_of_sorted_words(spark):
    g = random.Random(9)
    words = ["the", "of", "and", "zu", "über", "x"]
    texts = [" ".join(g.choices([*words, "The", "other", "1", ""], k=n)) for n in (0, 1, 2, 50, 400)] + [None, "the", " zu-zu "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = quality.profiles(quality.base_rules(docs), words)
    for r in found.collect():
        want = collections.Counter(w for w in re.split(r"[\W\d_]+", (r["text"] or "").lower()) if w in words)
        assert {b["w"]: b["n"] for b in r["_bins"]} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "array_remove(_common" not in plan


# Urls


def parts_of(url):
    url = url or ""
    rest = url[url.find("://") + 3 :] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "HTTP://Ex.NET", "a://b://c/d", "x://example.net/en/x?y#z", "x://sub.example.com/de/", "x://a.org/fr/1#q?b", "x://a.org?x", "https://net/\nfoo", "x://notexample.net/en/a", "x://", "x://É.NET/Ä"]
    df = pages.union(spark.createDataFrame([(None if i % 4 == 0 else 10**6 + i, u) for i, u in enumerate(odd + odd[3:6])], "page_id long, url string"))
    found = urls.judged_urls(df.withColumns({"rule": F.lit(1), "_s1": F.lit(2)})).collect()
    assert len(found) == df.count()
    for r in found:
        host, path = parts_of(r["url"])
        fits = [x for x in urls.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2])) if fits else None
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1] + best[2])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("block", "allow")
    assert urls.judged_urls(pages.limit(0)).count() == 0


def verdicts(spark, rows, **options):
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    return [r["verdict"] for r in urls.judged_urls(df, **options).orderBy("page_id").collect()]


def test_the_tree_decides_urls_without_words(spark):
    """Most slugs of a branch speak for spam: the others go along; a few words in a clean branch block only themselves."""
    g = random.Random(2)
    slug = lambda: "".join(g.choice("bcdfgh") for _ in range(8))
    worded = [f"https://h.test/a/go/casino-{slug()}" for _ in range(40)]
    along = [f"https://h.test/a/go/{slug()}" for _ in range(8)]
    clean = [f"https://h.test/a/read/{slug()}" for _ in range(90)] + [f"https://k.test/{slug()}" for _ in range(90)]
    few = [f"https://k.test/poker-{slug()}" for _ in range(10)]
    one = [f"https://big.test/news/{slug()}" for _ in range(300)] + ["https://big.test/news/the-poker-face"]
    found = verdicts(spark, worded + along + clean + few + one)
    assert found[:48] == ["block"] * 48
    assert found[48:228] == ["allow"] * 180
    assert found[228:238] == ["block"] * 10
    assert found[238:] == ["allow"] * 301  # one word in a large clean branch


def test_segments_below_the_second_decide(spark):
    """Labels of other sources; both branches differ in the fifth segment alone."""
    rows = [f"https://h.test/blog/2024/{m}/x/{k}/page{i}" for m in ("may", "june") for k in ("offers", "recipes") for i in range(30)]
    df = spark.createDataFrame([(i, u, 1 if "offers" in u and i % 3 else 0 if "recipes" in u and i % 3 else None) for i, u in enumerate(rows)], "page_id long, url string, known int")
    found = {r["url"]: r["verdict"] for r in urls.judged_urls(df, label=F.col("known")).collect()}
    assert all((v == "block") == ("offers" in u) for u, v in found.items())


def test_parents_are_the_same_once_generalised(spark):
    """Names vary, so that what is below them is counted together."""
    rows = [(i, "h", [f"u{'abcdefghijklmnopqrstuvwxyz'[i]}", f"s{'abcdefghijklmnopqrstuvwxyz'[i]}x", "end"], 1) for i in range(26)]
    paths = spark.createDataFrame(rows, "id long, host string, segs array<string>, n long")
    once = urls.generalised(paths)
    assert {tuple(r["segs"][:1]) for r in once.collect()} == {("*",)}
    assert {tuple(r["segs"]) for r in urls.generalised(once).collect()} == {("*", "*", "end")}


def test_similar_siblings_share_counts(spark):
    rows = [("h", 0, 1, "a", 100, 5.0, 1), ("h", 0, 1, "b", 100, 9.0, 1), ("h", 0, 1, "c", 100, 90.0, 1), ("h", 0, 2, "a", 10, 1.0, 1)]
    nodes = spark.createDataFrame(rows, "host string, level int, parent long, segment string, n long, bad double, rows long")
    found = {(r["parent"], r["segment"]): (r["n"], r["bad"]) for r in urls.merged_siblings(nodes).collect()}
    assert found == {(1, "a"): (200, 14.0), (1, "b"): (200, 14.0), (1, "c"): (100, 90.0), (2, "a"): (10, 1.0)}


def test_very_long_urls(spark):
    assert verdicts(spark, ["https://h.test/" + "a/" * 3000, "https://h.test/" + "b" * 50000, "https://h.test/x"]) == ["allow"] * 3


def test_varying_segments_are_wildcards(spark):
    segments = ["123", "2024-01-02", "a1b2c3d4e5f6", "news", "page7.html", "deadbeef"]
    df = spark.createDataFrame([(s,) for s in segments], "s string")
    assert [r[0] for r in df.select(urls.looks(F.col("s"))).collect()] == ["*", "*-*-*", "*", "news", "page*.html", "deadbeef"]


# Quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base_counts(spark, docs):
    g = random.Random(3)
    texts = ODD + ["".join(g.choice(["a ", "b ", "c\n", "| ", "# ", "\x0b", "\x1c"]) for _ in range(90)) for _ in range(200)]
    for df in (docs, clashing(spark, texts)):
        found = quality.quality(df)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        rows = found.collect()
        assert len(rows) == df.count() and all(tuple(r[n] for n in names) == base_of(r["text"]) for r in rows)
        assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality.quality(docs.limit(0)).count() == 0
    assert "_words" in quality.quality(clashing(spark, ODD)).columns


def test_quality_keeps_prose_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs).where("not base_failed").join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.9


def test_quality_counts_words_of_any_length(spark):
    df = spark.createDataFrame([("Который, который; (КОТОРЫЙ) The THE, the", "ru")], "text string, lang string")
    words = quality.vocabulary(df)
    assert words == ["the", "который"]
    row = quality.profiles(quality.base_rules(df), words).first()
    assert row["_tokens"] == 6 and sorted(tuple(b) for b in row["_bins"]) == [("the", 3.0), ("который", 3.0)]


def test_junk_of_normal_characters_shapes_no_reference(spark, monkeypatch):
    g = random.Random(4)
    common = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    word = lambda: "".join(g.choice("abdefgikou") for _ in range(7))
    rows = [(i, " ".join(g.choice(common) if g.random() < 0.6 or i >= 100 else word() for _ in range(120)), "en") for i in range(20, 160)]
    rows += [(i, " ".join(word() for _ in range(120)), "en") for i in range(20)]
    seen, counted = [], quality.references
    monkeypatch.setattr(quality, "references", lambda df: (seen.append({r["doc_id"] for r in df.select("doc_id").collect()}), counted(df))[1])
    monkeypatch.setattr(quality, "set_aside", lambda df, *names: df)
    monkeypatch.setattr(quality, "restored", lambda df, columns, *new: df)
    quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen) == 2 and set(range(20)) <= seen[0] and not set(range(20)) & seen[1]


def plain_kept(rows):
    """The verdict of every row (text, lang), with references counted twice."""
    import regex

    words = lambda t: [w for w in regex.split(r"[^\p{L}]+", t.lower()) if w]
    classes = (r"[a-z0-9\p{Ll}]", r"\p{Lu}", r"[ \t-\r]", r"[.,;:'\"()?-]", r"[|/\\<>{}\[\]=]", r"[#*$%&!@^_+~`]")
    texts = [t or "" for t, _ in rows]
    tokens = [words(t) for t in texts]
    chars = [[len(regex.findall(c, t)) for c in classes] for t in texts]
    chars = [[*c, len(t) - sum(c)] for c, t in zip(chars, texts, strict=True)]
    top = lambda count: [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: quality.WORDS]]
    by_lang = collections.defaultdict(collections.Counter)
    for (t, lang), w in zip(rows, tokens, strict=True):
        if lang is not None and t is not None:
            by_lang[lang].update(w)
    vocabulary = {w for count in by_lang.values() for w in top(count)}
    failed = [base_of(t)[5] for t in texts]

    def references(chosen):
        out = []
        for lang in {rows[i][1] for i in chosen} - {None}:
            own = [i for i in chosen if rows[i][1] == lang]
            n, total = np.sum([chars[i] for i in own], axis=0), sum(len(tokens[i]) for i in own)
            count = collections.Counter(w for i in own for w in tokens[i] if w in vocabulary)
            if n.sum() and total:
                out.append((lang, n / n.sum(), {w: count[w] / total for w in top(count)}))
        return out

    def divergence(p, q):
        return sum((x * np.log2(2 * x / (x + y)) if x > 0 else 0) / 2 + (y * np.log2(2 * y / (x + y)) if y > 0 else 0) / 2 for x, y in zip(p, q, strict=True))

    def worst(i, ref):
        n, total, out = len(tokens[i]), sum(chars[i]), 0.0
        if total >= quality.LEAST_CHARS:
            out = np.sqrt(max(0, divergence(np.array(chars[i]) / total, ref[1]))) / (quality.MOST_CHARS + quality.SPREAD_CHARS / np.sqrt(total))
        if n >= quality.LEAST_WORDS:
            count = collections.Counter(tokens[i])
            p = [count[w] / n for w in ref[2]]
            d = divergence([*p, max(0, 1 - sum(p))], [*ref[2].values(), max(0, 1 - sum(ref[2].values()))])
            out = max(out, np.sqrt(max(0, d)) / (quality.MOST_WORDS + quality.SPREAD_WORDS / np.sqrt(n)))
        return out

    def like(i, refs):
        return not failed[i] and (not refs or min(worst(i, r) for r in refs) <= 1)

    passing = [i for i in range(len(rows)) if not failed[i]]
    first = references(passing)
    refs = references([i for i in passing if like(i, first)])
    return [like(i, refs) for i in range(len(rows))]


def test_quality_verdicts_are_the_plain_ones(spark, docs):
    g = random.Random(11)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(10**6 + i, " ".join("".join(g.choice("abcdefgh ABC19.,|") for _ in range(7)) for _ in range(90)), g.choice(["en", "xx", None])) for i in range(12)]
    found = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = plain_kept([(t, lang) for _, t, lang in rows])
    assert [found[i] for i, _, _ in rows] == want and 0 < sum(want) < len(want)


def test_divergence_is_jensen_shannon(spark):
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.2, 0.3, 0.5])
    m = (p + q) / 2
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    found = spark.range(1).select(sum((quality.term(F.lit(float(a)), F.lit(float(b))) for a, b in zip(p, q, strict=True)), F.lit(0.0))).first()[0]
    assert abs(found - (kl(p, m) + kl(q, m)) / 2) < 1e-9


# Personal data


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


PRIVATE = [
    "a@b.c%d@e.f.g x@y", "a.b@c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "+1 (017) 555-7713 +12 +1234567890123456 +1--", "4111 1111 1111 1111", "4111111111111111 4111-1111-1111-1111",
    "é😀a@b.co 😀1.2.3.4", "1 " * 8000, "+1" + " " * 8000, "a@" * 5000, "+14155550123@x.org 4.4.4.4",
]


def test_base_spans(spark, docs):
    g = random.Random(5)
    texts = ODD + PRIVATE + ["".join(g.choice("ab12.@+- (%0") for _ in range(60)) for _ in range(1500)]
    for df in (docs, clashing(spark, texts)):
        found = pii.personal_data(df).withColumn("masked", pii.masked("text", F.col("found")))
        rows = found.collect()
        assert len(rows) == df.count()
        for r in rows:
            want = base_spans(r["text"] or "")
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
            out, at = "", 0
            for s in sorted(r["found"], key=lambda s: (s["start"], s["end"], s["kind"])):
                if s["start"] >= at:
                    out += r["text"][at : s["start"]] + f"[{s['kind'].upper()}]"
                at = max(at, s["end"])
            assert r["masked"] == (None if r["text"] is None else out + r["text"][at:] if r["found"] else r["text"])
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_secrets_are_found_and_plain_numbers_left(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    g = random.Random(6)
    texts = [f'the token = "{"".join(g.choice("0123456789abcdef") for _ in range(40))}" of it' for _ in range(30)] + [f"the {g.randrange(10**15, 10**16)} and that" for _ in range(60)] + [f'x token = "{key}" y']
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[-1]["spans"] == f"secret:11:{11 + len(key)}"
    assert all("secret" in r["spans"] for r in rows[:30]) and not any("secret" in r["spans"] for r in rows[30:90])


def test_reliabilities_trust_labelers_that_agree():
    belief = pii.reliabilities({("secret", "1,1,1,1,1"): 50.0, ("secret", "-1,0,-1,-1,-1"): 400.0, ("secret", "1,0,0,1,1"): 10.0})
    assert belief["secret", "1,1,1,1,1"] > 0.95 and belief["secret", "-1,0,-1,-1,-1"] < 0.05


# Near copies


def brute_links(texts, threshold=0.8):
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset() for w in words]
    close = lambda a, b: len(a & b) >= threshold * len(a | b) - 1e-9
    return [[j for j, b in enumerate(sets) if j != i and a and b and close(a, b)] for i, a in enumerate(sets)], words


def components(links):
    label = list(range(len(links)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([label[i], *(label[j] for j in near)])
            if least != label[i]:
                label[i], changed = least, True
    return label


def corpus():
    """Exact copies, a large group of near copies, chains of near copies, short texts and strangers."""
    g = random.Random(8)
    new = lambda n: [g.choice("abcdefghij") + str(g.randrange(5000)) for _ in range(n)]
    base, texts = new(200), [None, "", " ", "one", "One", "two words", "one two three four"]
    for _ in range(70):
        copy = list(base)
        for _ in range(g.randrange(4)):
            copy[g.randrange(200)] = new(1)[0]
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 25 + [" ".join(base).upper()]
    chain = new(120)
    for _ in range(12):
        chain = chain[4:] + new(4)
        texts.append(" ".join(chain))
    return texts + [" ".join(new(60)) for _ in range(40)]


@pytest.mark.parametrize(("block", "size"), [(512, 8 << 20), (16, 8 << 20), (512, 9000)])
def test_links_and_clusters(spark, monkeypatch, block, size):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    texts = corpus()
    g = random.Random(9)
    ids = list(range(len(texts)))
    g.shuffle(ids)
    df = spark.createDataFrame([(ids[i], t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, stays string, _row long")
    found = neardup.near_duplicates(df)
    assert found.columns == ["doc_id", "text", "_row", "class_id", "cluster_id", "n_links", "n_text_links", "stays"]
    by = {r["_row"]: r for r in found.collect()}
    links, words = brute_links(texts)
    label = components(links)
    least = collections.defaultdict(list)
    for i in range(len(texts)):
        least[label[i]].append(ids[i])
    for i in range(len(texts)):
        same = [j for j in range(len(texts)) if words[j] == words[i]] if words[i] else [i]
        assert by[i]["n_links"] == len(links[i])
        assert by[i]["class_id"] == min(ids[j] for j in same)
        assert by[i]["cluster_id"] == min(least[label[i]])
        assert by[i]["n_text_links"] == len({tuple(words[j]) for j in links[i] if words[j] != words[i]})
    kept = [i for i in by if by[i]["stays"]]
    assert len({label[i] for i in kept}) == len(kept) == len(set(label))


def test_near_copies_of_odd_rows(spark, docs):
    odd = clashing(spark, ODD)
    found = neardup.near_duplicates(odd)
    assert found.count() == odd.count() and set(odd.columns) < set(found.columns)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.6, 0.99), (0.9, 0.999)):
        bands, rows = neardup.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall
    for threshold, recall in ((0.05, 0.9999), (0, 0.9), (0.8, 1)):
        with pytest.raises(ValueError):
            neardup.banding(threshold, recall)


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["quality rules", "language identification", "n-gram Jaccard join", "personal data", "best-fit packing"]
    now = docs
    for name, stage in p.STAGES[:-1]:
        after = p.written(stage(spark, now, SF), "test")
        assert after.schema.simpleString() == docs.schema.simpleString() and 0 < after.count() <= now.count()
        if name == "quality rules":
            assert not any(base_of(r["text"])[5] for r in after.collect())
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            lost = now.join(after, "doc_id", "left_anti").join(labels, "doc_id").where("quality = 1").collect()
            assert all(base_of(r["text"])[5] for r in lost)
        if name == "language identification":
            assert after.count() >= 0.97 * now.count()
        if name == "n-gram Jaccard join":
            rows = now.orderBy("doc_id").collect()
            label = components(brute_links([r["text"] for r in rows])[0])
            at = {r["doc_id"]: label[i] for i, r in enumerate(rows)}
            kept = [at[r["doc_id"]] for r in after.collect()]
            assert len(kept) == len(set(kept)) == len(set(label))
        if name == "personal data":
            rows = after.collect()
            assert not any(base_spans(r["text"]) for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
            before = {r["doc_id"]: r["text"] for r in now.collect()}
            assert all(before[r["doc_id"]] == r["text"] for r in rows if "[" not in r["text"])
        now = after
    from test_text_ops import by_id, check_packing

    used, least = check_packing(p.STAGES[-1][1](spark, now, SF).collect(), by_id(now), 2048)
    assert used <= least + 1 and public_tokenizers
    assert p.run(spark, SF).count() == p.STAGES[-1][1](spark, now, SF).count()


#: Names that operators give to columns of their own, in another case, or that need quotes; each holds its name.
CLASHING = ("Kept", "a.b", "a`b", "_text", "_others", "score", "count", "rows", "n", "_row", "_label", "_chars", "key", "spans", "Stays", "host", "segs", "_place")


def test_segments_that_vary_below_varying_ones_are_one_template(spark):
    g = random.Random(3)
    word = lambda: "".join(g.choice("abcdefghijk") for _ in range(9))
    rows = [(f"https://h.example/{'/'.join(word() for _ in range(6))}",) for _ in range(60)]
    paths = spark.createDataFrame([(i, "h", u.split("/")[3:], 1) for i, (u,) in enumerate(rows)], "id long, host string, segs array<string>, n long")
    changed, rounds = True, 0
    while changed:
        paths, changed = urls.generalised(paths)
        rounds += changed
    assert rounds == 6 and paths.select("segs").distinct().count() == 1


def test_siblings_of_nearly_the_same_share_are_told_apart_by_their_numbers(spark):
    nodes = [("h", 0, 1, "a", 10**6, 1000.0, 5), ("h", 0, 1, "b", 10**6, 2000.0, 7), ("h", 0, 1, "c", 50, 0.1, 1), ("h", 0, 1, "d", 100, 0.2, 1), ("h", 0, 2, "e", 10, 9.0, 1)]
    df = spark.createDataFrame(nodes, "host string, level int, parent long, segment string, n long, bad double, rows long")
    found = {r["segment"]: (r["n"], round(r["bad"], 6), r["rows"]) for r in urls.merged_siblings(df).collect()}
    # a and b differ by a thousandth, 25 standard errors; c and d have the same share, which is b's within the error of so few.
    assert found == {"a": (10**6, 1000.0, 5), "b": (10**6 + 150, 2000.3, 7), "c": (10**6 + 150, 2000.3, 1), "d": (10**6 + 150, 2000.3, 1), "e": (10, 9.0, 1)}


def test_long_paths_take_time_by_their_length(spark):
    df = spark.createDataFrame([("https://h.example/" + "/".join("ab" for _ in range(20_000)), 1), (None, 2), ("://", 3)], "url string, page_id long")
    assert {r["page_id"]: r["verdict"] for r in urls.judged_urls(df).collect()} == {1: "allow", 2: "allow", 3: "allow"}


def test_operators_take_any_extra_column(spark):
    from helixscan.llm import gif, langid

    for table, name, op, new in (
        ("documents", "text", quality.quality, quality.ADDED), ("documents", "text", neardup.near_duplicates, ("class_id", "cluster_id", "n_links", "n_text_links", "stays")),
        ("documents", "text", pii.personal_data, ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")), ("documents", "text", lambda d: langid.predicted(d, None), ("lang_pred", "score")),
        ("pages", "html", html.extract_text, ("text", "n_chars")), ("pages", "url", urls.judged_urls, ("host", "path", "rule", "share", "verdict")),
        ("documents", "media", lambda d: gif.frame_columns(d.withColumn("media", F.lit(gif.write_gif(bytes(64))))), ("media", *(f.name for f in gif.READ))),
    ):
        plain = spark.read.parquet(f"{SF}/{table}.parquet").limit(20)
        out = op(plain.select("*", *[F.lit(c).alias(c) for c in CLASHING]))
        kept = [c for c in CLASHING if c.lower() not in new]
        assert len({c.lower() for c in out.columns}) == len(out.columns) and set(kept) < set(out.columns), name
        rows = out.collect()
        assert len(rows) == 20 and all(r[c] == c for r in rows for c in kept), name


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    pytest.importorskip("public_tokenizers")
    g = random.Random(14)
    prose = [" ".join(g.choice("the of and river stone house was glass in on".split()) for _ in range(400)) for _ in range(6)]
    texts = [*ODD, *prose, "long " + " ".join(prose * 40)]
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", None, None if i % 2 else 7, *CLASHING) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)
    odd = spark.createDataFrame(rows + rows[-3:], schema)
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, odd, SF)
        assert after.columns == odd.columns and after.count() <= odd.count(), name
        assert {tuple(r)[5:] for r in after.collect()} <= {CLASHING}, name  # quality rules keep none of these texts
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    prose_docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).select("*", *[F.lit(c).alias(c) for c in CLASHING])
    assert {tuple(r)[5:] for r in p.quality_rules(spark, prose_docs, SF).collect()} == {CLASHING}
    kept = p.quality_rules(spark, odd, SF).collect()
    assert not any(base_of(r["text"])[5] for r in kept)
    assert all(any(map(str.isalpha, r["text"])) for r in p.language_id(spark, odd, SF).collect())
    copies = p.near_duplicates(spark, odd, SF).collect()
    assert len([r for r in copies if not (r["text"] or "").split()]) == sum(not (t or "").split() for t in texts)
    assert len([r for r in copies if r["text"] in prose]) == len(prose)
    masked = p.personal_data(spark, odd, SF).collect()
    assert {r["text"] for r in masked} >= {None, "", "[EMAIL]"}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert p.language_id(spark, unlabelled, SF).count() == odd.count()
    assert p.best_fit_packing(spark, odd, SF).count() >= odd.count()
    assert p.best_fit_packing(spark, odd.limit(0), SF).count() == 0
