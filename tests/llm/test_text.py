"""HTML extraction and toxicity."""

import random
import time
import zlib

import numpy as np
import pytest

from twinline.llm import html_text, toxicity

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>"
    "<div class='cookie-notice'>We use</div><nav><a>Home</a></nav><div class='post has-sidebar'><article class=post>"
    "<header><h1>T &lt;x&gt;</h1></header><p>One <b>two</b>three<p>Four&nbsp; five<ul><li>a<li>b</ul><form>go</form>"
    "<div id=related-posts>rel</div><script>if(a<b){}</script><!-- c --><table><tr><td>c<td>d</table></article></div>"
    "<section id=comments><article class=comment><p>nice</article></section><aside>s</aside><footer>f</footer>"
)


@pytest.mark.parametrize(
    "source, text",
    [
        (PAGE, "T <x> One twothree Four five a b c d"),
        ("", ""),
        ("plain <i>x</i> a < b <3 &amp; <div>q<div>r</div>", "plain x a < b <3 & q r"),
        ("<article><p>a<br>b<p><b>c<br><p>d", "a b c d"),
        ("<main><p>x</p><div class='ad'>buy</div></main><p>y</p>", "x"),
        ("<p>unclosed <script>var x = '<p>no</p>'", "unclosed"),
        ("<p title='a>b'>q</p><textarea>z</textarea>", "q"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(html_text.parse(source), set()).text == text


def test_templates_go_by_host(spark):
    page = lambda host, i: (i, f"http://{host}/{i}", f"<div class=x><p>Welcome to {host}</p></div><div><p>Story {i} of its own</p></div>")
    rows = [page("a.com", i) for i in range(30)] + [page("b.com", 100 + i) for i in range(3)]
    rows += [(200, None, None), (201, "http://a.com/x", None), (202, "bad", "<p>one</p>"), rows[0]]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, main_text string")
    got = sorted((r.page_id, r.main_text) for r in html_text.extract(df).collect())
    want = [(i, f"Story {i} of its own") for i in [0, *range(30)]]
    want += [(100 + i, f"Welcome to b.com Story {100 + i} of its own") for i in range(3)]
    assert got == [*want, (200, ""), (201, ""), (202, "one")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_articles_are_never_template(spark):
    rows = [(i, f"http://a.com/{i}", "<nav>menu</nav><article><p>The same text</p></article>") for i in range(40)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.main_text for r in got} == {"The same text"}


def extracted(spark, bodies):
    rows = [(i, f"http://a.com/{i}", body) for i, body in enumerate(bodies)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.main_text for r in sorted(got, key=lambda r: r.page_id)]


def test_template_goes_inside_articles_and_text_stays_outside(spark):
    block = "<div class=z><p>Join our list</p><p>of readers</p></div>"
    page = lambda i: (
        f"<div class=x>Site line</div><article><h2>Summary</h2><p>Story {i} goes on <b>not</b> long {i}</p>{block}</article><div>Letter {i}</div>"
    )
    want = [f"Summary Story {i} goes on not long {i} Letter {i}" for i in range(20)]
    assert extracted(spark, [page(i) for i in range(20)]) == want


def test_paragraphs_of_copies_are_no_template(spark):
    # Whole copies, and near copies that differ in one paragraph; all end in the same block.
    body = "".join(f"<p>Paragraph {k} of a long story</p>" for k in range(6))
    block = "<p>Join our list</p>"
    copies = [f"<article>{body}<p>Seen {i // 3}</p>{block}</article>" for i in range(30)]
    others = [f"<article><p>Something else, by number {i}</p>{block}</article>" for i in range(20)]
    got = extracted(spark, copies + others)
    text = " ".join(f"Paragraph {k} of a long story" for k in range(6))
    assert got == [f"{text} Seen {i // 3}" for i in range(30)] + [f"Something else, by number {i}" for i in range(20)]


def toxic_corpus(seed, count):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "su", "ti"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(count):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Grubble!", "zwonk" + word(), "zwonk" + word()])
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_scores_hold_out_and_spans(spark):
    docs, labels = toxic_corpus(1, 1500)
    extra = [(5000, None), (5001, ""), (None, "grubble ka lo"), (5002, "ka " * 50_000 + "zwonkka")]
    df = spark.createDataFrame(docs + extra + docs[:3], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, table).collect()
    assert len(rows) == len(docs) + len(extra) + 3
    truth = {i: any(w.startswith(("Grubble", "zwonk")) for w in t.split()) for i, t in docs}
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    judged = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(t == bool(p) for t, p in judged) / len(judged) > 0.95
    long_one = next(r for r in rows if r.doc_id == 5002)
    assert [(s.word, s.text) for s in long_one.offending] == [(50_000, "zwonkka")]
    assert next(r for r in rows if r.doc_id == 5000).score == next(r for r in rows if r.doc_id == 5001).score < 0.5


def test_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.toxicity(df, none).collect()}) == 1
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_marginals_of_stretches_match_every_path():
    rng = np.random.default_rng(5)
    move = np.exp(rng.normal(size=(3, 2, 2)))
    for length, places, grades in ((1, [0], [1]), (6, [2, 3], [1, 2]), (9, [0, 8], [2, 1]), (5, [4], [1])):
        grade = [0] * length
        for p, g in zip(places, grades):
            grade[p] = g
        total, toxic = 0.0, np.zeros(length)
        for path in range(2**length):
            tags = [path >> i & 1 for i in range(length)]
            weight = np.prod([move[grade[i]][tags[i - 1] if i else 0, tags[i]] for i in range(length)])
            total += weight
            toxic += weight * np.array(tags)
        assert np.allclose(toxicity.marginals(move, places, grades, length), (toxic / total)[places])


def test_gradient_is_observed_less_expected():
    rng = np.random.default_rng(6)
    weights = rng.normal(size=toxicity.GRADES + 5) * 0.5
    grades, sizes, toxic = np.array([[0, 3, 0, 1], [2, 0, 0, 0]]), np.array([4, 2]), np.array([1, 0])

    def likelihood(w):
        emit, step = w[: toxicity.GRADES + 1], w[toxicity.GRADES + 1 :].reshape(2, 2)
        out = 0.0
        for row, size, bad in zip(grades, sizes, toxic):
            alpha, before = np.array([1.0, 0.0]), 0
            for g in row[:size]:
                tag = int(g > 0 and bad)
                out += step[before, tag] + (emit[g] if tag else 0.0)
                alpha = alpha @ np.exp(step + np.array([0.0, emit[g]]))
                before = tag
            out -= np.log(alpha.sum())
        return out

    slope = toxicity._observed(grades, sizes, toxic) - toxicity._counts(weights, grades, sizes)
    for i in range(len(weights)):
        step = np.eye(len(weights))[i] * 1e-5
        assert abs((likelihood(weights + step) - likelihood(weights - step)) / 2e-5 - slope[i]) < 1e-6


BROKEN = {
    "quotes that don't end": "<a '" * 200_000,
    "a quote at the end": "<a " * 300_000 + "'",
    "ends of nothing": "<div>" * 100_000 + "</x></span>" * 80_000,
    "articles in articles": "<article>" * 150_000 + "text",
    "headings in bold": "<p><div>" + "<b><h1>" * 100_000,
    "deep headers": "<div>" * 80_000 + "<header>x</header>" * 40_000,
    "items": "<ul>" + "<li><span>" * 100_000,
    "classes": "<div " + "class='a' " * 100_000 + ">x",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    source = BROKEN[name]
    start = time.process_time()
    html_text.main_text(html_text.parse(source), {1}, outside=True)
    whole = time.process_time() - start
    start = time.process_time()
    html_text.main_text(html_text.parse(source[: len(source) // 4]), {1}, outside=True)
    assert whole < 60 and whole < 12 * (time.process_time() - start) + 1


def test_tags_with_odd_quotes():
    parse = lambda s: html_text.main_text(html_text.parse(s), set()).text
    assert parse("<p title='a>b' class=\"c>d\">x</p>y") == "x y"
    assert parse("a <b 'c>d</b> e") == "a <b 'c>d e"  # the quote never ends: no tag
    assert parse("<p a='1' b=\"2\" c='>' d>x<p e='>y") == "x<p e='>y"
    assert parse("x<div") == "x"


def test_template_goes_by_count_whatever_it_is_called(spark):
    """No tag, class, id or role gives it away; one common line of prose stays."""
    common = "<p>All rights to the truth are reserved.</p>"

    def page(i):
        top = "<div class=q1><span>Home</span><span>World</span></div>"
        bottom = "<div id=z9><div>Imprint</div><div>Contact us</div></div>"
        story = f"<p>Story {i} begins here.</p>" + (common if i % 4 == 0 else "") + f"<p>And ends at {i}.</p>"
        return f"<body>{top}<div class=k3>{story}</div>{bottom}</body>"

    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://b.com/{i}", page(i)) for i in range(3)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), share=0.5).collect()}
    line = " All rights to the truth are reserved."
    for i in range(40):
        assert got[i].main_text == f"Story {i} begins here.{line if i % 4 == 0 else ''} And ends at {i}."
        assert (got[i].by_count, got[i].by_hint) == (2, 0)
    assert got[100].main_text.startswith("HomeWorld Story 0")  # too few pages to tell, and nothing says so


def test_counts_by_host_against_brute_force(spark):
    """What is found as template is what recurs, counted one page after the other."""
    nav = "<nav><a>Home</a><a>Shop</a></nav>"
    pages = [(f"h{i % 3}", f"{nav if i % 3 else ''}<div>{'Same' if i % 2 else i}</div><article><p>Text {i}</p><p>{'Block' if i % 4 else i}</p></article>") for i in range(60)]
    found = {(r.host, r.digest) for r in html_text.templates(spark.createDataFrame(pages, "host string, html string"), 5, 0.1, 0.5).collect()}
    outside, inside, articles = {}, {}, {}
    for host, source in pages:
        root = html_text.parse(source)
        html_text._articles(root)
        subtrees, own = html_text.subtree_hashes(root)
        articles.setdefault(host, set()).update(a for a, _ in own)
        for digest in {d for _, d, article, _ in subtrees if article is None}:
            outside[host, digest] = outside.get((host, digest), 0) + 1
        for _, digest, article, _ in subtrees:
            if article is not None:
                inside.setdefault((host, digest), set()).add(article)
    want = {k for k, n in outside.items() if n >= max(5, 2)}
    want |= {k for k, own in inside.items() if len(own) >= max(5, len(articles[k[0]]) / 2)}
    assert found == want and len(want) > 5


def test_a_common_line_of_articles_stays(spark):
    """A paragraph of a third of the articles is prose; one of nearly all is template."""
    block = "<p>Join our list of readers</p>"
    page = lambda i: f"<article><p>Story {i} of its own and longer than the rest of it</p>{'<p>Time will tell.</p>' if i % 3 == 0 else ''}{block}</article>"
    want = [f"Story {i} of its own and longer than the rest of it{' Time will tell.' if i % 3 == 0 else ''}" for i in range(30)]
    assert extracted(spark, [page(i) for i in range(30)]) == want
