"""Near copies, toxicity, quality and page text against hand-made rows and brute force."""

import html
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docuvet.llm import near_text, page_text, quality, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
AWKWARD = "doc_id long, raw_text string, head string, bucket string, label int, score double"


def awkward(spark, texts):
    """Rows with extra columns of clashing names, nulls, repeated rows and a null key."""
    rows = [(i, t, "h", "b", 1, 0.5) for i, t in enumerate(texts)] + [(None, "no key here at all", None, None, None, None)]
    return spark.createDataFrame([*rows, rows[0]], AWKWARD)


def shingle_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_no_link_is_lost_near_a_hub(spark):
    """Pairs (x, y) at 0.84 of which x is like a large group's texts (0.70) and y is not (0.58): both are found together."""
    n, pairs = 400, 600
    base = [f"b{i}" for i in range(n)]
    texts, first = [" ".join([*base[: 3 + i], f"v{i}", *base[4 + i :]]) for i in range(100)], 100
    for p in range(pairs):
        own = [f"x{p}.{i}" for i in range(n)]
        x = [*base[: int(0.8235 * n)], *own[int(0.8235 * n) :]]
        y = [*[f"y{p}.{i}" for i in range(int(0.088 * n))], *x[int(0.088 * n) :]]
        texts += [" ".join(x), " ".join(y)]
    sets = [shingle_set(t) for t in texts[first - 1 : first + 2]]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert 0.8 < alike(sets[1], sets[2]) < 0.86 and 0.67 < alike(sets[0], sets[1]) < 0.73 and 0.55 < alike(sets[0], sets[2]) < 0.61
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    found = {r.doc_id: r.component_id for r in near_text.link_documents(df).collect()}
    assert all(found[i] == 0 for i in range(first))
    lost = [p for p in range(pairs) if found[first + 2 * p] != found[first + 2 * p + 1]]
    assert lost == [] and all(found[first + 2 * p] == first + 2 * p for p in range(pairs))


def test_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(60)] + ["Äpfel", "ÄPFEL", "X", "x"]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((3, 30, 120)))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice((" ", "\n\t")).join(copy))
    texts += [None, "", " \n", "X y", "x Y", "long " * 5000]
    df = awkward(spark, texts)
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = brute_components(sets)
    rows = near_text.link_documents(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.kept is None
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_near_copies_of_nothing(spark):
    assert near_text.link_documents(spark.createDataFrame([], "doc_id long, raw_text string")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 900).astype(np.uint64)
    b[:700] = a[:700]
    one, two = near_text.registers(a, np.array([0])), near_text.registers(b, np.array([0]))
    union = near_text.registers(np.unique(np.concatenate([a, b])), np.array([0]))
    assert (np.maximum(one, two) == union).all()
    estimate = near_text.likely_similarity(one, two, np.array([900.0]), np.array([900.0]))[0]
    assert abs(estimate - 700 / 1100) < 0.2


def test_block_comparison_counts_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (1, 50, 200, 200)]
    got = near_text._common(sets, columns=16)
    assert [[int(x) for x in row] for row in got] == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


@pytest.fixture(scope="module")
def reviewed(spark):
    rng = random.Random(5)
    plain = [f"word{n}" for n in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        lines = [[rng.choice(plain) for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 8))]
        if bad:
            rng.choice(lines).insert(1, rng.choice(("grumble", "grumbly", "grumblest")))
        poor = i % 7 == 0
        text = ". ".join(" ".join(line) for line in lines)
        rows.append((i, text.upper() + " ###" * 20 if poor else text, 1, len(text)))
        labels.append((i, int(bad), int(not poor)))
    labels += [(9999, 1, 1), (None, 1, 0), (3, None, None), (4, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, raw_text string, score int, n_chars long"), spark.createDataFrame(labels, "doc_id long, abusive int, accepted int")


def test_toxicity_learns_from_document_labels(spark, reviewed):
    documents, labels = reviewed
    seen, held = labels.filter("doc_id % 4 <> 0 or doc_id is null"), range(0, 400, 4)
    rows = {r.doc_id: r for r in toxicity.score_documents(documents, seen).collect()}
    right = sum(rows[i].abusive == int(i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    texts = {r.doc_id: r.raw_text for r in documents.collect()}
    for r in rows.values():
        assert 0 <= r.score <= 1 and r.abusive == int(r.score >= 0.5)
        assert bool(r.offending) == bool(r.abusive)
        if r.abusive and r.doc_id % 5 == 0:
            assert any("grumbl" in texts[r.doc_id][o.start : o.end].lower() for o in r.offending)


def test_noisy_or_by_hand():
    z = np.log(np.array([0.5, 0.2, 0.1]) / (1 - np.array([0.5, 0.2, 0.1])))
    assert np.allclose(toxicity.noisy_or(z, np.array([0, 0, 2]), 4), [1 - 0.5 * 0.8, 0, 0.1, 0])


def test_scores_of_awkward_rows(spark, reviewed):
    _, labels = reviewed
    texts = [None, "", "  \n", "Ünïcödé ßtraße. Zweiter Satz!", "x" * 100_000, "a " * 50_000]
    df = awkward(spark, texts)
    for rows in (toxicity.score_documents(df, labels).collect(), quality.score_documents(df, labels, ("label",)).collect()):
        assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
        same = [r.score for r in rows if r.doc_id == 0]
        assert same[0] == same[1]
    nothing = labels.filter("false")
    assert {r.score < 0.5 for r in toxicity.score_documents(df, nothing).collect()} == {True}
    assert quality.score_documents(df, nothing).count() == len(texts) + 2
    empty = df.filter("false")
    assert toxicity.score_documents(empty, labels).count() == quality.score_documents(empty, labels).count() == 0


def test_quality_learns_structure(spark, reviewed):
    documents, labels = reviewed
    seen = labels.filter("doc_id % 4 <> 0 or doc_id is null")
    rows = {r.doc_id: r for r in quality.score_documents(documents, seen, ("n_chars",)).collect()}
    held = range(0, 400, 4)
    assert sum(rows[i].accepted == int(i % 7 != 0) for i in held) >= 0.95 * len(held)


def test_pairs_by_sums_of_squares():
    """The linear-time identity against the sum over all pairs of features."""
    texts = quality.Texts(pa.array(["one two two three", "", "four one"]))
    rng = np.random.default_rng(4)
    edges = [np.array([0.5])] * texts.statistics.shape[1]
    size = (1 << quality.BUCKET_BITS) + 3 * len(edges)
    weights, factors = rng.normal(size=size), rng.normal(size=(size, 3))
    bins = quality._intervals(texts.statistics, edges)
    got, _ = quality._forward(texts, bins, 0.25, weights, factors)
    for row in range(3):
        x = dict(zip(texts.bucket[texts.row == row], texts.value[texts.row == row], strict=True)) | {b: 1.0 for b in bins[row]}
        want = 0.25 + sum(weights[i] * v for i, v in x.items())
        want += sum(factors[i] @ factors[j] * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        assert abs(got[row] - want) < 1e-6


ARTICLE = "<article><h1>T &amp; x</h1><p>One <b>two</b>\n three<p>Four<br>five &eacute;&#233;</p></article>"
PAGES = [
    (f"<html><head><title>no</title></head><body><nav>menu</nav>{ARTICLE}<footer>f</footer></body>", "T & x\nOne two three\nFour\nfive éé"),
    ("<body><div id=cookie-notice>c</div><div class='menu top'><p>m</p></div><p>keep</p><section class=\"comments\"><p>c</p></section>", "keep"),
    ("<main>a<form><p>in</p></form><aside>z</aside>b</main>tail", "a\nb"),
    ("<script>var t = '</p>';</script><style>p{}</style>x", "x"),
    ("a < b &lt; c", "a < b < c"),
    ("<p>x<!-- <p>y</p> -->z<p>un<i>closed", "xz\nunclosed"),
    ("<table><tr><td>1<td>2<tr><td> 3 </table>", "1\n2\n3"),
    (None, ""),
    ("", ""),
    ("<nav>only</nav>", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_page_text_by_hand(spark):
    rows = [(i, f"http://h{i}.example.com/x", h, "t", "d") for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, rows[0], (None, None, "<p>n</p>", None, None)], "page_id long, url string, html string, text string, dropped string")
    got = page_text.extract_text(df).collect()
    assert len(got) == len(PAGES) + 2
    for r in got:
        assert r.text == ("n" if r.page_id is None else PAGES[r.page_id][1]), r
        assert r.n_chars == len(r.text)
    assert page_text.extract_text(df.filter("false")).count() == 0


def test_branches_alike_on_all_pages_of_a_host_go(spark):
    """A part that no tag or class names as noise goes where a host repeats it, and stays elsewhere."""
    def page(n, extra):
        return f"<html><body><div class=intro>{extra}</div><div class=story><p>Story number {n}</p><p>More on {n}</p></div></body></html>"

    rows = [(n, "https://one.example.org/p", page(n, "Welcome to our pages")) for n in range(20)]
    rows += [(100 + n, "https://two.example.org/p", page(n, f"Opening {n}")) for n in range(20)]
    got = {r.page_id: r.text for r in page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3\nMore on 3" and got[103] == "Opening 3\nStory number 3\nMore on 3"


def test_copies_of_an_article_are_kept(spark):
    rows = [(n, "https://one.example.org/p", f"<nav>m</nav>{ARTICLE}") for n in range(20)]
    got = page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("text").distinct().collect()
    assert [r.text for r in got] == [PAGES[0][1]]


def test_importance_by_hand(spark):
    rows = [(f"h{n % 1}", f"<p>{'same' if n < 4 else n}</p>") for n in range(8)]
    trees = page_text.style_trees(spark.createDataFrame(rows, "host string, html string")).collect()
    leaf = next(r for r in trees if r.node != 0)
    # Five different contents, one of them on four of the eight pages: 1 - (2/3) / 5; one style only below the root.
    assert leaf.pages == leaf.host_pages == 8 and abs(leaf.importance - (1 - (2 / 3) / 5)) < 1e-9


def test_html_entities_as_the_standard_library():
    for ref in ("&amp;", "&#x41;", "&copy;", "&nbsp;x", "&notanentity;"):
        assert page_text.text_of(f"<p>a{ref}b</p>") == re.sub(r"\s+", " ", html.unescape(f"a{ref}b"))


def _texts(spark, rows):
    return {r.page_id: r.text for r in page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_repeated_boxes_inside_an_article_go(spark):
    """The tree decides inside main elements too; a list that only the copies of one article have is no repeated box."""
    def page(n, more=""):
        return f"<article><p>Story number {n}</p><div>Send this <i>page</i> on</div><div class=body><p>More on {n}</p>{more}</div></article>"

    rows = [(n, "https://one.example.org/p", page(n)) for n in range(20)]
    rows += [(100 + n, "https://one.example.org/c", page("copied", "<ul><li>own list</li></ul>")) for n in range(20)]
    got = _texts(spark, rows)
    assert got[3] == "Story number 3\nMore on 3"
    assert got[100] == got[119] == "Story number copied\nMore on copied\nown list"


def test_class_words_name_parts_beside_the_text(spark):
    """A name takes its part away wherever it stands, but covers neither the article nor nearly all of the text."""
    story = "The story of the day in many words, told from its beginning to its end. " * 3

    def page(n):
        part = f"<section class='related-links'><p>Others {n}</p></section><p class=notice>Note {n}</p><div class=share-it>Share</div>"
        return f"<div class='layout has-sidebar'><div class=comments><article>said {n}</article></div><article><p>{story}{n}</p>{part}</article>side</div>"

    rows = [(n, "https://one.example.org/p", page(n)) for n in range(20)]
    rows += [(100, "https://two.example.org/p", page(100))]
    rows += [(200 + n, "https://three.example.org/p", f"<div class=with-comments><div>Story {n}</div><div class=menu>All</div></div>") for n in range(20)]
    # A class word round the body of the article; nothing else is there.
    rows += [(300, "https://four.example.org/p", f"<article><h1>T</h1><div class='sidebar'><p>{story}</p></div></article>")]
    rows += [(301, "https://four.example.org/q", "<div class=comments><p>only this</p></div>")]
    got = _texts(spark, rows)
    assert got[3] == f"{story}3" and got[100] == f"{story}100" and got[203] == "Story 3"
    assert got[300] == f"T\n{story.strip()}" and got[301] == "only this"


def test_readers_comments_and_notices_inside_articles_go(spark):
    """They differ from page to page, so the tree cannot tell them from the article; long threads go as well."""
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice("so far the plan of this town was not what people had in mind then".split()) for _ in range(n))
    rows, want = [], {}
    for n in range(24):
        body = [words(30) for _ in range(2)]
        thread = "".join(f"<li class='comment depth-1'><b class=author>R{n}{i}</b><time>{i} May</time><p>{words(25)}</p></li>" for i in range(n % 12))
        kind = (f"<div class='comments'><ol>{thread}</ol></div>", f"<section id='reader-comments'>{thread.replace('<li', '<article').replace('</li', '</article')}</section>")[n % 2]
        extra = f"<div class='cookie-notice'>We use cookies {n}</div><div class='ad slot'>{words(4)}</div>"
        rows.append((n, f"https://h{n % 3}.example.org/{n}", f"<main><article><h1>Title {n}</h1><p>{body[0]}</p>{extra}<p>{body[1]}</p>{kind}</article></main>"))
        want[n] = f"Title {n}\n{body[0]}\n{body[1]}"
    assert _texts(spark, rows) == want


def test_branches_at_any_depth(spark):
    """The same repeated box and the same named part go at depth 3 and at depth 60."""
    def page(n, depth):
        deep = "<div>" * depth
        return f"<article>{deep}<p>Story number {n} of this house</p><div>Send this on</div><div class=comments>said {n}</div>{'</div>' * depth}</article>"

    rows = [(100 * depth + n, f"https://d{depth}.example.org/p", page(n, depth)) for depth in (3, 40, 60) for n in range(12)]
    assert set(_texts(spark, rows).items()) == {(100 * depth + n, f"Story number {n} of this house") for depth in (3, 40, 60) for n in range(12)}


def test_branches_of_a_small_share_of_a_host_go(spark):
    rows = [(n, "https://one.example.org/p", f"<div class=story>Story {n}</div>" + "<div class=section>Of this section</div>" * (n < 9)) for n in range(900)]
    got = _texts(spark, rows)
    assert got[3] == "Story 3" and got[800] == "Story 800"
