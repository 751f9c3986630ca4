"""Language identification, quality, decontamination, main text."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.llm import decontaminate, html, langid, quality
from tests.llm.conftest import rows_of


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.98


def test_profiles_by_loop():
    """The bundle of a text is the sum of its bound n-grams, and the cosine is taken from it."""
    text = "Añb, cañ"
    codes = [0, *map(ord, "añb"), 0, *map(ord, "cañ"), 0]
    vectors = [np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c) for a, b, c in zip(codes, codes[1:], codes[2:])]
    bundle = np.sum(vectors, axis=0, dtype=np.float64)
    prototypes = np.random.default_rng(0).normal(size=(3, langid.DIMENSIONS))
    prototypes /= np.linalg.norm(prototypes, axis=1)[:, None]
    cosines = prototypes @ bundle / np.linalg.norm(bundle)
    names, score = langid.predict_texts([text, "12 !"], ["x", "y", "z"], prototypes)
    assert names == ["xyz"[int(cosines.argmax())], "und"]
    assert np.allclose(score, [max(cosines.max(), 0), 0], atol=1e-5)


def test_language_of_odd_rows(odd):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and odd.limit(0).transform(langid.identify).count() == 0
    assert {r.lang_pred for r in got} == {"und", "en"}
    kept = langid.keep_known(odd, langid.learn(odd))
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got)
    test = [r for r in got if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in test]) > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (4, 0, 0), (9, None, 0), (None, 1, 1), (10, 5, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = quality.score_quality(odd, marks).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_hinge_fit_is_optimal():
    """Small change of any weight does not lower the objective."""
    rng = np.random.default_rng(5)
    x, sign = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x += sign[:, None]
    rows, cost = [(np.arange(5), v) for v in x], np.full(60, 0.3)
    weight = quality.hinge_fit(rows, sign, 5, cost, rounds=3000, tol=1e-10)

    def loss(w):
        return w @ w / 2 + 0.3 * np.maximum(1 - sign * (x @ w), 0).sum()

    assert all(loss(weight) <= loss(weight + rng.normal(size=5) * 1e-3) + 1e-9 for _ in range(200))


def distance(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    table[:, 0], table[0] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y))
    return int(table[-1, -1])


def test_edit_match_by_loop():
    rng = random.Random(6)
    for _ in range(150):
        item = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 6))])
        text = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 9))], dtype=np.int64)
        got, lo, hi = decontaminate.edit_match(item, text)
        assert got == distance(item, text[lo:hi]) == min(distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_hits_against_brute_force(spark, block_bytes):
    """Items with edits up to the budget, in noise made of the items' own words."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 30)))) for k in range(8)] + [(90, None), (91, "  "), (92, "w1 w2 w3")]
    docs = [(None, None), (100, ""), *((101 + d, " ".join(rng.choice(vocabulary) for _ in range(40))) for d in range(10))]
    for d in range(60):
        words = items[d % 8][1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        noise = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 15))] for _ in range(2)]
        docs.append((d, ", ".join([*noise[0], *words, *noise[1]]).upper()))
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_hits(frame, bench, block_bytes=block_bytes).collect()}
    want = {}
    for d, text in docs:
        words = decontaminate.words_of(text or "")
        for k, item in items:
            wanted = decontaminate.words_of(item or "")
            if wanted and words:
                place = {w: i for i, w in enumerate(dict.fromkeys(wanted + words))}
                near = decontaminate.edit_match(np.array([place[w] for w in wanted]), np.array([place[w] for w in words]))[0]
                if near <= decontaminate.budget(len(wanted), 0.8):
                    want[d, k] = near
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 30
    assert all(got[x] >= want[x] for x in got)
    assert {x for x, d in want.items() if d == 0} <= set(got)
    clean = decontaminate.drop_contaminated(frame, bench, block_bytes=block_bytes)
    assert rows_of(clean.select("doc_id")) == sorted([(d,) for d, _ in docs if d not in {x for x, _ in got}], key=repr)
    assert decontaminate.benchmark_hits(frame, bench.limit(0)).count() == 0 == decontaminate.benchmark_hits(frame.limit(0), bench).count()


@pytest.mark.parametrize("length", [20, 60, 100, 200])
@pytest.mark.parametrize("kind", ["substitute", "delete", "insert"])
def test_recall_at_the_full_budget(length, kind):
    """Long items with as many edits as the budget allows, of one kind, are found."""
    rng = random.Random(length)
    items = [(k, " ".join(f"i{k}w{rng.randrange(10**6)}" for _ in range(length))) for k in range(50)]
    bench = decontaminate.Benchmark(items, 0.8, 0.99)
    search = decontaminate._Search(bench)
    e = decontaminate.budget(length, 0.8)
    for k, text in items:
        words = text.split()
        if kind == "insert":
            for _ in range(e):
                words.insert(rng.randrange(1, len(words)), "new")
        else:
            for at in sorted(rng.sample(range(length), e), reverse=True):
                words[at:at + 1] = ["new"] if kind == "substitute" else []
        search.add(k, k, " ".join(["before"] * 50 + words + ["after"] * 50))
    hits = search.hits()
    assert all(h[0] == h[2] and h[3] <= e for h in hits) and len(hits) >= 49


def test_words_beyond_ascii():
    """Signs of any script separate words, and each character of a script without spaces is one."""
    def split(text):
        return [w.decode() for w in decontaminate.words_of(text)]

    assert split("“Don’t” – he\u00a0said…　ＡＢ，ok！") == split("“Don't” - he said... ＡＢ, OK!") == ["don", "t", "he", "said", "ａｂ", "ok"]
    assert split("我有3本书，Über 42") == ["我", "有", "3", "本", "书", "über", "42"]
    assert split("ภาษาไทยที่") == list("ภาษาไทยที่")
    assert split("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and split("co\u00adop") == ["coop"] and split("a\u200bé") == ["a", "é"]


def test_items_in_scripts_without_spaces(spark):
    """Verbatim and edited passages inside a running text of the same script, against brute force."""
    rng = random.Random(9)
    scripts = {"zh": [chr(c) for c in range(0x4E00, 0x4E60)], "ja": [chr(c) for c in range(0x3042, 0x3090)], "th": [chr(c) for c in range(0x0E01, 0x0E2F)]}
    items, docs = [], []
    for letters in scripts.values():
        for _ in range(3):
            k, text = len(items), [rng.choice(letters) for _ in range(rng.randint(15, 60))]
            items.append((k, "".join(text)))
            for edits in (0, len(text) // 10, len(text) // 5, len(text) // 3):
                words = text[:]
                for at in rng.sample(range(len(words)), edits):
                    words[at] = rng.choice(letters)
                noise = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(2)]
                docs.append((len(docs), noise[0] + "".join(words) + noise[1]))
    items.append((len(items), "“It’s a test”—he said, plainly"))
    docs.append((len(docs), "So: it's a test - he said, plainly."))
    want = set()
    for d, text in docs:
        for k, item in items:
            a, b = decontaminate.words_of(item), decontaminate.words_of(text)
            place = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
            if decontaminate.edit_match(np.array([place[w] for w in a]), np.array([place[w] for w in b]))[0] <= decontaminate.budget(len(a), 0.8):
                want.add((d, k))
    hits = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in hits.collect()}
    assert {(4 * k + v, k) for k in range(9) for v in range(3)} | {(36, 9)} <= want == got


PAGES = [
    ("<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='content'>"
     "<h1>Title &amp;amp; more</h1><p>Some long text of the article,\n with <a href=y>a link</a> in&nbsp;it.<p>Second &lt;b&gt; here<br>goes on.</p>"
     "<ul><li>one<li>two</ul></div><div id=comments><p>A long reader comment that goes on and on and on and on and on.</p></div>"
     "<form><p>Mail</p></form><script>if(a<b){'<p>no</p>'}</script><footer>2020</footer></body></html>",
     "Title &amp; more\nSome long text of the article, with a link in it.\nSecond <b> here goes on.\none\ntwo"),
    ("<p>Read <a href='/hidden/gems'>this link</a> and <a href='/p?id=menu'>that</a> <b data-id=\"ad-12\">now</b>.</p><p title='The hidden truth'>A whole paragraph.</p>",
     "Read this link and that now.\nA whole paragraph."),
    ("<article><p>Lead words.</p><h2 id='related-work'>Related work</h2><section id='search-methods'><p>How.</p></section><section id='discussion'><p>We discuss.</p></section>"
     "<section id='comments'><p>first!</p></section><div hidden>gone</div><div title='a' class=ad>buy</div></article>",
     "Lead words.\nRelated work\nHow.\nWe discuss."),
    ("<article><section><p>First part with many words in it.</section><section><p>Second.</p></section><aside>no</aside><div class='ad top'>buy</div>"
     "<article class=comment><p>I am a comment</p></article></article>", "First part with many words in it.\nSecond."),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<p title=\"a>b\">q</p><!-- <p>no</p> --> < 5", "q\n< 5"), ("<div " * 5000, ""),
    ("<div class=site-header><h1>Site</h1></div><div class=content><h1>Title</h1><p>Words of the text, and more of them.</p></div>"
     "<section class=comments><article>Someone's words on it all.</article></section>", "Title\nWords of the text, and more of them."),
    ("<main><div class='article-header'><h1>Head</h1></div><p>Words of the text.</p></main><div class=promo><p>Buy.</p></div>", "Head\nWords of the text."),
    ("<div>" * 3000 + "deep", "deep"), ("<table><tr><td>x<td>y<tr><td>z</table>", "x\ny\nz"),
]


def test_main_text(spark):
    frame = spark.createDataFrame([(i if i % 3 else None, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r.url: r for r in html.extract_main_text(frame).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[f"u{i}"].text == want and got[f"u{i}"].n_chars == len(want)
    assert html.extract_main_text(frame.limit(0)).count() == 0


def test_raw_elements_end_where_the_page_has_their_end_tag():
    """A letter that grows in lower case moves nothing."""
    text = "İstanbul, İzmir ve İznik üzerine uzun bir yazı. " * 5
    page = f"<body><article><p>{text}</p><SCRIPT>if(a<b){{}}</Script><p>Son söz burada.</p><style>p{{}}</STYLE><p>Bitti.</p></article></body>"
    assert html.main_text(page) == text.strip() + "\nSon söz burada.\nBitti."


def test_main_text_of_the_page_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    wanted = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    rows = html.extract_main_text(pages).join(pages.select("page_id", wanted.alias("article")), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.text == html.main_text(f"<body>{r.article}</body>") and r.n_chars > 0
