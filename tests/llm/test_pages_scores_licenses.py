from __future__ import annotations

import itertools
import random
from collections import Counter

import public_tokenizers  # noqa: F401  the queries need it
from pyspark.sql import functions as F

from changelore.llm import html_extract, license_scan, quality_classifier, queries

PAGE_SCHEMA = "page_id long, url string, html string, text string"


def longest(a: list[int], b: list[int]) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        found = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found)


def read(html: str | None) -> str:
    return html_extract.main_text(html_extract.lines_of(html), set())


def test_markup_of_all_kinds():
    assert read(None) == read("") == read("<") == ""
    assert read("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p><p><b>open<br><p>four</article>") == (
        "A & B\none two three\nopen\nfour"
    )
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav>menu</nav>
      <div class="cookie-notice">ok?</div><main><p>kept &#233; text</p><form>mail <input></form>
      <aside>side</aside><script>var a = "<p>no</p>";</script><section id="comments"><p>me too</p></section></main>
      <footer>foot</footer></body></html>"""
    assert read(page) == "kept é text"
    assert read("<p>plain</p><div class='ad'>buy</div><!-- <p>c</p> --><p>last <a href='x") == "plain\nlast"
    assert read("<nav><ul><li>x<article><p>the nav was never closed</p></article>") == "the nav was never closed"
    assert read("<table><tr><td>a</td><td>b</td></tr></table>") == "a b"


def test_shared_lines_of_the_nearest_page_go(table_of):
    frame = "<div>Site name</div><p>{}</p><div>Imprint and contact</div>"
    rows = [(i, f"http://h.org/a/{i}", frame.format(f"text {i}"), "x") for i in range(6)]
    rows += [(10, "http://other.org/", frame.format("alone"), None), (11, None, None, None), (12, "", "", None)]
    rows += [(13, "http://h.org/b", "<article><p>same</p></article>", None), (14, "http://h.org/b", "<article><p>same</p></article>", None)]
    rows += [rows[0]]
    got = html_extract.extract(table_of(rows, PAGE_SCHEMA)).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert [texts[i] for i in range(6)] == [f"text {i}" for i in range(6)]
    assert texts[10] == "Site name\nalone\nImprint and contact"
    assert texts[11] == texts[12] == "" and texts[13] == texts[14] == "same"
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_pairs_follow_the_path(table_of):
    rows = [(1, "http://h/a/x1"), (2, "http://h/a/x2"), (3, "http://h/b/y"), (4, "http://g/b/y"), (5, None)]
    got = html_extract.nearest_pairs(table_of(rows, "k long, url string")).collect()
    assert {r["k"]: r["partner"] for r in got} == {1: 2, 2: 1, 3: 2}


def test_alignment_decides_marked_content_and_copies_do_not_erase_each_other(table_of):
    bar = "<p>Share this page with your friends</p>"
    marked = "<nav>{1}</nav><article>" + bar + "<p>{0}</p></article><aside><p>{1}</p></aside>"
    plain = "<p>Site name</p><p>{}</p><p>Imprint</p>"
    body = lambda i: f"the long story number {i} " + f"of word{i} " * 20
    clean = lambda i: body(i).strip()
    # a menu may name another page's text; that text stays
    rows = [(i, f"http://h.org/a/{i}", marked.format(body(i), body(i + 1)), "") for i in range(4)]
    # many copies of one page under neighbouring URLs, with and without marked content
    rows += [(100 + i, f"http://m.org/a/1?page={i}", marked.format(body(7), ""), "") for i in range(60)]
    rows += [(200, "http://m.org/a/2", marked.format(body(8), ""), "")]
    rows += [(300 + i, f"http://p.org/a/{i:03}-print", plain.format(body(5)), "") for i in range(60)]
    rows += [(400, "http://p.org/a/9", plain.format(body(6)), "")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(table_of(rows, PAGE_SCHEMA)).collect()}
    assert {i: got[i] for i in range(4)} == {i: clean(i) for i in range(4)}
    assert {got[100 + i] for i in range(60)} == {clean(7)} and got[200] == clean(8)
    assert {got[300 + i] for i in range(60)} == {clean(5)} and got[400] == clean(6)


def labelled(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["river", "stone", "walk", "green", "the", "of", "and"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "###", "cheap$$$", "win"]) for _ in range(40))
    return [(i, good() if i % 3 else bad(), 1 if i % 3 else 0) for i in range(n)]


def test_classifier_on_held_out_rows(table_of, spark):
    rows = labelled(300, 1)
    docs = table_of([(i, t, "clash") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (0, rows[0][1], "")], "doc_id long, text string, score string")
    labels = table_of([(i, q, 0) for i, _, q in rows] + [(2000, None, 0), (None, 1, 0), (5, rows[5][2], 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    truth = {i: q for i, _, q in rows}
    scored = quality_classifier.score(docs, model).withColumn("fold", quality_classifier.fold(F.col("doc_id"))).collect()
    held = [r for r in scored if r["fold"] == 0 and r["doc_id"] in truth]
    assert len(scored) == 303 and len(held) > 30
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert [r["score"] for r in scored if r["doc_id"] in (900, 901)] == [0.0, 0.0]
    nothing = quality_classifier.fit(docs, labels.where("doc_id > 5000"))
    assert nothing is None and quality_classifier.score(docs, nothing).count() == 303


def test_scorer_equals_the_features():
    texts = [t for _, t, _ in labelled(40, 2)]
    model = quality_classifier.train([quality_classifier.features(t) for t in texts], [0, 1] * 20)
    logits = model.scores()
    margin = (logits[:, 1] - logits[:, 0]).astype(float)
    scorer = quality_classifier.Scorer(margin, 0.1)
    for t in [*texts, "one", "a a a", "x" * 300, "y" * 20_000 + " one", "é ﬁ 😀 \ud800 你好", " ".join(f"w{i}" for i in range(120_000))]:
        at, w = quality_classifier.features(t)
        z = float(w @ margin[at]) + 0.1
        assert abs(scorer(t) - 1 / (1 + 2.718281828459045**-z)) < 1e-5


def test_long_words_count_whole():
    start, rng = "".join(chr(0x4E00 + i) for i in range(80)), random.Random(5)
    good, bad = (["".join(rng.choice(c) for _ in range(300)) for _ in range(60)] for c in ("山水風月花鳥", "買賣錢金銀貨"))
    texts, labels = [start + t for t in good + bad], [1] * 60 + [0] * 60
    model = quality_classifier.train([quality_classifier.features(t) for t in texts[10:110]], labels[10:110])
    logits = model.scores()
    margin = (logits[:, 1] - logits[:, 0]).astype(float)
    scorer = quality_classifier.Scorer(margin, float(model.bias[1] - model.bias[0]))
    # the openings are equal and no whole word was seen before
    assert min(map(scorer, texts[:10])) > max(map(scorer, texts[110:])) + 0.5


def counted_grams(words: list[str]) -> Counter:
    return Counter(pair for owner, bucket in quality_classifier.grams(words) for pair in zip(owner.tolist(), bucket.tolist(), strict=True))


def test_grams_of_pieces_are_those_of_the_whole_word(monkeypatch):
    words = ["ab漢c" * 5000, "a", "", "four", "x" * 4094, "y" * 4095, "z" * 8192]
    cut = counted_grams(words)
    monkeypatch.setattr(quality_classifier, "PIECE", 1 << 30)
    assert cut == counted_grams(words)
    monkeypatch.setattr(quality_classifier, "RUN_CHARS", 5)
    assert cut == counted_grams(words)
    per_word = [sum(n for (k, _), n in cut.items() if k == i) + 2 for i in range(len(words))]
    assert per_word == quality_classifier.units(words).tolist()
