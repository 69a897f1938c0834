"""Operators on pages and benchmark items, and the pipeline."""

import hashlib
import random
import re

import pytest

import __spark_entry__ as entry
from quiver.llm import decontam, html_crf, warc
from quiver.llm.dom import blocks
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_SMALL}/pages.parquet")


# ---------------------------------------------------------------- HTML

def test_blocks_of_broken_markup():
    html = ("<!DOCTYPE html><head><title>no</title><style>p{}</style></head><body>a &lt; b<p>one <b>two<br>three<p>four</b> &eacute;&nbsp;x"
            "<script>var t='</p><p>no</p>'</script><ul><li>i<li>j</ul><div class='ad box'>buy <a href='x>y'>now</a></div><!-- c <p>no</p> -->"
            "5 < 6<p>cut <b")
    found = blocks(html)
    assert [b.text for b in found] == ["a < b", "one two three", "four é x", "i", "j", "buy now", "5 < 6", "cut"]
    ad = next(b for b in found if b.text == "buy now")
    assert ad.path[-1] == ("div", ("ad", "box")) and ad.linked == 3
    assert [t for t, _ in found[3].path] == ["body", "ul", "li"]
    assert blocks("") == [] and blocks("<p></p><!-- open") == [] and [b.text for b in blocks("plain")] == ["plain"]


def test_blocks_after_hidden_elements_that_stay_open():
    def texts(html):
        return [b.text for b in blocks(html)]
    for head in ("<head><title>no</title><body>", "<head><meta charset=x><noscript><p>no</noscript>", "<head><title>no</title>"):
        assert texts("<html>" + head + "<article><p>one<p>two</article>") == ["one", "two"]
    assert texts("<head><title>no</title>plain words<p>two") == ["plain words", "two"]
    for odd in ("<select><option>no", "<svg><path d=x>", "<template>", "<svg><g>", "<head><title>no</title>", "<object>", "<math>"):
        assert texts(f"<div><p>one</p>{odd}<p>two</p><p>three</p></div><p>four")[-4:] == ["one", "two", "three", "four"]
        assert texts(f"<p>one</p>{odd}<p>two</p><template>no</template><svg><text>no</text></svg><p>three")[-3:] == ["one", "two", "three"]
    assert texts("<p>one</p><select><option>no<p>two</p><select><option>no</select><p>three")[-1] == "three"
    assert "two" in texts("<p>one</p><select><option>no<p>two</p>")
    assert texts("<template><div>no</div></template><svg><foreignObject><div>no</div></foreignObject></svg><select><option>no</select>yes") == ["yes"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be") == ["let x=2 be"]
    assert texts("<article><object data=x><p>instead</object><noscript><p>shown <b>too</b></noscript></article>") == ["instead", "shown too"]


def test_extraction_of_pages_that_mark_their_article(pages):
    got = {r.page_id: r for r in html_crf.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        want = "\n".join(b.text for b in blocks(r.html) if any(t == "article" for t, _ in b.path))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_extraction_of_unseen_frames(spark, pages):
    """Held-out pages set in frames drawn anew: nearly all blocks get their label."""
    field = html_crf.train(pages)
    draw, right, total = random.Random(99), 0, 0
    for r in pages.collect():
        page = blocks(r.html)
        framed, labels = html_crf.reframed(page, html_crf.own_labels(page), draw)
        found = field.decode(html_crf.chain_features(framed))
        right, total = right + sum(x == y for x, y in zip(found, labels)), total + len(labels)
    assert right / total >= 0.93


LONG = ("The committee met on a rainy morning and spoke for hours about the bridge that the town had wanted for so long.",
        "Nobody could say, when the evening came, whether the river or the money was the greater obstacle to it.",
        "Still, the plans were laid out once more on the table, and the oldest member explained every line of them.")
#: html, main text; frames and names that the lists for learning don't have
HAND_MARKED = [
    (f"<p>{LONG[0]}</p><p>{LONG[1]}</p>", LONG[:2]),
    (f"<html><body><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2]}</p></body></html>", LONG),
    (f"<html><body><article><p>{LONG[0]}</p><p><a href='/x'>{LONG[1]}</a></p><p>{LONG[2]}</p></article></body></html>", LONG),
    (f"<html><body><article><p>{LONG[0]}</p><p>{LONG[1]}</p><figure><img src=a><figcaption>The old bridge in winter</figcaption></figure></article></body></html>",
     (*LONG[:2], "The old bridge in winter")),
    (f"<html><body><article><p>{LONG[0]}</p><div class='advertisements'><p>Buy our lamps now and save</p></div><p>{LONG[1]}</p></article></body></html>", LONG[:2]),
    (f"<html><body><article><p>{LONG[0]}</p><p>{LONG[1]}</p></article><div class='commentaries'><p>I was there myself and it was not like this at all.</p>"
     f"<p>My uncle laid the first stone, he told us often.</p></div></body></html>", LONG[:2]),
    (f"<html><body><div class='longread'><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2]}</p></div><footer><p>© 2020 The Gazette | Imprint</p></footer></body></html>", LONG),
    (f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div><div><p>{LONG[0]}</p><p>{LONG[1]}</p></div></div></body></html>", LONG[:2]),
]


def test_extraction_of_hand_marked_pages(spark, pages):
    """Blocks of pages in frames that no list has: nearly all get their label, and no article is empty."""
    field = html_crf.train(pages)
    right = total = 0
    for html, main in HAND_MARKED:
        page = blocks(html)
        found = field.decode(html_crf.chain_features(page))
        want = [int(b.text in main) for b in page]
        assert any(found)
        right, total = right + sum(x == y for x, y in zip(found, want)), total + len(want)
    assert right / total >= 0.95


def test_tables_without_a_marked_article(spark):
    rows = [(i, "u", f"<html><body><ul class=menu><li><a href=/>Home</a></li></ul><div id=x>" + "".join(f"<p>{t}</p>" for t in LONG) + "</div></body></html>")
            for i in range(6)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"\n".join(LONG)}


def test_field_marginals_and_decoding_by_enumeration():
    from itertools import product
    from math import exp
    scores, pair = [0.3, -1.2, 0.8, 0.1], [0.5, -0.2, -0.7, 0.9, 0.1, -0.3]

    def value(y):
        return pair[4 + y[0]] + sum(s * l for s, l in zip(scores, y)) + sum(pair[2 * a + b] for a, b in zip(y, y[1:]))
    every = list(product((0, 1), repeat=4))
    total = sum(exp(value(y)) for y in every)
    ones, expected = html_crf._marginals(scores, pair)
    for i in range(4):
        assert abs(ones[i] - sum(exp(value(y)) for y in every if y[i]) / total) < 1e-12
    for k, (a, b) in enumerate(product((0, 1), repeat=2)):
        want = sum(exp(value(y)) * sum((p, q) == (a, b) for p, q in zip(y, y[1:])) for y in every) / total
        assert abs(expected[k] - want) < 1e-12
    field = html_crf.Field(None, pair)
    field.scores = lambda chain: scores
    assert tuple(field.decode([()] * 4)) == max(every, key=value)


def test_extraction_awkward_rows(spark):
    page = "<html><body><nav><a>menu</a></nav><article><p>main text here.</p></article></body></html>"
    table = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", page), (4, "u", page), (4, "u", page), (5, "u", "<p>" * 3000 + "x")],
                                  "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    got = html_crf.extract(table).collect()
    assert len(got) == 6 and {(r.text, r.n_chars) for r in got if r.page_id in (1, 2)} == {("", 0)}
    assert html_crf.extract(table.filter("false")).count() == 0


# ---------------------------------------------------------------- WARC

def _expected(rows):
    best = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = best.get(data, page_id)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if to == page_id else "revisit",
                    None if to == page_id else to))
    return sorted(out, key=str)


def test_archive_round_trip_and_files(spark, pages, tmp_path):
    import gzip
    folder = str(tmp_path / "warc")
    got = warc.round_trip(pages, folder).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(map(tuple, got), key=str) == _expected(rows)
    html, seen = {r[0]: r[2].encode() for r in rows}, 0
    for file in sorted((tmp_path / "warc").glob("*.warc.gz")):
        keys = []
        data = gzip.decompress(file.read_bytes())                  # members one after another
        while data:
            head = data.partition(b"\r\n\r\n")[0]
            size = len(head) + 4 + int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            headers, payload = warc.parse(data[:size])
            assert data[size: size + 4] == b"\r\n\r\n"
            if headers["warc-type"] == "response":
                assert payload == html[int(headers["x-page-id"])]
            keys.append(headers["warc-target-uri"])
            data, seen = data[size + 4:], seen + 1
    assert seen == len(rows)


def test_archive_awkward_rows(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a.example.com/x\r\ny", big), (2, "http://a.example.com/x", big), (3, None, big), (4, "http://b.org", "small"),
            (5, "http://b.org", "small"), (6, "http://b.org", None), (7, "http://b.org", ""), (None, "http://c.org", "other")]
    rows += [(8, f"http://b.org/{i}", f"page {i}" * 300) for i in range(1)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS key", "'d' AS digest")
    got = sorted(map(tuple, warc.round_trip(table).collect()), key=str)
    assert got == _expected(rows)
    assert warc.round_trip(table.filter("false")).count() == 0


def test_lookups_across_blocks_of_equal_keys(spark, tmp_path, monkeypatch):
    """More captures of one place than a block holds, and places that are not there."""
    folder = str(tmp_path)
    shard = warc._Shard(folder)
    page = {"page_id": 7, "url": "http://a.b/", "payload": b"p", "digest": hashlib.sha1(b"p").hexdigest(), "response_id": None}
    for key, n in (("a", 3), ("b", 3 * warc.BLOCK_LINES), ("c", 2)):
        for _ in range(n):
            shard.add(key, page)
    made = shard.close()
    reader = warc.Reader(folder, [tuple(made[c] for c in ("index", "first_key", "first_id", "directory_at", "directory_size", "records"))])
    assert [len(list(reader.locate(k, 7))) for k in ("a", "b", "c", "d", "0")] == [3, 3 * warc.BLOCK_LINES, 2, 0, 0]


def test_url_keys(spark):
    urls = ["http://www.Example.com:80/a?b#c", "https://x@m.example.org", None, "no scheme"]
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in table.select(warc.url_key(table.url)).collect()] == [
        "com,example,www)/a?b", "org,example,m)", ")", ")no scheme"]


# ---------------------------------------------------------------- decontamination

ITEM = ("Anna bought 12 apples and 3 pears for her friend Tom. How many fruits did Anna have? "
        "She paid 5 dollars for them all and went home.")


def test_reparameterised_questions_are_found(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    other = (ITEM.replace("Anna", "Bella").replace("12", "45").replace("3 ", "7 ").replace("Tom", "Max").replace("5 dollars", "9 euros"))
    broken = other.replace("How many fruits did Bella", "How many fruits did Carl").replace("9 euros", "8 miles")
    table = H.awkward_docs(spark, "before it. " + other + " after it.", ITEM.upper(), "Anna bought 12 apples", broken, ITEM + " " + ITEM)
    got = {r.doc_id: r for r in decontam.contaminated(table, benchmark).collect()}
    assert {10, 14} <= set(got) and not {0, 1, 2, 5, 6, 12} & set(got)
    assert got[10].item_id == 1 and got[10].share >= 0.8 and got[10].slot_share == 1.0
    kept = decontam.keep_clean(table, benchmark)
    assert kept.columns == table.columns and kept.count() == table.count() - len(got)
    assert decontam.contaminated(H.empty_docs(spark), benchmark).count() == 0
    assert decontam.contaminated(table, benchmark.filter("false")).count() == 0


def test_slots_that_disagree(spark):
    """The same template throughout, but one name of the item stands for several in the document."""
    item = " ".join(f"then Alice gave box {i} to" for i in range(10, 30))
    scattered = " ".join(f"then {n} gave box {i} to" for i, n in zip(range(10, 30), ["Bob", "Cid", "Dan", "Eve"] * 5))
    swapped = item.replace("Alice", "Zoe")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = spark.createDataFrame([(1, scattered), (2, swapped)], "doc_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(table, benchmark).collect()] == [2]


def test_benchmark_passages_in_the_small_table(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    asked = {r.item_id: grams(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, g in asked.items() if len(g & grams(r.text)) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert want <= got and len(got - want) <= 1


def test_both_ways_of_joining_agree(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    broadcast = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == broadcast


def _reported(spark, texts, items):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(table, benchmark).collect()}


def test_items_dense_with_placeholders_and_short_items(spark):
    sums, names = "3 + 4 = 7, 5 + 6 = 11, 8 + 9 = 17", "Who met Anna Berta Carl Dora Emil Frida Gustav Hans in Rome and Oslo and Bonn"
    plain = "the quick brown fox jumps over the lazy dog near the old river bank today"
    items = [sums, names, plain, "never odd or even", "zyzzyva"]
    texts = ["so it is said that " + sums + " and no more", "here: " + names + " said they", "this is " + plain.title() + " again",
             "it was never odd or even he said", "what a zyzzyva is that", "1 2 3 4 5 6 7 8 9 10", "never even or odd",
             "here: " + names.replace("Berta", "Bella").replace("Hans", "Hugo") + " said they"]
    assert _reported(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 1)}


def test_items_of_long_runs_of_numbers(spark):
    """Templates go on over a run of any length; its length and what stands beside it must agree."""
    def sums(numbers, tail="find the next line"):
        return ", ".join(f"{a} + {b} = {c}" for a, b, c in numbers) + ", " + tail
    first = [(n, n + 1, 2 * n + 1) for n in range(3, 33, 2)]
    other = [(n, n + 4, 2 * n + 4) for n in range(100, 145, 3)]
    items = [sums(first), "list " + " ".join(str(n * n) for n in range(900)) + " done"]
    texts = [sums(first), "we met it here " + sums(other), "see " + sums(other[:-2]), sums(other, "buy some new lamps"),
             "my list " + " ".join(str(n * n * n) for n in range(900)) + " done", "list " + " ".join(str(n * n * n) for n in range(899)) + " done"]
    assert _reported(spark, texts, items) == {(0, 0), (1, 0), (4, 1)}


def test_far_templates_are_one_a_stretch(spark):
    """A run of thousands of numbers gives rows in proportion to it, its slots once."""
    text = "start " + " ".join(map(str, range(3000))) + " end of it"
    rows = decontam.windows(spark.createDataFrame([(1, text)], "item_id long, text string"), "item_id").collect()
    assert len(rows) < 12_000 and sum(len(r.slots) for r in rows) < 200_000
    rows = decontam.windows(spark.createDataFrame([(1, text)], "item_id long, text string"), "item_id", every=False).collect()
    assert sum(r.hash != r.window for r in rows) < 100 and max(len(r.slots) for r in rows) == 3000


def test_share_is_of_all_windows(spark):
    """The few windows with enough literal words do not stand for the whole item."""
    item = "12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 are what we call"
    assert _reported(spark, ["those 26 are what we call", "see " + item], [item]) == {(1, 0)}


def test_the_shorter_way_gives_the_same_windows(spark, monkeypatch):
    """Whatever stands between a word and a capital after it, and whether or not a digit stands anywhere."""
    between = [" (", " [", " \u201c", "\u2014", "/", "\t", " \u00ab", "\u00a0", ", '", ". ", "! ", '" ', " .", "\n", " \n", "\u0301 "]
    texts = [f"we all went to the{b}Bar {w} and sat there until late" for b in between for w in ("house", "\u0391\u03a3.\u0392")]
    texts += ["USA won it all and so did I", "\u01c5eljo met \u01c5eljo at the old house", "one (Bar", "\u0130stanbul is where we went then"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = sorted(map(str, decontam.windows(table, "doc_id").collect()))
    monkeypatch.setattr(decontam, "PERHAPS_FILLED", "")
    assert short == sorted(map(str, decontam.windows(table, "doc_id").collect()))


def test_a_digit_elsewhere_does_not_hide_a_copy(spark):
    item = "we all met in the old (Bar) by the sea and went on to the house (Inn) near the wood"
    other = item.replace("Bar", "Pub").replace("Inn", "Spa")
    assert _reported(spark, ["in 1999 " + item, "they say " + other, "in 1999 " + other], [item]) == {(0, 0), (1, 0), (2, 0)}


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_keep_columns_and_shrink(spark):
    import corpus_pipeline
    d = SF_SMALL
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontaminate", "redact_secrets", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_registered_with_the_entry_module():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
