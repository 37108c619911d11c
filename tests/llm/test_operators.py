"""The operators against brute force over the small tables, and on rows made of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from signpost.llm import (
    chat_collapse,
    crf_langid,
    decontaminate,
    html_extract,
    jaccard_join,
    line_dedup,
    line_rules,
    mixing,
    pii,
    pu_quality,
    queries,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def small(spark, texts, **more):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), 0, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, ROWS)


EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (None, None), (None, "two words"), (5, "word " * 30_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return small(spark, EDGES, source={2: None}, lang={4: None}).cache()


@pytest.fixture(scope="module")
def docs_001(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()


def run(spark, name):
    return queries.QUERIES[name][0](spark, "/root/testdata/sf0.01").toPandas()


# ---- mixing ----


def test_mix_reaches_targets_and_orders(spark):
    got = run(spark, "op1_source_mix")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (both.taken <= 2 * both["size"]).all()
    sums = both.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((sums.taken - sums.target).abs() <= sums.largest).all()
    assert abs(sums.target.sum() - 1.5 * both["size"].sum()) < 1


def test_mix_deals_rows_out_once(spark):
    rows = [(i, "a b c", None if i % 3 == 0 else f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.plan_mix(docs)
        text = plan._jdf.queryExecution().executedPlan().toString()
        got = {r.key: r.copies for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # by slot, once for the rows and once for the buckets; not by bucket for the window and again for the join
    assert len(re.findall(r"Exchange hashpartitioning\(slot", text)) == 2
    # 1.5 times 90 words: s1 gets 60, its limit, s2 and the null source share 75 as 1 to 2; copies of 3 words
    taken = Counter()
    for i, copies in got.items():
        taken[i % 3] += copies
    assert len(got) == 30 and taken[1] == 20 and abs(taken[2] - 25 / 3) < 1 and abs(taken[0] - 50 / 3) < 1


def test_mix_edges(spark, edges):
    rows = mixing.plan_mix(edges).select("key", "source", "size", "copies", "target", "source_size").collect()
    assert len(rows) == len(EDGES)
    assert all(r.copies == 0 for r in rows if r["size"] == 0)
    assert all(r.target <= 2 * r.source_size for r in rows)
    out = mixing.mix_documents(edges)
    assert out.columns == ["mix_position", "mix_copy", *edges.columns]
    spots = [r.mix_position for r in out.collect()]
    assert spots == sorted(spots)
    assert mixing.mix_documents(edges.limit(0)).count() == 0


def test_ramp_inverts_its_integral(spark):
    """Copies up to time t hold the integral's share of the target."""
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "if(id % 2 = 0, 'p', 'q') as source")
    out = mixing.mix_documents(docs).toPandas()
    p = out[out.source == "p"]
    # falls from 1.5 to 0.5 of its mean: by t = 0.5 it has given 5/8
    assert abs((p.mix_position < 0.5).mean() - 0.625) < 0.01


# ---- main text ----


def test_pages_give_their_articles(spark):
    got = run(spark, "op2_main_text")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    import html

    expected = {}
    for i, page in zip(pages.page_id, pages.html, strict=True):
        inner = page.split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|br)>", inner)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        expected[i] = " ".join(t for t in texts if t)
    assert dict(zip(got.page_id, got.text, strict=True)) == expected
    assert (got.n_chars == got.text.map(len)).all()


PAGE = """<html><head><title>T</title><script>if (a<b) x("<p>no</p>")</script></head><body><header><p>Site name and slogan here</p></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><aside><p>Aside text that is long enough to surge on its own merits.</p></aside>
{open}<h1>A &amp; B</h1><p>First   paragraph of the <b>art</b>icle, which is long enough.<div class="ad-box">Buy now</div>
<p>Er.</p><form><p>Your mail</p><button>Send</button></form><p>Last one&nbsp;ends.{close}<div id="comments"><p>I do not agree with any of this, says a reader.</p></div>
<footer>&copy; all</footer></body>"""


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<main>", "</main>"), ("", "")])
def test_page_parts_are_left_out(marks):
    text = html_extract.main_text(PAGE.format(open=marks[0], close=marks[1]))
    assert text == "A & B First paragraph of the article, which is long enough. Er. Last one ends."


@pytest.mark.parametrize("page", [None, "", "<p>", "<!-- open", "<script>var a = 1", "<nav><p>menu</p></nav>"])
def test_pages_without_text(page):
    assert html_extract.main_text(page) == ""


def test_cut_page_keeps_what_is_there():
    assert html_extract.main_text("<article><p>One &amp; two &am") == "One & two &am"
    assert html_extract.main_text("<article><p>One</p><p cla") == "One"


def test_lines_decide_with_and_without_article_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    for page in pages.html:
        assert html_extract.main_text(re.sub(r"</?article>", "", page)) == html_extract.main_text(page)


BODY = "<div><div>The body of this page lies in plain blocks.</div><div>It is longer than the teaser is.</div></div>"


def test_article_tag_is_only_a_weight():
    teaser = "<article class=card><h3>Teaser</h3></article><ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul>"
    body = "The body of this page lies in plain blocks. It is longer than the teaser is."
    assert html_extract.main_text(teaser + BODY) == body
    # surge and window act inside an article as well
    two = "<article><p>Short.</p></article><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><article><p>A longer text.</p></article>"
    assert html_extract.main_text(two, window=1) == "A longer text."
    assert html_extract.main_text(two, window=3) == "Short. A longer text."


LONG = ["The first paragraph is long enough to surge.", "The second paragraph is long enough, too.", "So is the third one, on its own merits."]
PARAS = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize(
    "page",
    [
        f"<p><a name=top>{PARAS}",
        f"<a href=/x>{PARAS}<p><a href=/y></a></p>",
        f"<p>{LONG[0]}</p><p><a href=/x>{LONG[1]}</a></p><p>{LONG[2]}</p>",
    ],
)
def test_anchors_take_no_text_away(page):
    assert html_extract.main_text(page) == " ".join(LONG)


def test_links_over_blocks_stay_links():
    cards = "".join(f"<a href=/{i}><div>The title of card number {i}</div><div>and its long teaser text</div></a>" for i in range(3))
    assert html_extract.main_text(cards + "<ul><li></ul>" + PARAS) == " ".join(LONG)


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-sidebar", "search-results", "entry", "sidebar"])
@pytest.mark.parametrize("inner", ["<article><h1>Head</h1>{}</article>", "<h1>Head</h1>{}"])
def test_wrappers_are_not_set_apart(name, inner):
    page = f'<body><div class="{name}">{inner.format(PARAS)}</div><div class="footer">A footer text that is long enough to surge.</div>'
    assert html_extract.main_text(page) == "Head " + " ".join(LONG)


def test_entry_header_holds_the_headline():
    assert html_extract.main_text(f'<div class="entry-header"><h1>Head</h1></div>{PARAS}') == "Head " + " ".join(LONG)
    for name in ("ad", "ad-box", "site-footer", "sidebar left", "comment-list", "main-nav", "cookie_banner", "related-posts"):
        assert html_extract.main_text(f'{PARAS}<div class="{name}">{LONG[0]}</div>') == " ".join(LONG)


def test_self_closed_svg_ends_at_once():
    assert html_extract.main_text(f'<svg width="1" title="a>b"/>{PARAS}') == " ".join(LONG)
    assert html_extract.main_text(f"<svg><path d='M0'/><text>no</text></svg>{PARAS}") == " ".join(LONG)


# ---- line dedup ----


def test_line_dedup_edges_and_bitmaps(spark, edges):
    docs = small(spark, [(1, "A shared line here\nown"), (2, "own\n  a SHARED line here \nrest"), (3, None), (2, "a shared line here"), (None, "a shared line here")])
    bitmaps = line_dedup.keep_bitmaps(docs)
    left = sorted((r.doc_id or 99, r.text) for r in line_dedup.apply_bitmaps(docs, bitmaps).collect())
    assert left == [(1, "A shared line here\nown"), (2, ""), (2, "own\nrest"), (3, ""), (99, "")]
    assert line_dedup.apply_bitmaps(docs, bitmaps).columns == docs.columns
    assert line_dedup.apply_bitmaps(edges, line_dedup.keep_bitmaps(edges)).count() == len(EDGES)
    none = edges.limit(0)
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0


def test_one_line_over_many_partitions(spark):
    """A line of every document is spread over the partitions and settled at their edges."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the very same line\n', id, ' own line of it') as text")
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), digest=True).toPandas()
    assert got[got.n_dropped == 0].doc_id.tolist() == [0]
    assert (got.n_lines == 2).all()


def test_stream_carries_over_batches():
    rows = [(1, 1, 5), (1, 1, 5), (1, 1, 7), (2, 2, 1), (2, 2, 9), (2, 2, 9)]
    frame = pd.DataFrame([(a, b, d, 0, 9, i) for i, (a, b, d) in enumerate(rows)], columns=["h1", "h2", "doc", "version", "n_lines", "place"])
    for cut in range(1, 7):
        out = pd.concat(line_dedup._stream(iter([frame[:cut], frame[cut:]])))
        marked = out[~out.edge]
        assert sorted(marked[~marked.pending].place) == [4, 5]
        assert sorted(marked[marked.pending].place) == [0, 1, 2]
        assert sorted(zip(out[out.edge].h1, out[out.edge].first_doc, strict=True)) == [(1, 5), (2, 1)]


# ---- decontamination ----


def test_decontamination_edges(spark, edges):
    bench = spark.createDataFrame(
        [(1, "a b c d e f g h i j k l m n o p q r s t"), (2, None), (3, ""), (4, "two words"), (5, "x y x y x y x y x y x y")], "item_id long, text string"
    )
    near = "a b c d e f g h i j k l m n o p q r s t".split()
    near[19] = "Z"
    docs = small(
        spark,
        [(1, "start A b c d e f g h i j k l m n o p q r s t end"), (2, " ".join(near)), (3, "a b c d e f g h"), (None, "x y x y x y x y x y x y"), (5, None), (6, "Two words")],
    )
    got = sorted((r.doc_id or 99, r.item_id, round(r.similarity, 3), r.word_start) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1, 1.0, 1), (2, 1, round(15 / 17, 3), 0), (6, 4, 1.0, 0), (99, 5, 1.0, 0)]
    kept = sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect())
    assert kept == [3, 5]
    assert decontaminate.contaminated(edges, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(edges.limit(0), bench).count() == 0


def test_decontamination_of_periodic_texts(spark):
    """Nineteen shingles of two kinds, ten and nine: the fingerprints follow the more frequent one."""
    pairs = [("tick", "tock"), ("left", "right"), ("x", "y"), ("on", "off")]
    bench = spark.createDataFrame([(i, " ".join([a, b] * 11 + [a])) for i, (a, b) in enumerate(pairs)], "item_id long, text string")
    docs = small(spark, [(i, " ".join([b, a] * 11 + [b])) for i, (a, b) in enumerate(pairs)])
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 3), r.word_start, r.n_words) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(i, i, 0.9, 0, 23) for i in range(len(pairs))]


# ---- Jaccard join ----


def brute_components(texts, k, num, den):
    sets = []
    for _, t in texts:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(texts)}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_against_brute_force(spark, docs_001, k, num, den):
    texts = list(zip(docs_001.doc_id, docs_001.text, strict=True))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {tuple(r) for r in jaccard_join.jaccard_components(docs, num, den, k).collect()}
    assert got == brute_components(texts, k, num, den)


def test_jaccard_group_of_near_copies(spark):
    """Copies with zero to six changed words: links at 0.9 by chains, most pairs below it."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        texts.append((i, " ".join(w)))
    docs = small(spark, texts)
    got = {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(texts, 3, 9, 10)


def test_jaccard_copies_too_far_apart(spark, monkeypatch):
    """Copies of an origin that is not there, none similar enough to another: no pair of them is a candidate."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(300), 9):
            w[at] = f"z{i}_{at}"
        texts.append((i, " ".join(w)))
    pairs = {}

    def counted(df, name, **options):
        pairs[name] = table = written(df, name, **options)
        return table

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", counted)
    got = {tuple(r) for r in jaccard_join.jaccard_components(small(spark, texts)).collect()}
    assert got == {(i, 298, i) for i, _ in texts}
    assert pairs["differences"].count() == len(texts)
    assert pairs["candidates"].count() == 0


def test_jaccard_group_with_strangers(spark, monkeypatch):
    """Signatures that a large group and a few strangers share are settled without one-deletion neighbours."""
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(70):
        w = list(base)
        for at in rng.sample(range(300), 2):
            w[at] = f"z{i}_{at}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join([*base[:160], *(f"s{i}_{at}" for at in range(140))])) for i in range(12)]
    tables = {}

    def kept(df, name, **options):
        tables[name] = table = written(df, name, **options)
        return table

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    got = {tuple(r) for r in jaccard_join.jaccard_components(small(spark, texts), 4, 5, 5).collect()}
    assert got == brute_components(texts, 5, 4, 5)
    opened = tables["open-rows"].groupBy("sig").count().where("count > 32")
    assert opened.count() > 0 and tables["class-segments"].count() == 0


@pytest.mark.parametrize("crowd", [0, 2, 6])
def test_jaccard_short_classes(spark, monkeypatch, crowd):
    """Without groups, pairs are found through signatures that are not crowded, or on both sides by allotment."""
    import random

    rng = random.Random(crowd)
    passage = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(40):
        own = [f"o{i}_{at}" for at in range(rng.choice([6, 25, 60]))]
        for copy in range(3):
            w = passage[: rng.choice([40, 70])] + own
            for at in rng.sample(range(len(w)), copy):
                w[at] = f"x{i}_{copy}_{at}"
            texts.append((3 * i + copy, " ".join(w)))
    tables = {}

    def kept(df, name, **options):
        tables[name] = table = written(df, name, **options)
        return table

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "_stars", lambda shared: shared.selectExpr("fp as a", "fp as b").where("false"))
    got = {tuple(r) for r in jaccard_join.jaccard_components(small(spark, texts), 4, 5, 3).collect()}
    assert got == brute_components(texts, 3, 4, 5)
    short = tables["class-segments"].select("fp").distinct().count()
    assert 0 < short < len(texts) if crowd else short > 0


def test_jaccard_edges(spark, edges):
    got = sorted((r.doc_id or 99, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(edges).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5), (99, 0, None), (99, 1, None)]
    assert jaccard_join.one_per_component(edges).count() == len(EDGES) - 1
    assert jaccard_join.jaccard_components(edges.limit(0)).count() == 0


def test_bands_never_miss_a_partner():
    bands = jaccard_join.Bands()
    for s in range(1, 400):
        for size in range(1, s + 1):
            if size * 10 >= s * 9:
                assert bands.of(size) in bands.schemes(s)
                assert (s + size) // 19 < bands.needed[bands.of(size)] <= bands.segments[bands.of(size)]


# ---- personal data ----


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_base(text):
    out = {}
    for kind, p in BASE.items():
        spans = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        out[kind] = spans
    return out


def test_base_spans_against_brute_force(spark, docs_001):
    got = run(spark, "op6_personal_data").set_index("doc_id")
    n = 0
    for d, t in zip(docs_001.doc_id, docs_001.text, strict=True):
        want, row = brute_base(t), got.loc[d]
        assert [row[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE]
        joined = ",".join(x for k in BASE for x in want[k])
        n += len(joined) > 0
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert row.spans == joined or row.spans.startswith(joined + ",term:") or row.spans == joined
        assert joined or not row.spans
    assert n > 20


TRICKY = "😀 a@b.c+d@e.f.g. x@@y.z 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 4111111111111112 +1 (555) 010-9999 +12 +" + "1" * 30


def test_personal_data_edges(spark, edges):
    docs = small(spark, [(1, TRICKY), (2, "1" * 5000), (3, "+" * 200 + "1"), (4, None)])
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for d, t in [(1, TRICKY), (2, "1" * 5000), (3, "+" * 200 + "1"), (4, None)]:
        want = brute_base(t)
        assert {k: [f"{k}:{h.start}:{h.end}" for h in rows[d][k]] for k in BASE} == want
    assert pii.find_personal_data(edges).count() == len(EDGES)
    assert pii.find_personal_data(edges.limit(0)).count() == 0


def test_terms_that_reveal_an_entity(spark):
    """zorblax stands in all texts of one address and in no other; grumble in most; the rest is everywhere."""
    texts = [(i, f"note {i} Zorblax, the and of writes from z@x.org today" + (" grumble" if i else "")) for i in range(30)]
    texts += [(100 + i, f"note {i} the and of writes from today" + (" grumble" if i < 3 else "")) for i in range(60)]
    docs = small(spark, texts)
    found = pii.find_personal_data(docs).cache()
    text = dict(texts)
    for r in found.collect():
        words = [text[r.doc_id][h.start : h.end] for h in r.terms]
        assert words == ([] if r.doc_id >= 100 else ["Zorblax,", "grumble"] if r.doc_id else ["Zorblax,"])
    out = {r.doc_id: r.sanitised for r in pii.sanitise(docs, found).collect()}
    assert out[1] == "note 1  the and of writes from [EMAIL] today [TERM]"
    assert out[101] == text[101]


def test_terms_that_reveal_an_entity_of_one_text(spark):
    """Rare words of an address's only texts are generalised; of words found elsewhere and texts without address, none."""
    texts = [(i, f"the and of plain note w{i % 40}") for i in range(40)] + [(100 + i, f"the and of note from day n{i}") for i in range(2000)]
    texts += [(5000, "Quixandor, the plain note of a@x.org and b@x.org"), (5001, "the note of vorpalin plain c@x.org"), (5002, "and vorpalin of c@x.org w7")]
    docs = small(spark, texts)
    found = pii.find_personal_data(docs).cache()
    text = dict(texts)
    words = {r.doc_id: [text[r.doc_id][h.start : h.end] for h in r.terms] for r in found.collect()}
    assert {d: w for d, w in words.items() if w} == {5000: ["Quixandor,"], 5001: ["vorpalin"], 5002: ["vorpalin"]}
    out = {r.doc_id: r.sanitised for r in pii.sanitise(docs, found).collect()}
    assert out[5000] == "[TERM] the plain note of [EMAIL] and [EMAIL]"


def test_terms_appear_on_the_whole_table(spark):
    got = queries.QUERIES["op6_personal_data"][0](spark, "/root/testdata/sf0.1")
    assert got.where(F.col("spans").contains("term:")).count() > 20


# ---- classifiers ----


def test_quality_on_held_out_labels(spark):
    got = run(spark, "op7_quality_score")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_edges(spark, edges):
    labels = spark.createDataFrame([(4, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = pu_quality.train(edges, labels, F.lit(True))
    assert pu_quality.score_documents(edges, model).where("score between 0 and 1").count() == len(EDGES)
    assert pu_quality.train(edges, labels.limit(0), F.lit(True)) is None
    assert pu_quality.score_documents(edges, None).select("score").distinct().count() == 1


@pytest.fixture
def fitted(monkeypatch):
    """Shapes of the positive and unlabelled rows that reach the fit."""
    shapes = []
    fit = pu_quality.fit_nnpu
    monkeypatch.setattr(pu_quality, "fit_nnpu", lambda p, u, prior: shapes.append((len(p), len(u))) or fit(p, u, prior, steps=5))
    return shapes


def test_quality_draws_ids_not_rows(spark, fitted):
    """One id with most of the rows, copies and different texts, labelled and drawn, counts as at most four texts."""
    ids = sorted((r.h, r.id) for r in spark.range(200).selectExpr("id", "xxhash64(id) as h").collect())
    hot = ids[0][1]
    texts = [(i, f"text of number {i}") for i in range(200)] + [(hot, "a copy")] * 500 + [(hot, f"version {i}") for i in range(500)]
    labels = spark.createDataFrame([(hot, 1), (ids[1][1], 0)], "doc_id long, quality int")
    pu_quality.train(small(spark, texts), labels, F.lit(True), max_unlabelled=50)
    assert fitted == [(4, 49 + 4)]


def test_language_on_held_out_documents(spark):
    got = run(spark, "op9_language")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    out = both[both.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_switches_inside_a_line():
    field = crf_langid.fit_field([("the thing that they think", "en")] * 20 + [("der schöne zug über berge", "de")] * 20)
    words = field.label_words(["the thing that they der schöne zug über"])[0].argmax(1)
    assert [field.langs[i] for i in words] == ["en"] * 4 + ["de"] * 4


def test_language_edges(spark, edges):
    field = crf_langid.train(edges, F.lit(True))
    got = sorted(((r.doc_id or 99), r.lang_pred) for r in crf_langid.label_documents(edges, field).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en"), (99, "en"), (99, "und")]
    assert crf_langid.label_documents(edges, None).select("lang_pred").distinct().count() == 1
    assert crf_langid.train(edges.limit(0), F.lit(True)) is None
    assert crf_langid.label_documents(small(edges.sparkSession, [(1, "123 ---")]), field).first().lang_pred == "und"


# ---- quality rules ----


def brute_rules(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_rules_against_brute_force(spark, docs_001):
    got = run(spark, "op8_line_rules").set_index("doc_id")
    for d, t in zip(docs_001.doc_id, docs_001.text, strict=True):
        r = got.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t)
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_and_drop_junk(spark):
    got = run(spark, "op8_line_rules")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert both[(both.quality == 1) & ~both.base_failed].kept.all()
    assert not both[both.quality == 0].kept.any()


def test_rules_edges(spark, edges):
    rows = line_rules.judge_documents(edges, with_text=True).collect()
    assert len(rows) == len(EDGES) and not any(r.kept for r in rows)
    good = "\n".join(f"Line {i} is plain text number {i * 7} here." for i in range(20))
    judged = line_rules.judge(good + "\nHome | News | Sport | About\nAll rights reserved.")
    assert judged[7] and judged[8] == good


def test_boilerplate_lines_of_any_length():
    good = "\n".join(f"Line {i} is plain text number {i * 7} here." for i in range(20))
    notice = "This site uses cookies to remember what you like and to count how many people read each of its many pages every day. " * 5
    cjk = "这个网站使用 cookies 来记住您的喜好并统计阅读人数。" * 12
    for line in (notice, cjk, "Some words first. " + notice):
        assert len(line.encode()) >= 400 and line_rules.judge(good + "\n" + line)[8] == good
    story = "A long text on one line goes on and on, with nothing but plain prose in each of its sentences. " * 9 + "Read more."
    assert line_rules.judge(good + "\n" + story)[8] == good + "\n" + story


# ---- chat ----


def test_chat_collapse_edges(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", None),
        (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", None),
        (4, 0, None, ""), (None, None, "user", "z"), (None, 5, "user", "z"),
        (5, 0, "user", "a"), (5, 7, "assistant", "B"),
    ]
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    turns = spark.createDataFrame(rows, schema).withColumn("place", F.lit(1)).withColumn("part", F.lit("x"))
    got = sorted((r.conv_id or 99, r.part, r.n_turns, r.rendered) for r in chat_collapse.collapse_conversations(turns, block=4).collect())
    a, b = "<|user|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n"
    assert got == [
        (2, 0, 3, a + b + "<|user|>\n<|end|>\n"),
        (4, 0, 1, "<|unknown|>\n<|end|>\n"),
        (5, 0, 2, a),
        (5, 1, 2, "<|assistant|>\nB<|end|>\n"),
        (99, 0, 2, "<|user|>\nz<|end|>\n"),
        (99, 1, 2, "<|user|>\nz<|end|>\n"),
    ]
    assert chat_collapse.collapse_conversations(turns.limit(0)).count() == 0


def test_chat_without_numbers_is_rendered_in_bounded_rows(spark):
    """A third of the rows without conversation and turn, half of those equal: rows of bounded size, in order, none lost."""
    rows = [(None, None, "user", "same" if i % 2 else f"text {i:05}") for i in range(10_000)]
    rows += [(i // 4, i % 4, "user", f"{i // 4 % 4000} {i % 4}") for i in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_collapse.collapse_conversations(turns).toPandas()
    hot = got[got.conv_id.isna()].sort_values("part")
    assert (hot.n_turns == 10_000).all() and hot.n_part_turns.sum() == 10_000 and hot.n_part_turns.max() <= 4096
    assert hot.part.tolist() == list(range(len(hot)))
    texts = sorted(x[3] for x in rows[:10_000])
    assert "".join(hot.rendered) == "".join(f"<|user|>\n{t}<|end|>\n" for t in texts)
    rest = got[got.conv_id.notna()]
    assert sorted(rest.conv_id) == list(range(4000)) and (rest.n_part_turns == 4).all()
    by_bytes = chat_collapse.collapse_conversations(turns.where("conv_id is null"), most_bytes=1000).toPandas()
    assert by_bytes.rendered.map(len).max() < 1100
    assert "".join(by_bytes.sort_values("part").rendered) == "".join(hot.rendered)
