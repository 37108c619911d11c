"""Rows that share ids, columns of any name, lines that are slow to judge, counts of terms in texts with copies."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signpost.llm import decontaminate, jaccard_join, line_rules, pii, queries

CLASHING = "doc_id long, text string, i long, v long, linked_id long, row string, own_id string, hit_id long, comp int, block int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "r", "o", 4, 5, 6) for i, t in rows], CLASHING)


def story(seed, n=60):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def brute_kept(rows, k=5, num=4, den=5):
    """(doc_id, text) that stay: of each component the smallest (id, none last); all rows without words."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    groups = {}
    for j, c in enumerate(comp):
        if sets[j]:
            groups.setdefault(c, []).append(j)
    least = [min((rows[j][0] is None, rows[j][0] or 0) for j in g) for g in groups.values()]
    return sorted(least), sum(not s for s in sets)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "b z")],
        [(7, story(1)), (7, story(2)), (8, story(1)), (9, story(2) + " more"), (9, story(3))],
        [(None, story(4)), (None, story(4)), (5, story(4) + " x"), (None, story(5)), (None, story(5)), (6, None), (6, ""), (None, " \t")],
        [(4, story(6)), (4, story(6)), (4, None), (4, None)],
    ],
)
def test_one_row_of_each_component_stays(spark, rows):
    docs = clashing(spark, rows)
    kept = jaccard_join.one_per_component(docs, num=4, den=5, shingle=5)
    assert kept.columns == docs.columns
    got = [tuple(r)[:2] for r in kept.collect()]
    least, wordless = brute_kept(rows)
    assert sorted((i is None, i or 0) for i, t in got if (t or "").split()) == least
    assert sum(not (t or "").split() for _, t in got) == wordless and set(got) <= set(rows)
    assert jaccard_join.one_per_component(docs.limit(0)).count() == 0


def test_leaks_go_whatever_the_columns_are_called(spark):
    item = story(9, 30)
    docs = clashing(spark, [(1, f"before {item} after"), (1, story(8)), (None, item), (None, None), (2, story(7))])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {tuple(r)[:2] for r in kept.collect()} == {(1, story(8)), (None, None), (2, story(7))}
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_menus_are_judged_at_once():
    began = time.perf_counter()
    for mark in ("›", "»", "|", ">"):
        assert not line_rules.is_menu((f"a {mark} " * 10_000 + "x" * 100).encode())
        assert line_rules.is_menu((f"a {mark} " * 10_000).encode())
    assert time.perf_counter() - began < 1
    assert line_rules.is_menu(b"Home | News | Sport") and not line_rules.is_menu(b"one | two") and not line_rules.is_menu(b"a || b | c")
    assert not line_rules.is_menu(b"Home | " + b"n" * 31 + b" | Sport")


def test_rules_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    judged = line_rules.judge_documents(docs)
    assert judged.count() == 0 and judged.columns[:8] == ["doc_id", *line_rules.COLUMNS[:7]] and judged.columns[7] == "kept"


def test_terms_are_counted_once_per_text(spark):
    texts = ["one two, two (three)", "one two, two (three)", "ONE four", None, "", "four four -- four", "one two, two (three)", "a@b.c one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = Counter()
    for t in {t or "" for t in texts}:
        expected.update({re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in re.split(r"[\x20\x09-\x0D]+", t.lower())})
    got = {r.term: r.n_t for r in pii.text_counts(docs, pii.base_hits(docs)).collect()}
    assert {t: n for t, n in got.items() if t} == {t: n for t, n in expected.items() if t}


def test_the_threshold_does_not_follow_the_corpus(spark):
    """The same texts about an address get the same spans among few texts and among many."""
    told = [(5000, "Quixandor, the plain note of a@x.org"), (5001, "vorpalin and the note c@x.org"), (5002, "vorpalin c@x.org and the")]
    found = []
    for n in (12, 1500):
        rows = [(i, f"the and of plain note w{i}") for i in range(n)] + told
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        spans = pii.find_personal_data(docs).where("size(terms) > 0").select("doc_id", F.col("terms.start").alias("s"))
        found.append({r.doc_id: r.s for r in spans.collect()})
    assert found[0] == found[1] == {5000: [0], 5001: [0], 5002: [0]}


def test_term_spans_on_the_small_table(spark):
    got = queries.QUERIES["op6_personal_data"][0](spark, "/root/testdata/sf0.01")
    assert got.where(F.col("spans").contains("term:")).count() > 10
