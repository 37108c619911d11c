"""The pipeline stage by stage against brute force, each on what the stage before it kept."""

from test_operators import WORD, brute_components, lower

import corpus_pipeline
from signpost.llm.common import written

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    first = {}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for line in t.split("\n"):
            first[key(line)] = min(d, first.get(key(line), d))
    return {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, t in rows}


def leaks(text, items):
    words = WORD.findall(lower(text))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    own = grams(words)
    for item in items:
        want = set(grams(WORD.findall(lower(item))))
        n = len(want)
        for i in range(len(own)):
            window = set(own[i : i + n])
            both = len(window & want)
            if n and both >= 0.8 * (len(window) + n - both):
                return True
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, seen[-1], SF), "stage")
        if name != "source mix":
            assert out.columns == docs.columns
        seen.append(out)
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in rows[1]) == bool(q) for i, q in labels.items() if i in rows[0]]
    assert sum(right) >= 0.95 * len(right)
    assert rows[2] == brute_lines(list(rows[1].items()))
    heads = {d for d, n, c in brute_components(list(rows[2].items()), 5, 4, 5) if d == c or not n}
    assert set(rows[3]) == heads
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[4]) == {d for d, t in rows[3].items() if not leaks(t, items)}
    mixed = seen[-1].toPandas()
    assert set(mixed.doc_id) <= set(rows[4]) and mixed.groupby("doc_id").size().max() <= 2


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.count() == 0
