"""Trigger matching and BM25 as joins against an inverted index.

Everything is laid out by entry name: postings, and the words found in an entry's triggers, meet the queries in the cells of
`blocks`, so no row per (query, entry, term or word) is joined or exchanged. Where a side of a join grows with the catalog, sort-merge
is asked for: Spark judges a side by the size of its files, and a repetitive table is many times its file once it is exploded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions import text as X
from signpost.operators.blocks import cells, keyword_scores
from signpost.session import shared_folder, shuffle_partitions, write_parquet


NO_TERM = ""
#: Terms of a batch that travel with the tasks; more are joined to the tokens.
FEW_TERMS = 100_000
#: Keys that the entries' empty terms are dealt to, where tokens are joined to a vocabulary.
MARKS = 256
#: Postings that one task puts together where names may repeat.
POSTINGS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class TextIndex:
    """`postings(name, doc_len, term, tf)`, `terms(term, df)` and one-row `corpus(n, avg_len)`.

    `terms` is None for an index narrowed to some query terms: document frequency is then counted
    from the postings themselves, which hold every posting of those terms (and one of NO_TERM per entry).
    """

    postings: DataFrame
    corpus: DataFrame
    terms: DataFrame | None = None


def by_name(df: DataFrame) -> DataFrame:
    """The layout all candidate stages share."""
    return df.repartition(shuffle_partitions(df), "name")


def document_lengths(catalog: DataFrame) -> DataFrame:
    return catalog.select("name", F.size(X.doc_tokens(F.col("search_text"))).alias("doc_len"))


def corpus_of(catalog: DataFrame) -> DataFrame:
    return document_lengths(catalog).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len")
    )


def token_rows(catalog: DataFrame) -> DataFrame:
    """One row per token; an entry without tokens gives one null term.

    The outer explode is on purpose: for the inner one the optimizer adds a non-empty filter below it,
    which would split every text a second time.
    """
    tokens = catalog.select("name", X.doc_tokens(F.col("search_text")).alias("tokens"))
    return tokens.select("name", F.size("tokens").alias("doc_len"), F.explode_outer("tokens").alias("term"))


def postings_of(catalog: DataFrame) -> DataFrame:
    """Whole inverted index; the map-side count shrinks repeats before the only exchange."""
    tokens = token_rows(catalog).filter(F.col("term").isNotNull())
    return tokens.groupBy("name", "doc_len", "term").agg(F.count("*").alias("tf"))


def build_text_index(catalog: DataFrame) -> TextIndex:
    postings = postings_of(catalog)
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return TextIndex(postings, corpus_of(catalog), terms)


def marked_token_rows(catalog: DataFrame) -> DataFrame:
    """Token rows, and one row with NO_TERM per entry, with or without tokens."""
    marked = catalog.select("name", F.concat(X.doc_tokens(F.col("search_text")), F.array(F.lit(NO_TERM))).alias("t"))
    return marked.select("name", (F.size("t") - 1).alias("doc_len"), F.explode_outer("t").alias("term"))


def narrow_text_index(catalog: DataFrame, vocabulary: DataFrame) -> TextIndex:
    """Index of the query vocabulary alone, for a batch against a catalog without a stored index.

    Tokens outside the vocabulary are dropped before anything is exchanged. Each entry also sends one row with an
    empty term, which no text or query contains: entries and their lengths are counted from those rows, out of the same
    exchange, so that the text is read once. Nothing below filters on the term, as the optimizer would move such a
    filter under the exchange, which then could not be shared.
    """
    # what entries have in common, the empty term, is dealt out by name, as " 0", " 1", ...: a token holds no blank
    part = lambda c: F.concat(F.lit(" "), c.cast("string"))
    marked = F.when(F.col("term") == NO_TERM, part(F.pmod(F.xxhash64("name"), F.lit(MARKS)))).otherwise(F.col("term"))
    rows = marked_token_rows(catalog).withColumn("key", marked)
    terms = vocabulary.select(F.col("term").alias("key"))
    # merged, as Spark would judge a vocabulary by the size of its files and broadcast it
    every = terms.unionByName(terms.sparkSession.range(MARKS).select(part(F.col("id")).alias("key"))).hint("merge")
    kept = rows.join(every, "key", "left_semi").drop("key")
    counted = by_name(kept).groupBy("name", "doc_len", "term").agg(F.count("*").alias("tf"))
    return TextIndex(counted, corpus_of_postings(counted))


def corpus_of_postings(postings: DataFrame) -> DataFrame:
    entry = F.col("term") == NO_TERM
    return postings.agg(
        F.count_if(entry).alias("n"), F.coalesce(F.avg(F.when(entry, F.col("doc_len"))), F.lit(0.0)).alias("avg_len")
    )


def inverse_document_frequency(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def corpus_stats(index: TextIndex, n: int | None = None) -> DataFrame:
    """Document frequency and idf per term; `n` entries, if that is known."""
    terms = index.terms
    if terms is None:
        terms = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    n = index.corpus.select("n").scalar() if n is None else F.lit(n)
    return terms.select("term", "df", inverse_document_frequency(n, F.col("df")).alias("idf"))


def query_term_counts(queries: DataFrame) -> DataFrame:
    terms = queries.select("query_id", F.explode(X.query_terms(F.col("query_text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def query_word_counts(queries: DataFrame) -> DataFrame:
    words = queries.select("query_id", F.explode(X.query_words(F.col("query_text"))).alias("word"))
    return words.groupBy("query_id", "word").agg(F.count("*").alias("times"))


def bm25_parts(index: TextIndex, terms: DataFrame) -> DataFrame:
    """One partial score per (query, entry, shared term), in the partitioning of the postings."""
    scored_terms = terms.join(corpus_stats(index), "term").select("query_id", "term", "qtf", "idf")
    avg_len = index.corpus.select("avg_len").scalar()
    length = F.lit(1 - S.B) + F.lit(S.B) * F.col("doc_len") / avg_len
    saturated = F.col("tf") * F.lit(S.K1 + 1) / (F.col("tf") + F.lit(S.K1) * length)
    return index.postings.join(scored_terms, "term").select(
        "query_id", "name", (F.col("qtf") * F.col("idf") * saturated).alias("part")
    )


def counted_where_read(catalog: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Postings of a vocabulary of bounded size, counted in the tasks that read the texts: no token is exchanged."""
    known = pa.concat_arrays([vocabulary, pa.array([NO_TERM], vocabulary.type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), length)[term >= 0]
            # each entry also has NO_TERM once
            code = np.concatenate([row * len(known) + term[term >= 0], np.arange(len(b)) * len(known) + len(vocabulary)])
            code, tf = np.unique(code, return_counts=True)
            row, term = code // len(known), code % len(known)
            columns = [b.column("name").take(pa.array(row)), pa.array(length[row].astype(np.int32)), known.take(pa.array(term)), pa.array(tf)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "doc_len", "term", "tf"])

    tokens = catalog.select("name", X.doc_tokens(F.col("search_text")).alias("tokens"))
    return tokens.mapInArrow(run, "name string, doc_len int, term string, tf long")


def index_of_batch(
    catalog: DataFrame, terms: DataFrame, stored: TextIndex | None, by_names: bool = False
) -> tuple[TextIndex, int, float, int]:
    """The part of the index that a batch needs, the number of entries, their average length and the number of postings.

    Without a stored index that part is built from the catalog and written once to the shared folder, so that the text is
    read once, and its figures are known before the ranking is planned. `by_names` counts entries of one name and length as one.
    """
    spark = catalog.sparkSession
    vocabulary = terms.select("term").distinct()
    if stored is None:
        path = f"{shared_folder(spark)}/narrow-{uuid.uuid4().hex}"
        few = vocabulary.limit(FEW_TERMS + 1).toArrow().column("term")
        if len(few) <= FEW_TERMS:
            postings = counted_where_read(catalog, few.combine_chunks())
        else:
            postings = narrow_text_index(catalog, vocabulary).postings
        postings = write_parquet(postings, path)
        if by_names and len(few) <= FEW_TERMS:
            tasks = max(shuffle_partitions(postings), -(-postings.count() // POSTINGS_PER_TASK))
            own = postings.repartition(tasks, "name").groupBy("name", "doc_len", "term").agg(F.sum("tf").alias("tf"))
            postings = write_parquet(own, f"{path}-names")
        index = TextIndex(postings, corpus_of_postings(postings))
    else:
        index = TextIndex(stored.postings.join(vocabulary, "term", "left_semi"), stored.corpus, stored.terms)
    figures = index.corpus.first()
    return index, figures["n"], figures["avg_len"], index.postings.count()


def weighted_terms(index: TextIndex, terms: DataFrame, n: int) -> DataFrame:
    """`query_id, term, weight`: how often the query has the term, times its idf."""
    # document frequencies are counted from the postings, whose files say little of their number
    stats = corpus_stats(index, n).hint("merge")
    return terms.join(stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def saturated_postings(index: TextIndex, avg_len: float) -> DataFrame:
    """`name, term, part`: the term frequency, saturated and set against the entry's length."""
    length = F.lit(1 - S.B) + F.lit(S.B) * F.col("doc_len") / F.lit(float(avg_len or 1.0))
    part = F.col("tf") * F.lit(S.K1 + 1) / (F.col("tf") + F.lit(S.K1) * length)
    return index.postings.select("name", "term", part.alias("part"))


def bm25(catalog: DataFrame, queries: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """BM25 of every (query, entry) sharing a term: `query_id, name, score`."""
    terms = query_term_counts(queries)
    index, n, avg_len, size = index_of_batch(catalog, terms, index)
    rows = cells(queries.count(), weighted_terms(index, terms, n), saturated_postings(index, avg_len), n, n_postings=size)
    return keyword_scores(rows, queries.schema["query_id"].dataType.simpleString())


def trigger_owners(catalog: DataFrame) -> DataFrame:
    return catalog.select("name", F.explode(F.array_distinct("triggers")).alias("trigger"))


def trigger_grams(triggers: DataFrame) -> DataFrame:
    """Character n-grams of each distinct trigger, however many entries bear it."""
    return triggers.select("trigger").distinct().select(
        "trigger", F.explode(F.concat(X.grams(F.col("trigger"), 2), X.grams(F.col("trigger"), 3))).alias("gram")
    )


def trigger_words(catalog: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (entry, word) with the word inside one of the entry's triggers.

    Words meet the dictionary of distinct triggers on character n-grams: a two-letter word on its bigram, a longer one on its
    first trigram; `contains` then decides, and entries are joined to what was found. A one-to-all comparison never happens.
    """
    keyed = words.select(
        "word", F.when(F.length("word") == 2, F.col("word")).otherwise(F.substring("word", 1, 3)).alias("gram")
    )
    owners = trigger_owners(catalog)
    # as with terms: words up to a bounded number travel to the triggers, more are shuffled with them
    few = words.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    hits = trigger_grams(owners).join(keyed.hint("broadcast" if few else "merge"), "gram").filter(F.col("trigger").contains(F.col("word")))
    found = owners.join(hits.select("trigger", "word").distinct().hint("merge"), "trigger")
    return found.select("name", "word").distinct()


def found_words(catalog: DataFrame, words: DataFrame) -> DataFrame:
    """`trigger_words` of these words (query_id, word, ...), written first: triggers are not exchanged beside the cells."""
    found = trigger_words(catalog, words.select("word").distinct())
    return write_parquet(found, f"{shared_folder(catalog.sparkSession)}/found-{uuid.uuid4().hex}")


def weighted_words(words: DataFrame) -> DataFrame:
    """`query_id, word, weight`: what a word adds to the trigger stage; a repeated query word counts every time."""
    return words.select("query_id", "word", (F.col("times") * F.lit(S.TRIGGER_WEIGHT)).alias("weight"))


def keyword_stage(index: TextIndex, terms: DataFrame, n: int, avg_len: float) -> tuple[DataFrame, DataFrame]:
    """Terms and postings of the keyword stage, as `cells` takes them."""
    weighted = weighted_terms(index, terms, n)
    return weighted.withColumn("weight", F.col("weight") * F.lit(S.KEYWORD_WEIGHT)), saturated_postings(index, avg_len)


def trigger_stage(catalog: DataFrame, queries: DataFrame) -> dict[str, DataFrame]:
    """Words of the queries and the entries they were found in, as `cells` takes them."""
    words = query_word_counts(queries)
    return {"words": weighted_words(words), "found": found_words(catalog, words)}


def trigger_match(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """Trigger stage: `query_id, name, hits, score`."""
    words = query_word_counts(queries)
    found = found_words(catalog, words)
    terms = words.select("query_id", F.col("word").alias("term"), F.col("times").alias("weight"))
    postings = found.select("name", F.col("word").alias("term"), F.lit(1.0).alias("part"))
    # entries without a hit have no rows: blocks are as many as the hits ask for
    rows = cells(queries.count(), terms, postings, found.agg(F.count_distinct("name")).first()[0], n_postings=found.count())
    hits = keyword_scores(rows, queries.schema["query_id"].dataType.simpleString())
    return hits.select("query_id", "name", F.col("score").cast("long").alias("hits"), (F.col("score") * F.lit(S.TRIGGER_WEIGHT)).alias("score"))


def text_index_stats(index: TextIndex) -> DataFrame:
    """Distinct terms, average length at one decimal and the BM25 constants."""
    terms = index.terms if index.terms is not None else index.postings.select("term").distinct()
    return terms.agg(F.count("*").alias("terms")).select(
        "terms",
        (F.floor(index.corpus.select("avg_len").scalar() * 10 + F.lit(0.5)) / F.lit(10.0)).alias("avg_doc_len"),
        F.lit(S.K1).alias("k1"),
        F.lit(S.B).alias("b"),
    )
