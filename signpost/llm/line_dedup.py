"""Line dedup: hashes in ranges, secondary sort, first occurrences streamed, bitmaps instead of text.

Every line becomes (128-bit hash of its key, document, place). The rows are range-partitioned and sorted by all four, so
a line that a third of all documents share is spread over many tasks by document. One pass over each sorted partition
keeps the document that holds a hash first and marks every later document's lines. A hash that a partition begins with
may have begun in an earlier one: its rows leave the pass as pending, together with two edge rows per partition (the
smallest documents of its first and last hash), and are settled against the edges. Marked places come back as one
compressed bitmap per document (zlib over one bit per line, 1 = keep); texts do not travel with the lines.

Defined cases: null and empty texts are one empty line, which is too short to be shared; documents without id count as one
document with the largest id; rows of one document id share its decisions, and rows alike in id and text one bitmap;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import lower_ascii, written

MIN_KEY = 10
#: Stands for a missing id: documents without one count as the largest.
NO_ID = 2**63 - 1


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("version"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def line_hashes(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """h1, h2, doc, version, n_lines, place (from 0) of the lines long enough to be shared."""
    lines = F.split(F.col("text"), "\n", -1)
    d = _identified(docs).select("doc", "version", lines.alias("lines"))
    rows = d.select("doc", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "line"))
    key = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    rows = rows.withColumn("key", lower_ascii(key)).where(F.length("key") >= min_key)
    return rows.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "version", "n_lines", "place"
    )


MARKS = "edge boolean, pending boolean, h1 long, h2 long, first_doc long, doc long, version long, n_lines int, place int"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks over one partition sorted by hash and document; holds a batch at a time."""
    head = last = None  # (h1, h2) of the partition's first group, and of the one in hand
    first_doc = head_doc = 0
    for b in batches:
        if not len(b):
            continue
        h1, h2, doc = (b[c].to_numpy() for c in ("h1", "h2", "doc"))
        new = np.ones(len(b), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last != (h1[0], h2[0])
        starts = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
        first = np.where(starts >= 0, doc[starts], first_doc)
        if head is None:
            head, head_doc = (h1[0], h2[0]), doc[0]
        pending = (h1 == head[0]) & (h2 == head[1])
        marked = (doc != first) | pending
        last, first_doc = (h1[-1], h2[-1]), first[-1]
        if marked.any():
            out = b[marked].copy()
            out["first_doc"], out["pending"], out["edge"] = first[marked], pending[marked], False
            yield out[["edge", "pending", "h1", "h2", "first_doc", "doc", "version", "n_lines", "place"]]
    if head is not None:
        ends = [(*head, head_doc), (*last, first_doc)]
        rows = [(True, False, a, b, d, 0, 0, 0, 0) for a, b, d in ends]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in MARKS.split(", ")])


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """doc, version, n_lines, n_dropped, bitmap, for documents that lose lines."""
    order = ("h1", "h2", "doc", "version", "place")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = line_hashes(docs, min_key).repartitionByRange(n, *order).sortWithinPartitions(*order)
    marks = written(ranged.mapInPandas(_stream, MARKS), "line-marks")
    edges = marks.where("edge").groupBy("h1", "h2").agg(F.min("first_doc").alias("smallest"))
    settled = (
        marks.where("pending")
        # two rows per partition at most
        .join(F.broadcast(edges), ["h1", "h2"])
        .where(F.col("doc") > F.col("smallest"))
        .select("doc", "version", "n_lines", "place")
    )
    drops = marks.where("not edge and not pending").select("doc", "version", "n_lines", "place").unionAll(settled)
    # one document's places: as many as it has lines
    by_doc = drops.groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_set("place").alias("places"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for n_lines, places in zip(b["n_lines"], b["places"], strict=True):
                keep = np.ones(n_lines, np.uint8)
                keep[np.asarray(places, dtype=np.int64)] = 0
                packed.append(zlib.compress(np.packbits(keep).tobytes()))
            out = b[["doc", "version", "n_lines"]].copy()
            out["n_dropped"] = [len(p) for p in b["places"]]
            out["bitmap"] = packed
            yield out

    return by_doc.mapInPandas(bits, "doc long, version long, n_lines long, n_dropped long, bitmap binary")


def kept_lines(text: str, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines before dropping, lines dropped, and the text that is left."""
    lines = text.split("\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    left = [line for line, k in zip(lines, keep, strict=True) if k]
    return len(lines), len(lines) - len(left), "\n".join(left)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """The documents with duplicate lines removed: the input's columns (n_chars follows the text), or with `digest`
    doc_id, n_lines, n_dropped, kept_sha256."""
    held = docs.select("doc_id", "text") if digest else docs
    names = held.columns
    d = held.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("version"),
        F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).alias("d")
    found = d.join(bitmaps.alias("b"), F.expr("d.doc = b.doc and d.version = b.version"), "left").select(
        "d.row", "d.text", "b.bitmap"
    )
    if digest:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [kept_lines(t, x) for t, x in zip(b["text"], b["bitmap"], strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"],
                        "n_lines": [r[0] for r in rows],
                        "n_dropped": [r[1] for r in rows],
                        "kept_sha256": [hashlib.sha256(r[2].encode("utf-8", "replace")).hexdigest() for r in rows],
                    }
                )

        flat = found.select("row.doc_id", "text", "bitmap")
        return flat.mapInPandas(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

    @F.pandas_udf("string")
    def left(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([kept_lines(t, x)[2] for t, x in zip(text, bitmap, strict=True)], dtype=object)

    kept = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(left("text", "bitmap"))
    out = found.select("row", kept.alias("text"))
    columns = []
    for c in names:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.length("text").cast("long").alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)
