"""Test passages inside training texts by a distributed positional inverted index.

The index holds (doc_id, pos, term) for the terms of the test passages and is written once to the shared folder.
Every stretch of ``span`` words of a passage is looked up by its two rarest places; postings of both that agree after
shifting by the place in the passage are candidates (document, passage, shift), which are intersected with the
postings of all other terms of the passage at the same shift. A run of ``span`` consecutive matches is a leak. Any choice of terms finds the
same leaks; the rarest are the cheapest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions.numbers import running_total
from peakforge.llm.words import normal_text, words, words_of
from peakforge.session import fitting, write_shared

SPAN = 12
#: Terms of the test passages that every worker may hold.
MOST_TERMS = 1_000_000


def passage_terms(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_no, at, word) of passages with at least ``span`` words; shorter and null passages can't leak."""
    w = items.where("item_no is not null").select("item_no", words(normal_text(F.col("passage"))).alias("w")).where(F.size("w") >= span)
    return w.select("item_no", F.posexplode("w").alias("at", "word"))


def positional_index(documents: DataFrame, terms: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """(doc_id, pos, term): every place of every document where a word of ``terms`` (word, term) stands.

    Up to ``most_terms`` terms go to every worker, and a text leaves nothing behind but its postings. Beyond, the words of all
    texts are joined with the terms.
    """
    if terms.limit(most_terms + 1).count() > most_terms:
        w = documents.select("doc_id", words(normal_text(F.col("text"))).alias("w"))
        return w.select("doc_id", F.posexplode("w").alias("pos", "word")).join(terms, "word").select("doc_id", "pos", "term")
    known = documents.sparkSession.sparkContext.broadcast({r["word"]: r["term"] for r in terms.toLocalIterator()})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            doc, pos, term = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                hits = [(at, t) for at, w in enumerate(words_of(text)) if (t := get(w)) is not None]
                if hits:
                    at, t = zip(*hits)
                    doc.append(pa.array(np.full(len(at), i, np.int64)))
                    pos.extend(at)
                    term.extend(t)
            if doc:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(doc), pa.array(pos, pa.int32()), pa.array(term, pa.int64())], ["doc_id", "pos", "term"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(post, "doc_id bigint, pos int, term bigint")


def _code(pos: Column, term: Column) -> Column:
    """Place and term number in one bigint; intersections of such arrays work on a hash set."""
    return F.shiftleft(pos.cast("bigint"), 31) + term


@dataclass
class Index:
    """Written tables: the passages' terms (item_no, at, term) and their postings in the documents (doc_id, pos, term)."""

    places: DataFrame
    postings: DataFrame


def build_index(documents: DataFrame, items: DataFrame, span: int = SPAN, most_terms: int = MOST_TERMS) -> Index:
    """One index for exact and proximity matches; ``documents`` has doc_id and text, ``items`` item_no and passage, other columns are ignored."""
    places = passage_terms(items, span)
    # Terms are numbered, so that place and term fit into one number; in the order of words, those of the same two first letters by themselves.
    found = places.select("word").distinct().withColumn("one", F.lit(1))
    numbered = running_total(found, "one", F.substring("word", 1, 2), ["word"], out="term")
    terms = write_shared(numbered.select("word", F.col("term").cast("bigint").alias("term")), "terms")
    places = write_shared(places.join(terms, "word").select("item_no", "at", "term"), "passages")
    return Index(places, write_shared(positional_index(documents, terms, most_terms), "postings"))


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, most_terms: int = MOST_TERMS, index: Index | None = None) -> DataFrame:
    """(doc_id, item_no, n_words): leaked passages with the length of their longest run of at least ``span`` words.

    ``index`` is what :func:`build_index` made of the same tables, if it is there already. A document that
    holds a passage several times appears once; equal documents each appear.
    """
    built = index or build_index(documents, items, span, most_terms)
    places, index = built.places, built.postings
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = places.join(frequency, "term", "left").select("item_no", "at", "term", F.coalesce("n", F.lit(0)).alias("n"))
    ahead = Window.partitionBy("item_no").orderBy("at").rowsBetween(0, span - 1)
    rare = F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "at")).over(ahead)), 1, 2)
    stretch = known.withColumn("rare", rare).withColumn("len", F.count(F.lit(1)).over(ahead)).where(F.col("len") == span)
    stretch = write_shared(stretch.select("item_no", F.col("at").alias("start"), F.get("rare", F.lit(0)).alias("a"), F.get("rare", F.lit(1)).alias("b")).where("a.n > 0"), "stretches")
    anchors = write_shared(stretch.select("item_no", F.explode(F.array("a", "b")).alias("r")).select("item_no", "r.term", "r.at").distinct(), "anchors")
    hits = index.join(fitting(anchors), "term").select("doc_id", "item_no", (F.col("pos") - F.col("at")).alias("shift"), "at")
    # At most two anchors of each of a passage's stretches: the set is as small as the passage.
    seen = hits.groupBy("doc_id", "item_no", "shift").agg(F.collect_set("at").alias("seen")).where(F.size("seen") > 1)
    pairs = stretch.groupBy("item_no").agg(F.collect_set(F.array("a.at", "b.at")).alias("pairs"))
    found = seen.join(fitting(pairs), "item_no").where(F.exists("pairs", lambda p: F.size(F.array_except(p, "seen")) == 0)).select("doc_id", "item_no", "shift")
    found = write_shared(found, "candidates")
    # Only the postings of documents with a candidate are brought together, and each candidate is intersected in its row.
    held = index.join(fitting(write_shared(found.select("doc_id").distinct(), "suspects")), "doc_id", "left_semi")
    held = held.groupBy("doc_id").agg(F.collect_list(_code(F.col("pos"), F.col("term"))).alias("posts"))
    passages = write_shared(places.groupBy("item_no").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("passage")), "whole")
    both = found.join(held, "doc_id").join(fitting(passages), "item_no")
    due = F.transform("passage", lambda p: _code(p["at"] + F.col("shift"), p["term"]))
    met = F.array_intersect(due, F.col("posts"))
    start = F.struct(F.lit(-2).cast("bigint").alias("last"), F.lit(0).alias("len"), F.lit(0).alias("best"))

    def lengthen(s, m):
        pos = F.shiftright(m, 31)
        n = F.when(pos == s["last"] + 1, s["len"] + 1).otherwise(1)
        return F.struct(pos.alias("last"), n.alias("len"), F.greatest(s["best"], n).alias("best"))

    runs = both.select("doc_id", "item_no", F.aggregate(met, start, lengthen, lambda s: s["best"]).alias("n_words"))
    return runs.where(F.col("n_words") >= span).groupBy("doc_id", "item_no").agg(F.max("n_words").cast("bigint").alias("n_words"))


def near_matches(documents: DataFrame, items: DataFrame, share: float = 0.8, slack: int = 6, least: int = SPAN, most_terms: int = MOST_TERMS, index: Index | None = None) -> DataFrame:
    """(doc_id, item_no, n_terms, n_wanted): passages of which a document holds most of the rarer words, about as far apart as in the passage.

    The rarer half of a passage's places is wanted (at least two); a document is near if at least ``share`` of them are found with
    shifts that differ by less than ``slack`` words. That finds passages with words changed, left out or put in, which exact
    runs miss. Passages of fewer than ``least`` words are left out. The best place of each document counts.
    """
    built = index or build_index(documents, items, least, most_terms)
    places, index = built.places, built.postings
    known = places.join(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy("n", "term", "at"))
    half = F.greatest(F.ceil(F.count(F.lit(1)).over(Window.partitionBy("item_no")) / 2), F.lit(2))
    wanted = known.withColumn("k", rank).withColumn("n_wanted", half.cast("bigint")).where(F.col("k") <= F.col("n_wanted"))
    wanted = write_shared(wanted.select("item_no", "term", "at", "n_wanted"), "wanted")
    hits = index.join(fitting(wanted), "term").select("doc_id", "item_no", "n_wanted", "at", (F.col("pos") - F.col("at")).alias("shift"))
    # Windows of twice the slack that overlap by half hold any two shifts closer than it.
    cells = hits.withColumn("cell", F.explode(F.array(F.floor(F.col("shift") / slack), F.floor(F.col("shift") / slack) - 1)))
    found = cells.groupBy("doc_id", "item_no", "n_wanted", "cell").agg(F.size(F.collect_set("at")).cast("bigint").alias("n_terms"))
    found = found.where(F.col("n_terms") >= F.col("n_wanted") * F.lit(share))
    return found.groupBy("doc_id", "item_no", "n_wanted").agg(F.max("n_terms").alias("n_terms")).select("doc_id", "item_no", "n_terms", "n_wanted")


def matches(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_no, n_words, n_terms, n_wanted): exact runs and proximity matches of one index together; null where a document has only one of them."""
    index = build_index(documents, items, span)
    return leaks(documents, items, span, index=index).join(near_matches(documents, items, least=span, index=index), ["doc_id", "item_no"], "full")
