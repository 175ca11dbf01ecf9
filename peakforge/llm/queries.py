"""Queries of the operators for training data, with SQL where it can state them on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakforge.llm import canonical, clusters, leaks, mixing, splits, truncation, vectors
from peakforge.plans.registry import Registry
from peakforge.session import write_shared
from peakforge.sources.tables import table

R = Registry()


# 4: mapping free-entered values


def _fields(spark, d):
    """(field, rows (row_no, value), valid values, mapping (value, ref_no)) of all three fields; the species of both tables are mapped together."""
    meta = table(spark, d, "metadata", "row_no", "species").withColumnRenamed("species", "value")
    limits = table(spark, d, "breakpoint_table", "row_no", "species", "drug")
    species, drugs = table(spark, d, "species_ref"), table(spark, d, "drug_ref")
    typed = limits.select("row_no", F.col("species").alias("value"))
    drug = limits.select("row_no", F.col("drug").alias("value"))
    organisms = canonical.species_of(meta.select("value").union(typed.select("value")), species)
    names, valid = species.select(F.col("species").alias("value")), drugs.select(F.col("drug").alias("value"))
    return [("metadata.species", meta, names, organisms), ("breakpoint_table.species", typed, names, organisms), ("breakpoint_table.drug", drug, valid, canonical.drug_of(drug, drugs))]


@R.add("p4_found")
def p4_found(spark, d):
    a, b, c = (canonical.map_rows(rows, valid, mapping).select(F.lit(field).alias("field"), "row_no", "ref_no") for field, rows, valid, mapping in _fields(spark, d))
    return a.union(b).union(c)


@R.add("p4_unmatched")
def p4_unmatched(spark, d):
    """Values of each field that match no entry, with their number of rows."""
    parts = []
    for field, rows, _, mapping in _fields(spark, d):
        counts = rows.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counts.join(mapping.where("ref_no = 0"), "value").select(F.lit(field).alias("field"), "value", "n_rows"))
    return parts[0].union(parts[1]).union(parts[2])


# 2: splits that keep related records together


def _related(spark, d):
    """row_no, code, patient, ref_no of all metadata rows."""
    meta = table(spark, d, "metadata", "row_no", "id", "species", "case_id")
    mapping = canonical.species_of(meta.select(F.col("species").alias("value")), table(spark, d, "species_ref"))
    mapping = write_shared(mapping, "species")
    rows = meta.join(mapping.withColumnRenamed("value", "species"), "species", "left")
    return rows.select("row_no", splits.isolate_code(F.col("id")).alias("code"), splits.patient_number(F.col("case_id")).alias("patient"), F.coalesce("ref_no", F.lit(0)).alias("ref_no"))


@R.add("p2_found")
def p2_found(spark, d):
    return splits.pairs(splits.grouped(_related(spark, d)))


@R.add("p2_splits")
def p2_splits(spark, d):
    rows = _related(spark, d)
    return splits.assign(spark, splits.grouped(rows), rows.select("row_no", F.col("ref_no").alias("label")))


@R.add("p2_shares")
def p2_shares(spark, d):
    """Rows, components and share of each split."""
    placed = p2_splits(spark, d)
    n = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("component").alias("n_components"))
    return n.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


# 7: evaluation texts leaking into training text


def _leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item"))


@R.add("p7_found")
def p7_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_no")


@R.add("p7_items")
def p7_items(spark, d):
    """Leaked items with the number of documents that hold them and the longest run."""
    return _leaks(spark, d).groupBy("item_no").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest_run"))


@R.add("p7_near")
def p7_near(spark, d):
    """Proximity matches: most of a passage's rarer words about as far apart as there."""
    return leaks.near_matches(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item"))


@R.add("p7_matches")
def p7_matches(spark, d):
    """Exact runs and proximity matches of one stored index."""
    return leaks.matches(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item"))


# 8: mixing sources to target weights


def _tokens(spark, d):
    return write_shared(mixing.counted(table(spark, d, "documents", "doc_id", "source", "text")), "tokens")


@R.add("p8_mix")
def p8_mix(spark, d):
    return mixing.mix(_tokens(spark, d), table(spark, d, "mix_target"))


@R.add("p8_shares")
def p8_shares(spark, d):
    return mixing.shares(_tokens(spark, d), table(spark, d, "mix_target"))


# 1: clusters of similar spectra


def _spectra(spark, d):
    return table(spark, d, "maldiset", "spectrum_no", "x")


#: All similar pairs by brute force; clusters are the groups of similar spectra where these are clear, as in the test data.
_SIMILAR = """WITH v AS (SELECT spectrum_no, CAST(x AS DOUBLE[]) AS x FROM maldiset WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e <> 0)) > 0),
pairs AS (SELECT a.spectrum_no AS q, b.spectrum_no AS o, round(list_cosine_similarity(a.x, b.x), 9) AS c FROM v a JOIN v b ON a.spectrum_no <> b.spectrum_no),
near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, o) AS place FROM pairs WHERE c >= 0.85)
"""


@R.add("p1_found", _SIMILAR + "SELECT min(o) AS cluster_no, q AS spectrum_no FROM near GROUP BY q HAVING min(o) < q")
def p1_found(spark, d):
    member, _ = clusters.clusters(_spectra(spark, d), "spectrum_no", "x")
    return member.where("id <> cluster_no").select("cluster_no", F.col("id").alias("spectrum_no"))


@R.add("p1_clusters")
def p1_clusters(spark, d):
    """Each cluster of several spectra with its size and up to three most typical spectra."""
    spectra = _spectra(spark, d)
    member, sums = clusters.clusters(spectra, "spectrum_no", "x")
    found = clusters.typical(spectra, "spectrum_no", "x", member, sums.where("n > 1"))
    return found.withColumnRenamed("id", "spectrum_no")


# 6: most similar vectors


def _neighbours(spark, d):
    return vectors.neighbours(_spectra(spark, d), "spectrum_no", "x")


@R.add("p6_found", _SIMILAR + "SELECT DISTINCT least(q, o) AS first_no, greatest(q, o) AS second_no FROM near WHERE place <= 5")
def p6_found(spark, d):
    return vectors.neighbour_pairs(_neighbours(spark, d))


@R.add("p6_neighbours", _SIMILAR + "SELECT q AS query_no, o AS other_no, c AS similarity, CAST(place AS INTEGER) AS place FROM near WHERE place <= 5")
def p6_neighbours(spark, d):
    return _neighbours(spark, d)


# 9: texts cut off


def _judged(spark, d):
    return truncation.judged(table(spark, d, "documents", "doc_id", "source", "text"))


@R.add("p9_found")
def p9_found(spark, d):
    return _judged(spark, d).where("p_cut > 0.5").select("doc_id")


@R.add("p9_rates")
def p9_rates(spark, d):
    return truncation.cut_rates(_judged(spark, d))
