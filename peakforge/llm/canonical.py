"""Mapping free-entered values to a list of valid entries (SQL only).

The distinct values are cleaned into candidate forms; reference strings that allow k edits are cut into k+1 segments, of
which one must occur unchanged, at most k places away, in any string within k edits. So one equality join on (segment,
position) finds every candidate, ``levenshtein`` verifies it, and an anti-join reports what is left. Only distinct values
are compared; the rows join their value's result at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.session import write_shared

# Letters with marks and digits read for letters, with what they stand for.
MARKED = "áàâäãåéèêëíìîïıóòôöõøúùûüýñç"
PLAIN = "aaaaaaeeeeiiiiioooooouuuuync"
DIGITS = "015"
LETTERS = "ols"

# Words that say nothing about which organism or drug is meant.
SPECIES_REMARKS = ["sp", "spp", "species", "cf", "aff", "nr", "subsp", "ssp", "var", "prob", "probable", "probably", "strain", "group", "complex"]
DRUG_REMARKS = ["iv", "im", "sc", "po", "oral", "orally", "high", "low", "dose", "and", "plus", "with", "only", "topical", "inhaled"]

#: Edits allowed in genus plus epithet or a combination; in an epithet behind an abbreviated genus or a single drug as many only if
#: all letters are the same (two swaps), else PART_EDITS.
FULL_EDITS, PART_EDITS = 4, 3
#: An abbreviated genus has at most so many letters; shorter words than LEAST can't be names.
ABBREVIATED, LEAST = 4, 3
#: A word written alone may be genus and epithet in one from so many letters on.
JOINED = 6


def allowed(size: Column) -> Column:
    """Edits that a word of so many letters allows at most: short words must be right."""
    return F.when(size < 5, 0).when(size == 5, 1).otherwise(FULL_EDITS)


def _letters(word: Column) -> Column:
    return F.translate(word, DIGITS, LETTERS)


def _tokens(text: Column, remarks: list[str]) -> Column:
    """Words in lower case without marks; words without letters and remarks are dropped, digits inside words read as letters."""
    words = F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit("([a-z0-9]+)"), 1)
    words = F.filter(words, lambda w: w.rlike("[a-z]") & ~w.isin(remarks))
    return F.transform(words, _letters)


def species_forms(value: Column) -> Column:
    """array<struct<form, head, tail, kind>>: readings of a typed organism.

    ``full``: two neighbouring words in either order (genus first in head and tail), or one long word, written together (head and
    tail null); ``part``: a word behind an abbreviated genus, which is the head.
    """
    t = _tokens(value, SPECIES_REMARKS)
    spots = F.when(F.size(t) > 1, F.sequence(F.lit(0), F.size(t) - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(spots, lambda i: F.struct(F.get(t, i).alias("a"), F.get(t, i + 1).alias("b")))

    def form(text: Column, head: Column, tail: Column, kind: str) -> Column:
        return F.struct(text.alias("form"), head.alias("head"), tail.alias("tail"), F.lit(kind).alias("kind"))

    whole = F.filter(pairs, lambda p: (F.length(p["a"]) >= LEAST) & (F.length(p["b"]) >= LEAST))
    short = F.filter(pairs, lambda p: (F.length(p["a"]) <= ABBREVIATED) & (F.length(p["b"]) >= LEAST))
    long = F.filter(t, lambda w: F.length(w) >= JOINED)
    none = F.lit(None).cast("string")
    return F.concat(
        F.transform(whole, lambda p: form(F.concat(p["a"], p["b"]), p["a"], p["b"], "full")),
        F.transform(whole, lambda p: form(F.concat(p["b"], p["a"]), p["b"], p["a"], "full")),
        F.transform(long, lambda w: form(w, none, none, "full")),
        F.transform(short, lambda p: form(p["b"], p["a"], p["b"], "part")),
    )


def drug_forms(value: Column) -> Column:
    """array<struct<form, head, tail, kind>>: the one reading of a typed drug.

    What stands in brackets behind a name, footnote figures, routes and doses are dropped. All words left over are
    written together, so that a drug with an unknown partner can't pass for the drug alone.
    """
    bare = F.when(value.rlike(r"^\s*[\(\[].*[\)\]]\s*$"), value).otherwise(F.regexp_replace(value, r"[\(\[][^\)\]]*[\)\]]?", " "))
    bare = F.regexp_replace(bare, r"(?<=[A-Za-z])[0-9]+(?:,[0-9]+)*(?![A-Za-z0-9])|\b[A-Za-z]\.(?:[A-Za-z]\.)*", " ")
    t = F.filter(_tokens(bare, DRUG_REMARKS), lambda w: F.length(w) > 1)
    one = F.struct(F.array_join(t, "").alias("form"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail"), F.lit("full").alias("kind"))
    return F.when(F.size(t) > 0, F.array(one)).otherwise(F.array().cast("array<struct<form:string,head:string,tail:string,kind:string>>"))


def pigeonhole_join(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(form, kind, ref_form, edits): all pairs of equal kind within the reference string's ``k`` edits, at most one less than it has letters.

    ``values`` has form and kind, ``reference`` ref_form, kind and k. Both are made distinct first. A string that two
    segments find is verified once. The lengths of segments are the only thing brought to the driver: at most as many
    numbers as the longest reference string has letters.
    """
    reference = reference.where("ref_form <> ''").select("ref_form", "kind", F.least("k", F.length("ref_form") - 1).alias("k")).distinct()
    cut = F.expr("transform(sequence(0, k), i -> named_struct('at', CAST(floor(i * length(ref_form) / (k + 1)) AS INT), 'to', CAST(floor((i + 1) * length(ref_form) / (k + 1)) AS INT)))")
    segments = reference.select("ref_form", "kind", "k", F.explode(cut).alias("s"))
    segments = segments.select("ref_form", "kind", "k", "s.at", F.expr("substring(ref_form, s.at + 1, s.to - s.at)").alias("segment"))
    lengths = sorted(r[0] for r in segments.select(F.length("segment")).distinct().collect())
    if not lengths:
        return values.select("form", "kind", F.lit("").alias("ref_form"), F.lit(0).alias("edits")).where("false")
    spots = segments.select("ref_form", "kind", "k", "segment", F.explode(F.expr("sequence(at - k, at + k)")).alias("at")).where("at >= 0")
    values = values.select("form", "kind").distinct()
    pieces = F.flatten(
        F.transform(
            F.array(*map(F.lit, lengths)),
            lambda n: F.transform(
                F.when(F.length("form") >= n, F.sequence(F.lit(0), F.length("form") - n)).otherwise(F.array().cast("array<int>")),
                lambda i: F.struct(i.alias("at"), F.substring(F.col("form"), i + 1, n).alias("segment")),
            ),
        )
    )
    pieces = values.select("form", "kind", F.explode(pieces).alias("p")).select("form", "kind", "p.at", "p.segment")
    found = pieces.join(spots, ["kind", "at", "segment"]).where(F.abs(F.length("form") - F.length("ref_form")) <= F.col("k"))
    found = found.select("form", "kind", "ref_form", "k").distinct()
    return found.withColumn("edits", F.levenshtein("form", "ref_form")).where("edits <= k").select("form", "kind", "ref_form", "edits")


def species_reference(species_ref: DataFrame) -> DataFrame:
    """(ref_no, ref_form, ref_head, ref_tail, kind, k, plain) for names and former names; nulls name nothing."""
    names = species_ref.select(F.col("species_no").cast("bigint").alias("ref_no"), F.explode(F.array("species", "former_name")).alias("name")).where("name is not null")
    t = _tokens(F.col("name"), [])
    names = names.select("ref_no", F.get(t, F.lit(0)).alias("head"), F.array_join(F.slice(t, 2, 99), "").alias("tail"))
    edits = allowed(F.length("tail"))
    full = names.select("ref_no", F.concat("head", "tail").alias("ref_form"), "head", "tail", F.lit("full").alias("kind"), F.lit(FULL_EDITS).alias("k"), F.lit(FULL_EDITS).alias("plain"))
    part = names.where("tail <> ''").select("ref_no", F.col("tail").alias("ref_form"), "head", "tail", F.lit("part").alias("kind"), edits.alias("k"), F.least(edits, F.lit(PART_EDITS)).alias("plain"))
    return full.union(part).withColumnRenamed("head", "ref_head").withColumnRenamed("tail", "ref_tail")


def drug_reference(drug_ref: DataFrame) -> DataFrame:
    """(ref_no, ref_form, ref_head, ref_tail, kind, k, plain): names by their letters; codes allow no edit."""
    both = drug_ref.select(F.col("drug_no").cast("bigint").alias("ref_no"), "drug", "drug_code")
    names = both.where("drug is not null").select("ref_no", F.array_join(_tokens(F.col("drug"), []), "").alias("ref_form"))
    size = F.length("ref_form")
    names = names.withColumn("k", allowed(size)).withColumn("plain", F.least(allowed(size), F.when(size >= 14, FULL_EDITS).otherwise(PART_EDITS)))
    codes = both.where("drug_code is not null").select("ref_no", F.array_join(_tokens(F.col("drug_code"), []), "").alias("ref_form"), F.lit(0).alias("k"), F.lit(0).alias("plain"))
    return names.union(codes).select("ref_no", "ref_form", F.lit("").alias("ref_head"), F.lit("").alias("ref_tail"), F.lit("full").alias("kind"), "k", "plain")


def map_values(values: DataFrame, reference: DataFrame, forms) -> DataFrame:
    """(value, ref_no) for each distinct non-null value of column ``value``; ref_no is 0 where no entry is meant.

    The reading with the fewest edits holds, a whole name before an abbreviated one; when two entries are equally near,
    none is meant. An empty reference matches nothing, an empty text has no reading. An abbreviated genus must begin the
    entry's genus.
    """
    values = write_shared(values.where("value is not null").select("value").distinct(), "values")
    reference = write_shared(reference, "reference")
    read = write_shared(values.select("value", F.explode(forms(F.col("value"))).alias("f")).select("value", "f.form", "f.head", "f.tail", "f.kind").distinct(), "readings")
    near = pigeonhole_join(read, reference)
    hit = read.join(near, ["form", "kind"]).join(reference.select("ref_no", "ref_form", "ref_head", "ref_tail", "kind", "plain"), ["ref_form", "kind"])
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    hit = hit.where((F.col("edits") <= F.col("plain")) | (letters("form") == letters("ref_form")))
    # A word alone may be genus and epithet in one, but not if it is as near to the genus alone; of two words each must be near its own.
    near_word = lambda a, b: F.levenshtein(a, b) <= allowed(F.least(F.length(a), F.length(b)))
    joined = F.col("head").isNull() & ((F.col("ref_head") == "") | (F.col("edits") < F.levenshtein("form", "ref_head")))
    two = F.col("head").isNotNull() & (F.col("edits") == 0) | (near_word("head", "ref_head") & near_word("tail", "ref_tail"))
    hit = hit.where(F.when(F.col("kind") == "full", joined | F.coalesce(two, F.lit(False))).otherwise(F.startswith("ref_head", "head")))
    rank = F.min(F.struct(F.when(F.col("kind") == "full", 0).otherwise(1).alias("kind"), "edits"))
    hit = write_shared(hit.groupBy("value", "ref_no").agg(rank.alias("rank")), "hits")
    best = hit.groupBy("value").agg(F.min("rank").alias("rank"))
    ties = hit.join(best, ["value", "rank"]).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("ref_no").alias("ref_no"))
    matched = write_shared(ties.where("n = 1").select("value", "ref_no"), "matched")
    missed = values.join(matched, "value", "left_anti").select("value", F.lit(0).cast("bigint").alias("ref_no"))
    return matched.union(missed)


def map_rows(rows: DataFrame, literal: DataFrame, mapping: DataFrame) -> DataFrame:
    """(row_no, ref_no) of rows whose ``value`` is neither null nor literally in ``literal.value``."""
    open_ = rows.where("value is not null").join(literal.where("value is not null").distinct(), "value", "left_anti")
    return open_.join(mapping, "value").select("row_no", "ref_no")


def species_of(values: DataFrame, species_ref: DataFrame) -> DataFrame:
    """(value, ref_no) for typed organisms; literal names map to their entry like any other value."""
    return map_values(values, species_reference(species_ref), species_forms)


def drug_of(values: DataFrame, drug_ref: DataFrame) -> DataFrame:
    """(value, ref_no) for typed drugs."""
    return map_values(values, drug_reference(drug_ref), drug_forms)
