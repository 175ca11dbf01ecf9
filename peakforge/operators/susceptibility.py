"""MIC strings, breakpoints and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: an optional qualifier and a number with decimal point or comma.
MIC = r"^\s*([<>]=?|=)?\s*([0-9]+[,.]?[0-9]*)\s*$"
# Spellings of the categories.
RESISTANT = ["R", "r", "resistant", "Resistant"]
SUSCEPTIBLE = ["S", "s", "susceptible", "Susceptible"]
INTERMEDIATE = ["I", "i", "intermediate", "Intermediate"]


def mic_value(mic: Column) -> Column:
    """The number as double, null if the text is no MIC."""
    return F.when(mic.rlike(MIC), F.replace(F.regexp_extract(mic, MIC, 2), F.lit(","), F.lit(".")).cast("double"))


def mic_qualifier(mic: Column) -> Column:
    """``=``, ``<``, ``<=``, ``>``, ``>=``; empty where the text is no MIC."""
    q = F.regexp_extract(mic, MIC, 1)
    return F.when(~F.coalesce(mic.rlike(MIC), F.lit(False)), "").when(q == "", "=").otherwise(q)


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def breakpoints(table: DataFrame, order: str = "row_no") -> DataFrame:
    """(species_key, drug_key, s_le, r_gt, atu_low, atu_high, source): of duplicate keys the last row holds."""
    keyed = table.where("species is not null and drug is not null").withColumn("species_key", _key(F.col("species"))).withColumn("drug_key", _key(F.col("drug")))
    last = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("species_key", "drug_key").orderBy(F.desc(order)))).where("_r = 1")
    return last.select("species_key", "drug_key", "s_le", "r_gt", "atu_low", "atu_high", "source")


def in_atu(mic: Column) -> Column:
    """Area of technical uncertainty: one value if there is no upper limit, else a closed range; independent of the category."""
    return F.coalesce(F.when(F.col("atu_low").isNull(), F.lit(False)).when(F.col("atu_high").isNull(), mic == F.col("atu_low")).otherwise(mic.between(F.col("atu_low"), F.col("atu_high"))), F.lit(False))


def categorised(rows: DataFrame, table: DataFrame, species: str = "species", drug: str = "drug", mic: str = "mic_value") -> DataFrame:
    """Adds category (S, I, R), atu and source. Unknown pairs give nulls, a null MIC a null category but the source.

    The breakpoint table is made unique first, so no row is multiplied; it is a dimension of bounded size that the
    planner broadcasts by its own threshold.
    """
    b = breakpoints(table)
    joined = rows.join(b, (_key(F.col(species)) == b["species_key"]) & (_key(F.col(drug)) == b["drug_key"]), "left")
    m = F.col(mic)
    category = F.when(m <= F.col("s_le"), "S").when(m > F.col("r_gt"), "R").when(m.isNotNull() & F.col("s_le").isNotNull(), "I")
    return joined.select(*[rows[c] for c in rows.columns], category.alias("category"), F.when(F.col("species_key").isNotNull(), in_atu(m)).alias("atu"), F.col("source"))


def encoded(rows: DataFrame, table: DataFrame | None, mic: str = "mic", species: str = "species", drug: str = "drug") -> DataFrame:
    """Adds log2_mic (null if not positive), censored, category, atu, source."""
    v = rows.withColumn("mic_value", mic_value(F.col(mic)))
    v = v.withColumn("log2_mic", F.when(F.col("mic_value") > 0, F.log2("mic_value"))).withColumn("censored", mic_qualifier(F.col(mic)).isin("<", "<=", ">", ">="))
    if table is None:
        return v.withColumns({"category": F.lit(None).cast("string"), "atu": F.lit(None).cast("boolean"), "source": F.lit(None).cast("string")})
    return categorised(v, table, species, drug)


def label(value: Column, intermediate: str = "susceptible") -> Column:
    """1 resistant, 0 susceptible; I as 0 (susceptible), 1 (resistant) or null (nan); null stays null, anything else is an error."""
    i = {"susceptible": F.lit(0), "resistant": F.lit(1), "nan": F.lit(None).cast("int"), "drop": F.lit(None).cast("int")}[intermediate]
    wrong = F.raise_error(F.concat(F.lit("not a category: "), value)).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(value.isin(RESISTANT), 1).when(value.isin(SUSCEPTIBLE), 0).when(value.isin(INTERMEDIATE), i).otherwise(wrong)


def labelled(rows: DataFrame, column: str, intermediate: str = "susceptible") -> DataFrame:
    """Adds ``label``; with ``drop`` the intermediate rows are left out."""
    kept = rows.where(~F.coalesce(F.col(column).isin(INTERMEDIATE), F.lit(False))) if intermediate == "drop" else rows
    return kept.withColumn("label", label(F.col(column), intermediate))
