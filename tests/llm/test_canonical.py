from pyspark.sql import functions as F

from peakforge.llm import canonical


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_pigeonhole_join_equals_all_pairs(spark):
    import random

    rnd = random.Random(3)
    ref = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 12))) for _ in range(40)]
    forms = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    for r in ref[:20]:
        s = list(r)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(s))
            s[at : at + 1] = rnd.choice([[], ["a"], [s[at], "b"]])
            s = s or ["a"]
        forms.append("".join(s))
    values = spark.createDataFrame([(f, "full") for f in forms + ["", ref[0]]], "form string, kind string")
    reference = spark.createDataFrame([(r, "full", 3) for r in ref], "ref_form string, kind string, k int")
    got = {(r["form"], r["ref_form"]): r["edits"] for r in canonical.pigeonhole_join(values, reference).collect()}
    want = {(f, r): d for f in set(forms) | {"", ref[0]} for r in set(ref) if (d := lev(f, r)) <= 3}
    assert got == want


SPECIES = [(1, "Alphabacter betaensis", None), (2, "Alphabacter gammacola", "Oldbacter gammacola"), (3, "Deltacoccus betanii", None), (4, "Deltaspira omegina", None)]


def test_species_readings(spark):
    ref = spark.createDataFrame(SPECIES, "species_no int, species string, former_name string")
    cases = {
        "Alphabacter betaensis": 1, " ALPHABACTER  BETAENSIS ": 1, "alphabacter betaensis": 1, "betaensis, Alphabacter": 1, "Alphabacterbetaensis": 1, "A. betaensis": 1, "Alp betaensis": 1,
        "prob. Alphabacter cf. betaensis (strain 12)": 1, "Alphabacter betaensis subsp. betaensis": 1, "A1phabacter betaen5is": 1, "Álphabacter betáensis": 1, "Alphabatcer betaesnis": 1, "A. ebtaesnis": 1,
        "Oldbacter gammacola": 2, "O. gammacola": 2, "D. betanii": 3, "Alphabacter": 0, "Alphabacter sp.": 0, "Alphabacter zetathetaina": 0, "no growth": 0, "???": 0, "": 0, "x" * 5000: 0, "B. omegina": 0,
    }
    v = spark.createDataFrame([(c,) for c in cases] * 2 + [(None,)], "value string")
    got = {r["value"]: r["ref_no"] for r in canonical.species_of(v, ref).collect()}
    assert got == cases
    assert canonical.species_of(v.limit(0), ref).count() == 0
    assert {r["ref_no"] for r in canonical.species_of(v, ref.limit(0)).collect()} == {0}


def test_equally_near_entries_are_unmatched(spark):
    ref = spark.createDataFrame([(1, "Alphabacter betaensis", None), (2, "Alphabacter betaensus", None)], "species_no int, species string, former_name string")
    v = spark.createDataFrame([("Alphabacter betaensos",), ("Alphabacter betaensus",)], "value string")
    assert {r["value"]: r["ref_no"] for r in canonical.species_of(v, ref).collect()} == {"Alphabacter betaensos": 0, "Alphabacter betaensus": 2}


def test_drug_readings(spark):
    ref = spark.createDataFrame([(1, "Penifloxacin", "PEN"), (2, "Penifloxacin-clavutam", "PCL"), (3, "Kipenem", "KIP")], "drug_no int, drug string, drug_code string")
    cases = {
        "penifloxacin": 1, "Penifloxacin iv": 1, "Penifloxacin (oral)": 1, "Penifloxacin2,3": 1, "Penifloxacin*": 1, "PEN": 1, "pen": 1, "Penifloxcain": 1, "Pneifloxcain": 1, "Penifloxacin p.o.": 1, "Kipenme": 3,
        "Penifloxacin/clavutam": 2, "Penifloxacin + clavutam": 2, "Penifloxacin and clavutam": 2, "Penifloxacinclavutam high dose": 2, "Penifloxacin-otherbactam": 0, "-": 0, "see notes": 0, "": 0,
    }
    v = spark.createDataFrame([(c,) for c in cases], "value string")
    assert {r["value"]: r["ref_no"] for r in canonical.drug_of(v, ref).collect()} == cases


def test_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "b", "x")], "row_no bigint, value string, ref_no string")
    literal = spark.createDataFrame([("a",), (None,)], "value string")
    mapping = spark.createDataFrame([("a", 5), ("b", 0)], "value string, ref_no bigint")
    out = canonical.map_rows(rows.select("row_no", "value"), literal, mapping)
    assert sorted(tuple(r) for r in out.collect()) == [(2, 0), (4, 0)]


def test_found_on_small_tables(spark, data):
    from peakforge.llm.queries import R

    got = R.queries["p4_found"](spark, data)
    assert got.columns == ["field", "row_no", "ref_no"]
    n = {r["field"]: r["count"] for r in got.groupBy("field").count().collect()}
    t = spark.read.parquet(f"{data}/breakpoint_table.parquet").join(spark.read.parquet(f"{data}/drug_ref.parquet"), "drug", "left_anti").where(F.col("drug").isNotNull()).count()
    assert n["breakpoint_table.drug"] == t


def test_short_words_and_a_genus_alone(spark):
    ref = spark.createDataFrame([(1, "Escherichia coli", None), (2, "Escherichia albertii", None), (3, "Enterococcus avium", None), (4, "Ba vu", None)], "species_no int, species string, former_name string")
    cases = {
        "Escherichia coli": 1, "E. coli": 1, "E coli": 1, "e.coli": 1, "coli Escherichia": 1, "Eschericia coli": 1, "Escherichiacoli": 1, "Escherichiacol": 1, "Escherichia": 0, "Escherichia sp.": 0, "Escherichia xyz": 0, "Escherichiaxyz": 0,
        "E. cola": 0, "E. avium": 3, "E. avius": 3, "Enterococcus avius": 3, "Enterococcus avi": 0, "Escherichia albertii": 2, "Escherichia albretti": 2, "albertii": 0, "coli": 0, "Enterococcus": 0,
    }
    v = spark.createDataFrame([(c,) for c in cases], "value string")
    assert {r["value"]: r["ref_no"] for r in canonical.species_of(v, ref).collect()} == cases
    drugs = spark.createDataFrame([(1, "Fusi", "FU"), (2, "Colin", None), (3, "Penifloxacin", "PEN")], "drug_no int, drug string, drug_code string")
    cases = {"Fusi": 1, "fusi": 1, "FU": 1, "Fusa": 0, "isuF": 0, "Colin": 2, "Coli": 2, "Colan": 2, "Cocan": 0, "Penifloxacin": 3, "Peniflxacin": 3}
    v = spark.createDataFrame([(c,) for c in cases], "value string")
    assert {r["value"]: r["ref_no"] for r in canonical.drug_of(v, drugs).collect()} == cases


def test_pigeonhole_join_keeps_short_references(spark):
    values = spark.createDataFrame([("ab", "full"), ("a", "full"), ("", "full"), ("abc", "full")], "form string, kind string")
    reference = spark.createDataFrame([("ab", "full", 4), ("c", "full", 4), ("", "full", 4)], "ref_form string, kind string, k int")
    got = {(r["form"], r["ref_form"]): r["edits"] for r in canonical.pigeonhole_join(values, reference).collect()}
    assert got == {("ab", "ab"): 0, ("a", "ab"): 1, ("abc", "ab"): 1}
