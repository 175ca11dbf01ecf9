import struct

import pytest
from pyspark.sql import functions as F

from peakforge.operators import filters
from peakforge.operators.pipeline import MzTrimmer, Pipeline, TicNormalizer
from peakforge.sources import bruker, dataset, records, text

PARAMETERS = {"TD": 100, "DELAY": 19000, "DW": 2, "ML1": 5e6, "ML2": 400, "ML3": 0, "BYTORDA": 0}


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "spectra"
    for year, names in (("2015", "ab"), ("2016", "c")):
        (d / year).mkdir(parents=True)
        for i, n in enumerate(names):
            sep = {"a": " ", "b": ";", "c": "\t"}[n]
            lines = ["# mass intensity"] + [f"{2000 + 5 * k:.6f}{sep}{(k % 7) + i:.6f}" for k in range(60)]
            (d / year / f"{n}.txt").write_text("\n".join(lines))
    (d / "2016" / "bad.txt").write_text("nothing here")
    (tmp_path / "meta.csv").write_text("ID,Species,Drug\na,X,R\nb,X,\nc,Y,S\nbad,Y,S\nmissing,Y,S\n")
    return tmp_path


PIPE = Pipeline([("trim", MzTrimmer(2000, 2300)), ("tic", TicNormalizer())])


def test_text_spectra(spark, tree):
    s = {r["spectrum_id"]: r for r in text.read_spectra(spark, str(tree / "spectra")).collect()}
    assert set(s) == {"a", "b", "c", "bad"} and all(len(s[k]["mz"]) == 60 for k in "abc") and s["c"]["mz"][1] == 2005 and s["bad"]["mz"] == []
    assert {r["sample_id"] for r in text.raw_input(spark, str(tree / "spectra")).collect()} == {"a", "b", "c", "bad"}


def test_build_and_load(spark, tree):
    out = str(tree / "out")
    layout = dataset.FlatLayout(str(tree / "spectra"), str(tree / "meta.csv"))
    done = dataset.build(spark, layout, out, "site", PIPE, 10.0)
    assert done["n_spectra"] == 3 and done["n_failed"] == 1 and records.read_manifest(out)["name"] == "site"
    assert [r["spectrum_id"] for r in spark.read.parquet(f"{out}/errors").collect()] == ["bad"]
    one = dataset.load(spark, out, year=2015, drugs=["Drug"])
    assert [r["spectrum_id"] for r in one.spectra.collect()] == ["a"] and sum(one.spectra.first()["intensity"]) == pytest.approx(1)
    binned = spark.read.parquet(f"{out}/stage=binned_30")
    assert binned.count() == 90
    with pytest.raises(ValueError):
        dataset.build(spark, layout, str(tree / "o2"), "x", PIPE, 10.0, on_error="raise")


def test_spectrum_set(spark, tree):
    s = dataset.SpectrumSet.from_directory(spark, str(tree / "spectra"), str(tree / "meta.csv"), ["Drug"], "X", PIPE)
    assert s.matrix(10.0, high=2300.0).select("spectrum_id").distinct().count() == 1
    assert s.filter(filters.species("Y", "Species")).spectra.count() == 1
    assert s.labels().count() == 1 and s.averaged().spectra.count() == 3
    s.to_csv(str(tree / "wide"), 10.0, high=2300.0)
    wide = spark.read.option("header", True).csv(str(tree / "wide"))
    assert wide.columns[:2] == ["spectrum_id", "2000.0"] and wide.count() == 1
    s.save_spectra(str(tree / "saved"))
    assert spark.read.option("header", True).csv(str(tree / "saved")).count() > 0


def test_instrument_directory(spark, tmp_path):
    d = tmp_path / "922" / "0_G10" / "1" / "1SLin"
    (d / "pdata" / "1").mkdir(parents=True)
    (d / "acqus").write_text("".join(f"##${k}= {v}\n" for k, v in PARAMETERS.items()))
    (d / "fid").write_bytes(struct.pack("<100i", *range(-1, 99)))
    (d / "pdata" / "1" / "1r").write_bytes(struct.pack("<100i", *[2 * i for i in range(100)]))
    r = bruker.read_bruker(spark, str(tmp_path), "fid").first()
    assert r["error"] is None and r["intensity"][:3] == [0.0, 0.0, 1.0] and r["spectrum_id"] == "922_0_G10"
    b = (1e12 / 5e6) ** 0.5
    assert r["mz"][0] == pytest.approx(((400 - 19000) / b) ** 2)
    (d / "acqus").write_text("##$TD= 5\n")
    assert "missing" in bruker.read_bruker(spark, str(tmp_path), "1r").first()["error"]


def test_breakpoint_files(spark, tmp_path):
    for v, year in (("9.0", 2019), ("10.0", 2020)):
        (tmp_path / f"t_{v}.yaml").write_text(f"guideline: G\nversion: '{v}'\nyear: {year}\nbreakpoints:\n- {{species: ' A ', drug: D, s_le: 1, r_gt: 2}}\n")
    assert records.read_breakpoints(spark, str(tmp_path)).first()["version"] == "10.0"
    assert records.read_breakpoints(spark, str(tmp_path), year=2019).first()["species"] == "A"
    (tmp_path / "bad.yaml").write_text("breakpoints:\n- {species: A, drug: D, s_le: 3, r_gt: 2}\n")
    with pytest.raises(ValueError):
        records.read_breakpoints(spark, str(tmp_path / "bad.yaml"))


def test_years_and_columns(spark):
    df = spark.createDataFrame([("2015-03-01",), ("2015",), ("2016/1/2",), ("x2015",), (None,)], "d string")
    assert [r[0] for r in df.select(records.year_of(F.col("d"))).collect()] == [2015, 2015, 2016, None, None]
    assert records.id_column(["x", "code"]) == "code" and records.species_column(["SPECIES"]) == "SPECIES"


def test_command_line(spark, tree, capsys):
    from peakforge import cli

    assert cli.main(["build", "-s", str(tree / "spectra"), "-m", str(tree / "meta.csv"), "-o", str(tree / "o"), "-b", "500"]) == 0
    assert cli.main(["quality", "-i", str(tree / "spectra"), "-o", str(tree / "q")]) == 0
    assert spark.read.option("header", True).csv(str(tree / "q")).count() == 3


def test_streaming_windows(spark, tmp_path):
    from peakforge.streaming import drift

    rows = [(i, f"2024-01-{1 + i % 28:02d} 00:00:00", b, float(b + i)) for i in range(40) for b in range(3)]
    df = spark.createDataFrame(rows, "spectrum_no bigint, ts string, bin_index int, intensity double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = drift.window_means(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), days=10)
    q = s.writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in drift.window_means(df, days=10).collect()}
    assert {tuple(r) for r in spark.table("means").collect()} == want
    ref = df.groupBy("bin_index").agg(F.avg("intensity").alias("reference"))
    assert drift.distances(spark.table("means"), ref).count() == len({r[0] for r in want})
