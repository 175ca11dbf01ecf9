"""Staged and recorded layouts, peak sets on disk, text outputs."""

import struct

import pytest
from pyspark.sql import functions as F

from peakforge import cli
from peakforge.operators.pipeline import Pipeline
from peakforge.sources import dataset, layouts, peaksets, records


def spectrum_text(top, n=30):
    return "".join(f"{2000 + 600 * i} {top if i == n // 2 else 1}\n" for i in range(n))


@pytest.fixture()
def staged(tmp_path):
    for stage, year, names in (("preprocessed", "2019", ["a", "b_MALDI1"]), ("preprocessed", "2020", ["c", "a"]), ("raw", "2019", ["a"])):
        for n in names:
            p = tmp_path / stage / year / f"{n}.txt"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(spectrum_text(10))
    for n in ("a", "c"):
        p = tmp_path / "binned_10" / f"{n}.txt"
        p.parent.mkdir(exist_ok=True)
        p.write_text("bin_index binned_intensity\n" + "".join(f"{i} {float(i)}\n" for i in range(10)))
    for year, body in (("2019", "code,Species,Drugin\na,E x,R\nb,E y,\n"), ("2020", "code,Species,Other\nc,E x,S\na,E z,S\n")):
        p = tmp_path / "id" / year / f"{year}_clean.csv"
        p.parent.mkdir(parents=True)
        p.write_text(body)
    return tmp_path


def test_stage_choice():
    assert layouts.stage_of(["raw/", "binned_6000/", "binned_600/", "preprocessed/", "binned_9.txt"]) == "binned_6000"
    assert layouts.stage_of(["raw/", "preprocessed/"]) == "preprocessed" and layouts.stage_of(["raw/"]) == "raw"
    with pytest.raises(FileNotFoundError):
        layouts.stage_of(["id/"])


def test_staged_layout(spark, staged):
    lay = layouts.StagedLayout(str(staged))
    got = {r["spectrum_id"]: r for r in lay.spectra(spark).collect()}
    assert set(got) == {"a", "c"} and got["a"]["mz"] == [2000.0 + 2000.0 * i for i in range(10)]
    lay = layouts.StagedLayout(str(staged), stage="preprocessed", collapse_replicates=True, normalise_tic=True)
    got = {r["spectrum_id"]: r for r in lay.spectra(spark).collect()}
    assert set(got) == {"a", "b", "c"} and "2019" in got["a"]["path"] and sum(got["b"]["intensity"]) == pytest.approx(1.0)
    meta = {r["spectrum_id"]: r for r in lay.metadata(spark).collect()}
    assert set(meta) == {"a", "b", "c"} and meta["c"]["species"] == "E x" and meta["c"]["Drugin"] is None
    only = layouts.StagedLayout(str(staged), stage="preprocessed", year=2020)
    assert {r["spectrum_id"] for r in only.spectra(spark).collect()} == {"a", "c"} == {r["spectrum_id"] for r in only.metadata(spark).collect()}
    assert {r["spectrum_id"] for r in layouts.StagedLayout(str(staged), stage="preprocessed", duplicates="drop").spectra(spark).collect()} == {"b_MALDI1", "c"}
    s = dataset.load_layout(spark, lay, "E x", ["Other"])
    assert {r["spectrum_id"] for r in s.spectra.collect()} == {"c"}
    with pytest.raises(FileNotFoundError):
        layouts.StagedLayout(str(staged), stage="preprocessed", year=1999).spectra(spark)
    with pytest.raises(FileNotFoundError):
        layouts.StagedLayout(str(staged), metadata_dir="none").metadata(spark)


def instrument_folder(folder, values):
    folder.mkdir(parents=True)
    keys = {"TD": len(values), "DELAY": 18000, "DW": 2, "ML1": 6e6, "ML2": 300, "ML3": 0, "BYTORDA": 0}
    (folder / "acqus").write_text("".join(f"##${k}= {v}\n" for k, v in keys.items()))
    (folder / "pdata/1").mkdir(parents=True)
    (folder / "pdata/1/1r").write_bytes(struct.pack(f"<{len(values)}i", *values))


def test_recorded_layout(spark, tmp_path):
    root = tmp_path / "site" / "data"
    instrument_folder(root / "2020" / "s1" / "0_A1" / "1", [1, 2, 3])
    instrument_folder(root / "2020" / "s2" / "0_A2" / "1", [4, 5, 6])
    csv = tmp_path / "meta.csv"
    csv.write_text("Identifier,Path,Target,Year,Species\ns1,site/data/2020/s1,A1,2020,E x\ns2,./2020\\s2/0_A2,A2,2020,E y\ns3,2020/none,A3,2021,E z\n")
    lay = layouts.RecordedLayout(str(root), str(csv), position_column="Target")
    got = {r["spectrum_id"]: r["intensity"] for r in lay.spectra(spark).collect()}
    assert got == {"s1_A1": [1.0, 2.0, 3.0], "s2_A2": [4.0, 5.0, 6.0]}
    assert {r["spectrum_id"] for r in layouts.RecordedLayout(str(root), str(csv), year=2021).metadata(spark).collect()} == {"s3"}
    with pytest.raises(ValueError, match="Nothing"):
        layouts.RecordedLayout(str(root), str(csv), path_column="Nothing").metadata(spark)


def test_paths_below_a_root(spark):
    cases = {"2020/s1": "/x/site/data/2020/s1", "data/2020/s1": "/x/site/data/2020/s1", "site/data/s": "/x/site/data/s", "./a\\b/": "/x/site/data/a/b", "/full/p": "/full/p", "hdfs://n/p": "hdfs://n/p", "data": "/x/site/data", "database/q": "/x/site/data/database/q", None: None}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r["p"]: r["o"] for r in df.select("p", layouts.below("/x/site/data", F.col("p")).alias("o")).collect()} == cases


def test_peak_sets_on_disk(spark, staged, tmp_path):
    where, plain = str(tmp_path / "cache"), Pipeline([])
    how = {"ids": spark.createDataFrame([("a",), ("c",)], "spectrum_id string"), "pipeline": plain, "k": 3}
    first = peaksets.from_directory(spark, f"{staged}/preprocessed", cache=where, **how)
    assert {r["spectrum_id"]: r["mz"] for r in first.collect()} == {"a": [11000.0], "c": [11000.0]}
    names = layouts.children(spark, where)
    again = peaksets.from_directory(spark, f"{staged}/preprocessed", cache=where, **how)
    assert again.count() == 2 and layouts.children(spark, where) == names and len(names) == 1
    peaksets.from_directory(spark, f"{staged}/preprocessed", cache=where, **{**how, "k": 2})
    assert len(layouts.children(spark, where)) == 2
    peaksets.save(first, str(tmp_path / "kept"))
    assert peaksets.load(spark, str(tmp_path / "kept")).count() == 2
    spark.range(2).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        peaksets.load(spark, str(tmp_path / "other"))


def test_text_outputs(spark, tmp_path):
    s = spark.createDataFrame([("a", [2000.0, 2003.5], [0.1, 1 / 3])], "spectrum_id string, mz array<double>, intensity array<double>")
    dataset.write_text(s, str(tmp_path / "raw"))
    dataset.write_text(s, str(tmp_path / "binned"), binned=True)
    lines = lambda p: [x for f in sorted((tmp_path / p / "spectrum_id=a").glob("part*")) for x in f.read_text().splitlines()]
    assert lines("raw") == ["2000.000000 0.100000", "2003.500000 0.333333"]
    assert lines("binned") == ["bin_index binned_intensity", "0 0.1", f"1 {1 / 3!r}"]
    held = dataset.SpectrumSet(s, s.select("spectrum_id"))
    held.save_spectra(str(tmp_path / "b"), "txt", "binned", 3.0)
    assert len(lines("b")) == 6001
    with pytest.raises(ValueError):
        held.save_spectra(str(tmp_path / "c"), stage="odd")


def test_manifest_round_trip(spark, tmp_path):
    records.write_manifest(str(tmp_path / "new"), {"name": "n", "stages": ["raw"]})
    assert records.read_manifest(f"file://{tmp_path}/new")["name"] == "n" and records.read_manifest(str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        records.read_manifest(str(tmp_path), missing_ok=False)


def test_command_line_matrix_and_spectra(spark, staged, tmp_path):
    out = tmp_path / "m"
    assert cli.main(["preprocess", "-i", f"{staged}/raw", "-o", str(out), "--format", "csv", "-b", "600", "--save-spectra-dir", str(tmp_path / "s"), "-p", _plain(tmp_path)]) == 0
    wide = spark.read.option("header", True).csv(str(out))
    assert wide.count() == 1 and len(wide.columns) == 31
    assert (tmp_path / "s" / "spectrum_id=a").is_dir()
    assert cli.main(["quality", "-i", f"{staged}/raw", "-o", str(tmp_path / "q")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).first()["peak_count"] == "1"


def _plain(tmp_path):
    from peakforge.operators.pipeline import MzTrimmer

    p = tmp_path / "pipe.json"
    Pipeline([("cut", MzTrimmer(2000.0, 20000.0))]).save(str(p))
    return str(p)


