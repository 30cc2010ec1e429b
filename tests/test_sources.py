import os
import tempfile

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from mixscore.operators.groups import group_ordinals
from mixscore.sources.measurements import MEASUREMENT_SCHEMA, MISSING_TEXTS, scan_measurements
from mixscore.streaming import score_stream
from mixscore.plans import fit_profile_pca, score_rows

HEADER = ",".join(f'"{n}"' for n in MEASUREMENT_SCHEMA.names)


def write_csv(path, header, lines):
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_csv_scan_types_and_missing_texts(spark, tmp_path):
    lines = [f'{i},n{i},{s},{i}.5,300,400,,NA' for i, s in enumerate(["Water", "NA", "n/a", '""', "", "DMF/Water", "NAN"])]
    df = scan_measurements(spark, write_csv(tmp_path / "m.csv", HEADER, lines), fmt="csv")
    assert df.columns == MEASUREMENT_SCHEMA.names
    assert [f.dataType for f in df.schema] == [f.dataType for f in MEASUREMENT_SCHEMA]
    rows = df.orderBy("row_id").collect()
    assert [r["Solvent"] for r in rows] == ["Water", None, None, None, None, "DMF/Water", "NAN"]
    assert (rows[3]["Quantum yield(%)"], rows[3]["particle size(nm)"], rows[3]["stoke (nm)"]) == (3.5, None, None)
    assert "" in MISSING_TEXTS


def test_csv_header_must_match(spark, tmp_path):
    path = write_csv(tmp_path / "m.csv", HEADER.replace("Solvent", "Liquid"), ["1,a,Water,1,2,3,4,5"])
    with pytest.raises(Exception, match="(?i)header"):
        scan_measurements(spark, path, fmt="csv").collect()


def test_row_ids_are_assigned_once(spark, tmp_path):
    lines = [f"n{i},Water,1,2,3,4,5" for i in range(50)]
    path = write_csv(tmp_path / "m.csv", HEADER.replace('"row_id",', ""), lines)
    df = scan_measurements(spark, path, fmt="csv", add_row_id=True)
    first = {r["Name"]: r["row_id"] for r in df.collect()}
    assert len(set(first.values())) == 50
    assert {r["Name"]: r["row_id"] for r in df.repartition(3).collect()} == first
    assert sorted(first, key=first.get) == [f"n{i}" for i in range(50)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_other_formats(spark, part_measurements, tmp_path, fmt):
    path = str(tmp_path / fmt)
    part_measurements.write.format(fmt).save(path)
    back = scan_measurements(spark, path, fmt=fmt)
    assert back.columns == part_measurements.columns
    assert back.exceptAll(part_measurements).count() == 0


def test_missing_columns_are_named(spark, part_measurements, tmp_path):
    part_measurements.drop("Name", "row_id").write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="row_id, Name"):
        scan_measurements(spark, str(tmp_path / "m"))


def test_row_ids_follow_file_names_not_sizes(spark, tmp_path):
    header = HEADER.replace('"row_id",', "")
    for name, solvent, n in (("1", "Water", 3), ("2", "DMF", 400), ("3", "THF", 40)):
        write_csv(tmp_path / f"{name}.csv", header, [f"{solvent}{i},{solvent},1,2,3,4,5" for i in range(n)])
    before = sorted(tmp_path.parent.iterdir())
    df = scan_measurements(spark, str(tmp_path), fmt="csv", add_row_id=True)
    rows = df.orderBy("row_id").collect()
    assert [r["Name"] for r in rows] == [f"{s}{i}" for s, n in (("Water", 3), ("DMF", 400), ("THF", 40)) for i in range(n)]
    firsts = group_ordinals(df, "Solvent", "row_id").orderBy("ordinal").collect()
    assert [r["Solvent"] for r in firsts] == ["Water", "DMF", "THF"]
    assert sorted(tmp_path.parent.iterdir()) == before


def test_row_ids_of_split_files(spark, tmp_path):
    header = HEADER.replace('"row_id",', "")
    write_csv(tmp_path / "b.csv", header, [f"b{i},Water,1,2,3,4,5" for i in range(3000)])
    write_csv(tmp_path / "a.csv", header, [f"a{i},DMF,1,2,3,4,5" for i in range(2000)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = scan_measurements(spark, str(tmp_path), fmt="csv", add_row_id=True).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r["Name"] for r in rows] == [f"a{i}" for i in range(2000)] + [f"b{i}" for i in range(3000)]


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_row_ids_are_gapless_however_files_are_split(spark, part_measurements, tmp_path, fmt):
    rows = part_measurements.drop("row_id").withColumn("n", F.monotonically_increasing_id())
    for i, (low, high) in enumerate(((0, 3), (3, 40), (40, 41), (41, 200))):
        part = rows.where(F.col("n").between(low, high - 1)).drop("n").coalesce(1)
        part.write.format(fmt).option("header", True).save(str(tmp_path / "parts" / str(i)))
    names = sorted(p for p in (tmp_path / "parts").rglob("part-*"))
    folder = tmp_path / "all"
    folder.mkdir()
    for i, name in enumerate(names):
        (folder / f"{i}.{fmt}").write_bytes(name.read_bytes())
    found, size = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for limit in ("300", "2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            scanned = scan_measurements(spark, str(folder), fmt=fmt, add_row_id=True)
            found.append(sorted((r["row_id"], r["Name"]) for r in scanned.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found[0] == found[1] == found[2]
    assert [i for i, _ in found[0]] == list(range(200))
    assert [n for _, n in found[0]] == [r["Name"] for r in rows.orderBy("n").collect()]


def test_parquet_row_ids_are_gapless(spark, part_measurements, tmp_path):
    path = str(tmp_path / "m")
    part_measurements.drop("row_id").repartitionByRange(4, "Name").sortWithinPartitions("Name").write.parquet(path)
    rows = scan_measurements(spark, path, add_row_id=True).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(200))
    assert [r["Name"] for r in rows] == sorted(r["Name"] for r in rows)


def test_csv_numbers_are_numbers_or_missing(spark, tmp_path):
    path = write_csv(tmp_path / "m.csv", HEADER, ["1,a,Water,1.5,n/a, 3 ,4,5", "2,b,Water,abc,2,3,4,5"])
    df = scan_measurements(spark, path, fmt="csv")
    assert df.where("Name = 'a'").select("`Quantum yield(%)`", "`Ex(nm)`", "`Em(nm)`").first()[:] == (1.5, None, 3.0)
    with pytest.raises(Exception, match=r"column Quantum yield\(%\): not of type double: abc"):
        df.collect()


def test_known_columns_have_their_types(spark, part_measurements, tmp_path):
    path = str(tmp_path / "m")
    part_measurements.withColumns({"Ex(nm)": F.lit(300), "row_id": F.col("row_id").cast("int")}).write.parquet(path)
    df = scan_measurements(spark, path)
    assert dict(df.dtypes)["Ex(nm)"] == "double" and dict(df.dtypes)["row_id"] == "bigint"


def test_a_fit_leaves_no_folder_behind(part_measurements):
    folders = lambda: {e.path for e in os.scandir(tempfile.gettempdir()) if e.is_dir()}
    before = folders()
    model = fit_profile_pca(part_measurements, search=False)
    assert not [f for f in folders() - before if "mixscore" in f or "profiles" in f]
    model.release()
    assert model.profiles.storageLevel == StorageLevel.NONE


def test_stream_scores_equal_batch_scores(spark, part_measurements, part_model, tmp_path):
    path = str(tmp_path / "in")
    part_measurements.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(part_measurements.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = score_stream(stream, part_model).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    batch = score_rows(part_measurements, part_model)
    assert spark.table("scored").exceptAll(batch).count() == 0
    assert spark.table("scored").count() == 200


def test_stream_scoring_refuses_a_batch(part_measurements, part_model):
    with pytest.raises(ValueError):
        score_stream(part_measurements, part_model)
