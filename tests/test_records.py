"""CSV files with line breaks in fields, cut into many splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from buildlens.sources import files, records

HEADER = ["build_failed", "gh_sloc", "note", "git_branch"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _rows(seed, count, end="\n"):
    rng = random.Random(seed)
    notes = ["plain", 'with "quotes"', "two\nlines", 'a,b\n\n"c"\n,', "\n", "x" * 150 + "\n" + "y" * 300, ""]
    return [[str(rng.randint(0, 1)), str(i), rng.choice(notes).replace("\n", end), "main"] for i in range(count)]


def _write(path, rows, end="\n"):
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator=end)
    writer.writerows([HEADER, *rows])
    path.write_bytes(text.getvalue().encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_read_like_a_whole_file(spark, tmp_path, small_splits, end):
    expected = {}
    for i in range(3):
        folder = tmp_path / f"p {i}"
        folder.mkdir()
        rows = _rows(i, 60, end)
        _write(folder / "a.csv", rows, end)
        expected[f"p {i}"] = rows
    # a file without breaks takes the plain way
    _write(tmp_path / "plain.csv", [["1", "7", "no breaks", "main"]])
    paths = [r["path"] for r in files.list_files(spark, str(tmp_path)).collect()]
    assert len(records.paths_with_breaks(spark, paths)) == 3
    assert records.lines_of(spark, paths).select("path", "block").distinct().count() > 60
    got = files._read_text(spark, HEADER, paths, corrupt=True).collect()
    for name, rows in expected.items():
        mine = sorted(([r[c] or "" for c in HEADER] for r in got if r["_folder"] == name),
                      key=lambda r: int(r[1]))
        assert mine == rows
    assert sum(r["_file"] == "plain.csv" for r in got) == 1
    assert all(r["_corrupt_record"] is None for r in got)


def test_scans_keep_fields_with_breaks(spark, tmp_path, small_splits):
    rows = _rows(5, 40)
    _write(tmp_path / "a.csv", rows)
    read, rejected = files.scan_project_dir(spark, str(tmp_path))
    assert read.count() == 40 and rejected.count() == 0
    assert read.agg(F.sum("gh_sloc")).first()[0] == sum(range(40))


def test_malformed_and_unclosed_records(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(
        'a,b\n1,"two\nlines"\n1,2,3\n4\n5,a 6" disk\n7,"8"\n9,"never closed\n10,11\n12,13\n')
    (tmp_path / "b%41 c.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "d%41 e.csv").write_text("a,b\n1,\"2\n3\"\n")
    got = {r["file"]: (r["rows"], r["malformed"]) for r in
           files.malformed_rows(spark, str(tmp_path)).collect()}
    assert got["b%41 c.csv"] == (2, 1) and got["d%41 e.csv"] == (1, 0)
    # the unclosed field's line is a record of its own, so are the two after it
    assert got["a.csv"][0] == 8 and got["a.csv"][1] >= 2
    paths = [r["path"] for r in files.list_files(spark, str(tmp_path)).collect()]
    rows = {(r["a"], r["b"]) for r in files._read_text(spark, ["a", "b"], paths).collect()}
    assert {("1", "two\nlines"), ("5", 'a 6" disk'), ("7", "8"), ("10", "11"), ("12", "13")} <= rows


def test_folders_of_equal_names_are_counted_apart(spark, tmp_path):
    for parent, count in (("x", 2), ("y", 5)):
        (tmp_path / parent / "same").mkdir(parents=True)
        _write(tmp_path / parent / "same" / "a.csv", [["1", "7", "two\nlines", "main"]] * count)
    inventory, total = files.file_inventory(spark, str(tmp_path))
    assert [(r["folder"], r["file"], r["rows"]) for r in inventory.collect()] == [
        ("same", "a.csv", 5), ("same", "a.csv", 2)]
    assert total.first()[0] == 7


def test_the_stored_table_has_no_empty_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = [files.source_name("job", c) for c in ("tr_build_id", "gh_sloc", "gh_team_size")]
    (tmp_path / "in" / "a.csv").write_text(",".join(names) + "\n1,,3\n2,,4\n")
    out = str(tmp_path / "out")
    combined = files.combine_sources(spark, str(tmp_path / "in"), out)
    assert combined.columns == spark.read.parquet(out).columns
    assert "gh_sloc" not in combined.columns and combined.count() == 2
