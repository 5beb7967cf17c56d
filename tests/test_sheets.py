from datetime import date

import pytest

from hydrolake.operators.cleaning import coerce_numeric
from hydrolake.plans import preprocessing
from hydrolake.sources import monitoring, sheets

FILES = {
    "a.csv": "date,station_code,DO,BOD,COD,AN,SS,pH\n2020-01-01,S01,5,1,2,3,4,7\n2020-01-02,S01,,1,2,3,4,7\n",
    "b file+1.csv": '﻿SMP-DAT,ID STN BARU,LOCATION,SUNGAI,"DO mg/l",TSS,"SS mg/l"\n"2020-01-01"," S02 ","Jambatan, lama",klang,6,10,99\n',
    "deep/c.csv": "pH,DO\n7.5,1\n\n8.5,3\n",
    "deep/d.csv": "date,station,WQI,Status,DO,extra\n2020-01-01,S01,55.5,ok,9,x,too,many\n2020-01-01,S03,,,n/a\n",
    "empty.csv": "",
    "only_header.csv": "date,DO\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_as_each_sheet_alone(spark, folder):
    got = sheets.read_sheets(spark, str(folder))
    rows = sorted(tuple(r) for r in got.select("_ord.file", *[c for c in got.columns if c != "_ord"]).fillna("?").collect())
    want = []
    for name in FILES:
        if name == "empty.csv":
            continue
        one = monitoring.load_sheet(spark, str(folder / name))
        for r in one.select("_ord.file", *[c for c in one.columns if c != "_ord"]).fillna("?").collect():
            d = r.asDict()
            want.append(tuple(d.get(c) if c in d or c == "date" else "?" for c in ["file", *[c for c in got.columns if c != "_ord"]]))
    assert len(rows) == 7 and [x[:5] for x in rows] == [x[:5] for x in sorted(want)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_registry_picks_files_whatever_their_spelling(spark, folder):
    registry = spark.createDataFrame(
        [(7, str(folder / "b file+1.csv")), (8, (folder / "deep/d.csv").as_uri()), (9, "/nowhere.csv")], "dataset_id long, file_path string"
    )
    got = sheets.read_sheets(spark, str(folder), registry).orderBy("_ord").collect()
    assert [(r.dataset_id, r.station_code, r.station_name, r.river_name, r.do_, r.tss) for r in got] == [
        (7, "S02", "Jambatan, lama", "Sungai Klang", "6", "10"),
        (8, "S01", "S01", "Sungai Klang", "9", None),
        (8, "S03", "S03", "Sungai Pinang", "n/a", None),
    ]


def test_header_with_line_break(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"SMP-DAT","BOD\nmg/l","ID STN BARU"\n2020-01-01,2.5,"S0\n4"\n')
    row = sheets.read_sheets(spark, str(tmp_path), multiline=True).first()
    assert (row.date, row.bod, row.station_code) == (date(2020, 1, 1), "2.5", "S0\n4")


def test_listed_order_and_globs(spark, tmp_path):
    for name, value in (("z/1.csv", 1), ("z/2.csv", 2), ("a/1.csv", 3), ("m.csv", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"date,DO\n2020-01-01,{value}\n")
    both = sheets.read_many(spark, [f"{tmp_path}/z", f"{tmp_path}/?/1.csv", f"file:{tmp_path}/m.csv"])
    assert [r.do_ for r in both.orderBy("_ord").collect()] == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        sheets.read_many(spark, [])


def test_jobs_do_not_follow_the_files(spark, tmp_path):
    def jobs(n):
        root = tmp_path / str(n)
        root.mkdir()
        for i in range(n):
            (root / f"{i}.csv").write_text("date,station_code,DO" + ",x" * i + f"\n2020-01-0{1 + i % 9},S01,{i}\n")
        tracker, group = spark.sparkContext.statusTracker(), f"sheets-{n}"
        registry = spark.createDataFrame([(i, f"{root}/{i}.csv") for i in range(n)], "dataset_id long, file_path string")
        spark.sparkContext.setJobGroup(group, group)
        out = preprocessing.rebuild_from_registry(spark, registry, str(root)).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        # Of each day the highest dataset wins.
        assert sorted((r.date.day, r.dataset_id) for r in out) == [(d, max(i for i in range(n) if 1 + i % 9 == d)) for d in range(1, min(n, 9) + 1)]
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(30) <= jobs(3) + 2


def test_first_line_only(spark, tmp_path):
    """A large file is not read to its end for its header."""
    (tmp_path / "big.csv").write_text("date,DO\n" + "2020-01-01,5\n" * 3_000_000)
    accumulated = sheets.header_lines(spark, str(tmp_path))
    assert [r.header for r in accumulated.collect()] == [["date", "DO"]]
    assert coerce_numeric(sheets.read_sheets(spark, str(tmp_path))).filter("do_ = 5").count() == 3_000_000
