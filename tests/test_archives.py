import zipfile

import pytest
from test_sources import put, xlsx

from tidemark.sources.feeds import zipped_csv
from tidemark.sources.workbook import read_cells


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def test_a_member_is_a_task(spark, tmp_path):
    members = {f"{i}.csv": "﻿a,b,c\n" + "".join(f"{i},{j},\n" for j in range(3)) for i in range(4)} | {"readme.txt": "x"}
    d = zipped_csv(spark, archive(tmp_path / "m.zip", members), ["b", "a", "gone", "c"])
    assert d.rdd.getNumPartitions() == 4 and d.columns == ["b", "a", "gone", "c"]
    assert sorted((r.a, r.b, r.gone, r.c) for r in d.collect()) == [(str(i), str(j), None, None) for i in range(4) for j in range(3)]
    assert {r.a for r in zipped_csv(spark, str(tmp_path / "m.zip"), ["a"], members="[13].csv").collect()} == {"1", "3"}


def test_members_not_asked_are_not_inflated(spark, tmp_path):
    p = archive(tmp_path / "d.zip", {"good.csv": "a\n1\n", "bad.csv": "a\n" + "2\n" * 5000})
    with zipfile.ZipFile(p) as z:
        at = z.getinfo("bad.csv").header_offset + 45
    raw = bytearray(open(p, "rb").read())
    raw[at:at + 4] = b"\xff\xff\xff\xff"
    open(p, "wb").write(raw)
    assert [r.a for r in zipped_csv(spark, p, ["a"], members="good.csv").collect()] == ["1"]
    with pytest.raises(Exception):
        zipped_csv(spark, p, ["a"]).collect()


def test_sizes_folders_and_odd_archives(spark, tmp_path):
    (tmp_path / "z").mkdir()
    archive(tmp_path / "z" / "a.zip", {"a.csv": "a\n1\n"})
    archive(tmp_path / "z" / "b.zip", {"b.csv": "a\n2\n", "none.csv": ""})
    (tmp_path / "z" / "note.txt").write_text("x")
    assert sorted(r.a for r in zipped_csv(spark, str(tmp_path / "z"), ["a"]).collect()) == ["1", "2"]
    with pytest.raises(Exception, match="more than 3"):
        zipped_csv(spark, str(tmp_path / "z"), ["a"], max_bytes=3).collect()
    with pytest.raises(Exception, match="not an archive"):
        zipped_csv(spark, str(tmp_path / "z" / "note.txt"), ["a"]).collect()
    with pytest.raises(Exception, match="no such archive"):
        zipped_csv(spark, str(tmp_path / "absent.zip"), ["a"]).collect()
    assert zipped_csv(spark, archive(tmp_path / "e.zip", {}), ["a"]).collect() == []


def test_a_sheet_is_a_task(spark, tmp_path):
    p = put(tmp_path / "w.xlsx", xlsx({"One": [["a", None, "b"]], "Two": [["c"]], "Notes": []}))
    d = read_cells(spark, p)
    assert d.rdd.getNumPartitions() == 3
    assert sorted((r.sheet, r.row, r.col, r.text) for r in d.collect()) == [("One", 1, 1, "a"), ("One", 1, 3, "b"), ("Two", 1, 1, "c")]
    assert [r.text for r in read_cells(spark, p, "T*").select("text").collect()] == ["c"]
