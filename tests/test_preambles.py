"""Every file of a download brings its own lines before the header."""

import pytest

from kerbline.sources import tables

HEAD = ["Road restrictions", "as of today", "ID,Latitude,Longitude,GeoPolyline"]


def _write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_each_file_has_its_preamble(spark, tmp_path):
    p = _write(tmp_path, a=[*HEAD, "1,43.6,-79.4,x", "", "2,43.6,-79.4,x,more"], b=[*HEAD, *[f"{i},43.6,-79.4,x" for i in range(3, 40)]], c=HEAD)
    rows = tables.read_csv_with_preamble(spark, p).collect()
    assert sorted(int(r["ID"]) for r in rows) == list(range(1, 40))
    assert [r["ID"] for r in rows if r["ragged"]] == ["2"]


def test_headers_may_differ(spark, tmp_path):
    p = _write(tmp_path, a=[*HEAD, "1,43.6,-79.4,x"], b=["note", "GeoPolyline,Longitude,Latitude,ID,Road", "y,-79.5,43.7,2,Main"])
    rows = {r["ID"]: r for r in tables.read_csv_with_preamble(spark, p).collect()}
    assert rows["1"]["Latitude"] == "43.6" and rows["2"]["Latitude"] == "43.7" and rows["1"]["Road"] is None and rows["2"]["Road"] == "Main"


def test_a_file_without_header_is_an_error(spark, tmp_path):
    p = _write(tmp_path, a=[*HEAD, "1,43.6,-79.4,x"], b=["2,43.6,-79.4,x"])
    with pytest.raises(ValueError):
        tables.read_csv_with_preamble(spark, p)
