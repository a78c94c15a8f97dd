"""Zipped dumps give the rows of the same files unpacked; filters leave other members closed."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from tickloom.sources import zipped
from tickloom.sources.readers import read_raw_bars, read_zipped_bars

HEADER = "open_time,open,high,low,close,volume,close_time,quote_volume,n_trades,taker_buy_base,taker_buy_quote,ignore"


def dumps(root):
    for symbol in ("AAA", "BBB"):
        plain, packed = root / "plain" / symbol / "1m", root / "zip" / symbol / "1m"
        plain.mkdir(parents=True), packed.mkdir(parents=True)
        for day in (1, 2, 3):
            name = f"{symbol}-1m-2024-01-0{day}"
            lines = [HEADER] * (day == 1) + [f"{day}{k},1.5,2,1,{k}.25,3,0,0,0,0,0,0" for k in range(4)] + ["broken,line", ""]
            (plain / f"{name}.csv").write_text("\n".join(lines) + "\n")
            with zipfile.ZipFile(packed / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{name}.csv", "\r\n".join(lines) + "\r\n")
                z.writestr("README.txt", "not a dump")
    # One archive of a month with two days in it.
    with zipfile.ZipFile(root / "zip" / "AAA" / "1m" / "AAA-1m-2024-02.zip", "w") as z:
        for day in ("04", "05"):
            z.writestr(f"AAA-1m-2024-02-{day}.csv", f"9{day},1,1,1,1,1,0,0,0,0,0,0\n")


def test_same_rows_as_plain_files(spark, tmp_path):
    dumps(tmp_path)
    key = lambda r: (r["symbol"], r["load_id"], r["open_time"])
    for k in (0, 1):
        plain = read_raw_bars(spark, str(tmp_path / "plain"))[k].collect()
        packed = read_zipped_bars(spark, str(tmp_path / "zip"), last_day="2024-01-31")[k]
        assert packed.columns == [c for c in read_raw_bars(spark, str(tmp_path / "plain"))[k].columns if c in packed.columns]
        order = key if k == 0 else (lambda r: (r["symbol"], r["load_id"]))
        assert sorted((tuple(r[c] for c in packed.columns) for r in packed.collect()), key=str) == sorted((tuple(r[c] for c in packed.columns) for r in sorted(plain, key=order)), key=str)


def test_filters_decide_what_is_opened(spark, tmp_path):
    dumps(tmp_path)
    root = f"file://{tmp_path}/zip"
    lines = zipped.zipped_lines(spark, root)
    assert lines.rdd.getNumPartitions() == 8  # one for each member
    one = zipped.zipped_lines(spark, root).where((F.col("symbol") == "AAA") & (F.col("day") >= "2024-01-03"))
    assert one.rdd.getNumPartitions() == 3
    assert {r["day"] for r in one.select("day").distinct().collect()} == {"2024-01-03", "2024-02-04", "2024-02-05"}
    few = zipped.zipped_lines(spark, root).where(F.col("symbol").isin("BBB", "CCC") & (F.col("day") < "2024-01-02") & F.col("value").startswith("1"))
    assert few.count() == 4 and few.rdd.getNumPartitions() == 1
    got, _ = read_zipped_bars(spark, root, ["AAA"], first_day="2024-02-05")
    assert [r["open_time"] for r in got.collect()] == [905]


def test_names_of_days():
    assert zipped.day_of("X-1m-2024-01-31.csv") == "2024-01-31" and zipped.day_of("/a/X-1m-2024-01.zip") == "2024-01" and zipped.day_of("notes.csv") is None
