import math

from ledgerloom.operators import marts, outliers
from ledgerloom.sources import readers


def test_raw_csv_and_table_round_trip(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('﻿Street Address,Suburb,Last Rental Price\n"1 A St","X, Y","$1,260"\n', encoding="utf-8")
    df = readers.read_raw(spark, str(p))
    assert df.columns == ["Street Address", "Suburb", "Last Rental Price"] and df.first()["Suburb"] == "X, Y"
    readers.write_table(df.withColumnRenamed("Suburb", "part"), str(tmp_path / "out"), ["part"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_pois_and_geocodes(spark, tmp_path):
    p = tmp_path / "pois.csv"
    p.write_text("Title,Class,Lat,Lng\nA,school high,1.5,2\nB,park,,3\n")
    rows = readers.read_pois(spark, str(p)).collect()
    assert [(r["name"], r["category"], r["latitude"]) for r in rows] == [("A", "SCHOOL_HIGH", 1.5)]


def test_scalar_tails():
    assert math.isclose(outliers.chi2_quantile(0.95, 1), 3.841458820694124, rel_tol=1e-9)
    assert math.isclose(outliers.chi2_quantile(0.999, 3), 16.26623619623813, rel_tol=1e-9)
    assert math.isclose(marts.f_survival(4.0, 2, 10), 0.0529, abs_tol=1e-3)
    assert math.isclose(marts.f_survival(1.0, 5, 5), 0.5, rel_tol=1e-9)
