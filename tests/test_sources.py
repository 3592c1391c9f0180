"""Readers and sinks: CSV with declared raw schemas, dense row ids,
statistics rows (and their error object), quotes, report JSON, metrics."""
import json
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.operators import clean, report
from riskloom.sources import tables


@pytest.fixture()
def base(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/src-{uuid.uuid4().hex}"


def test_csv_scan_coerces_junk(spark, base):
    import os
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/freq.csv", "w") as f:
        f.write("IDpol,ClaimNb,Exposure,VehPower,VehAge,DrivAge,BonusMalus,Density,VehBrand,VehGas,Area,Region\n")
        f.write("1,1,0.5,6,2,40,50,100,B1,'Diesel',C,R24\n")
        f.write("2,x,1.2,7,3,50,60,200,'B2',Regular,'D',R11\n")
    with open(f"{base}/sev.csv", "w") as f:
        f.write("IDpol,ClaimAmount\n1,100.5\n1,oops\n")
    freq, sev = clean.coerce(*tables.load_raw(spark, f"{base}/freq.csv", f"{base}/sev.csv"))
    r = {x.IDpol: x for x in freq.collect()}
    assert r[1].ClaimNb == 1.0 and r[2].ClaimNb is None and r[2].Exposure == 1.2
    assert (r[1].VehGas, r[2].VehBrand, r[2].Area) == ("Diesel", "B2", "D")
    assert sorted((x.ClaimAmount is None) for x in sev.collect()) == [False, True]
    with pytest.raises(FileNotFoundError):
        tables.load_raw(spark, f"{base}/nope.csv", f"{base}/sev.csv")


def test_csv_is_read_by_name(spark, base):
    import os
    os.makedirs(base, exist_ok=True)
    head = "Exposure,DrivAge,Area,IDpol,VehAge,VehPower,ClaimNb,Region,VehGas,VehBrand,Density,BonusMalus,Note"
    with open(f"{base}/p.csv", "w") as f:
        f.write(head + "\n0.25,33,D,8,4,7,1,R31,Diesel,B3,420,64,x\n0.75,old,A,9,1,5,0,R53,Regular,B10,30,50,\n")
    with open(f"{base}/c.csv", "w") as f:
        f.write("ClaimAmount,IDpol\n12.5,8\n")
    freq, sev = tables.load_raw(spark, f"{base}/p.csv", f"{base}/c.csv")
    r = {x.IDpol: x for x in freq.collect()}
    assert (r[8].DrivAge, r[8].VehAge, r[8].VehPower, r[8].BonusMalus, r[8].Area) == (33, 4, 7, 64, "D")
    assert r[9].DrivAge is None and "Note" not in freq.columns and sev.first().IDpol == 8
    # the Parquet names fall back to the CSV files when both exist
    assert tables.load_raw(spark, f"{base}/p.parquet", f"{base}/c.parquet")[0].count() == 2
    with open(f"{base}/noid.csv", "w") as f:
        f.write(head.replace("IDpol,", "") + "\n0.25,33,D,4,7,1,R31,Diesel,B3,420,64,x\n0.5,34,E,2,6,0,R31,Diesel,B3,4,70,x\n")
    ids = tables.load_raw(spark, f"{base}/noid.csv", f"{base}/c.csv")[0].collect()
    assert sorted((x.IDpol, x.DrivAge, x.Area) for x in ids) == [(0, 33, "D"), (1, 34, "E")]
    with open(f"{base}/short.csv", "w") as f:
        f.write("IDpol,ClaimNb\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.load_raw(spark, f"{base}/short.csv", f"{base}/c.csv")


def test_malformed_quotes_are_quarantined(spark, base):
    import os
    os.makedirs(f"{base}/bad", exist_ok=True)
    lines = ['{"IDpol": 1, "DrivAge": "abc"}', '{"IDpol": 2, "DrivAge": 40.7}', "not json at all", '{"DrivAge": 30}',
             '{"IDpol": 5, "DrivAge": "35", "BonusMalus": 60.0}', '{"IDpol": 6, "VehPower": null}',
             '{"IDpol": 7, "Area": {"x": 1}}', '{"IDpol": 8, "VehAge": 99999999999}']
    with open(f"{base}/bad/q.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    valid, bad = clean.validate_quotes(tables.read_quotes(spark, f"{base}/bad"))
    assert sorted((r.IDpol, r.DrivAge, r.BonusMalus, r.VehPower) for r in valid.collect()) == [(5, 35, 60, 6), (6, 40, 50, 6)]
    reasons = sorted(r.reasons for r in bad.collect())
    assert reasons == [["Area:type"], ["DrivAge:type"], ["DrivAge:type"], ["IDpol:missing"], ["VehAge:type"], ["line"]]


def test_dense_row_ids(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3).alias("v"))
    out = tables.with_row_id(df).collect()
    assert sorted(r.IDpol for r in out) == list(range(1000))
    assert all(r.IDpol * 3 == r.v for r in out)          # file order kept


def test_stat_rows_and_error_object(spark, base):
    import os
    os.makedirs(base, exist_ok=True)
    rows = [{"ITM_NM": "계", "C1_NM": "총계", "C2_NM": "남자", "DT": "10"}]
    with open(f"{base}/ok.json", "w") as f:
        json.dump(rows, f, ensure_ascii=False)
    assert tables.read_stat_rows(spark, f"{base}/ok.json").first().DT == "10"
    with open(f"{base}/err.json", "w") as f:
        json.dump({"err": "20", "errMsg": "bad key"}, f)
    with pytest.raises(RuntimeError):
        tables.read_stat_rows(spark, f"{base}/err.json")


def test_quotes_reports_and_metrics(spark, base):
    import os
    os.makedirs(f"{base}/q", exist_ok=True)
    with open(f"{base}/q/a.json", "w") as f:
        f.write(json.dumps({"IDpol": 1, "DrivAge": 30}) + "\n" + json.dumps({"IDpol": 2, "DrivAge": 10}) + "\n")
    q = tables.read_quotes(spark, f"{base}/q")
    valid, bad = clean.validate_quotes(q)
    assert [r.IDpol for r in valid.collect()] == [1] and [r.IDpol for r in bad.collect()] == [2]
    mk = spark.createDataFrame([(i, float(i)) for i in range(100)], "IDpol long, premium double")
    rep = report.build_report(valid.withColumn("premium", F.lit(50.5)), mk, loading={"expense_ratio": .25,
                                                                                   "profit_margin": .05})
    tables.write_reports(report.report_json(rep), f"{base}/rep")
    txt = spark.read.text(f"{base}/rep").first()[0]
    doc = json.loads(json.loads(txt)["report"])
    assert doc["risk_percentile"] == 51.0 and doc["coverage"]["tier"] == "standard"
    assert "리스크" in doc["disclaimer"]
    m = tables.metric_rows(spark, "r", "glm", {"gini": 0.3})
    tables.write_metrics(m, f"{base}/metrics")
    assert spark.read.parquet(f"{base}/metrics").first().metric == "gini"
