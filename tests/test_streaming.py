import os

from cinderwell.streaming.ingest import ingest

HEADER = "StationCode,SampleDate,StationName,TargetLatitude,TargetLongitude,Region,Analyte,Result,Unit"


def test_incremental_ingest(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(HEADER + "\nS1,1/2/2020,n,34.5,-120.1,3,pH,7.1,none\nS1,1/3/2020,n,34.5,-120.1,3,pH,NaN,none\n")
    ingest(spark, src, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write(HEADER + "\nS2,1/2/2020,m,34.5,-120.1,3,pH,6.5,none\n")
    ingest(spark, src, out, ck).awaitTermination()
    df = spark.read.parquet(out)
    assert df.count() == 3                      # old file not read twice
    assert df.where("Result is null").count() == 1
