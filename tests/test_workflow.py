"""End-to-end run of the three stages on domain-shaped files: analyte CSVs
(header, M/D/YYYY dates, commas in names, NaN and 'none') and GeoJSON
perimeters."""

import json
import os
import random

from pyspark.sql import functions as F

from cinderwell.plans import workflow
from cinderwell.sources.polygons import read_geojson_polygons

HEADER = "StationCode,SampleDate,StationName,TargetLatitude,TargetLongitude,Region,Analyte,Result,Unit"
UNITS = {"Oxygen, Dissolved, Total": "mg/L", "Turbidity, Total": "NTU", "pH": "none"}


def _fixture(tmp):
    rnd = random.Random(4)
    files = []
    stations = [(f"ST{i}", 34.0 + rnd.random() * 2, -121.0 + rnd.random() * 2) for i in range(12)]
    for a, unit in UNITS.items():
        p = os.path.join(tmp, a.split(",")[0] + ".csv")
        lines = [HEADER]
        for code, lat, lon in stations:
            for k in range(40):
                m, d, y = 1 + k % 12, 1 + (k * 7) % 28, 2016 + k // 12
                v = "NaN" if k % 17 == 0 else f"{rnd.uniform(1, 10):.3f}"
                lines.append(f'{code},{m}/{d}/{y},Creek {code},{lat},{lon},3,"{a}",{v},{unit}')
        with open(p, "w") as f:
            f.write("\n".join(lines) + "\n")
        files.append(p)
    fires = os.path.join(tmp, "fires.geojsonl")
    feats = [{"type": "Feature", "properties": {"FIRE_NAME": n, "ALARM_DATE": f"{y}-07-01 00:00:00+00:00",
                                                 "GIS_ACRES": str(ac), "fire_id": str(i)},
              "geometry": {"type": "Polygon", "coordinates": [[[x0, y0], [x0 + 1.2, y0], [x0 + 1.2, y0 + 1.2],
                                                               [x0, y0 + 1.2], [x0, y0]]]}}
             for i, (n, y, ac, x0, y0) in enumerate([("ALPHA", 2017, 60000, -121.0, 34.0),
                                                     ("BETA", 2018, 1200, -120.2, 34.8)])]
    with open(fires, "w") as f:
        f.write("\n".join(json.dumps(x) for x in feats) + "\n")
    return files, fires


def test_three_stages(spark, tmp_dir):
    files, fires_path = _fixture(tmp_dir)
    fires = read_geojson_polygons(spark, fires_path)
    master, units = workflow.build_master(spark, files)
    assert {r["Analyte"]: r["Unit"] for r in units.collect()} == UNITS
    n = master.count()
    assert sorted(r[0] for r in master.select("WaterQualityID").collect()) == list(range(1, n + 1))
    assert master.columns[:7] == ["WaterQualityID", "StationCode", "StationName", "TargetLatitude",
                                  "TargetLongitude", "Region", "SampleDate"]
    assert master.columns[-1] == "pH"
    joined = workflow.build_spatial_join(master, fires)
    assert joined.count() >= n
    stage2 = workflow.event_study(joined)
    fp = stage2["fire_paired_results"]
    assert set(fp.columns) >= {"Fire", "GIS_Acres", "n_before", "n_after", "Oxygen_change", "pH_before"}
    assert stage2["scenario_summary"].count() >= 0
    out = workflow.run_models(joined)
    rf = out["random_forest_results"].collect()
    assert rf and all(r["n"] >= 100 for r in rf if r["status"] == "ok")
    plan = stage2["scenario_results"]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "within" not in plan  # reads the written join
    ranking = out["analyte_impact_ranking"].collect()
    assert {r["Analyte"] for r in ranking} == {"Dissolved Oxygen", "Turbidity", "pH"}
    assert abs(sum(r["Importance"] for r in ranking) - 1.0) < 2e-3


def test_published_tables(spark, tmp_dir):
    """Headers, order and rounding of what ``run_all`` writes."""
    files, fires_path = _fixture(tmp_dir)
    out = os.path.join(tmp_dir, "out")
    workflow.run_all(spark, files, read_geojson_polygons(spark, fires_path), out)
    read = lambda n: spark.read.option("header", True).csv(f"{out}/{n}")
    assert read("random_forest_results").columns == ["Analyte", "R²", "top_feature", "n"]
    assert read("gam_results").columns == ["Analyte", "R²", "Post-fire change", "Direction", "Accuracy", "Precision", "Recall", "F1", "n"]
    assert read("analyte_impact_ranking").columns == ["Analyte", "Before", "After", "% Change", "Direction", "Importance"]
    assert read("mixed_effects_results").columns == ["Analyte", "Coefficient", "p-value", "Significant", "Direction", "n_readings", "n_stations"]
    assert read("scenario_summary").columns == ["scenario", "Analyte", "Mean Change", "p-value", "n_fires"]
    assert {r["Analyte"] for r in read("scenario_summary").collect()} <= {"Oxygen", "Turbidity", "pH"}
    assert [r["Analyte"] for r in read("analyte_units_reference").collect()] == sorted(UNITS)
    fires = [r["Fire"] for r in read("fire_paired_results").collect()]
    assert fires == sorted(fires)
    r2 = [float(r["R²"]) for r in read("random_forest_results").collect()]
    assert r2 == sorted(r2, reverse=True)
    assert all(len(r["R²"].split(".")[1]) <= 4 for r in read("gam_results").collect())
    assert {(r["table"], r["Analyte"]) for r in read("model_status").collect()} == {(t, a) for t in ("random_forest_results", "gam_results", "mixed_effects_results") for a in ("Oxygen", "Turbidity", "pH")}
    assert "row_ord" not in read("all_stations_fire_joined").columns


def test_unreadable_date_raises(spark, tmp_dir):
    import pytest
    p = os.path.join(tmp_dir, "a.csv")
    with open(p, "w") as f:
        f.write(HEADER + "\nS1,2020/01/04,n,1,2,3,pH,7,none\n")
    with pytest.raises(Exception, match="cannot read 2020/01/04"):
        workflow.load_readings(spark, [p]).collect()
    assert workflow.load_readings(spark, [p], strict=False).first()["SampleDate"] is None
