"""Hand-computed cases."""

import datetime
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from rivulet.operators import browse, consolidate, correlation, density, filters, ks, quality, slices, summaries, windows
from rivulet.plans import reports
from rivulet.sources import readers, writers

NAN, INF = float("nan"), float("inf")
SCHEMA = "scenario_id long, stage_id long, node_id long, hydro_id long, incremental_inflow_m3s double"


def month(index):
    return datetime.date(index // 12, index % 12 + 1, 1)


def calendar(spark, stages):
    """stages: {stage_id: month index}."""
    rows = [(s, month(m), month(m + 1)) for s, m in stages.items()]
    return readers.with_order(spark.createDataFrame(rows, "stage_id long, start date, end date"))


def flows(spark, values, entity=10):
    """values: {stage: {scenario: value}}."""
    rows = [(c, s, s * 100 + c, entity, v) for s, per in values.items() for c, v in per.items()]
    return spark.createDataFrame(rows, SCHEMA)


def history(spark, values, entity=7):
    """values: [(month index, value)]."""
    rows = [(entity, month(m), month(m + 1), v, m % 12 + 1) for m, v in values]
    return spark.createDataFrame(rows, "hydro_id long, start date, end date, value double, month int")


JAN26 = 2026 * 12


@pytest.mark.parametrize(
    "ours, theirs, want",
    [
        ([1.0, 2.0, 3.0, 4.0, NAN], [1.0, 1.0, 1.0, 1.0, INF], (5, 5, 4, 4, 0.75, 1.0, 1, 4, "more_in_history", "computed")),
        ([1.0, 2.0, 3.0], [1.0, 3.0], (3, 2, 3, 2, 1 / 6, 1.0, 1, 1, "more_in_history", "computed")),
        ([-2.0, -2.0], [-2.0], (2, 1, 2, 1, 0.0, None, None, None, "curves_coincide", "single_value")),
        ([-2.0], [3.0], (1, 1, 1, 1, 1.0, -2.0, 1, 0, "more_in_scenarios", "single_value")),
        ([NAN], [3.0], (1, 1, 0, 1, None, None, None, None, None, "no_scenarios")),
    ],
)
def test_ks(spark, ours, theirs, want):
    df = flows(spark, {0: dict(enumerate(ours))}, entity=7)
    past = history(spark, [(JAN26 - 12 * (i + 1), v) for i, v in enumerate(theirs)])
    row = ks.ks_distance(df, past, calendar(spark, {0: JAN26})).first()
    got = [row[c] for c in ("found_scenarios", "found_history", "valid_scenarios", "valid_history", "distance", "at_x", "count_scenarios", "count_history", "direction", "situation")]
    assert all(a == b or math.isclose(a, b) for a, b in zip(got, want, strict=True))


def test_ks_table(spark):
    df = flows(spark, {0: {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}, 1: {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}, 12: dict.fromkeys(range(1, 5), 1.0)}, entity=7)
    past = history(spark, [(2020 * 12, 1.0), (2021 * 12, 1.0)])
    cal = calendar(spark, {0: JAN26, 1: JAN26 + 1, 12: JAN26 + 12})
    names = spark.createDataFrame([(7, "Seven")], "hydro_id long, name string")
    rows = reports.ks_report(df, past, cal, names).orderBy("order").collect()
    assert [r["found_history"] for r in rows] == [2, 0, 2]
    assert [r["distance"] for r in rows] == [0.75, None, 0.0]
    assert rows[2]["at_x"] is None and rows[0]["label"] == "Seven - 7" and rows[0]["period"] == "01/2026"
    with pytest.raises(quality.QualityError):
        reports.ks_report(df.unionByName(df.limit(1)), past, cal, names)
    with pytest.raises(quality.QualityError):
        reports.ks_report(df, past.unionByName(past.limit(1)), cal, names)


def lagged(spark, change=None):
    values = {0: [1.0, 2.0, 3.0, 4.0], 1: [4.0, 3.0, 2.0, 1.0], 2: [1.0, 2.0, 3.0, 4.0]}
    rows = []
    for s in values:
        for c in range(1, 5):
            lags = [values[s - k][c - 1] if s >= k else float(100 + s - k) for k in range(1, 7)]
            rows.append({"scenario_id": c, "stage_id": s, "node_id": s, "hydro_id": 10, "incremental_inflow_m3s": values[s][c - 1]} | {f"lag_{k}_m3s": v for k, v in enumerate(lags, 1)})
    for r in rows:
        if change:
            change(r)
    schema = SCHEMA + "".join(f", lag_{k}_m3s double" for k in range(1, 7))
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3)


def lag_rows(spark, df):
    got = correlation.lag_correlation(df, calendar(spark, {s: JAN26 + s for s in range(3)})).collect()
    return {(r["stage_id"], r["lag"]): r for r in got}


def test_lag_correlation(spark):
    got = lag_rows(spark, lagged(spark))
    assert len(got) == 21
    assert math.isclose(got[1, 1]["rho"], -1) and math.isclose(got[2, 2]["rho"], 1) and math.isclose(got[0, 0]["rho"], 1)
    assert got[0, 1]["rho"] is None and got[0, 1]["reason"] == "constant" and got[0, 1]["past_period"] == "12/2025"
    assert got[0, 1]["origin"] == "before_study" and got[2, 2]["origin"] == "simulated" and got[2, 0]["origin"] == "current"


def test_lag_correlation_missing_pair(spark):
    def change(r):
        if r["scenario_id"] == 4 and r["stage_id"] == 2:
            r["lag_2_m3s"] = None

    got = lag_rows(spark, lagged(spark, change))
    assert math.isclose(got[2, 2]["rho"], 1) and got[2, 2]["n"] == 3


def test_lag_correlation_mismatch(spark):
    def change(r):
        if r["scenario_id"] == 1 and r["stage_id"] == 2:
            r["lag_1_m3s"] = 999.0

    got = lag_rows(spark, lagged(spark, change))
    assert got[2, 1]["rho"] is None and got[2, 1]["reason"] == "lag_mismatch:1" and math.isclose(got[2, 2]["rho"], 1)


def test_lag_correlation_bad_keys(spark):
    def change(r):
        if r["scenario_id"] == 2 and r["stage_id"] == 1:
            r["node_id"] = None

    assert lag_rows(spark, lagged(spark, change))[1, 1]["reason"] == "bad_keys"
    df = lagged(spark)
    twice = df.unionByName(df.filter("stage_id = 2 and scenario_id = 1"))
    assert lag_rows(spark, twice)[2, 0]["rho"] is None


def spatial(spark):
    stage0 = [[1, 2, 3, 4], [NAN, 3, 2, 1], [1, 2, 1, 2], [7, 7, 7, 7]]
    stage1 = [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 2, 1], [7, 7, 7, 7]]
    rows = [(c, s, 1000 + s * 100 + c * 10 + e, e, float(v)) for s, block in enumerate((stage0, stage1)) for e, per in enumerate(block) for c, v in enumerate(per)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("form", [correlation.spatial_pairs, correlation.spatial_correlation, lambda df: correlation.spatial_correlation(df, chunk=2)])
def test_spatial(spark, form):
    got = {(r["stage_id"], r["a"], r["b"]): r for r in form(spatial(spark)).collect()}
    r = got[0, 0, 1]
    assert math.isclose(r["rho"], -1) and r["n"] == 3 and math.isclose(r["mean_x"], 3) and math.isclose(r["mean_y"], 2) and r["reason"] == "computed"
    assert math.isclose(got[0, 0, 2]["rho"], 1 / math.sqrt(5))
    assert got[0, 0, 3]["rho"] is None and got[0, 0, 3]["reason"] == "constant"
    assert math.isclose(got[1, 0, 1]["rho"], 1) and abs(got[1, 0, 2]["rho"]) < 1e-12


def test_spatial_views(spark):
    pairs = correlation.spatial_pairs(spatial(spark))
    table = correlation.spatial_table(pairs, [0, 1, 2, 3])
    assert table.count() == 8 and len(table.columns) == 6
    assert table.filter("reference = 2 and stage_id = 0").first()["2"] is None
    alone = correlation.against_reference(spatial(spark), 0).filter("stage_id = 0 and other = 1").first()
    assert math.isclose(alone["rho"], -1)
    few = spatial(spark).filter("hydro_id <> 1 or stage_id <> 0 or scenario_id = 1")
    assert correlation.spatial_pairs(few).filter("stage_id = 0 and a = 0 and b = 1").first()["reason"] == "lt2_pairs"
    assert correlation.pair_lookup(pairs, 1, 0).filter("stage_id = 0").first()["mean_x"] == 2
    assert {r["reason"] for r in correlation.pair_lookup(pairs, 1, 1).collect()} == {"self_pair"}


def annual(spark, first=2025 * 12 + 7, months=44):
    totals = {2026: [1, 2, 3, 4], 2027: [4, 3, 2, 1], 2028: [1, -1, -1, 1]}
    rows, stages = [], {}
    for i in range(months):
        m, s = first + i, 100 + 3 * i
        stages[s] = m
        for c in range(1, 5):
            v = totals[m // 12][c - 1] / 12 if m // 12 in totals else 5.0
            v = NAN if (m, c) == (2027 * 12 + 5, 4) else v
            rows += [(c, s, s, 10, v), (c, s, s, 20, 5.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), calendar(spark, stages)


def test_annual(spark):
    df, cal = annual(spark)
    rows = correlation.annual_correlation(df, cal).collect()
    got = {(r["hydro_id"], r["year"], r["lag"]): r for r in rows}
    assert {r["year"] for r in rows} == {2026, 2027, 2028} and len(rows) == 12
    assert got[10, 2026, 1]["reason"] == "past_year_incomplete" and got[10, 2026, 1]["rho"] is None
    r = got[10, 2027, 1]
    assert math.isclose(r["rho"], -1) and r["n"] == 3 and r["complete"] == 3 and math.isclose(r["mean_x"], 3) and math.isclose(r["mean_y"], 2) and r["scenarios"] == 4
    assert abs(got[10, 2028, 2]["rho"]) < 1e-12 and got[10, 2028, 2]["n"] == 4 and round(got[10, 2028, 1]["rho"], 2) == 0.87
    assert got[20, 2027, 1]["rho"] is None and got[20, 2027, 1]["reason"] in ("constant", "near_constant")
    names = spark.createDataFrame([(10, "Ten")], "hydro_id long, name string")
    with pytest.raises(quality.QualityError):
        reports.annual_report(df.unionByName(df.limit(1)), cal, names)


def test_moments_mask_and_shape(spark):
    df = flows(spark, {0: {1: 1.0, 2: INF, 3: None, 4: NAN}, 1: {1: 5.0, 2: 5.0}, 2: {1: 1.0, 2: 2.0, 3: 6.0}})
    got = {r["stage_id"]: r for r in summaries.moment_summary(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s").collect()}
    assert got[0]["n"] == 1 and got[0]["sd"] == 0 and got[0]["skewness"] is None
    assert got[1]["sd"] == 0 and got[1]["kurtosis"] is None
    sd = math.sqrt(14 / 3)
    assert math.isclose(got[2]["skewness"], (-8 - 1 + 27) / 3 / sd**3) and math.isclose(got[2]["kurtosis"], (16 + 1 + 81) / 3 / sd**4 - 3)


def test_rolling(spark):
    values = {s: {1: float(s), 2: None if s == 4 else 1.0} for s in range(13) if s != 9}
    cal = calendar(spark, {s: JAN26 + s for s in range(13)})
    got = {(r["scenario_id"], r["stage_id"], r["window"]): r["total"] for r in windows.rolling_sums(flows(spark, values), cal).collect()}
    assert got[1, 5, 6] == 15 and got[1, 8, 6] == 33 and (1, 10, 6) not in got and not any(k[2] == 12 for k in got)
    assert not any(k[0] == 2 for k in got)
    past = history(spark, [(JAN26 + i, 1.0) for i in range(14)])
    rolled = windows.rolling_history(past).groupBy("window").count().collect()
    assert {r["window"]: r["count"] for r in rolled} == {6: 9, 12: 3}


def test_slices(spark):
    df = flows(spark, {0: {i: float(i) for i in range(1, 21)}, 1: {1: 7.0}, 2: {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 100.0, 6: -50.0}})
    got = {(r["stage_id"], r["percent"]): r for r in slices.slices(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s", "scenario_id", keep_outliers=True).collect()}
    assert all(got[0, p]["k"] == p // 5 for p in range(5, 100, 5)) and all(got[1, p]["k"] == 1 for p in range(5, 100, 5))
    assert got[0, 50]["q1"] == 3 and got[0, 50]["median"] == 5.5 and got[0, 50]["q3"] == 8
    assert got[1, 5]["q1"] == got[1, 5]["q3"] == 7 and got[1, 5]["skewness"] is None
    box = {r["stage_id"]: r for r in slices.box_plot(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s", "scenario_id", True).collect()}
    assert box[2]["outliers"] == 2 and box[2]["outlier_values"] == [-50, 100] and box[2]["whisker_low"] == box[2]["whisker_high"] == 1


def test_density(spark):
    df = flows(spark, {0: {1: 1.0, 2: 2.0, 3: 4.0}, 1: {1: 3.0, 2: 3.0}, 2: {1: 1.0}})
    curve = density.density(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s").toPandas().sort_values("i")
    assert set(curve.stage_id) == {0} and len(curve) == 1024
    area = (0.5 * (curve.density.values[1:] + curve.density.values[:-1]) * (curve.x.values[1:] - curve.x.values[:-1])).sum()
    assert abs(area - 1) < 1e-9


def test_browse(spark):
    df = flows(spark, {0: {1: 2.0, 2: None, 3: -0.01, 4: -0.02, 5: 2.0}})
    v = "incremental_inflow_m3s"
    assert [r["scenario_id"] for r in browse.page(df, v).collect()] == [4, 3, 1, 5, 2]
    assert [r["scenario_id"] for r in browse.page(df, v, descending=True).collect()] == [1, 5, 3, 4, 2]
    assert browse.page(df, v, number=3, size=4).count() == 0 and browse.page_count(5, 4) == 2 and browse.page_count(0, 4) == 1
    for down in (False, True):
        want = [r["scenario_id"] for r in browse.page(df, v, down).collect()]
        first = browse.page(df, v, down, size=2).collect()
        rest = browse.page_after(df, v, first[-1].asDict(), down).collect()
        assert [r["scenario_id"] for r in (*first, *rest)] == want
    assert filters.negative_flows(df).count() == 1
    assert browse.lowest_record(df).first()["scenario_id"] == 4


def trees(spark, tmp_path, edit=lambda flows, lags: None):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for c in (1, 2):
        own = [(c, s, s, 10, b, float(10 * s + c), float(b or 0)) for s in (0, 1, 2) for b in ((None, 0, 1) if c == 1 else (0, 1))]
        lags = [(c, s, s, 10, k, float(100 * k + s)) for s in (0, 1, 2) for k in ((0, 1) if c == 1 else (0,))]
        edit(own, lags)
        for name, rows, columns in (("hydros", own, ["scenario_id", "stage_id", "node_id", "hydro_id", "block_id", "incremental_inflow_m3s", "inflow_nonnegativity_slack_m3s"]), ("inflow_lags", lags, ["scenario_id", "stage_id", "node_id", "hydro_id", "lag_index", "inflow_m3s"])):
            folder = tmp_path / name / f"scenario_id={c:04d}"
            folder.mkdir(parents=True)
            kinds = {"block_id": pa.int32(), "lag_index": pa.int32()}
            arrays = [pa.array([r[i] for r in rows], kinds.get(n, pa.float64() if n.endswith("m3s") else pa.int64())) for i, n in enumerate(columns)]
            pq.write_table(pa.table(arrays, columns), folder / "data.parquet")
    return readers.read_tree(spark, str(tmp_path / "hydros"), readers.FLOWS), readers.read_tree(spark, str(tmp_path / "inflow_lags"), readers.LAGS)


def test_consolidate_and_publish(spark, tmp_path):
    out = consolidate.consolidate(*trees(spark, tmp_path))
    assert filters.lag_columns(out.columns) == ["lag_1_m3s", "lag_2_m3s"]
    writers.publish(out, str(tmp_path / "out"))
    rows = {(r["scenario_id"], r["stage_id"]): r for r in readers.read_consolidated(spark, str(tmp_path / "out")).collect()}
    assert len(rows) == 6 and rows[1, 2]["incremental_inflow_m3s"] == 21 and rows[1, 2]["lag_2_m3s"] == 102 and rows[2, 2]["lag_2_m3s"] is None
    assert writers.run_summary(out).first()["scenarios"] == 2

    def refuse(df):
        raise quality.QualityError("no")

    with pytest.raises(quality.QualityError):
        writers.publish(out.limit(1), str(tmp_path / "out"), check=refuse)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    writers.publish(out.limit(1), str(tmp_path / "out"), by="entity")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["hydros", "inflow_lags", "out"]
    writers.write_report(out, writers.run_summary(out), str(tmp_path / "rep"), "csv")
    assert spark.read.csv(str(tmp_path / "rep/report"), header=True).count() == 6


def set_flow(value):
    def edit(flows, lags):
        flows[-1] = (*flows[-1][:5], value, 0.0)

    return edit


@pytest.mark.parametrize(
    "edit",
    [
        lambda f, g: f.pop(1) if f[0][0] == 1 else None,  # no block 0
        lambda f, g: f.append(f[0]),  # a row twice
        lambda f, g: set_flow(99.0)(f, g) if f[0][0] == 2 else None,  # flow differs
        lambda f, g: set_flow(None)(f, g) if f[0][0] == 2 else None,  # null beside a number
        lambda f, g: g.append((g[0][0], 9, 9, 10, 0, 1.0)),  # lag without flow
        lambda f, g: g.append(g[0]),  # lag twice
        lambda f, g: g.append((g[0][0], 0, 0, 10, -1, 1.0)),  # negative index
        lambda f, g: f.append((7, *f[0][1:])),  # scenario of another path
    ],
)
def test_consolidate_refuses(spark, tmp_path, edit):
    with pytest.raises(quality.QualityError):
        consolidate.consolidate(*trees(spark, tmp_path, edit))


def entry(tmp_path, tree, name):
    return tmp_path / tree / f"scenario_id={name}"


def emptied(path):
    import pyarrow.parquet as pq

    pq.write_table(pq.ParquetFile(path).read().slice(0, 0), path)


@pytest.mark.parametrize(
    "problem, edit",
    [
        ("no_number", lambda p: entry(p, "hydros", "0002").rename(entry(p, "hydros", "abc"))),
        ("empty_file", lambda p: emptied(entry(p, "hydros", "0002") / "data.parquet")),
        ("no_file", lambda p: entry(p, "inflow_lags", "3").mkdir()),
        ("no_file", lambda p: (entry(p, "hydros", "0002") / "data.parquet").rename(entry(p, "hydros", "0002") / "copy.parquet")),
        ("not_a_folder", lambda p: entry(p, "hydros", "3").write_text("")),
        ("repeated_scenario", lambda p: shutil.copytree(entry(p, "hydros", "0001"), entry(p, "hydros", "1"))),
        ("other_scenario", lambda p: entry(p, "hydros", "0002").rename(entry(p, "hydros", "3"))),
        ("only_in", lambda p: shutil.rmtree(entry(p, "inflow_lags", "0002"))),
    ],
)
def test_scenario_folders_are_refused(spark, tmp_path, problem, edit):
    trees(spark, tmp_path)
    paths = [str(tmp_path / t) for t in ("hydros", "inflow_lags")]
    assert [t.count() for t in readers.checked_trees(spark, *paths)] == [15, 9]
    edit(tmp_path)
    with pytest.raises(quality.QualityError, match=problem):
        readers.checked_trees(spark, *paths)


def test_only_the_files_of_scenarios_are_read(spark, tmp_path):
    trees(spark, tmp_path)
    tree = tmp_path / "hydros"
    for other in ("scenario_id=0001/old.parquet", "scenario_id=0001/kept/data.parquet", "old/data.parquet", "data.parquet"):
        (tree / other).parent.mkdir(exist_ok=True)
        shutil.copy(tree / "scenario_id=0001/data.parquet", tree / other)
    assert readers.read_tree(spark, str(tree), readers.FLOWS).count() == 15
    got = {r["folder"]: (r["scenario"], r["rows"], r["bytes"] > 0, r["least"], r["most"]) for r in readers.tree_manifest(spark, str(tree), readers.FLOWS).collect()}
    assert got == {"scenario_id=0001": (1, 9, True, 1, 1), "scenario_id=0002": (2, 6, True, 2, 2)}
    assert quality.bad_folders(readers.tree_manifest(spark, str(tree), readers.FLOWS)).isEmpty()
    (tmp_path / "none").mkdir()
    for missing in ("none", "nowhere"):
        with pytest.raises(quality.QualityError):
            readers.checked_tree(spark, str(tmp_path / missing), readers.FLOWS)


def test_many_folders_are_listed(spark, tmp_path):
    for i in range(300):  # more than are listed one after another
        (tmp_path / "t" / f"scenario_id={i}").mkdir(parents=True)
    assert readers.tree_manifest(spark, str(tmp_path / "t"), readers.FLOWS).filter("bytes is null").count() == 300


def test_publication_waits_for_the_counts_of_its_job(spark, tmp_path):
    flows, lags = (t.drop("path_scenario_id", "file_path") for t in trees(spark, tmp_path))
    path = str(tmp_path / "out")
    assert consolidate.publish_consolidated(flows, lags, path) == {"rows": 6, "flow_keys": 6, "lag_keys": 6}
    by = sorted(consolidate.consolidate(flows, lags).columns)
    rows = lambda df: sorted(map(str, df.select(by).collect()))
    assert rows(spark.read.parquet(path)) == rows(consolidate.consolidate(flows, lags))
    wrong = flows.withColumn("block_id", F.when((F.col("block_id") == 0) & (F.col("stage_id") < 2), 5).otherwise(F.col("block_id")))
    with pytest.raises(quality.QualityError, match="4 keys.*block_0_not_once"):
        consolidate.publish_consolidated(wrong, lags, path)
    for broken in (lags.unionByName(lags.limit(1)), lags.unionByName(lags.limit(1).withColumn("stage_id", F.lit(77).cast("long"))), lags.filter("scenario_id = 1")):
        with pytest.raises(quality.QualityError):
            consolidate.publish_consolidated(flows, broken, path)
    assert rows(spark.read.parquet(path)) == rows(consolidate.consolidate(flows, lags))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["hydros", "inflow_lags", "out"]


def test_errors_name_a_sample_of_violations(spark):
    with pytest.raises(quality.QualityError) as told:
        quality.require(spark.range(50), "all")
    assert str(told.value).count("'id'") == quality.SHOWN and "and more" in str(told.value)


def test_calendar_catalog_history(spark, tmp_path):
    (tmp_path / "stages.json").write_text('{"stages": [{"id": 5, "start_date": "2026-02-01", "end_date": "2026-03-01"}, {"id": 9, "start_date": "2026-01-01", "end_date": "2026-02-01"}, {"id": 3, "start_date": "2026-04-01", "end_date": "2026-05-01"}, {"id": 4, "start_date": "bad", "end_date": "2026-05-15"}]}')
    cal = readers.read_calendar(spark, str(tmp_path / "stages.json"))
    assert {r["stage_id"]: r["problem"] for r in quality.bad_calendar(cal).collect()} == {5: "gap_or_overlap", 4: "bad_date"}
    assert cal.filter("stage_id = 9").first()["month"] == 1
    (tmp_path / "hydros.json").write_text('{"hydros": [{"id": 1, "name": " A "}, {"id": 2, "name": " "}, {"id": 3, "name": "C"}, {"id": 3, "name": "D"}]}')
    names = readers.read_catalog(spark, str(tmp_path / "hydros.json"))
    assert names.first()["name"] == "A"
    assert sorted(r["problem"] for r in quality.bad_catalog(names).collect()) == ["blank_name", "repeated_id", "repeated_id"]
    raw = spark.createDataFrame([(1, "2020-01-01", "2020-02-01", "1.5"), (1, "2020-01-01", "2020-02-01", "x"), (1, "2020-03-02", "2020-04-02", "2"), (1, "?", "2020-04-02", "2")], "hydro_id long, start_date string, end_date string, value_m3s string")
    assert sorted(r["problem"] for r in quality.bad_history(raw).collect()) == ["bad_date", "not_a_month", "repeated_month", "repeated_month"]
    assert readers.tidy_history(raw).filter("value is null").count() == 1


def test_order_of_rows_does_not_matter(spark):
    df = spatial(spark)
    a = correlation.spatial_correlation(df).orderBy("stage_id", "a", "b").collect()
    b = correlation.spatial_correlation(df.orderBy(F.desc("scenario_id")).repartition(2)).orderBy("stage_id", "a", "b").collect()
    assert [(r["stage_id"], r["a"], r["b"], r["n"], r["reason"]) for r in a] == [(r["stage_id"], r["a"], r["b"], r["n"], r["reason"]) for r in b]
    assert all((x["rho"] is None) == (y["rho"] is None) and abs((x["rho"] or 0) - (y["rho"] or 0)) < 1e-12 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("chunk, tile", [(8, 512), (8, 2), (256, 512), (100_000, 512)])
def test_pairs_without_a_joint_scenario(spark, chunk, tile):
    """All pairs of a stage, whatever blocks their scenarios fall in."""
    rows = [(s, 0, 1, e, float(s % 7 + e)) for e in range(3) for s in range(300 * e, 300 * e + 301)]
    rows += [(s, 1, 1, e, float(s)) for e in (4, 5) for s in range(e, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["stage_id"], r["a"], r["b"]): (r["n"], r["reason"]) for r in correlation.spatial_correlation(df, chunk, tile).collect()}
    assert got == {(0, 0, 1): (1, "lt2_pairs"), (0, 0, 2): (0, "lt2_pairs"), (0, 1, 2): (1, "lt2_pairs"), (1, 4, 5): (4, "computed")}
    assert got == {(r["stage_id"], r["a"], r["b"]): (r["n"], r["reason"]) for r in correlation.spatial_pairs(df).collect()}


@pytest.mark.parametrize("tile", [1, 2, 3])
def test_spatial_tiles_add_up(spark, tile):
    key = lambda r: (r["stage_id"], r["a"], r["b"])
    want = sorted(correlation.spatial_pairs(spatial(spark)).collect(), key=key)
    got = sorted(correlation.spatial_correlation(spatial(spark), chunk=2, tile=tile).collect(), key=key)
    assert list(map(key, got)) == list(map(key, want))
    for x, y in zip(got, want, strict=True):
        assert x["reason"] == y["reason"] and x["n"] == y["n"]
        assert all(abs((x[c] or 0) - (y[c] or 0)) < 1e-9 for c in ("mean_x", "mean_y", "sd_x", "sd_y", "cov", "rho"))


def reported(spark):
    """A small study: flows, history, calendar, names."""
    df = flows(spark, {s: {1: 1.0 + s, 2: 4.0 - s} for s in range(14)}, entity=7)
    cal = calendar(spark, {s: JAN26 + s for s in range(14)})
    return df, history(spark, [(2020 * 12 + i, float(i % 5)) for i in range(30)]), cal, spark.createDataFrame([(7, "Seven")], "hydro_id long, name string")


REPORTS = {
    "statistics": lambda df, past, cal, names: reports.statistical_report(df, past, cal, names),
    "slices": lambda df, past, cal, names: reports.slice_report(df, past, cal, names),
    "ks": lambda df, past, cal, names: reports.ks_report(df, past, cal, names),
    "spatial": lambda df, past, cal, names: reports.spatial_report(df, cal, names),
    "annual": lambda df, past, cal, names: reports.annual_report(df, cal, names)[0],
    "profile": lambda df, past, cal, names: reports.stage_profile(df.withColumn("inflow_nonnegativity_slack_m3s", F.lit(0.0)), past, cal, names),
    "density": lambda df, past, cal, names: reports.density_report(df, past, cal, names),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_refuse(spark, name):
    df, past, cal, names = reported(spark)
    REPORTS[name](df, past, cal, names).collect()
    with pytest.raises(quality.QualityError):  # a repeated row
        REPORTS[name](df.unionByName(df.filter("stage_id = 3 and scenario_id = 1")), past, cal, names)
    with pytest.raises(quality.QualityError):  # a stage that the calendar lacks
        REPORTS[name](df, past, cal.filter("stage_id <> 13"), names)
    if name in ("statistics", "slices", "ks", "profile", "density"):
        with pytest.raises(quality.QualityError):  # a month of history twice
            REPORTS[name](df, past.unionByName(past.limit(1)), cal, names)
    if name != "ks":
        with pytest.raises(quality.QualityError):  # a node missing
            REPORTS[name](df.withColumn("node_id", F.when(F.col("stage_id") != 2, F.col("node_id"))), past, cal, names)


def test_spatial_refuses_repeated_rows_in_a_task(spark):
    df = spatial(spark)
    twice = df.unionByName(df.filter("stage_id = 0 and scenario_id = 1 and hydro_id = 2"))
    with pytest.raises(Exception, match="repeated"):
        correlation.spatial_correlation(twice).collect()


def test_constant_but_for_rounding_has_no_shape(spark):
    df = flows(spark, {0: {1: 0.1 + 0.2, 2: 0.3, 3: 0.3}, 1: {1: 1.0, 2: 1.0 + 1e-9, 3: 3.0}})
    got = {r["stage_id"]: r for r in summaries.moment_summary(df, ["stage_id"], "incremental_inflow_m3s").collect()}
    assert got[0]["skewness"] is None and got[0]["kurtosis"] is None and got[1]["skewness"] > 0.7


def test_density_ends(spark):
    df = flows(spark, {0: {1: 1.0, 2: 2.0, 3: 4.0}})
    row = density.density_summary(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s").first()
    sd = math.sqrt(14 / 9)
    h = sd * 3**-0.2
    kernel = lambda x: sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in (1.0, 2.0, 4.0)) / (3 * h * math.sqrt(2 * math.pi))
    assert math.isclose(row["at_minimum"], kernel(1.0), rel_tol=1e-3) and math.isclose(row["at_maximum"], kernel(4.0), rel_tol=1e-3)
    both = reports.density_report(df, history(spark, [(24000 + 12 * i, float(i)) for i in range(4)]), calendar(spark, {0: JAN26}), spark.createDataFrame([], "hydro_id long, name string"))
    assert {(r["source"], r["n"]) for r in both.collect()} == {("scenarios", 3), ("history", 4)}


def test_report_is_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_report(spark.range(3), spark.range(2), path)
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        writers.write_report(spark.range(5), broken, path)
    assert spark.read.parquet(f"{path}/report").count() == 3 and [x.name for x in tmp_path.iterdir()] == ["out"]


def test_density_of_a_group_in_blocks(spark):
    import numpy as np

    from rivulet.operators import density as module

    rng = np.random.default_rng(7)
    v = np.concatenate([rng.standard_normal(900), np.zeros(300)])
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("h", 1.0), ("h", None), ("h", 2.0)], "g string, v double").repartition(3)
    out = module.density(df, ["g"], "v", block=50)
    got = sorted((r["i"], r["x"], r["density"]) for r in out.filter("g = 'g'").collect())
    assert out.filter("g = 'h'").count() == module.LEAST_POINTS
    x, y = np.array([r[1] for r in got]), np.array([r[2] for r in got])
    want = np.exp(-0.5 * ((x[:, None] - v[None, :]) / (v.std() * len(v) ** -0.2)) ** 2).sum(axis=1)
    want /= np.trapezoid(want, x)
    assert [r[0] for r in got] == list(range(len(got))) and np.allclose(y, want, atol=1e-9)
    one, many = (sorted(map(tuple, module.density_summary(df, ["g"], "v", block=b).collect())) for b in (50, 1 << 16))
    assert all(np.allclose(p[1:], q[1:], rtol=1e-9) for p, q in zip(one, many, strict=True)) and one[0][-4:] == pytest.approx([x[y.argmax()], y.max(), np.interp(v.min(), x, y), np.interp(v.max(), x, y)])


def test_density_of_many_groups_and_null_keys(spark):
    rows = [(None if g == 7 else f"g{g}", g % 3, float(i * i % 11 + g)) for g in range(200) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    got = density.density_summary(df, ["g", "k"], "v").filter("peak is not null and g is not null")
    assert got.count() == 199 and got.select(F.round(F.col("peak"), 9)).distinct().count() == 1


def _plain_slice(xs, k):
    """Statistics of the k smallest of sorted values, by the definitions."""
    part = xs[:k]
    mean = sum(part) / k
    m2, m3, m4 = (sum((x - mean) ** p for x in part) / k for p in (2, 3, 4))
    shaped = k >= 2 and part[-1] - part[0] > 1e-12 * max(abs(part[0]), abs(part[-1]))

    def quartile(q):
        at = min(max(q * k - 0.5, 0), k - 1)
        i = math.floor(at)
        return part[i] + (at - i) * (part[min(i + 1, k - 1)] - part[i])

    q1, median, q3 = (quartile(q) for q in (0.25, 0.5, 0.75))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [x for x in part if low <= x <= high]
    return {"n": len(xs), "k": k, "mean": mean, "sd": math.sqrt(m2) if part[0] != part[-1] else 0.0, "skewness": m3 / m2**1.5 if shaped else None, "kurtosis": m4 / m2**2 - 3 if shaped else None, "minimum": part[0], "q1": q1, "median": median, "q3": q3, "maximum": part[-1], "whisker_low": inside[0], "whisker_high": inside[-1], "outliers": k - len(inside), "outlier_values": [x for x in part if x < low or x > high]}


@pytest.mark.parametrize("percents", [tuple(range(5, 100, 5)), (100,), (3, 4, 50, 99, 100)])
def test_slices_equal_their_definition(spark, percents):
    rng = random.Random(7)
    shapes = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(4)), lambda: rng.lognormvariate(0, 2), lambda: -10.0 if rng.random() < 0.4 else rng.gauss(50, 9), lambda: 3.5, lambda: 1e6 + rng.gauss(0, 1e-3)]
    groups = {g: [shapes[g % len(shapes)]() for _ in range(size)] for g, size in enumerate([1, 1, 2, 2, 3, 3, 7, 19, 20, 21, 40, 99, 100, 101, 333, 500, 501, 750])}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)] + [(g, 1000 + i, x) for g in (0, 5, 99) for i, x in enumerate([None, float("nan"), float("inf"), -float("inf")])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, tie int, x double")
    for keep, empty in ((True, True), (False, False)):
        got = {(r["g"], r["percent"]): r.asDict() for r in slices.slices(df, ["g"], "x", "tie", percents, keep, empty).collect()}
        assert len(got) == (len(groups) + empty) * len(percents)
        for g, xs in groups.items():
            for p in percents:
                want, have = _plain_slice(sorted(xs), (len(xs) * p + 99) // 100), got[g, p]
                for name, value in want.items():
                    if name in have and g % len(shapes) == 5 and name in ("skewness", "kurtosis"):
                        assert (have[name] is None) == (value is None)
                    elif name in have:
                        assert have[name] == (value if isinstance(value, (int, list)) or value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), (g, p, name)
        for p in percents if empty else ():
            assert {k: v for k, v in got[99, p].items() if v is not None} == {"g": 99, "percent": p, "n": 0, "k": 0, "outliers": 0, "outlier_values": []}


def test_stored_pages_are_the_pages_and_open_few_ranges(spark, tmp_path):
    v, rng = "incremental_inflow_m3s", random.Random(3)
    rows = [(c, s, s, h, rng.choice([None, NAN, 1.0, 2.0, rng.random()])) for c in range(10) for s in range(9) for h in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for down in (False, True):
        path = f"{tmp_path}/pages-{down}"
        writers.publish_pages(df, path, v, down, partitions=16)
        ranges = spark.read.parquet(f"{path}/directory").orderBy("page_part").collect()
        assert len(ranges) > 8 and [r["first"] for r in ranges] == [sum(x["rows"] for x in ranges[:i]) for i in range(len(ranges))]
        for number in (1, 2, 15, 23, 24):
            got = browse.stored_page(spark, path, v, down, number, 20)
            assert str(got.collect()) == str(browse.page(df, v, down, number, 20).collect())
        some = browse.stored_page(spark, path, v, down, 15, 20)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [page_part#" in plan and "part" not in "".join(some.columns)
    writers.publish_pages(df.limit(0), f"{tmp_path}/none", v)
    assert browse.stored_page(spark, f"{tmp_path}/none", v).collect() == []


@pytest.mark.parametrize("form", [correlation.spatial_pairs, correlation.spatial_correlation, lambda df: correlation.spatial_correlation(df, chunk=2)])
@pytest.mark.parametrize("more", [0, 400])
def test_equal_values_of_a_pair_are_constant(spark, form, more):
    """Equal over the pair's scenarios though not over the entity's; with ``more`` most cells are empty."""
    rows = [(s, 0, 1, 0, 59.115044247787608 if s < 3 else 10.0 * s + 1 / 3) for s in range(6 + more)]
    rows += [(s, 0, 1, 1, 46.195543 + s * s) for s in range(3)] + [(s + 10**6, 0, 1, 1, 1.0) for s in range(more)]
    rows += [(s, 0, 1, 2, 5.0 * s * s) for s in range(6)] + [(s, 0, 1, 3, None) for s in range(6)]
    got = {(r["a"], r["b"]): r for r in form(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 6 and got[0, 1]["n"] == 3 and got[0, 1]["reason"] == "constant" and got[0, 1]["sd_x"] == 0 and got[0, 1]["rho"] is None
    assert got[0, 2]["reason"] == "computed" and got[0, 3]["n"] == 0 and got[0, 3]["mean_x"] is None


def test_scenarios_of_one_entity_only_move_no_value(spark):
    """Dense matrices hold joint scenarios only."""
    rows = [(s, 0, 1, 0, float(s * s % 11)) for s in range(0, 40)] + [(s, 0, 1, 1, float(s * 7 % 5)) for s in range(0, 60, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (f.first() for f in (correlation.spatial_pairs(df), correlation.spatial_correlation(df, chunk=7)))
    assert one["n"] == two["n"] == 20 and all(math.isclose(one[c], two[c], abs_tol=1e-12) for c in ("mean_x", "mean_y", "sd_x", "sd_y", "cov", "rho"))
    assert math.isclose(one["mean_x"], sum(s * s % 11 for s in range(0, 40, 2)) / 20)


def test_spatial_table_has_the_columns_of_its_sql(spark):
    from rivulet import queries

    df = queries.QUERIES["T5_spatial_table"](spark, "/root/testdata/sf0.1")
    assert sorted(df.columns) == sorted(["reference", "stage_id", *map(str, range(10))])


def test_annual_totals_do_not_depend_on_the_order_of_months(spark):
    """Equal totals of other months, rows in other orders: constant, not constant but for rounding."""
    rows = [(c, s, s, 10, (355 * ((s * (2 * c + 1)) % 12) / 113 - 10) * 1.1 + s // 12 * c) for c in range(1, 5) for s in range(24)]
    cal = calendar(spark, {s: 2026 * 12 + s for s in range(24)})
    for parts in (1, 5):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        totals = {r["total"] for r in correlation.annual_sums(df, cal).filter("year = 2026 and scenario_id in (2, 3)").collect()}
        assert len(totals) == 1
        got = {(r["year"], r["lag"]): r["reason"] for r in correlation.annual_correlation(df.filter("scenario_id in (2, 3)"), cal).collect()}
        assert got[2027, 1] == "constant"


def test_no_rounding_of_centred_sums_looks_like_a_deviation(spark):
    """Many entities, each equal over the three scenarios of entity 1."""
    rows = [(s, 0, 1, e, e / 7 + 90.1 if s < 3 else e * s / 3 + s) for e in range(2, 42) for s in range(9)]
    rows += [(s, 0, 1, 1, 46.195543 + s * s) for s in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for form in (correlation.spatial_pairs, correlation.spatial_correlation):
        got = form(df).filter("a = 1").collect()
        assert len(got) == 40 and {(r["n"], r["reason"], r["sd_y"]) for r in got} == {(3, "constant", 0.0)}


@pytest.mark.parametrize("form", [correlation.spatial_pairs, correlation.spatial_correlation])
def test_stored_pairs_repeat_their_entities_nearby(spark, tmp_path, form):
    """Tiles are ranges and pairs go by blocks: the names of a pair take a fraction of a byte."""
    import pyarrow.parquet as pq

    rows = [(c, 0, 1, 7 * e, float(e % 5 + c)) for e in range(600) for c in range(3) if (c + e) % 4]
    out = form(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=150)
    out.select("a", "b").coalesce(1).write.parquet(f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*.parquet")
    meta, pairs = pq.read_metadata(file), pq.read_table(file)
    size = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(2))
    assert len(set(zip(*(pairs[c].to_pylist() for c in ("a", "b")), strict=True))) == len(pairs) == 600 * 599 // 2
    assert all(a < b for a, b in zip(*(pairs[c].to_pylist() for c in ("a", "b")), strict=True))
    assert size < 0.25 * len(pairs)  # 0.32 where tiles are dealt by hash


def test_rows_of_a_tile_are_packed_narrowly(spark):
    from pyspark.sql import types

    rows = spark.range(40_000).selectExpr("id % 3 AS stage", "int(0) AS tile", "int(1) AS tiles", "id AS s", "1000000 + id * 7 % 6000 AS e", "double(id % 50) * 355 / 113 - 10 AS v")
    packs = correlation._packed(rows.coalesce(1))
    held = packs.collect()
    binary = [f.name for f in packs.schema if isinstance(f.dataType, types.BinaryType)]
    assert len(held) == 3 and sum(len(r[c]) for r in held for c in binary) < 8 * 40_000


@pytest.mark.parametrize("s", [[-(2**63), -(2**63), -5, -5, 0, 2**63 - 1], [-7, -1, 0, 1, 255, 256], [3] * 6, [-(2**63)] * 6])
@pytest.mark.parametrize("v", [[0.0, -0.0, math.nan, 1e308, -1e308, 5e-324], [1.5] * 6, [1.5, math.nan] * 3, [0.0, -0.0] * 3])
def test_packed_rows_come_back(s, v):
    import numpy as np

    for e in ([-(2**63), 2**63 - 1, 0, 1, 2, 3], [5] * 6, [70_000, 1, 2, 3, 4, 5]):
        for n in (1, 6):
            given = np.array(s[:n]), np.array(e[:n]), np.array(v[:n])
            back = correlation._unpack(*correlation._pack(*given))
            assert all(a.dtype == b.dtype and a.tobytes() == b.tobytes() for a, b in zip(given, back, strict=True))


@pytest.mark.parametrize("tile", [1, 7, 40])
def test_tiles_of_unequal_entities_keep_every_pair(spark, tile):
    """Entities with far more rows than others, below zero too: some tiles are empty, none of the pairs is lost."""
    rows = [(c, 0, 1, 3 * e - 30, float((c * (e + 2)) % 7)) for e in range(30) for c in range(400 if e in (4, 5) else 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["a"], r["b"]): (r["n"], r["reason"]) for r in correlation.spatial_correlation(df, chunk=64, tile=tile).collect()}
    assert len(got) == 30 * 29 // 2 and all(a < b for a, b in got)
    assert got == {(r["a"], r["b"]): (r["n"], r["reason"]) for r in correlation.spatial_pairs(df).collect()}


def uneven(spark, entities=37, seed=5):
    """Two stages of entities with missing and equal values, some of them with one value or none."""
    import random

    pick, rows = random.Random(seed), []
    for s in (0, 1):
        for e in range(entities):
            most = 9 if e % 5 else e % 3
            for c in range(9):
                v = NAN if c >= most else float(pick.randrange(3 if e % 7 else 1)) * 355 / 113
                rows += [(c, s, 1, 3 * e - 40, v)] if pick.random() < 0.8 else []
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("tile, strip", [(4096, 1 << 18), (4096, 90), (8, 1 << 18), (3, 1)])
@pytest.mark.parametrize("chunk", [256, None])
def test_spatial_table_has_every_partner(spark, monkeypatch, tile, strip, chunk):
    monkeypatch.setattr(correlation, "STRIP_PAIRS", strip)
    df = uneven(spark)
    want = {(r["a"], r["stage_id"], r["b"]): r["rho"] for r in correlation.mirrored(correlation.spatial_correlation(df)).collect()}
    table = correlation.spatial_blocks(df, chunk=chunk, tile=tile).collect()
    assert len({(r["reference"], r["stage_id"], r["first"]) for r in table}) == len(table)
    assert {(a, s, b // 10 * 10) for a, s, b in want} == {(r["reference"], r["stage_id"], r["first"]) for r in table}
    got = {(r["reference"], r["stage_id"], r["first"] + k): r[str(k)] for r in table for k in range(10) if r[str(k)] is not None}
    want = {key: rho for key, rho in want.items() if rho is not None}
    assert len({b for _, _, b in want}) > 20 and got.keys() == want.keys()
    assert all(abs(got[key] - rho) < 1e-12 for key, rho in want.items())


HARD = [1e200, -1e200, 1e-200, 2e-200, 5e-324, 0.0, -0.0, 1.0, 1.0 + 2**-52, 1.0 + 2**-45, 1e15, 1e15 + 1, 1e308, -1e308]


def hard(spark, entities=30, scenarios=8, seed=9):
    """Values at both ends of the range of a double, and values that differ by rounding only."""
    import random

    pick, rows = random.Random(seed), []
    for s in (0, 1):
        for e in range(entities):
            few = pick.sample(HARD, 2) if e % 3 else HARD
            rows += [(c, s, 1, 2 * e, pick.choice(few)) for c in range(scenarios) if pick.random() < 0.7]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("data", [uneven, hard])
@pytest.mark.parametrize("tile, strip, bits", [(16_384, 1 << 18, 1024), (16_384, 50, 1024), (4, 1 << 18, 1024), (4, 1 << 18, 3)])
def test_pairs_that_are_not_listed_have_a_correlation(spark, monkeypatch, data, tile, strip, bits):
    monkeypatch.setattr(correlation, "STRIP_PAIRS", strip)
    monkeypatch.setattr(correlation, "BIT_SCENARIOS", bits)
    monkeypatch.setattr(correlation, "LISTED_CELLS", 64)
    df = data(spark)
    key = lambda r: (r["stage_id"], r["a"], r["b"])
    want = {key(r): (r["n"], r["reason"]) for r in correlation.spatial_pairs(df).collect()}
    rows = correlation.unsure_pairs(df, None, tile).collect()
    got = {key(r): (r["n"], r["reason"]) for r in rows if r["a"] is not None}
    assert got.items() <= want.items() and len(got) == sum(r["a"] is not None for r in rows)
    assert {k for k, (_, reason) in want.items() if reason != "computed"} <= got.keys()
    assert sum(r["pairs"] for r in rows) == len(want)
    counts = {r["stage_id"]: (r["defined"], r["possible"]) for r in summaries.defined_counts(correlation.unsure_pairs(df, None, tile), "stage_id", number="pairs").collect()}
    assert counts == {s: (sum(k[0] == s and v[1] == "computed" for k, v in want.items()), sum(k[0] == s for k in want)) for s in (0, 1)}


def test_most_pairs_of_a_stage_are_not_summed(spark):
    rows = [(c, 0, 1, e, float((c * (e + 3) + e) % 101)) for e in range(60) for c in range(100) if (c + e) % 50]
    pairs = correlation.unsure_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["a"], r["pairs"], r["reason"]) for r in pairs] == [(None, 60 * 59 // 2, "computed")]


@pytest.mark.parametrize("name", ["A20_defined_counts", "F12_unavailable"])
def test_counts_and_missing_pairs_do_not_sum_every_pair(spark, monkeypatch, name):
    from rivulet import queries

    monkeypatch.setattr(correlation, "spatial_correlation", None)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_one_pair_is_that_of_all_pairs(spark):
    df = uneven(spark, 12).unionByName(spark.createDataFrame([(1, 2, 1, -40, 1.0), (1, 3, 1, -37, 1.0), (1, 3, 1, 99, None)], SCHEMA))
    pairs = correlation.spatial_pairs(df)
    for a, b in ((-40, -37), (-37, -40), (-25, -31), (-37, 99), (-40, -40), (-37, -37), (5000, 5000), (-40, 5000)):
        want = correlation.pair_lookup(pairs, a, b)
        got = correlation.one_pair(df, a, b)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_looking_up_a_pair_reads_its_entities_alone(spark, monkeypatch):
    from rivulet import queries

    seen, form = [], correlation.spatial_pairs
    monkeypatch.setattr(correlation, "spatial_pairs", lambda df, *args, **named: seen.append(df) or form(df, *args, **named))
    assert queries.QUERIES["T6_pair_lookup"](spark, "/root/testdata/sf0.001").count() > 0
    assert {r["hydro_id"] for df in seen for r in df.select("hydro_id").distinct().collect()} == {2, 5}
