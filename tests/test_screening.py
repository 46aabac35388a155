"""Screening runs: whole, stopped and resumed, crashed between tables, and with sites that fail at first."""

import pytest
from pyspark.sql import functions as F

from heliosite.operators import screening as s
from heliosite.sources.commits import Store


@pytest.fixture(scope="module")
def centers(spark):
    rows = [(i, f"site {i}", "ABCD"[i % 4], str(121 + i / 100), str(31 + i / 100), "x") for i in range(40)]
    rows += [(3, "again", "D", "121", "31", None), (50, "", "a ", "121.5", "31.5", None), (51, "blank", "A", "", "31", ""), (52, "nan", "A", "nan", "31", ""), (None, "none", "A", "1", "1", "")]
    return spark.createDataFrame(rows, "mall_id long, name string, confidence_level string, center_lon string, center_lat string, center_source string")


def detected(spark, failing=()):
    kinds = spark.createDataFrame([], s.DETECTION).schema
    row = lambda i: {"mall_id": i, "pv_status": "likely_pv", "pv_confidence": 0.9, "pv_area_px": 200 * i, "roof_area_px": 5000 * i, "roof_candidate_count": i % 12, "self_area_px": 60 * i, "self_box_px": 262144, "self_component_count": 1, "error": "too dark" if i in failing else None}
    return spark.createDataFrame([tuple(row(i).get(f.name) for f in kinds) for i in [*range(60), 8, 8] if i != 12], kinds)


def tables(store):
    return {name: sorted(map(tuple, df.collect())) for name, df in s.results(store).items()}


def test_stopped_and_resumed_runs_give_the_whole_runs_tables(spark, centers, tmp_path):
    p, found = s.ScreenParams("r1"), detected(spark)
    whole, part, other = (Store(spark, str(tmp_path / n)) for n in ("whole", "part", "other"))
    assert s.run(whole, centers, found, p, 100) == 1
    want = tables(whole)
    assert [len(v) for v in want.values()] == [21, 21, 21] and {r[1] for r in want["self"]} == {*range(0, 40, 4), *range(1, 40, 4), 50}
    assert s.run(part, centers, found, p, 4, most=2) == 2 and part.read("summary").count() == 8
    assert s.run(part, centers, found, p, 5) == 3
    assert tables(part) == want and s.run(part, centers, found, p, 5) == 1  # 12 has no detection and is tried again
    assert tables(part) == want

    class Crash(Exception):
        pass

    write, made = Store.commit, []

    def crashing(self, batch, rows):
        made.append(batch)
        if len(made) == 3:
            rows["self"].write.parquet(f"{self.root}/self/_batches/{batch}.{'0' * 32}")
            raise Crash
        return write(self, batch, rows)

    Store.commit = crashing
    try:
        with pytest.raises(Crash):
            s.run(other, centers, found, p, 4)
    finally:
        Store.commit = write
    assert other.read("self").count() == 8
    s.run(other, centers, found, p, 4)
    assert tables(other) == want


def test_failed_sites_are_rows_and_are_tried_again(spark, centers, tmp_path):
    store, p = Store(spark, str(tmp_path)), s.ScreenParams("r2", levels=("B",), ids=(1, 5, 9, 2))
    s.run(store, centers, detected(spark, failing=(5,)), p, 2)
    bad = {r.mall_id: r for r in s.results(store)["summary"].collect()}
    assert set(bad) == {1, 5, 9} and bad[5].error == "too dark" and bad[5].install_condition_level == "unknown" and bad[5].downloaded_tile_count == 0 and bad[5].roof_area_m2_est is None
    assert s.results(store)["detail"].where("mall_id = 5").first().pv_status == "not_checked"
    assert s.run(store, centers, detected(spark), p, 2) == 1
    good = {r.mall_id: r for r in s.results(store)["summary"].collect()}
    assert good[5].error == "" and good[5].image_status == "ok" and good[1] == bad[1] and store.read("summary").where("mall_id = 5").count() == 2


def test_levels_and_areas(spark, centers, tmp_path):
    store = Store(spark, str(tmp_path))
    s.run(store, centers, detected(spark), s.ScreenParams("r3"), 50)
    out = {name: {r.mall_id: r for r in df.collect()} for name, df in s.results(store).items()}
    mpp = spark.range(1).select(F.cos(F.radians(F.lit(31.36))) * 156543.03392804097 / 262144).first()[0]
    x = out["summary"][36]
    assert x.roof_area_m2_est == pytest.approx(180_000 * mpp**2, abs=0.01) and x.install_condition_level == "medium" and x.install_condition_score == 0.5
    assert out["summary"][33].install_condition_score == pytest.approx(0.95) and out["summary"][33].install_condition_level == "high"
    assert out["summary"][0].install_condition_level == "not_obvious" and out["detail"][1].pv_status == "no_clear_pv" and out["detail"][4].pv_status == "likely_pv"
    assert [out["self"][i].pv_status for i in (4, 9, 20)] == ["no_clear_pv", "possible_pv", "likely_pv"] and out["self"][50].name == "mall"
