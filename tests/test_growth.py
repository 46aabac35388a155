"""Plans that compute a dear expression once, where it was copied to each place that names it."""

from heliosite.plans import bindings, places  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return bindings.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_polygon_is_parsed_once(spark):
    assert plan(spark, "geojson_roundtrip").count("from_json(") == 1


def test_sites_of_one_scale_share_their_grid(spark):
    text = plan(spark, "tile_grid")
    assert "Aggregate [mpp" in text and text.count("sort_array(") == 1
