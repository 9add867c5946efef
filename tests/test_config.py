import pytest

from quillspark.config import BridgeGeometry, latent_shape, run_mode


def test_geometry():
    assert BridgeGeometry(4, 4, 4, 2, 1, 64).dim == 64
    for bad in ((4, 5, 4, 2, 1, 80), (4, 4, 4, 2, 2, 64), (0, 4, 4, 2, 1, 64)):
        with pytest.raises(ValueError):
            BridgeGeometry(*bad)


def test_presets():
    assert latent_shape("flux", {"vae_kind": "sd"}) == (16, 32, 32)
    assert latent_shape(None, {"bridge_preset": "flux", "vae_kind": "sd"}) == (16, 32, 32)
    assert latent_shape() == (4, 32, 32)
    with pytest.raises(ValueError):
        latent_shape("other")


def test_modes():
    assert run_mode("noise2data", 2) == "n2d_two"
    with pytest.raises(ValueError):
        run_mode("data2data", 2, image_to_text=False)


def test_settings_in_columns(spark):
    import itertools

    from pyspark.sql import functions as F

    from quillspark.config import geometry_fits
    from quillspark.sources import writers

    sizes = list(itertools.product((0, 2, 4), (4, 6), (2, 3), (1, 4, 6), (8, 16)))
    df = spark.createDataFrame(sizes + [(None, 4, 2, 4, 16)], "c int, h int, p int, t int, d int")

    def fits(c, h, p, t, d):
        try:
            BridgeGeometry(c, h, h, p, t, d)
        except ValueError:
            return False
        return True

    for r in df.select("*", geometry_fits("c", "h", "h", "p", "t", "d").alias("fits")).collect():
        assert r["fits"] == (r["c"] is not None and fits(*r[:5])), r
    rows = spark.createDataFrame([(3, 'a "b" \\ c/d', 9), (-1, "", 8)], "n int, s string, batch_size int")
    for r in rows.select("*", writers.settings_hash({"n": F.col("n"), "z": F.col("s"), "batch_size": F.col("batch_size")}, text=("z",)).alias("h")).collect():
        assert r["h"] == writers.config_hash({"z": r["s"], "n": r["n"], "batch_size": 1})
