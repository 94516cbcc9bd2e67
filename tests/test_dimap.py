"""DIMAP products: headers, and rasters and grids written and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.operators import pixels
from rasterlake.operators import tie_points as tp
from rasterlake.sources import dimap
from test_operators import back, raster

HEADER = """<?xml version="1.0" encoding="ISO-8859-1"?>
<Dimap_Document name="made.dim">
  <Dataset_Id><DATASET_NAME>made</DATASET_NAME></Dataset_Id>
  <Production><PRODUCT_TYPE>T1</PRODUCT_TYPE><PRODUCT_SCENE_RASTER_START_TIME>01-FEB-2008 09:26:09.416160</PRODUCT_SCENE_RASTER_START_TIME></Production>
  <Geoposition><Geoposition_Points><TIE_POINT_GRID_NAME_LAT>latitude</TIE_POINT_GRID_NAME_LAT><TIE_POINT_GRID_NAME_LON>longitude</TIE_POINT_GRID_NAME_LON></Geoposition_Points></Geoposition>
  <Flag_Coding name="flags"><Flag><Flag_Name>LAND</Flag_Name><Flag_Index>8</Flag_Index><Flag_description>x</Flag_description></Flag></Flag_Coding>
  <Raster_Dimensions><NCOLS>3</NCOLS><NROWS>2</NROWS><NBANDS>2</NBANDS></Raster_Dimensions>
  <Data_Access>
    <Data_File><DATA_FILE_PATH href="made.data/r.hdr" /><BAND_INDEX>0</BAND_INDEX></Data_File>
    <Tie_Point_Grid_File><TIE_POINT_GRID_FILE_PATH href="made.data/tie_point_grids/longitude.hdr" /><TIE_POINT_GRID_INDEX>0</TIE_POINT_GRID_INDEX></Tie_Point_Grid_File>
  </Data_Access>
  <Tie_Point_Grids><NUM_TIE_POINT_GRIDS>1</NUM_TIE_POINT_GRIDS><Tie_Point_Grid_Info><TIE_POINT_GRID_INDEX>0</TIE_POINT_GRID_INDEX><TIE_POINT_GRID_NAME>longitude</TIE_POINT_GRID_NAME><DATA_TYPE>float32</DATA_TYPE><NCOLS>2</NCOLS><NROWS>2</NROWS><OFFSET_X>0.5</OFFSET_X><OFFSET_Y>0.5</OFFSET_Y><STEP_X>16.0</STEP_X><STEP_Y>8.0</STEP_Y><CYCLIC>true</CYCLIC></Tie_Point_Grid_Info></Tie_Point_Grids>
  <Image_Interpretation>
    <Spectral_Band_Info><BAND_INDEX>0</BAND_INDEX><BAND_NAME>r</BAND_NAME><DATA_TYPE>uint16</DATA_TYPE><PHYSICAL_UNIT>dl</PHYSICAL_UNIT><BAND_WAVELEN>412.6</BAND_WAVELEN><SCALING_FACTOR>0.5</SCALING_FACTOR><SCALING_OFFSET>-1.0</SCALING_OFFSET><LOG10_SCALED>false</LOG10_SCALED><NO_DATA_VALUE_USED>true</NO_DATA_VALUE_USED><NO_DATA_VALUE>0.0</NO_DATA_VALUE></Spectral_Band_Info>
    <Spectral_Band_Info><BAND_INDEX>1</BAND_INDEX><BAND_NAME>twice</BAND_NAME><DATA_TYPE>float32</DATA_TYPE><VIRTUAL_BAND>true</VIRTUAL_BAND><EXPRESSION>2 * r</EXPRESSION></Spectral_Band_Info>
  </Image_Interpretation>
  <Dataset_Sources><MDElem name="metadata"><MDElem name="MPH"><MDATTR name="PRODUCT" type="ascii">P1</MDATTR><MDATTR name="N" type="int32">1</MDATTR><MDATTR name="N" type="int32">2</MDATTR></MDElem></MDElem></Dataset_Sources>
</Dimap_Document>"""


@pytest.mark.parametrize("order", ["0", "1", None])
def test_read(spark, tmp_path, order):
    (tmp_path / "made.data/tie_point_grids").mkdir(parents=True)
    (tmp_path / "made.dim").write_text(HEADER)
    sign = "<" if order == "0" else ">"
    (tmp_path / "made.data/r.img").write_bytes(np.array([0, 2, 4, 6, 8, 10], f"{sign}u2").tobytes())
    (tmp_path / "made.data/tie_point_grids/longitude.img").write_bytes(np.array([170, -170, 170, -170], ">f4").tobytes())
    if order:
        (tmp_path / "made.data/r.hdr").write_text(f"ENVI\nsamples = 3\nlines = 2\nbyte order = {order}\n")
    p = dimap.read_dimap(spark, str(tmp_path / "made.dim"))
    assert np.allclose(back(p, "r"), [[np.nan, 0, 1], [2, 3, 4]], equal_nan=True)
    assert (p.meta["name"], p.meta["type"], p.meta["start"]) == ("made", "T1", "01-FEB-2008 09:26:09.416160")
    assert p.meta["flags"] == {"flags": {"LAND": 8}} and p.meta["metadata"] == {"metadata": {"MPH": {"PRODUCT": "P1", "N": ["1", "2"]}}}
    assert [b["expression"] for b in p.meta["bands"]] == [None, "2 * r"] and p.meta["geocoding"] == ("latitude", "longitude")
    t = dimap.read_tie_points(spark, str(tmp_path / "made.dim"), "longitude")
    assert (t.rows, t.cols, t.step_x, t.step_y, t.discontinuity) == (2, 2, 16.0, 8.0, 180)
    df = spark.createDataFrame([(8.5, 3.0)], "x double, y double")
    assert abs(tp.bilinear_at(t, df, F.col("x"), F.col("y"), "v").first()["v"]) == pytest.approx(180.0)
    with pytest.raises(ValueError, match="no tie-point grid"):
        dimap.read_tie_points(spark, str(tmp_path / "made.dim"), "other")
    with pytest.raises(ValueError, match="not a DIMAP header"):
        dimap.parse_header("<a/>")


def test_write_and_read_back(spark, tmp_path):
    grid = np.random.default_rng(5).normal(size=(19, 6))
    grid[4, 4] = np.nan
    p = raster(spark, grid)
    p = p.with_bands(n=F.when(F.col("v").isNotNull(), F.col("y") * 0.5 - 3), k=F.col("x"))
    about = {"type": "T2", "start": "01-JAN-2010 00:00:00.000000", "flags": {"f": {"A": 1, "B": 2}}, "metadata": {"m": {"a": "1", "b": ["2", "3"]}}, "geocoding": ("lat", "lon")}
    about["bands"] = [{"name": "n", "type": "int16", "unit": "m", "description": "height & more", "scale": 0.5, "offset": -3.0, "no_data": -1}, {"name": "k", "type": "uint8", "coding": "f"}, {"name": "w", "type": "float32", "expression": "n < 2 and k > 1"}]
    p = p.with_pixels(p.pixels, meta=about)
    lat = tp.tie_points(spark, [[1.0, 2.0], [3.0, 4.0]], (0.5, 0.5), (8.0, 20.0))
    lon = tp.tie_points(spark, [[359.0, 1.0], [359.0, 1.0]], (0.5, 0.5), (8.0, 20.0), 360)
    path = str(tmp_path / "one.dim")
    dimap.write_dimap(p, path, {"v": "float64"}, {"lat": lat, "lon": lon}, "first", lines=4)
    assert not list((tmp_path / "one.data").glob("strips*")) and (tmp_path / "one.data/v.img").stat().st_size == 19 * 6 * 8
    q = dimap.read_dimap(spark, path)
    assert np.allclose(back(q, "v"), grid, equal_nan=True)
    assert np.allclose(back(q, "n"), np.where(np.isnan(grid), np.nan, np.arange(19)[:, None] * 0.5 - 3), equal_nan=True)
    assert q.meta["name"] == "first" and all(q.meta[k] == about[k] for k in ("type", "start", "flags", "metadata", "geocoding"))
    assert {b["name"]: (b["unit"], b["expression"]) for b in q.meta["bands"]}["w"] == (None, "n < 2 and k > 1")
    assert q.meta["bands"][1]["description"] == "height & more" and q.meta["bands"][2]["coding"] == "f"
    again = dimap.read_tie_points(spark, path, "lon")
    assert again.discontinuity == 360 and sorted(r["v"] for r in again.points.collect()) == [1.0, 1.0, 359.0, 359.0]
    part = pixels.subset(dimap.read_dimap(spark, path, ["k"]), 2, 5, 3, 2)
    assert part.bands == ["k"] and (back(part, "k") == [[2, 3, 4], [2, 3, 4]]).all()
