"""The geographic functions as SQL functions (inlined by the optimizer)."""

from __future__ import annotations

from pyspark.sql import SparkSession

_A = (
    "power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) "
    "* power(sin(radians(lon2 - lon1) / 2), 2)"
)
_W = "(h[6] * x + h[7] * y + h[8])"

FUNCTIONS = {
    "sky_haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                        f"12742000.0D * atan2(sqrt({_A}), sqrt(1 - ({_A})))"),
    "sky_haversine_lonlat_m": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE",
                               f"12742000.0D * asin(sqrt({_A}))"),
    "sky_pixel_to_geo": ("gt ARRAY<DOUBLE>, x DOUBLE, y DOUBLE", "STRUCT<lon: DOUBLE, lat: DOUBLE>",
                         "named_struct('lon', gt[0] + x * gt[1] + y * gt[2], 'lat', gt[3] + x * gt[4] + y * gt[5])"),
    "sky_geo_to_pixel": ("gt ARRAY<DOUBLE>, lon DOUBLE, lat DOUBLE", "STRUCT<col: INT, row: INT>",
                         "named_struct('col', cast((gt[5] * (lon - gt[0]) - gt[2] * (lat - gt[3])) / (gt[1] * gt[5] - gt[2] * gt[4]) as int), "
                         "'row', cast((gt[1] * (lat - gt[3]) - gt[4] * (lon - gt[0])) / (gt[1] * gt[5] - gt[2] * gt[4]) as int))"),
    "sky_project": ("h ARRAY<DOUBLE>, x DOUBLE, y DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE>",
                    f"named_struct('x', (h[0] * x + h[1] * y + h[2]) / {_W}, 'y', (h[3] * x + h[4] * y + h[5]) / {_W})"),
    "sky_ellipse_axis": ("sxx DOUBLE, sxy DOUBLE, syy DOUBLE, sign DOUBLE", "DOUBLE",
                         "sqrt(((sxx + syy) / 2 + sign * sqrt((sxx - syy) / 2 * ((sxx - syy) / 2) + sxy * sxy)) * 5.991D)"),
}


def register(spark: SparkSession) -> None:
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
