"""Explicit schemas of every table (no inference on read)."""

TRUTH = "id BIGINT, frame_number INT, x DOUBLE, y DOUBLE, latitude DOUBLE, longitude DOUBLE"
DETECTION_CSV = "x FLOAT, y FLOAT"
TILE = (
    "aoi STRING, frame INT, ty INT, tx INT, r0 INT, c0 INT, h INT, w INT, "
    "height INT, width INT, px BINARY"
)
HOMOGRAPHY = "aoi STRING, src_frame INT, dst_frame INT, h ARRAY<DOUBLE>"
METRICS = (
    "aoi STRING, tp BIGINT, fp BIGINT, fn BIGINT, n_gt BIGINT, n_det BIGINT, "
    "precision DOUBLE, recall DOUBLE, f1 DOUBLE"
)

TILE_KEY = ("aoi", "frame", "ty", "tx")
