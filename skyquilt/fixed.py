"""They must equal the published ones for results to agree."""

# AOI boxes in degrees: id, upper-left lon, upper-left lat, lower-right lon, lower-right lat.
AOI_BOXES = (
    ("01", -84.125664, 39.771185, -84.119895, 39.765354),
    ("02", -84.122165, 39.786161, -84.116273, 39.780145),
    ("03", -84.101297, 39.781737, -84.095836, 39.775665),
    ("04", -84.122289, 39.766089, -84.116211, 39.760628),
    ("34", -84.126152, 39.783150, -84.114983, 39.776215),
    ("40", -84.127380, 39.772167, -84.118790, 39.765719),
    ("41", -84.121796, 39.772351, -84.113391, 39.764676),
)

# Road classes and their half widths in metres.
ROAD_BUFFER_M = (
    ("motorway", 15),
    ("trunk", 12),
    ("primary", 10),
    ("secondary", 8),
    ("tertiary", 6),
    ("residential", 4),
    ("service", 3),
    ("unclassified", 3),
)

EARTH_RADIUS_M = 6371000.0
CHI2_95_2DOF = 5.991
GREY_FROM_BGR = (0.114, 0.587, 0.299)
