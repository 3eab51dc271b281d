"""Explicit schemas of the tables the engine reads and writes."""

POOL = (
    "pool_id BIGINT, source STRING, label INT, location STRING, generator STRING, phash STRING, whole_image_safe INT, w INT, h INT, "
    "fmt STRING, square INT, bpp DOUBLE"
)
TILE_SCORE = (
    "path STRING, dataset STRING, source STRING, label INT, width INT, height INT, tile_count INT, bytes_per_pixel DOUBLE, "
    "texture_mean DOUBLE, texture_p50 DOUBLE, texture_p90 DOUBLE, tile_scores ARRAY<DOUBLE>"
)
IMAGE_SCORE = "detector_id STRING, path STRING, dataset STRING, source STRING, label INT, width INT, height INT, bytes_per_pixel DOUBLE, image_score DOUBLE"
CATALOG = "source STRING, dataset STRING, kind STRING, label_map MAP<INT,INT>, label_names ARRAY<STRING>, whole_image_safe BOOLEAN"
