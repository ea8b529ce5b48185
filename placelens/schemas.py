"""Explicit schemas of all tables and documents; nothing is inferred."""

CHIPS = (
    "cycle string, chip_id string, row int, col int, chip_location_id string, loc_idx bigint, xmin double, ymin double, xmax double, ymax double, "
    "cx double, cy double, lon double, lat double, inside_aoi boolean"
)
CHIP_EMBEDDINGS = (
    "experiment_id string, model_id string, bands string, source_cycle string, chip_id string, chip_location_id string, inside_aoi boolean, "
    "embedding array<float>, cx double, cy double, xmin double, ymin double, xmax double, ymax double"
)
STORE_KEY = ["experiment_id", "model_id", "bands", "chip_id"]
STORE_PARTITIONS = ["experiment_id", "model_id", "bands", "source_cycle"]
FEATURE_COLLECTION = (
    "type string, crs struct<properties: struct<name: string>>, features array<struct<type: string, id: string, "
    "properties: struct<id: string, name: string, type: string, category: string, source: string, findable_aerial: boolean, findable_aerial_source: string, "
    "findable_lidar: boolean, notes: string, provenance: string, mvp_required: boolean>, geometry: struct<type: string, coordinates: string>>>"
)
CHIP_INDEX = (
    "generated_at string, working_crs string, chip_size_m int, stride_m int, grid_origin_26916 array<int>, n_rows int, n_cols int, "
    "aoi_bounds_26916 array<double>, cycles array<struct<year: string, source_cog: string, native_pixel_size_m: double, native_chip_array_shape: array<int>, "
    "chips: array<struct<chip_id: string, row: int, col: int, bbox_26916: array<double>, center_26916: array<double>, center_wgs84: array<double>, inside_aoi: boolean>>>>, "
    "eval_lookup map<string, array<struct<year: string, chip_id: string>>>"
)
_ITEM = "item_id: string, datetime: string, assets: map<string, string>, fetched_at: string"
NAIP_MANIFEST = f"generated_at string, stac_endpoint string, collection string, picked_years array<string>, cycles array<struct<year: string, items: array<struct<{_ITEM}>>>>"
S2_MANIFEST = f"generated_at string, stac_endpoint string, collection string, scenes array<struct<{_ITEM}, cloud_cover: double>>"
