"""Table contracts as DDL, so they need no running session."""
from __future__ import annotations

COORDINATES = ("sampleid bigint, latitude double, longitude double, has_solar int")
MANIFEST = (
    "sampleid bigint, filename string, coco_image_id bigint, width int, height int, annotation_count int,"
    "has_solar int, split string, dataset_type string"
)
IRRADIANCE = (
    "properties struct<parameter:struct<ALLSKY_SFC_SW_DWN:map<string,double>>>"
)
HISTORY = (
    "prediction_id string, op string, created_at_utc timestamp, persisted_at_utc timestamp, filename string, status string,"
    "model_name string, image_width int, image_height int, total_image_pixels bigint, solar_area_pixels bigint,"
    "solar_coverage_percent double, detected_region_count bigint, largest_region_area_pixels bigint,"
    "smallest_region_area_pixels bigint, mean_region_area_pixels double, physical_area_m2 double,"
    "physical_area_hectares double, physical_area_status string, energy_status string,"
    "estimated_energy_kwh_year double, co2_status string, co2_avoided_kg_year double, co2_avoided_tonnes_year double,"
    "latitude double, longitude double, georeferencing_level string, location_name string, mask_url string,"
    "overlay_url string, original_image_url string, applied_threshold double, applied_min_component_area int,"
    "processing_strategy string, gsd_status string, source_resolution string, source_crs string,"
    "metadata_provenance string, calibration_type string, calibration_status string, calibration_source string,"
    "custom_gsd double, calibration_rejection_reason string, details string,"
    "ingested_at timestamp, ingested_row bigint"
)
