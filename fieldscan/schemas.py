"""Explicit schemas; nothing is inferred from files."""

from __future__ import annotations

BAND = "struct<name:string,center_wavelength:double,nodata:double>"
ITEM = """
    id string, bbox array<double>,
    geometry struct<type:string,coordinates:array<array<array<double>>>>,
    properties struct<`datetime`:string,platform:string,gsd:double,license:string,`eo:cloud_cover`:double,
        `s2:mgrs_tile`:string,`sat:relative_orbit`:int,`s2:generation_time`:string,`s2:processing_baseline`:string>,
    assets map<string,struct<href:string,gsd:double,
        bands:array<struct<name:string,`eo:center_wavelength`:double,nodata:double>>,
        `eo:bands`:array<struct<name:string,center_wavelength:double,full_width_half_max:double>>>>
"""
PIXELS = """
    scene_id string, pixel_id bigint, row int, col int, nodata_mask tinyint, cloud_mask tinyint, cirrus_mask tinyint,
    red double, red_edge double, nir double, swir double
"""
BANDS = "scene_id string, band_index int, wavelength_nm double, band_name string, nodata double"
SPECTRA = "scene_id string, band_index int, pixel_id bigint, reflectance float"
SCENES = """
    scene_id string, platform string, acquired_at timestamp, tile string, relative_orbit int, generation_time string,
    cloud_cover double, west double, south double, east double, north double
"""
SCENE_PIXELS = "scene_id string, cell_x int, cell_y int, b04 float, b05 float, b8a float, b11 float, scl tinyint"
TIME_SERIES = """
    date date, acquisition_datetime timestamp, acquisition_datetimes string, scene_ids string, scene_cloud_percent string,
    valid_pixel_count bigint, vegetation_pixel_count bigint, footprint_pixel_count bigint,
    valid_footprint_percentage double, vegetation_percentage_of_valid double,
    ndvi_median double, ndvi_p25 double, ndvi_p75 double, ndre_median double, ndre_p25 double, ndre_p75 double,
    ndmi_median double, ndmi_p25 double, ndmi_p75 double,
    eligible_at_decision_cutoff boolean, after_decision_cutoff boolean, operational_availability string
"""
GROUND = """
    observation_id string, lon double, lat double, timestamp string, crop_type string, observer_type string,
    plant_condition string, soil_condition string, recent_irrigation string, verification_state string,
    recent_irrigation_timestamp string, symptoms string, notes string, photo_reference string, verification_reference string
"""
SENSORS = """
    sensor_id string, lon double, lat double, timestamp string, soil_moisture double, air_temperature double,
    relative_humidity double, soil_temperature double, ec double, ph double, leaf_wetness double, state string,
    quality_valid boolean, cal_state string, cal_reference string, cal_site_reference string, calibrated_at string, valid_until string
"""
AVAILABILITY = "result_id string, source string, state string"
GROUND_CONTRACT = """
    sensor_id string, sensor_timestamp string, soil_moisture_value double, soil_moisture_unit string,
    location struct<latitude:double,longitude:double>, quality_valid boolean, measurement_depth_cm double,
    calibration_reference string, interpretation string, interpretation_authority string
"""
