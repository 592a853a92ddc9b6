"""Physical constants, limits, column names and feature lists.

They have to equal the values that users of such forecast and sensor files
already rely on, so they are stated here once and taken as given.
"""

# --- air and wind -----------------------------------------------------------
R_DRY = 287.05
EPSILON = 0.62197
ONE_MINUS_EPSILON = 0.37803
VAPOUR_SHARE = 0.378
RHO_STANDARD = 1.225
CALM_FLOOR = 1e-3
HUB_HEIGHT = 117.0
GUST_RATIO_MAX = 5.0
RH_MAX = 100.0
TIME_JUMP = 15.0
SPACE_JUMP = 10.0

# --- geography --------------------------------------------------------------
EARTH_KM = 6371.0
IDW_NEIGHBOURS = 4
IDW_POWER = 2.0
MIN_KM = 1e-6
TINY = 1e-8
GROUPS = ["kpx_group_1", "kpx_group_2", "kpx_group_3"]
GROUP_CAPACITY = {"kpx_group_1": 21600.0, "kpx_group_2": 21600.0, "kpx_group_3": 21000.0}

# --- ten-minute sensors -----------------------------------------------------
SAMPLES_PER_HOUR = 6
RELAXED_SAMPLES = 5
POWER_CAP_RATIO = 1.05
NEGATIVE_RATIO = 0.05
FROZEN_STEPS = 18
CUT_IN = 3.0
HIGH_WIND = 5.0
LOW_WIND = 1.0
WIND_MAX = 75.0
DISAGREE_RATIO = 0.5
MAX_GAP = 2
SWEPT_AREA = {"V126": 12469.0, "U136": 14470.0}
CUT_OUT = {"V126": 22.5, "U136": 22.0}
# The position in this list is the bit of the stored quality code.
QC_FLAGS = [
    "is_power_outlier", "is_power_neg_large", "is_power_neg_small", "is_frozen_sensor",
    "is_high_wind_zero_power", "is_low_wind_zero_power", "is_cut_out",
    "is_ws_out_of_range", "is_turbine_disagreement",
]
DISTRUST_FLAGS = ["is_power_outlier", "is_power_neg_large", "is_frozen_sensor"]

# --- settlement -------------------------------------------------------------
PRICE_STEPS = [(0.06, 4.0), (0.08, 3.0)]
SOFT_STEEPNESS = 40.0
CALIBRATION_STEPS = 21
SLOPE_RANGE = (0.85, 1.15)
OFFSET_RANGE = (-0.02, 0.02)
BLEND_STEPS = 21
TEST_RATIO = 0.2
TUNE_RATIO = 0.5
AUDIT_MINIMUM = 500
SEQUENCE_LENGTH = 24
SEASONS = ["winter", "spring", "summer", "autumn"]
HOUR_BUCKETS = ["short", "middle", "long"]
ORACLE_MODEL = "Persistence_oracle_lag1"

# --- source columns ---------------------------------------------------------
LDAPS_NAMES = {
    "heightAboveGround_10_10u": "u10", "heightAboveGround_10_10v": "v10",
    "heightAboveGround_50_50MUmax": "u50_max", "heightAboveGround_50_50MUmin": "u50_min",
    "heightAboveGround_50_50MVmax": "v50_max", "heightAboveGround_50_50MVmin": "v50_min",
    "heightAboveGround_5_XBLWS": "blws_x", "heightAboveGround_5_YBLWS": "blws_y",
    "heightAboveGround_2_t": "t2m", "heightAboveGround_2_dpt": "dpt2m",
    "heightAboveGround_2_q": "q2m", "heightAboveGround_2_r": "rh2m",
    "surface_0_sp": "sp", "meanSea_0_prmsl": "prmsl", "etc_0_blh": "blh",
    "surface_0_NDNSW": "nd_sw", "surface_0_NDNLW": "nd_lw",
    "heightAboveGround_2_SWDIR": "sw_dir", "heightAboveGround_2_SWDIF": "sw_dif",
    "etc_0_hcc": "hcc", "etc_0_mcc": "mcc", "etc_0_lcc": "lcc", "etc_0_VLCDC": "vlcdc",
    "surface_0_avg_lsprate": "ls_prate", "surface_0_lssrate": "ls_srate",
    "surface_0_ncpcp": "ncpcp", "surface_0_snol": "snol", "surface_0_SNOM": "snom",
    "surface_0_lsm": "lsm", "surface_0_h": "surface_h",
}
GFS_NAMES = {
    "heightAboveGround_10_10u": "gfs_u10", "heightAboveGround_10_10v": "gfs_v10",
    "heightAboveGround_80_u": "gfs_u80", "heightAboveGround_80_v": "gfs_v80",
    "heightAboveGround_100_100u": "gfs_u100", "heightAboveGround_100_100v": "gfs_v100",
    "heightAboveGround_2_2t": "gfs_t2m", "heightAboveGround_2_2d": "gfs_dpt2m",
    "heightAboveGround_2_2r": "gfs_rh2m", "heightAboveGround_2_2sh": "gfs_q2m",
    "planetaryBoundaryLayer_0_u": "gfs_pbl_u", "planetaryBoundaryLayer_0_v": "gfs_pbl_v",
    "planetaryBoundaryLayer_0_VRATE": "gfs_vrate",
    "surface_0_sp": "gfs_sp", "meanSea_0_prmsl": "gfs_prmsl", "surface_0_gust": "gfs_gust",
    "surface_0_dswrf": "gfs_dswrf", "surface_0_dlwrf": "gfs_dlwrf",
    "surface_0_prate": "gfs_prate", "surface_0_tp": "gfs_tp",
    "lowCloudLayer_0_lcc": "gfs_lcc", "middleCloudLayer_0_mcc": "gfs_mcc",
    "highCloudLayer_0_hcc": "gfs_hcc", "atmosphere_0_tcc": "gfs_tcc",
    "isobaricInhPa_850_t": "gfs_t850", "isobaricInhPa_850_u": "gfs_u850",
    "isobaricInhPa_850_v": "gfs_v850", "isobaricInhPa_850_r": "gfs_rh850",
    "isobaricInhPa_700_t": "gfs_t700", "isobaricInhPa_700_u": "gfs_u700",
    "isobaricInhPa_700_v": "gfs_v700",
    "isobaricInhPa_500_gh": "gfs_gh500", "isobaricInhPa_500_t": "gfs_t500",
    "isobaricInhPa_500_u": "gfs_u500", "isobaricInhPa_500_v": "gfs_v500",
}
SENSOR_NAMES = {"datetime": "kst_dtm", "power": "power_raw", "ws": "ws_raw", "wd": "wd_raw"}
SENSOR_REQUIRED = ["kst_dtm", "turbine", "power_raw", "ws_raw", "wd_raw"]
GRID_REQUIRED = [
    "forecast_kst_dtm", "data_available_kst_dtm", "grid_id", "latitude", "longitude",
    "heightAboveGround_10_10u", "heightAboveGround_10_10v",
]
GFS_LEVELS = {
    "10": ("gfs_u10", "gfs_v10"), "80": ("gfs_u80", "gfs_v80"), "100": ("gfs_u100", "gfs_v100"),
    "pbl": ("gfs_pbl_u", "gfs_pbl_v"), "850": ("gfs_u850", "gfs_v850"),
    "700": ("gfs_u700", "gfs_v700"), "500": ("gfs_u500", "gfs_v500"),
}
LDAPS_AREA_FEATURES = [
    "u10", "v10", "ws10", "air_density", "wind_power_density",
    "t2m", "dpt2m", "rh2m", "q2m", "t_dew_diff",
    "sp", "prmsl", "blh", "surface_h", "blws",
    "u50_range", "v50_range", "ws10_spatial_range",
    "lcc", "mcc", "hcc", "vlcdc", "ncpcp", "ls_prate", "nd_sw", "nd_lw",
]
LDAPS_STAT_FEATURES = [
    "ws10", "u10", "v10", "air_density", "wind_power_density",
    "t2m", "q2m", "sp", "blh", "rh2m", "lcc", "ncpcp",
]
GFS_AREA_FEATURES = [
    "gfs_u10", "gfs_v10", "gfs_ws_10", "gfs_u80", "gfs_v80", "gfs_ws_80",
    "gfs_u100", "gfs_v100", "gfs_ws_100",
    "gfs_ws_hub", "gfs_shear_alpha", "gfs_air_density", "gfs_wind_power_density",
    "gfs_pbl_u", "gfs_pbl_v", "gfs_ws_pbl", "gfs_vrate",
    "gfs_t2m", "gfs_dpt2m", "gfs_rh2m", "gfs_q2m", "gfs_t_dew_diff",
    "gfs_sp", "gfs_prmsl", "gfs_gust", "gfs_gust_factor",
    "gfs_dswrf", "gfs_dlwrf", "gfs_prate", "gfs_tp",
    "gfs_lcc", "gfs_mcc", "gfs_hcc", "gfs_tcc",
    "gfs_u850", "gfs_v850", "gfs_ws_850", "gfs_t850", "gfs_rh850",
    "gfs_u500", "gfs_v500", "gfs_ws_500", "gfs_gh500",
    "gfs_lapse_850", "gfs_bulk_shear_850",
]
