"""Fixed domain values."""

from __future__ import annotations

# Production types and the energy type they count towards.
PRODUCTION_MAP = {
    "Solar": "Solar",
    "Wind Onshore": "Wind",
    "Wind Offshore": "Wind",
    "Hydro Run-of-river and poundage": "Hydro",
}

# Area codes accepted by the generation, load and forecast scans.
AREA_CODES = [
    "AT", "BA", "BE", "BG", "CH", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE",
    "IT", "LT", "LV", "MD", "ME", "NL", "NO", "PL", "PT", "RO", "RS", "SE", "SI", "SK",
]

# Area codes accepted by the transfer-capacity scan.
NETWORK_CODES = [
    "AT", "BA", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GE", "GR", "HR",
    "HU", "IE", "IT", "LT", "LU", "LV", "MD", "ME", "NL", "NO", "PL", "PT", "RO", "RS", "SE", "SI", "SK",
]

# Price zones and their country.
ZONE_TO_COUNTRY = {
    "AT": "AT",
    "BE": "BE",
    "BG": "BG",
    "CH": "CH",
    "CZ": "CZ",
    "EE": "EE",
    "ES": "ES",
    "FI": "FI",
    "FR": "FR",
    "GB": "GB",
    "GR": "GR",
    "HR": "HR",
    "HU": "HU",
    "LT": "LT",
    "LV": "LV",
    "MD": "MD",
    "ME": "ME",
    "NL": "NL",
    "PL": "PL",
    "PT": "PT",
    "RO": "RO",
    "RS": "RS",
    "SI": "SI",
    "SK": "SK",
    "BA": "BA",
    "DE_LU": "DE",
    "IT-Calabria": "IT",
    "IT-CNORTH": "IT",
    "IT-CSOUTH": "IT",
    "IT-NORTH": "IT",
    "IT-SACOAC": "IT",
    "IT-SACODC": "IT",
    "IT-Sardinia": "IT",
    "IT-Sicily": "IT",
    "IT-SOUTH": "IT",
    "NO1": "NO",
    "NO2": "NO",
    "NO3": "NO",
    "NO4": "NO",
    "NO5": "NO",
    "NO2NSL": "NO",
    "SE1": "SE",
    "SE2": "SE",
    "SE3": "SE",
    "SE4": "SE",
    "DK1": "DK",
    "DK2": "DK",
    "IE_SEM": "IE",
}

# Panel columns dropped as unreliable.
DROPPED_VARIABLES = ["IE_Solar", "ME_Solar", "NL_Hydro", "MD_RM"]

# Thresholds of the report tables.
MPM_THRESHOLDS = [0.5, 0.7, 0.9]
WEIGHT_THRESHOLDS = [0.001, 0.005, 0.01, 0.02, 0.05, 0.10]

# Model settings.
MODEL = {
    "selected_lags": [1, 7],
    "exog_suffixes": ["wind", "solar"],
    "n_chains": 4,
    "pi_shrink": 0.001,
    "lag_decay": 2.0,
    "exog_weight": 0.5,
    "alpha_offset": 2,
    "pi_edge": 0.5,
    "ig_shape": 10.0,
    "ig_scale": 0.01,
    "v_h0": 10.0,
    "sigma_h2_start": 0.1,
}
