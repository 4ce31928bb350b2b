"""Explicit input schemas (DDL strings, readable by every Spark reader)."""

BILLS = (
    "account string, contract bigint, issue_date date, year int, month int, office int, "
    "benefit_type string, product_code string, class_code string, usage_code string, "
    "water_item string, sewage_item string, units int, days int, "
    "meas_water decimal(18,7), meas_sewage decimal(18,7), meas_effluent decimal(18,7), "
    "bill_water_pos decimal(18,7), bill_water_neg decimal(18,7), "
    "bill_sewage_pos decimal(18,7), bill_sewage_neg decimal(18,7), "
    "bill_effluent_pos decimal(18,7), bill_effluent_neg decimal(18,7), processed string"
)
REGISTRY = "account string, territory string, end_date date, registry_id bigint"
PRICE_INDEX_RAW = "data string, valor string"
PRICE_INDEX_ALT_RAW = "D3C string, V string"
SURVEY_RAW = (
    "Indicador string, Data string, DataReferencia string, Media double, Mediana double, baseCalculo int"
)
CLIMATE_DAILY_RAW = "cd_ibge string, day string, T2M double, T2M_MAX double, T2M_MIN double, PRECTOTCORR double, RH2M double, T2MDEW double, WS2M double"
BASE = (
    "series_key string, region string, municipality string, ibge_code string, office int, category string, "
    "category_detail string, territory string, size_class string, abc_class string, period date, "
    "vol_meas_water double, vol_meas_sewage double, vol_bill_water double, vol_bill_sewage double, "
    "units_water double, units_sewage double, conns_water double, conns_sewage double, "
    "n_bills double, days double, vol_meas_water_raw double, vol_bill_water_raw double, "
    "vol_meas_water_imputed double, rebalanced boolean, prec_tot double, temp_med double, jobs double, "
    "real_tariff double"
)
BASE_ALIASES = {"irt_real": "real_tariff"}
BASE_OPTIONAL = ["size_class"]
DECISION = "segment string, target string, category_detail string, grouping string, model string"

# Keys
SERIES = ["region", "municipality", "ibge_code", "office", "category", "category_detail", "territory"]
SERIES_SIZE = [*SERIES, "size_class"]
GROUP_NO_DETAIL = [c for c in SERIES_SIZE if c != "category_detail"]
MODEL_SERIES = ["region_adj", "group", "category_detail", "territory"]
FACT_KEYS = ["account", "category_code", "item_code", "office", "territory", "year", "month"]
