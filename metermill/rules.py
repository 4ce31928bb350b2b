"""Rule tables.  Data only: operators turn them into Column expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CodeRule:
    """One line of the ordered classification; unset fields match anything."""

    code: str
    items: tuple[str, ...] = ()
    no_item: bool = False
    product: str | None = None
    product_prefix: str | None = None
    benefit: str | None = None
    class_in: tuple[str, ...] = ()
    class_has: tuple[str, ...] = ()
    usage: str | None = None


# Item and product codes, class fragments and category codes, in
# the order in which they apply (first match wins; "_NA" = known but unusable).
CODE_RULES: tuple[CodeRule, ...] = (
    CodeRule("PO", product="SB_PUBLICA_MUN_O"),
    CodeRule("SA", product="SB_PREDIO"),
    CodeRule("RS2", product="SB_SOCIAL_2_SR"),
    CodeRule("RS2", benefit="19", class_in=("SB_SOC_50_4",)),
    CodeRule("RST1", product_prefix="SB_SOCIAL", benefit="16"),
    CodeRule("RST1", benefit="-1", class_in=("SB_SOC_50_1",)),
    CodeRule("RST2", product_prefix="SB_SOCIAL", benefit="17"),
    CodeRule("RF", items=("FAV",), product="SB_FAVELAS_N"),
    CodeRule("AT", items=("PER",)),
    CodeRule("CA", items=("COM", "COM_D"), class_has=("_AS",)),
    CodeRule("CE", items=("COM", "COM_D"), class_has=("_ESPECIAL",)),
    CodeRule("C", items=("COM", "COM_D")),
    CodeRule("I", items=("CIP",), class_has=("_INDUS",)),
    CodeRule("C", items=("CIP",), class_has=("_COMER",)),
    CodeRule("C", items=("CIP",), usage="2"),
    CodeRule("I", items=("CIP",), usage="3"),
    CodeRule("_NA", items=("CIP",)),
    CodeRule("CD", items=("DF", "DFN", "PERS_M"), usage="2"),
    CodeRule("ID", items=("DF", "DFN", "PERS_M"), usage="3"),
    CodeRule("_NA", items=("DF", "DFN", "PERS_M")),
    CodeRule("REUSO", items=("MIN", "SB_REUSO")),
    CodeRule("RST1", items=("SOC", "SOC_2"), class_has=("SOC_50",)),
    CodeRule("RST2", items=("SOC", "SOC_2"), class_has=("SOC_75",)),
    CodeRule("RS", items=("SOC", "SOC_2")),
    CodeRule("CAM", items=("CAM",)),
    CodeRule("EMB", items=("EMB",)),
    CodeRule("RV", items=("FAV",)),
    CodeRule("PP", items=("PUB", "PUB_M"), class_has=("_PRO", "_PUBPROG", "CON_PR", "PUB_PR", "PUB_CON_PR")),
    CodeRule("PC", items=("PUB", "PUB_M"), class_has=("PURA", "PUBCONPUR", "PUB_CON_P", "PUB_PU", "PUB_CPUR")),
    CodeRule("P", items=("PUB", "PUB_M")),
    CodeRule("RE", items=("RES", "V_RES", "RES_D"), class_in=("SB_LINS_ESPECIAL", "SB_R_ESPECIAL")),
    CodeRule("R", items=("RES", "V_RES", "RES_D")),
    CodeRule("I", items=("IND",)),
    CodeRule("R", items=("NOR_1F", "NOR_5F", "SB_ESG_ND_ESP_4F"), no_item=True, usage="1"),
    CodeRule("C", items=("NOR_1F", "NOR_5F", "SB_ESG_ND_ESP_4F"), no_item=True, usage="2"),
    CodeRule("I", items=("NOR_1F", "NOR_5F", "SB_ESG_ND_ESP_4F"), no_item=True, usage="3"),
    CodeRule("P", items=("NOR_1F", "NOR_5F", "SB_ESG_ND_ESP_4F"), no_item=True, usage="4"),
)

# Item code prefixes and markers.
REUSE_ITEM = "SB_REUSO"
WATER_PREFIX = "SB_AGUA_"
SEWAGE_PREFIX = "SB_ESGOTO_"
AVAILABILITY_SUFFIX = "_D"
NO_ITEM = "-1"
NO_ACCOUNT = "-1"

# Category code -> description, detail, category.
CATEGORY_MAP: tuple[tuple[str, str, str, str], ...] = (
    ("R", "Residencial", "Residencial Normal", "Residencial"),
    ("RE", "Residencial especial", "Residencial Normal", "Residencial"),
    ("RS", "Residencial social", "Residencial Social", "Residencial"),
    ("RS2", "Residencial social 2", "Residencial Social", "Residencial"),
    ("RST1", "Residencial social tarifa 1", "Residencial Social", "Residencial"),
    ("RST2", "Residencial social tarifa 2", "Residencial Social", "Residencial"),
    ("RF", "Residencial favela", "Residencial Social Vulnerável", "Residencial"),
    ("RV", "Residencial vulnerável", "Residencial Social Vulnerável", "Residencial"),
    ("C", "Comercial", "Comercial", "Comercial"),
    ("CA", "Comercial assistencial", "Comercial", "Comercial"),
    ("CE", "Comercial especial", "Comercial", "Comercial"),
    ("CD", "Comercial demanda firme", "Comercial - DF", "Comercial"),
    ("I", "Industrial", "Industrial", "Industrial"),
    ("ID", "Industrial demanda firme", "Industrial - DF", "Industrial"),
    ("P", "Pública", "Pública", "Pública"),
    ("PC", "Pública com contrato", "Pública", "Pública"),
    ("PP", "Pública contrato de programa", "Pública", "Pública"),
    ("PO", "Pública outros", "Pública", "Pública"),
    ("SA", "Próprio", "Pública", "Pública"),
    ("AT", "Atacado", "Atacado", "Atacado"),
    ("REUSO", "Reúso", "Outras", "Outras"),
    ("CAM", "Caminhão", "Outras", "Outras"),
    ("EMB", "Embarcação", "Outras", "Outras"),
)

# Categories that can be split by size, and the firm-demand marker.
SIZE_CATEGORIES = ("Residencial", "Comercial", "Industrial", "Pública")
FIRM_DEMAND = "DF"
LARGE, OTHERS = "Grande", "Demais"

# Category details left out of the base.
EXCLUDED_DETAILS = ("Atacado", "Outras", "Industrial - DF", "Comercial - DF")
MODEL_DETAILS = (
    "Residencial Normal",
    "Residencial Social",
    "Residencial Social Vulnerável",
    "Comercial",
    "Industrial",
    "Pública",
)
RESIDENTIAL = "Residencial"
SOCIAL_PREFIX = "Residencial Social"
TERRITORY_TOTAL, TERRITORY_INFORMAL, TERRITORY_RURAL, TERRITORY_URBAN = "Total", "Informal", "Rural", "Urbano"

# Exclusion reasons and problem labels.
REASON_CLOSED, REASON_UNITS, REASON_VOLUME = "encerrada", "poucas economias", "pouco volume"
REASON_NONE = "válida"
OFFICE_UNKNOWN, OFFICE_DUPLICATE = "sem_ibge", "duplicada"
MULTI_BILL_TYPES = (
    "1. com estorno (refaturamento)",
    "2. mesmo período repetido",
    "3. períodos complementares (~1 mês)",
    "4. períodos somando > 40 dias",
)

# Target -> (volume column, units column).
TARGETS = {
    "med_agua": ("vol_meas_water", "units_water"),
    "fat_agua": ("vol_bill_water", "units_water"),
    "med_esg": ("vol_meas_sewage", "units_sewage"),
    "fat_esg": ("vol_bill_sewage", "units_sewage"),
}
# A billed target without a backtest uses the choice of the measured one.
MEASURED_SIBLING = {"fat_agua": "med_agua", "fat_esg": "med_esg"}

# Usage of new connections -> category detail x territory.
USAGE_MAP: tuple[tuple[str, str, str], ...] = (
    ("Normal", "Residencial Normal", "Urbano"),
    ("Normal", "Residencial Normal", "Informal"),
    ("Rural", "Residencial Normal", "Rural"),
    ("Tarifa Social", "Residencial Social", "Urbano"),
    ("Tarifa Social", "Residencial Social", "Informal"),
    ("Tarifa Social", "Residencial Social Vulnerável", "Urbano"),
    ("Tarifa Social", "Residencial Social Vulnerável", "Informal"),
)
BOTH_SERVICES = ("A E", "AE")

# External consultant's coarser regions.
EXTERNAL_REGIONS = {
    "OI": "OIOX", "OX": "OIOX", "OC": "OCOS", "OS": "OCOS",
    "OM": "OMOP", "OP": "OMOP", "OT": "OTOU", "OU": "OTOU",
}
EXTERNAL_CAPITAL = "M"

# Model terms, label and expected sign of the coefficient.
TERMS: tuple[tuple[str, str, str, int], ...] = (
    ("log(temp_med)", "temp_med", "Temperatura", 1),
    ("log(prec_tot)", "prec_tot", "Precipitação", -1),
    ("log(caged)", "jobs", "CAGED (estoque)", 1),
)


@dataclass(frozen=True)
class ModelSpec:
    """Dynamic regression with ARIMA errors on the log of the response."""

    name: str
    response: str = "consumption"
    regressors: tuple[str, ...] = ()
    d: tuple[int, ...] = (0, 1)
    seasonal_d: tuple[int, ...] = (0, 1)
    constant: bool = True
    seasonal_naive: bool = False

    @property
    def formula(self) -> str:
        if self.seasonal_naive:
            return f"SNAIVE(log({self.response}))"
        d = f"{self.d[0]}:{self.d[-1]}" if len(self.d) > 1 else str(self.d[0])
        sd = f"{self.seasonal_d[0]}:{self.seasonal_d[-1]}" if len(self.seasonal_d) > 1 else str(self.seasonal_d[0])
        head = [] if self.constant else ["0"]
        terms = [t for t, c, _, _ in TERMS if c in self.regressors]
        return f"log({self.response}) ~ " + " + ".join(
            [*head, f"pdq(0:2, {d}, 0:2)", f"PDQ(0:1, {sd}, 0:1)", *terms]
        )


CLIMATE = ("temp_med", "prec_tot")
CLIMATE_JOBS = (*CLIMATE, "jobs")
REGRESSORS = CLIMATE_JOBS

MODELS: dict[str, ModelSpec] = {
    m.name: m
    for m in (
        ModelSpec("snaive", seasonal_naive=True),
        ModelSpec("arima_0"),
        ModelSpec("arima_1", regressors=("temp_med",)),
        ModelSpec("arima_2", regressors=CLIMATE),
        ModelSpec("arima_2_caged", regressors=CLIMATE_JOBS),
        ModelSpec("arima_2_dsaz", regressors=CLIMATE, seasonal_d=(1,)),
        ModelSpec("arima_2_sem_drift", regressors=CLIMATE, d=(1,), constant=False),
        ModelSpec("vol_arima_2", response="volume", regressors=CLIMATE),
        ModelSpec("vol_arima_2_caged", response="volume", regressors=CLIMATE_JOBS),
        ModelSpec(
            "vol_arima_2_dsaz_sem_drift", response="volume", regressors=CLIMATE, seasonal_d=(1,), constant=False
        ),
    )
}
BENCHMARKS = ("snaive",)
VOLUME_MODELS = tuple(m for m, s in MODELS.items() if s.response == "volume")
DRIFTLESS = tuple(m for m in MODELS if "sem_drift" in m)
EXTERNAL, COMBINED, CHOSEN = "LCA", "COMBINADO", "escolha"

# Levels of the accuracy cube and of the elasticity summaries.
ACCURACY_LEVELS = {
    "total": (),
    "superintendencia": ("region_adj",),
    "categoria": ("category_detail",),
    "recorte": ("territory",),
    "superint_cat_rec": ("region_adj", "category_detail", "territory"),
}
ELASTICITY_LEVELS = {
    "geral": (),
    "categoria": ("category_detail",),
    "recorte": ("territory",),
    "superintendencia": ("region_adj",),
    "categoria_recorte": ("category_detail", "territory"),
}

# fixed values: variables of the daily climate provider and the names of their monthly means
CLIMATE = {
    "T2M": "temp_med", "T2M_MAX": "temp_max", "T2M_MIN": "temp_min", "PRECTOTCORR": "prec_tot", "RH2M": "humidity", "T2MDEW": "dew_point", "WS2M": "wind_speed",
}
