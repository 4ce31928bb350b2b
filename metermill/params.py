"""Parameters.  Defaults are the production values; ``driver_scale`` re-scales
them to the TPC-H-like test tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from . import rules


@dataclass(frozen=True)
class SizeParams:
    ref_from: int = 202501
    ref_to: int = 202512
    min_months: int = 6
    # detail -> (minimum share of the series, minimum median volume)
    thresholds: tuple[tuple[str, float, float], ...] = (("Industrial", 0.0005, 5000.0), ("Pública", 0.0010, 1000.0))
    grid_share: tuple[float, ...] = (0.0005, 0.0010, 0.0025, 0.0050, 0.0100)
    grid_volume: tuple[float, ...] = (500.0, 1000.0, 5000.0)
    eval_year: int = 2025
    eval_last_month: int = 8


@dataclass(frozen=True)
class AbsurdParams:
    floor: float = 50_000.0
    ratio: float = 10.0


@dataclass(frozen=True)
class BaseParams:
    first_period: date = date(2022, 1, 1)
    default_territory: str = rules.TERRITORY_URBAN
    abc_months: int = 12
    abc_cut_a: float = 0.80
    abc_cut_b: float = 0.95
    min_units: float = 10.0
    min_volume: float = 100.0
    tolerance_months: int = 2
    window_start: date | None = date(2026, 3, 1)
    share_min: float = 0.40
    share_max: float = 0.60
    share_default: float = 0.505
    calendar_start: date = date(2020, 1, 1)
    # (ibge code, region, municipality, office)
    overrides: tuple[tuple[str, str, str, int], ...] = (("354780", "OC", "SANTO ANDRE", 72),)
    cycle_from: int = 202510
    cycle_to: int = 202607
    top_n: int = 30


@dataclass(frozen=True)
class TariffParams:
    base_month: date = date(2022, 1, 1)
    last_month: date = date(2026, 8, 1)
    # Fixed values: (month on bills, valid from, detail or None for all, percent)
    adjustments: tuple[tuple[date, date, str | None, float], ...] = (
        (date(2022, 6, 1), date(2022, 5, 10), None, 12.8019),
        (date(2023, 6, 1), date(2023, 5, 10), None, 9.5609),
        (date(2024, 6, 1), date(2024, 5, 10), None, 6.4469),
        (date(2024, 8, 1), date(2024, 7, 23), "Residencial Normal", -1.0),
        (date(2024, 8, 1), date(2024, 7, 23), "Residencial Social", -10.0),
        (date(2024, 8, 1), date(2024, 7, 23), "Residencial Social Vulnerável", -10.0),
        (date(2024, 8, 1), date(2024, 7, 23), "Comercial", -0.5),
        (date(2024, 8, 1), date(2024, 7, 23), "Industrial", -0.5),
        (date(2024, 8, 1), date(2024, 7, 23), "Pública", 0.0),
        (date(2026, 4, 1), date(2026, 1, 1), None, 6.1106),
    )
    details: tuple[str, ...] = rules.MODEL_DETAILS


@dataclass(frozen=True)
class CovariateParams:
    state: str = "SP"
    code_min: int = 110_000
    code_max: int = 539_999
    fill_value: float = -999.0
    fill_cut: float = -990.0
    min_coverage: float = 0.9
    max_fail_rate: float = 0.05
    min_alignment: float = 0.8
    reread_months: int = 3
    current_month: date = date(2026, 9, 1)


@dataclass(frozen=True)
class GroupingParams:
    capital: str = "SAO PAULO"
    by_office: tuple[str, ...] = ("SAO PAULO", "OSASCO", "GUARULHOS")
    capital_prefix: str = "SP_"


@dataclass(frozen=True)
class SegmentParams:
    """What a segment sets differently in its backtest and projection."""

    name: str
    categories: tuple[str, ...]
    clean_units: bool
    units_over_categories: bool
    units_level: tuple[str, ...]


SEGMENTS = (
    SegmentParams("Residencial", ("Residencial",), False, True, ("region_adj", "territory")),
    SegmentParams("Nao_Residencial", ("Comercial", "Industrial", "Pública"), True, False, ("region_adj", "category_detail")),
)


@dataclass(frozen=True)
class BacktestParams:
    segment: str = "Residencial"
    target: str = "med_agua"
    categories: tuple[str, ...] = ("Residencial",)
    size_mode: str = "sum"  # "sum" | "others"
    targets: tuple[str, ...] = ("med_agua", "med_esg")
    cut: date = date(2026, 1, 1)
    horizon: int = 8
    min_obs: int = 36
    merged_months: tuple[tuple[date, ...], ...] = ((date(2026, 3, 1), date(2026, 4, 1)),)
    treat_outliers: bool = True
    clean_units: bool = False
    actual: str = "raw"  # "raw" | "adjusted"
    fix_peaks: bool = True
    peak_factor: float = 3.0
    peak_months: int = 3
    groupings: tuple[str, ...] = ("G1_municipioA_clusterBC", "G2_superintendencia")
    models: tuple[str, ...] = tuple(rules.MODELS)
    test_units: str = "actual"  # "actual" | "projected"
    units_over_categories: bool = True
    select_by: tuple[str, ...] = ("category_detail",)
    select_level: str = "superintendencia"
    metric: str = "wape"
    select_scenario: str = "base"
    tolerance: float = 0.05


@dataclass(frozen=True)
class ProjectionParams:
    last_period: date = date(2027, 12, 1)
    min_obs_model: int = 36
    min_obs_units: int = 24
    max_imputed_run: int = 3
    units_level: tuple[str, ...] = ("region_adj", "territory")
    targets: tuple[str, ...] = tuple(rules.TARGETS)
    outside_premise: str = "trend"  # "trend" | "constant"
    coverage: str = "municipality_service"  # "municipality_service" | "municipality"
    default_choice: tuple[str, str] = ("G1_municipioA_clusterBC", "arima_2")
    # manual overrides: (segment, target, detail, grouping, model)
    manual_choice: tuple[tuple[str, str, str, str, str], ...] = ()
    adjustment: float = 0.065
    adjustment_month: date = date(2027, 4, 1)
    inflation: float = 0.045
    elasticity: tuple[tuple[str, float], ...] = tuple((d, -0.10) for d in rules.MODEL_DETAILS)
    default_elasticity: float = -0.10
    sensitivity_low: float = 0.5
    sensitivity_high: float = 1.5
    scenarios: tuple[str, ...] = ("base", "el_nino", "quente_seco", "frio_umido")
    main_scenario: str = "el_nino"
    analogue_from: date = date(2023, 6, 1)
    analogue_to: date = date(2024, 5, 1)
    apply_from: date = date(2027, 1, 1)
    apply_to: date = date(2027, 12, 1)
    intensity: float = 1.0
    smoothing: int = 3


@dataclass(frozen=True)
class Params:
    size: SizeParams = field(default_factory=SizeParams)
    absurd: AbsurdParams = field(default_factory=AbsurdParams)
    base: BaseParams = field(default_factory=BaseParams)
    tariff: TariffParams = field(default_factory=TariffParams)
    covariates: CovariateParams = field(default_factory=CovariateParams)
    grouping: GroupingParams = field(default_factory=GroupingParams)
    backtest: BacktestParams = field(default_factory=BacktestParams)
    projection: ProjectionParams = field(default_factory=ProjectionParams)
    segments: tuple[SegmentParams, ...] = SEGMENTS

    def part(self, segment: SegmentParams, target: str) -> Params:
        """The parameters of one segment x target."""
        b = replace(
            self.backtest, segment=segment.name, target=target, categories=segment.categories, clean_units=segment.clean_units,
            units_over_categories=segment.units_over_categories,
        )
        return replace(self, backtest=b, projection=replace(self.projection, units_level=segment.units_level))


def driver_scale() -> Params:
    """Production rules at the magnitudes and dates of the test tables."""
    p = Params()
    shift = 25 * 12 + 1  # 2026-08 (last production month) -> 2001-07

    def back(d: date, months: int = shift) -> date:
        i = d.year * 12 + d.month - 1 - months
        return date(i // 12, i % 12 + 1, 1)

    return replace(
        p,
        size=replace(
            p.size,
            ref_from=200001, ref_to=200012, min_months=2,
            thresholds=(("Industrial", 0.02, 40.0), ("Pública", 0.03, 30.0)),
            grid_share=(0.0005, 0.0050, 0.0100, 0.0200, 0.0500), grid_volume=(10.0, 30.0, 60.0),
            eval_year=2000, eval_last_month=7,
        ),
        absurd=AbsurdParams(floor=150.0, ratio=2.0),
        base=replace(
            p.base,
            first_period=date(1995, 1, 1), min_units=1.5, min_volume=20.0, tolerance_months=2,
            window_start=date(2001, 3, 1), calendar_start=date(1994, 1, 1),
            overrides=(("350003", "OC", "SANTO ANDRE", 72),),
            cycle_from=200010, cycle_to=200107,
        ),
        tariff=replace(
            p.tariff,
            base_month=date(1997, 1, 1), last_month=date(2001, 7, 1),
            adjustments=tuple((back(a), back(b), c, d) for a, b, c, d in p.tariff.adjustments),
        ),
        covariates=replace(p.covariates, current_month=date(2024, 2, 1)),
        grouping=replace(p.grouping, capital="NATION_0", by_office=("NATION_0", "NATION_1", "NATION_2")),
        backtest=replace(
            p.backtest,
            segment="Todos", categories=rules.SIZE_CATEGORIES,
            cut=date(2000, 12, 1), merged_months=((date(2001, 3, 1), date(2001, 4, 1)),),
        ),
        projection=replace(
            p.projection,
            last_period=date(2002, 12, 1), adjustment_month=date(2002, 4, 1),
            analogue_from=date(1998, 6, 1), analogue_to=date(1999, 5, 1),
            apply_from=date(2002, 1, 1), apply_to=date(2002, 12, 1),
        ),
    )
