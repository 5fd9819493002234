"""The published score model written out once more, for the SQL twins alone.

Nothing here is imported from the package, so a wrong weight there does not go unseen.
"""

from __future__ import annotations

from typing import NamedTuple


class Term(NamedTuple):
    sort_order: int
    indicator: str
    indicator_score: str
    component_score: str
    weight: str
    constant: str
    measure: str | None
    unit: str | None
    inverse: bool | None


# Order | indicator | score | component | weight | constant | measure | unit | inverse
_TEXT = """
1|EV Readiness|ev_readiness_score|charger_density_score|0.40|0|charging_points_per_km2|charging points per km2|no
2|EV Readiness|ev_readiness_score|charger_accessibility_score|0.30|0|distance_to_nearest_charger_m|metres|yes
3|EV Readiness|ev_readiness_score|population_adjusted_coverage_score|0.30|0|charging_points_per_100k_population|charging points per 100 000 people|no
4|Charger Deficit|charger_deficit_score|ev_readiness_score|-1.00|100|||
5|Transport Load|transport_load_score|traffic_intensity_score|0.60|0|traffic_intensity_dtv|vehicles per day|no
6|Transport Load|transport_load_score|traffic_road_density_score|0.25|0|traffic_weighted_road_density|vehicle-kilometres per day per km2|no
7|Transport Load|transport_load_score|road_proximity_score|0.15|0|distance_to_nearest_road_m|metres|yes
8|Grid Readiness Proxy|grid_readiness_proxy_score|substation_proximity_score|0.45|0|distance_to_nearest_substation_m|metres|yes
9|Grid Readiness Proxy|grid_readiness_proxy_score|voltage_line_density_score|0.35|0|voltage_weighted_line_density|kV-kilometres per km2|no
10|Grid Readiness Proxy|grid_readiness_proxy_score|substation_density_score|0.20|0|substation_density|substations per km2|no
11|Renewable Context|renewable_context_score|renewable_capacity_density_score|0.70|0|renewable_capacity_mw_per_km2|MW per km2|no
12|Renewable Context|renewable_context_score|renewable_technology_diversity_score|0.30|0|renewable_technology_count|distinct operating technologies|no
13|Infrastructure Opportunity|infrastructure_opportunity_score|transport_load_score|0.40|0|||
14|Infrastructure Opportunity|infrastructure_opportunity_score|grid_readiness_proxy_score|0.35|0|||
15|Infrastructure Opportunity|infrastructure_opportunity_score|renewable_context_score|0.25|0|||
16|Investment Priority|investment_priority_score|charger_deficit_score|0.60|0|||
17|Investment Priority|investment_priority_score|infrastructure_opportunity_score|0.40|0|||
18|Grid Absorption Risk Proxy|grid_absorption_risk_proxy_score|local_energy_balance_score|0.45|0|renewable_balance_ratio|generation divided by consumption|no
19|Grid Absorption Risk Proxy|grid_absorption_risk_proxy_score|renewable_growth_score|0.30|0|renewable_growth_density_mw_per_km2|MW added per km2 over the growth window|no
20|Grid Absorption Risk Proxy|grid_absorption_risk_proxy_score|grid_readiness_proxy_score|-0.25|25|||
"""


def _term(line: str) -> Term:
    order, *text, inverse = line.split("|")
    return Term(int(order), *(t or None for t in text), {"yes": True, "no": False, "": None}[inverse])


SCORE_MODEL = tuple(_term(line) for line in _TEXT.strip().splitlines())


def sql_values() -> str:
    """The model as SQL rows."""
    quoted = lambda v: "NULL" if v is None else "'" + v + "'"
    rows = [
        f"({t.sort_order}, {quoted(t.indicator)}, {quoted(t.indicator_score)}, {quoted(t.component_score)}, {t.weight}::DOUBLE, {t.constant}::DOUBLE, {quoted(t.measure)}, {quoted(t.unit)}, {'NULL' if t.inverse is None else str(t.inverse).lower()})"
        for t in SCORE_MODEL
    ]
    return "(VALUES " + ", ".join(rows) + ") AS m(sort_order, indicator, indicator_score, component_score, component_weight, constant_term, measure, measure_unit, inverse_measure)"
