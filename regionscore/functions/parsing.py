"""Reading values out of source text: numbers, dates, names, tags, traffic, identifiers."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionscore.config import DEFAULT

NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def finite_or_null(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def finite_number(text: Column) -> Column:
    """A finite number from text, NULL for blanks, words and non-finite literals."""
    return F.when(text.rlike(NUMBER), finite_or_null(F.expr("try_cast(1 as double)") * text.try_cast("double")))


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma or point; anything not finite is unknown."""
    return finite_number(F.replace(text, F.lit(","), F.lit(".")))


def max_point_power(readings: Sequence[Column]) -> Column:
    """The largest valid connector power; station power is never a stand-in."""
    valid = [F.when(v > 0, v) for v in (decimal_comma(r) for r in readings)]
    return F.greatest(*valid) if len(valid) > 1 else valid[0]


def power_class(maximum_kw: Column, threshold: float = DEFAULT.fast_threshold_kw) -> Column:
    return F.when(maximum_kw >= threshold, "fast").when(maximum_kw.isNotNull(), "normal")


def point_count(text: Column) -> Column:
    """Charging points as an integer; a missing reading and a zero both mean one."""
    return F.coalesce(F.nullif(decimal_comma(text), F.lit(0.0)), F.lit(1.0)).cast("int")


def road_class(source_class: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Publisher road class to the published vocabulary; other values pass through in lower case."""
    text = F.btrim(F.coalesce(source_class, F.lit("")))
    result = None
    for key, name in (mapping or DEFAULT.road_class_mapping).items():
        hit = F.upper(text) == key
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(F.nullif(F.lower(text), F.lit("")))


def voltage_kv(tag: Column) -> Column:
    """Highest positive voltage of a tag list; only whole tokens in volts or kV count."""

    def reading(token: Column) -> Column:
        t = F.btrim(token)
        volts = F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), t.try_cast("double") / 1000.0)
        kilovolts = F.regexp_extract(t, r"(?i)^(-?[0-9]+(?:\.[0-9]+)?)\s*kv\z", 1).try_cast("double")
        return F.coalesce(volts, kilovolts)

    tokens = F.split(F.coalesce(tag, F.lit("")), ";")
    return F.array_max(F.filter(F.transform(tokens, reading), lambda v: v > 0))


@lru_cache(maxsize=1)
def _letter_tables() -> tuple[str, str, str]:
    """What the compatibility decomposition leaves of each character in ``a-z0-9``, over all code points.

    Characters that become one letter, those letters, and a JSON object of those that become several.
    """
    single_from, single_to, several = [], [], {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        whole = unicodedata.normalize("NFKD", char)
        base = "".join(c for c in whole if c in "abcdefghijklmnopqrstuvwxyz0123456789")
        if len(base) == 1:
            single_from.append(char)
            single_to.append(base)
        elif base:
            several[char] = base
    return "".join(single_from), "".join(single_to), json.dumps(several)


def district_key(name: Column) -> Column:
    """Matching key of a district name: lower case, no city suffix, no accents, letters and digits.

    A sharp s has no decomposition and is dropped like any other mark.
    """
    source, target, several = _letter_tables()
    text = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+\z", ""))
    text = F.replace(text, F.lit("a.d."), F.lit("an der"))
    text = F.regexp_replace(text, r",?\s*kreisfreie\s+stadt\z", "")
    text = F.translate(text, source, target)
    table = F.from_json(F.lit(several), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[ -~]$"), c).otherwise(F.coalesce(F.try_element_at(table, c), F.lit("")))), "")
    return F.regexp_replace(F.when(text.rlike("[^ -~]"), spelled).otherwise(text), "[^a-z0-9]+", "")


def publication_date(text: Column) -> Column:
    """The register's own publication date; a missing or impossible date stays unknown."""
    stated = F.regexp_extract(text, r"(?i)Letzte\s+Aktualisierung\s+vom:\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1)
    return F.try_to_date(F.nullif(stated, F.lit("")), "dd.MM.yyyy")


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def pad_ags(code: Column, width: int = 8) -> Column:
    """Left-pad a municipality key; a longer value is kept whole."""
    text = code.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def first_text(*candidates: Column, default: str | None = None) -> Column:
    """The first non-blank text."""
    options = [F.nullif(c.cast("string"), F.lit("")) for c in candidates]
    return F.coalesce(*options, F.lit(default)) if default is not None else F.coalesce(*options)


def valid_coordinates(lon: Column, lat: Column) -> Column:
    """Finite and in range; NULL coordinates are invalid, not unknown."""
    ok = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.coalesce(ok, F.lit(False))


def valid_position_json(coordinates: Column) -> Column:
    """Whether raw GeoJSON point coordinates are a list of two real, finite, in-range numbers."""
    p = F.from_json(coordinates, "array<double>")
    return F.coalesce(
        (F.size(p) >= 2)
        & ~F.coalesce(coordinates.rlike(r"true|false"), F.lit(False))
        & valid_coordinates(F.get(p, F.lit(0)), F.get(p, F.lit(1))),
        F.lit(False),
    )


DAY_TYPE_TOTALS = ("DTVKFZA", "DTVKFZW", "DTVKFZU", "DTVKFZS")


def _volume_problem(value: Column, field: str) -> Column:
    number = value.cast("double")
    not_finite = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(not_finite, f"{field} must be finite").when(number < 0, f"{field} must not be negative")


def traffic_observation(totals: Mapping[str, Column], light: Column, heavy: Column) -> Column:
    """``struct<total, light, heavy, problem>`` of one counted section.

    All day types zero at once means nothing was published. A positive total with a zero/zero
    split means the split was not published. Any other zero is a measurement.
    """
    all_days = totals["DTVKFZA"].cast("double")
    problem = F.coalesce(*[_volume_problem(c, name) for name, c in totals.items()])
    others_positive = F.lit(False)
    for name, c in totals.items():
        if name != "DTVKFZA":
            others_positive = others_positive | F.coalesce(c.cast("double") != 0, F.lit(False))
    unpublished = F.coalesce(all_days == 0, F.lit(False))
    problem = F.coalesce(
        problem,
        F.when(unpublished & others_positive, "zero all-days total with a positive day-type total"),
        F.when(~unpublished, F.coalesce(_volume_problem(light, "DTVLVA"), _volume_problem(heavy, "DTVSVA"))),
    )
    light, heavy = light.cast("double"), heavy.cast("double")
    no_split = F.coalesce((all_days > 0) & (light == 0) & (heavy == 0), F.lit(False))
    keep = problem.isNull() & ~unpublished
    return F.struct(
        F.when(keep, all_days).alias("total"),
        F.when(keep & ~no_split, light).alias("light"),
        F.when(keep & ~no_split, heavy).alias("heavy"),
        problem.alias("problem"),
    )


UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
SHA256 = r"^[0-9a-f]{64}\z"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256), F.lit(False))


def uuid_of_feature(feature_id: Column) -> Column:
    """The uuid a feature id ends in, after a dot or alone."""
    tail = r"(?i)(?:^|\.)([0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})\z"
    return F.nullif(F.regexp_extract(feature_id, tail, 1), F.lit(""))


# Display names of the renewable technologies.
TECHNOLOGY_LABELS = {
    "Windenergie": "Wind energy",
    "Photovoltaik Freifläche": "Ground-mounted solar",
    "Photovoltaik Bauliche": "Rooftop solar",
    "Biomasse": "Biomass",
    "Wasserkraft": "Hydropower",
    "Deponiegas": "Landfill gas",
    "Grubengas": "Mine gas",
    "Klärgas": "Sewage gas",
}


def technology_label(technology: Column) -> Column:
    result = F.when(F.lit(False), F.lit(""))
    for key, label in TECHNOLOGY_LABELS.items():
        result = result.when(technology == key, label)
    return result.otherwise(F.coalesce(F.nullif(F.trim(technology), F.lit("")), F.lit("Renewable energy")))


def technology_group(technology: Column) -> Column:
    return F.when(technology.startswith("Photovoltaik"), "solar").otherwise("wind")


def grid_key(lon: Column, lat: Column, size: float) -> Column:
    return F.concat_ws(":", F.floor(lon / size).cast("string"), F.floor(lat / size).cast("string"))


def is_stale(generated_at: Column, now: Column, days: int = DEFAULT.stale_after_days) -> Column:
    """Older than the limit; an unreadable time is not called stale."""
    age = F.unix_micros(now) - F.unix_micros(generated_at)
    return F.coalesce(age > days * 24 * 3600 * 1_000_000, F.lit(False))


def is_displayed_technology(technology: Column) -> Column:
    return F.coalesce(technology.isin(*DEFAULT.display_technologies), F.lit(False))
