"""Node labels, account codes and column-name resolution."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockweave.functions.numeric import as_col

# Account codes of the flow table and the node-label separator.
PRODUCTION_PREFIX = "P_"
FINAL_DEMAND_ACCOUNTS = ("HH", "GOV", "CF", "WRL_REST")
LABEL_SEPARATOR = "::"

# ISO-2 code -> (ISO-3 code, country name).
ISO_COUNTRIES = {
    "AT": ("AUT", "Austria"),
    "BE": ("BEL", "Belgium"),
    "BG": ("BGR", "Bulgaria"),
    "HR": ("HRV", "Croatia"),
    "CY": ("CYP", "Cyprus"),
    "CZ": ("CZE", "Czechia"),
    "DK": ("DNK", "Denmark"),
    "EE": ("EST", "Estonia"),
    "FI": ("FIN", "Finland"),
    "FR": ("FRA", "France"),
    "DE": ("DEU", "Germany"),
    "GR": ("GRC", "Greece"),
    "HU": ("HUN", "Hungary"),
    "IE": ("IRL", "Ireland"),
    "IT": ("ITA", "Italy"),
    "LV": ("LVA", "Latvia"),
    "LT": ("LTU", "Lithuania"),
    "LU": ("LUX", "Luxembourg"),
    "MT": ("MLT", "Malta"),
    "NL": ("NLD", "Netherlands"),
    "PL": ("POL", "Poland"),
    "PT": ("PRT", "Portugal"),
    "RO": ("ROU", "Romania"),
    "SK": ("SVK", "Slovakia"),
    "SI": ("SVN", "Slovenia"),
    "ES": ("ESP", "Spain"),
    "SE": ("SWE", "Sweden"),
    "GB": ("GBR", "United Kingdom"),
    "UK": ("GBR", "United Kingdom"),
    "NO": ("NOR", "Norway"),
    "CH": ("CHE", "Switzerland"),
    "IS": ("ISL", "Iceland"),
    "US": ("USA", "United States"),
    "CN": ("CHN", "China"),
    "JP": ("JPN", "Japan"),
    "KR": ("KOR", "South Korea"),
    "CA": ("CAN", "Canada"),
    "AU": ("AUS", "Australia"),
}
# Source lists that write Greece as EL are aliased before any lookup.
COUNTRY_ALIASES = {"EL": "GR"}


def is_production(account: Column | str) -> Column:
    return as_col(account).startswith(PRODUCTION_PREFIX)


def is_final_demand(account: Column | str) -> Column:
    return as_col(account).isin(*FINAL_DEMAND_ACCOUNTS)


def is_filled(code: Column | str) -> Column:
    """Code is neither missing nor blank."""
    code = as_col(code)
    return code.isNotNull() & (F.length(F.trim(code)) > 0)


def node_label(country: Column | str, sector: Column | str) -> Column:
    return F.concat_ws(LABEL_SEPARATOR, as_col(country), as_col(sector))


def label_country(label: Column | str) -> Column:
    return F.split(as_col(label), LABEL_SEPARATOR, 2).getItem(0)


def label_sector(label: Column | str) -> Column:
    """Part after the separator; a label without one stands for itself."""
    parts = F.split(as_col(label), LABEL_SEPARATOR, 2)
    return F.coalesce(F.get(parts, F.lit(1)), parts.getItem(0))


def label_is_valid(label: Column | str) -> Column:
    """Exactly one separator with text on both sides."""
    parts = F.split(as_col(label), LABEL_SEPARATOR)
    return F.coalesce(
        (F.size(parts) == 2)
        & (F.length(F.trim(F.get(parts, F.lit(0)))) > 0)
        & (F.length(F.trim(F.get(parts, F.lit(1)))) > 0),
        F.lit(False),
    )


def prefixed_code(code: Column | str) -> Column:
    return F.concat(F.lit(PRODUCTION_PREFIX), F.trim(as_col(code)))


def edge_caption(i_label: Column | str, j_label: Column | str) -> Column:
    return F.concat_ws(" → ", as_col(i_label).cast("string"), as_col(j_label).cast("string"))


def resolve(df: DataFrame, candidates: Iterable[str], what: str) -> str:
    """First candidate that is a column of ``df``."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}; expected one of {list(candidates)}")


def resolve_pair(df: DataFrame, pairs: Sequence[tuple[str, str]], what: str) -> tuple[str, str]:
    """First pair of columns that are both present in ``df``."""
    for left, right in pairs:
        if left in df.columns and right in df.columns:
            return left, right
    raise ValueError(f"no {what} columns among {df.columns}; expected one of {list(pairs)}")


def canonical_country(code: Column | str) -> Column:
    """Trimmed upper-case code with source aliases replaced."""
    c = F.upper(F.trim(as_col(code).cast("string")))
    for alias, target in COUNTRY_ALIASES.items():
        c = F.when(c == alias, F.lit(target)).otherwise(c)
    return c
