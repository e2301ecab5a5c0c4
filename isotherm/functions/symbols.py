"""Weather symbols from the codes of the services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
WMO_SYMBOLS = {
    "klar": [0], "heiter": [1], "wolkig": [2], "bedeckt": [3], "nebel": [45, 48],
    "niesel": [51, 53, 55], "glatteis": [56, 57, 66, 67], "regen": [61, 63],
    "starkregen": [65, 82], "schnee": [71, 73, 75, 77], "schauer": [80, 81],
    "schneeschauer": [85, 86],
}
WMO_THUNDER_FROM = 95
# text codes: (kind of test, text, symbol), the first that fits
TEXT_RULES = [
    ("contains", "thunder", "gewitter"), ("contains", "snowshowers", "schneeschauer"),
    ("contains", "sleet", "schneeregen"), ("contains", "snow", "schnee"),
    ("contains", "rainshowers", "schauer"), ("equals", "heavyrain", "starkregen"),
    ("equals", "lightrain", "niesel"), ("contains", "rain", "regen"),
    ("equals", "clearsky", "klar"), ("equals", "fair", "heiter"),
    ("equals", "partlycloudy", "wolkig"), ("equals", "cloudy", "bedeckt"), ("equals", "fog", "nebel"),
]
ICON_SYMBOLS = {
    "clear": "klar", "partly-cloudy": "wolkig", "cloudy": "bedeckt", "fog": "nebel", "wind": "wind",
    "rain": "regen", "sleet": "schneeregen", "snow": "schnee", "hail": "gewitter",
    "thunderstorm": "gewitter",
}
# wet symbols from strong to weak, dry symbols from bright to dull
WET_SYMBOLS = ["gewitter", "glatteis", "schnee", "schneeschauer", "schneeregen", "starkregen",
               "regen", "schauer", "niesel"]
DRY_SYMBOLS = ["klar", "heiter", "wolkig", "bedeckt", "nebel", "wind"]
# -----------------------------------------------------------------------------


def _chain(pairs: list[tuple[Column, Column]]) -> Column:
    first, *rest = pairs
    return reduce(lambda acc, p: acc.when(p[0], p[1]), rest, F.when(*first))


def wmo_symbol(code: Column) -> Column:
    code = code.cast("int")
    pairs = [(code.isin(codes), F.lit(name)) for name, codes in WMO_SYMBOLS.items()]
    return _chain([*pairs, (code >= WMO_THUNDER_FROM, F.lit("gewitter"))])


def text_symbol(code: Column) -> tuple[Column, Column]:
    """(symbol, is-day) of a text code such as ``partlycloudy_night``."""
    base = F.substring_index(code, "_", 1)
    suffix = F.when(F.contains(code, F.lit("_")), F.substring(code, F.length(base) + 2, F.length(code)))
    pairs = [
        (F.contains(base, F.lit(t)) if kind == "contains" else base == t, F.lit(name))
        for kind, t, name in TEXT_RULES
    ]
    return F.when(code != "", _chain(pairs)), F.when(suffix != "", suffix == "day")


def icon_symbol(icon: Column) -> tuple[Column, Column]:
    base = F.replace(F.replace(icon, F.lit("-day"), F.lit("")), F.lit("-night"), F.lit(""))
    symbol = _chain([(base == k, F.lit(v)) for k, v in ICON_SYMBOLS.items()])
    day = F.when(F.endswith(icon, F.lit("-day")), F.lit(True)).when(
        F.endswith(icon, F.lit("-night")), F.lit(False))
    return symbol, day


def with_symbol(df: DataFrame, kind: str, code: str | None = None) -> DataFrame:
    """Add ``symbol`` (and ``ist_tag`` where the code tells it)."""
    if kind == "wmo":
        return df.withColumn("symbol", wmo_symbol(F.col(code or "weather_code")))
    of = {"text": text_symbol, "icon": icon_symbol}[kind]
    symbol, day = of(F.col(code or {"text": "symbol_code", "icon": "icon"}[kind]))
    return df.withColumns({"symbol": symbol, "ist_tag": day})

