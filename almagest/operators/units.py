"""Quantities recorded in different units, brought to the common unit of their metric.

A multi-pattern automaton finds unit names near figures in unit, value_text and metric (and in the notes of sources);
of overlapping finds the longest counts, and the metric's quantity decides what an ambiguous name means. The codes
found are joined with a broadcast table of conversion factors, whose size is fixed by this module.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.plans import small

# Fixed values. quantity -> unit code (UCUM) -> (factor, shift, names): base = factor * figure + shift.
UNITS: dict[str, dict[str, tuple[float, float, str]]] = {
    "length": {
        "m": (1, 0, "m meter meters metre metres メートル 米"), "km": (1000, 0, "km kilometer kilometers kilometre kilometres キロメートル キロ"), "cm": (0.01, 0, "cm centimeter centimeters centimetre centimetres センチ センチメートル"),
        "mm": (0.001, 0, "mm millimeter millimeters millimetre millimetres ミリ ミリメートル"), "[ft_i]": (0.3048, 0, "[ft_i] ft foot feet ' ′ フィート"), "[in_i]": (0.0254, 0, "[in_i] in inch inches \" ″ インチ"),
        "[mi_i]": (1609.344, 0, "[mi_i] mi mile miles マイル"), "[nmi_i]": (1852, 0, "[nmi_i] nmi 海里"), "[yd_i]": (0.9144, 0, "[yd_i] yd yard yards ヤード"),
    },
    "temperature": {
        "K": (1, 0, "k kelvin kelvins ケルビン"), "Cel": (1, 273.15, "cel c °c degc ℃ celsius centigrade 摂氏"), "[degF]": (5 / 9, 273.15 - 32 * 5 / 9, "[degf] f °f degf ℉ fahrenheit 華氏"),
    },
    "pressure": {
        "Pa": (1, 0, "pa pascal pascals パスカル"), "hPa": (100, 0, "hpa hectopascal hectopascals ヘクトパスカル mbar millibar millibars ミリバール"), "kPa": (1000, 0, "kpa kilopascal kilopascals キロパスカル"),
        "bar": (1e5, 0, "bar bars バール"), "atm": (101325, 0, "atm atmosphere atmospheres 気圧"), "mm[Hg]": (133.322387415, 0, "mm[hg] mmhg torr"),
    },
    "speed": {
        "m/s": (1, 0, "m/s m.s-1 mps 秒速 秒速m メートル毎秒"), "km/h": (1 / 3.6, 0, "km/h km.h-1 kph kmh km/hr 時速 時速km キロ毎時"), "[mi_i]/h": (0.44704, 0, "[mi_i]/h mph mi/h マイル毎時"), "[kn_i]": (1852 / 3600, 0, "[kn_i] kn kt kts knot knots ノット"),
    },
    "count": {
        "1": (1, 0, "1 人 件 persons person people inhabitants likes like"), "10*3": (1e3, 0, "10*3 k thousand thousands 千 千人 千件"), "10*4": (1e4, 0, "10*4 万 万人 万件"), "10*6": (1e6, 0, "10*6 m mio million millions 百万 百万人"),
        "10*8": (1e8, 0, "10*8 億 億人"), "10*9": (1e9, 0, "10*9 bn billion billions"), "{dozen}": (12, 0, "{dozen} doz dozen dozens ダース"), "10*2": (100, 0, "10*2 hundred hundreds"),
    },
    "mass": {
        "kg": (1, 0, "kg kilogram kilograms kilo kilos キログラム キロ"), "g": (0.001, 0, "g gram grams グラム"), "mg": (1e-6, 0, "mg milligram milligrams ミリグラム"), "t": (1000, 0, "t tonne tonnes ton tons トン"), "[lb_av]": (0.45359237, 0, "[lb_av] lb lbs pound pounds ポンド"), "[oz_av]": (0.028349523125, 0, "[oz_av] oz ounce ounces オンス"),
    },
    "time": {
        "s": (1, 0, "s sec secs second seconds 秒"), "ms": (0.001, 0, "ms msec millisecond milliseconds ミリ秒"), "min": (60, 0, "min mins minute minutes m 分"), "h": (3600, 0, "h hr hrs hour hours 時間"), "d": (86400, 0, "d day days 日"), "wk": (604800, 0, "wk week weeks 週間"),
    },
    "area": {
        "m2": (1, 0, "m2 m² 平方メートル"), "km2": (1e6, 0, "km2 km² 平方キロ 平方キロメートル"), "har": (1e4, 0, "har ha hectare hectares ヘクタール"), "[acr_us]": (4046.8564224, 0, "[acr_us] ac acre acres エーカー"), "[mi_i]2": (1609.344**2, 0, "[mi_i]2 mi2 mi² sqmi 平方マイル"),
    },
}
# Names of several words, and words for metrics in metric names and notes (* = every metric of the quantity).
SPACED = {"area": {"sq km": "km2", "square kilometres": "km2", "square kilometers": "km2", "sq mi": "[mi_i]2", "square miles": "[mi_i]2", "sq m": "m2"}, "temperature": {"deg c": "Cel", "deg f": "[degF]", "degrees celsius": "Cel", "degrees fahrenheit": "[degF]"}, "length": {"nautical miles": "[nmi_i]"}, "speed": {"miles per hour": "[mi_i]/h"}}
TOPICS = {"height": "height heights elevation elevations", "distance": "distance distances", "temperature": "temperature temperatures temp temps", "pressure": "pressure pressures", "wind_speed": "wind winds windspeed windspeeds windspeed", "population": "population populations inhabitants",
          "likes": "likes", "mass": "mass masses weight weights load loads", "duration": "duration durations runningtime runningtimes runtime", "area": "area areas", "rainfall": "rainfall rain precipitation", "*count": "count counts"}
UNKNOWN = "?"  # told, but by a name that is none of the metric's quantity
_NUMBER = re.compile(r"[-+−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?|[-+−]?\.\d+")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().strip()


@cache
def _automaton(quantity: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for code, (_, _, names) in UNITS[quantity].items():
        for name in {*names.split(), code}:
            a.add_word(fold(name), (len(fold(name)), code))
    for name, code in SPACED.get(quantity, {}).items():
        a.add_word(name, (len(name), code))
    a.make_automaton()
    return a


def finds(text: str, quantity: str) -> list[tuple[int, int, str]]:
    """Unit names in a folded text as (start, end, code), left to right; of overlapping ones the longest. Letters right beside a name make it no name."""
    hits = []
    for end, (n, code) in _automaton(quantity).iter(text):
        a, b = end + 1 - n, end + 1
        letters = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalpha()
        digit = lambda i: 0 <= i < len(text) and text[i].isdigit()
        if (letters(a) and letters(a - 1)) or (letters(b - 1) and letters(b)) or (digit(a) and (digit(a - 1) or a and text[a - 1] in ".,")) or (digit(b - 1) and (digit(b) or text[b : b + 1] in (".", ",", "*"))):
            continue
        hits.append((a, b, code))
    hits.sort(key=lambda x: (x[0] - x[1], x[0]))
    kept: list[tuple[int, int, str]] = []
    for h in hits:
        if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
            kept.append(h)
    return sorted(kept)


def read_text(text: str, quantity: str, with_figure: bool) -> tuple[float | None, str | None]:
    """(figure, unit code) told by a text; with_figure False: the figure stands elsewhere and the last unit named counts.

    A figure belongs to the unit right after it, else to one right before it. Several figures with units of one
    quantity (1 h 15 min) are summed in the unit of the first. A word right after the figure that is no unit of the
    quantity makes the unit unknown where no other is told.
    """
    t = fold(text)
    hits = finds(t, quantity)
    if quantity == "count":  # the figure one is no unit beside other figures
        hits = [h for h in hits if t[h[0] : h[1]] != "1"] if with_figure else hits
    if not with_figure:
        return None, hits[-1][2] if hits else None
    masked = list(t)
    for a, b, _ in hits:
        masked[a:b] = "\0" * (b - a)
    numbers = [(m.start(), m.end(), float(m[0].replace(",", "").replace("−", "-"))) for m in _NUMBER.finditer("".join(masked))]
    if not numbers:
        return None, hits[-1][2] if hits else None
    told: list[tuple[float, str | None]] = []
    for i, (_, end, x) in enumerate(numbers):
        until = numbers[i + 1][0] if i + 1 < len(numbers) else len(t)
        after = [code for a, _, code in hits if end <= a < until]
        told.append((x, after[0] if after else None))
    first, unit = told[0]
    if unit is None:
        before = [code for a, _, code in hits if a < numbers[0][0]]
        return first, before[-1] if before else UNKNOWN if re.match(r"\s*[^\W\d_]", t[numbers[0][1] :]) else None
    scale = UNITS[quantity][unit][0]
    for x, code in told[1:]:
        if code is None or UNITS[quantity][code][1] or UNITS[quantity][unit][1] or quantity == "count":
            break
        first += x * UNITS[quantity][code][0] / scale * (-1 if told[0][0] < 0 else 1)
    return first, unit


def _words(metric: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKC", metric))
    return [w for w in re.split(r"[\s_\-()./\[\]]+", spaced.casefold()) if w]


def read_metric(metric: str, quantities: dict[str, str]) -> tuple[str | None, str | None]:
    """(metric of the table, unit code told by the name) of a metric's name as written, (None, None) if it is none of the table."""
    words = _words(metric)
    for n in range(len(words), 0, -1):
        head, rest = "".join(words[:n]), words[n:]
        key = next((m for m in quantities if head == m.replace("_", "").casefold()), None) or next((m for m, names in TOPICS.items() if m in quantities and head in names.split()), None)
        if key is None and n == 1:  # a name and its unit written together
            continue
        if key:
            q = quantities[key]
            if q not in UNITS:
                return key, None
            found = finds(" ".join(rest), q) if rest else []
            return (key, found[-1][2] if found else None) if not rest or found else (None, None)
    return None, None


@lru_cache(100_000)
def _read_names(metric: str | None, unit: str | None, quantities: tuple[tuple[str, str], ...]) -> tuple[str | None, str | None, str | None]:
    """(metric of the table, unit code by the unit column, unit code by the metric's name)."""
    by_metric = dict(quantities)
    key, told = read_metric(metric, by_metric) if metric else (None, None)
    q = by_metric.get(key)
    if q not in UNITS:
        return None, None, None
    own = finds(fold(unit), q) if unit and unit.strip() else None
    return key, None if own is None else own[-1][2] if own else UNKNOWN, told


def read_note(note: str, quantities: dict[str, str]) -> dict[str, str]:
    """metric -> unit code that a source's note tells for figures without a unit."""
    text = re.sub(r"\(([^)]*)\)", lambda m: " " + m[1].replace(",", " ") + " ", fold(note)).replace("running time", "runningtime").replace("wind speed", "windspeed")
    told: dict[str, str] = {}
    for clause in re.split(r"[;,.:]\s|[;.]$|\band\b", text):
        words = set(re.findall(r"\w+", clause))
        metrics = [m for m in quantities if any(set(TOPICS.get(t, "").split()) & words for t in (m, f"*{quantities[m]}"))]
        for m in metrics:
            if quantities[m] in UNITS and (found := finds(clause, quantities[m])):
                told[m] = found[-1][2]
    return told


def conversion_factors(spark) -> DataFrame:  # noqa: ANN001
    """(quantity, unit, factor, shift): base unit = factor * figure + shift."""
    rows = [(q, code, float(f), float(s)) for q, units in UNITS.items() for code, (f, s, _) in units.items()]
    return spark.createDataFrame(rows, "quantity string, unit string, factor double, shift double")


def to_common_units(observations: DataFrame, metric_units: DataFrame, sources: DataFrame) -> DataFrame:
    """(obs_id, metric, unit, figure, common_unit, common_value, recorded_otherwise) of observations with a figure and a metric that has a common unit.

    The figure is ``value``, or where that is null the one in ``value_text``. The unit is the one told by ``unit``,
    else by ``value_text``, else by the metric's name, else by the note of the source; with none told it is the common
    one. ``recorded_otherwise`` tells whether it differs from the common unit in size or zero. Repeated rows count
    once. Null ids, unknown metrics and rows without a figure have no row; a figure told in a unit that is not known to
    the metric's quantity is left as it is: unit, common_value and recorded_otherwise are null. Empty tables give an
    empty result.
    """
    spark = observations.sparkSession
    known = metric_units.limit(10_001).collect()  # one row per metric, a fixed table: its bound is checked
    if len(known) > 10_000:
        raise ValueError("metric_units must be a dimension of at most 10,000 rows")
    quantities = {r["metric"]: r["quantity"] for r in known if r["metric"] and r["quantity"]}
    out = T.StructType([T.StructField("metric", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("figure", T.DoubleType())])
    frozen = tuple(sorted(quantities.items()))

    @F.pandas_udf(out)
    def read(metric: pd.Series, unit: pd.Series, value: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for m, u, v, t in zip(metric, unit, value, text, strict=True):
            key, own, told = _read_names(m, u, frozen)
            figure = None if v is None or v != v else float(v)
            q = quantities.get(key)
            in_text = None
            if t is not None and q in UNITS and (figure is None or own is None):
                x, in_text = read_text(t, q, figure is None)
                figure = x if figure is None else figure
            rows.append((key, own or (told or in_text if in_text == UNKNOWN else in_text or told), figure))
        return pd.DataFrame(rows, columns=["metric", "unit", "figure"])

    def notes(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = [(s, m, u) for s, n in zip(pdf.source, pdf.note, strict=True) if n for m, u in read_note(n, quantities).items()]
            yield pd.DataFrame(rows, columns=["source", "metric", "by_note"])

    by_note = sources.select("source", "note").filter("source is not null").distinct().mapInPandas(notes, "source string, metric string, by_note string").dropDuplicates(["source", "metric"])
    factors = F.broadcast(conversion_factors(spark))
    common = (
        metric_units.select("metric", "quantity", F.col("common_unit")).filter("metric is not null").dropDuplicates(["metric"])
        .join(factors.select("quantity", F.col("unit").alias("common_unit"), F.col("factor").alias("_cf"), F.col("shift").alias("_cs")), ["quantity", "common_unit"])
    )
    rows = (
        observations.select("obs_id", "source", read("metric", "unit", F.col("value").cast("double"), "value_text").alias("r")).select("obs_id", "source", "r.*")
        .filter("obs_id is not null and metric is not null and figure is not null")
    )
    rows = rows.join(small(by_note), ["source", "metric"], "left").join(F.broadcast(common), "metric").withColumn("unit", F.coalesce("unit", "by_note", "common_unit")).join(factors, ["quantity", "unit"], "left").withColumn("unit", F.when(F.col("unit") != UNKNOWN, F.col("unit")))
    value = (F.col("figure") * F.col("factor") + F.col("shift") - F.col("_cs")) / F.col("_cf")
    differs = (F.abs(F.col("factor") / F.col("_cf") - 1) > 1e-12) | (F.abs(F.col("shift") - F.col("_cs")) > 1e-9)
    return rows.select("obs_id", "metric", "unit", "figure", "common_unit", value.alias("common_value"), differs.alias("recorded_otherwise")).distinct()
