import pytest

from almagest.operators.units import read_metric, read_note, read_text, to_common_units

Q = {"height": "length", "distance": "length", "temperature": "temperature", "wind_speed": "speed", "population": "count", "likes": "count", "mass": "mass", "duration": "time", "area": "area", "rainfall": "length", "pressure": "pressure"}


@pytest.mark.parametrize(("text", "quantity", "want"), [
    ("42' 6\"", "length", (42.5, "[ft_i]")), ("1 h 15 min", "time", (1.25, "h")), ("1時間3分", "time", (1.05, "h")), ("華氏63.4度", "temperature", (63.4, "[degF]")), ("時速44.76km", "speed", (44.76, "km/h")), ("約18.1万人", "count", (18.1, "10*4")), ("約27,143[in_i]", "length", (27143.0, "[in_i]")),
    ("－１８.５ ℃", "temperature", (-18.5, "Cel")), ("read as 44.6 m.s-1", "speed", (44.6, "m/s")), ("3,860 likes", "count", (3860.0, "1")), ("5 10*3", "count", (5.0, "10*3")), ("about 7", "length", (7.0, None)), ("12 furlongs", "length", (12.0, "?")), ("no figure", "length", (None, None)), ("", "length", (None, None)),
])
def test_read_text(text, quantity, want):
    got = read_text(text, quantity, True)
    assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def test_names_and_notes():
    assert read_metric("windspeed_kn", Q) == ("wind_speed", "[kn_i]") and read_metric("heightKm", Q) == ("height", "km") and read_metric("mood_index", Q) == (None, None) and read_metric("tempK", Q) == ("temperature", "K")
    assert read_note("Loads without a unit are in tonnes; running times without a unit are in hours.", Q) == {"mass": "t", "duration": "h"}
    assert read_note("Counts (inhabitants, likes) are mirrored in thousands when no unit is attached.", Q) == {"population": "10*3", "likes": "10*3"}


def test_order_of_telling(spark):
    obs = [("a", "height", 100.0, None, "cm", "s", 1), ("b", "height", 10.0, None, None, "s", 1), ("c", "height", 10.0, "unit: km", " ", "s", 1), ("d", "height_ft", 10.0, None, None, None, 1), ("e", "height", None, None, "m", "s", 1), ("f", "height", 10.0, None, "m", "s", 1), ("g", "mood", 1.0, None, "m", "s", 1), ("a", "height", 100.0, None, "cm", "s", 1),
           (None, "height", 1.0, None, "cm", "s", 1), ("h", None, 1.0, None, "cm", "s", 1), ("i", "height", None, "x" * 50_000 + " 3 km", None, "t", 1), ("j", "height", 0.0, None, "idx", "t", 1), ("k", "height", None, "12 furlongs", None, "s", 1), ("l", "height_ft", None, "12 furlongs", None, "s", 1), ("m", "height", 1.0, None, "kg", "s", 1)]
    df = spark.createDataFrame(obs, "obs_id string, metric string, value double, value_text string, unit string, source string, factor int")
    units = spark.createDataFrame([("height", "length", "m"), ("height", "length", "m")], "metric string, quantity string, common_unit string")
    src = spark.createDataFrame([("s", "heights in feet"), ("s", "heights in feet"), ("t", None), (None, "heights in miles")], "source string, note string")
    got = {r.obs_id: (r.unit, r.common_value if r.common_value is None else round(r.common_value, 4), r.recorded_otherwise) for r in to_common_units(df, units, src).collect()}
    assert got == {"a": ("cm", 1.0, True), "b": ("[ft_i]", 3.048, True), "c": ("km", 10000.0, True), "d": ("[ft_i]", 3.048, True), "f": ("m", 10.0, False), "i": ("km", 3000.0, True), "j": (None, None, None), "k": (None, None, None), "l": ("[ft_i]", 3.6576, True), "m": (None, None, None)}
    assert to_common_units(df.filter("false"), units, src).count() == 0
