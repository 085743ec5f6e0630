"""Column functions on numbers, coordinates and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in km.
EARTH_KM = 6371.0088
#: Centres of the counties, in the order in which an address is searched for them.
COUNTIES = {
    "臺北市": (25.0375, 121.5637), "台北市": (25.0375, 121.5637), "新北市": (25.0169, 121.4628), "桃園市": (24.9937, 121.301),
    "臺中市": (24.1477, 120.6736), "台中市": (24.1477, 120.6736), "臺南市": (22.9999, 120.2269), "台南市": (22.9999, 120.2269),
    "高雄市": (22.6273, 120.3014), "基隆市": (25.1276, 121.7392), "新竹市": (24.8138, 120.9675), "新竹縣": (24.8389, 121.0177),
    "苗栗縣": (24.5602, 120.8214), "彰化縣": (24.0518, 120.5161), "南投縣": (23.961, 120.9719), "雲林縣": (23.7092, 120.4313),
    "嘉義市": (23.4801, 120.4491), "嘉義縣": (23.4518, 120.2555), "屏東縣": (22.5519, 120.5487), "宜蘭縣": (24.702, 121.7378),
    "花蓮縣": (23.9871, 121.6015), "臺東縣": (22.7583, 121.1444), "台東縣": (22.7583, 121.1444), "澎湖縣": (23.5712, 119.5793),
    "金門縣": (24.4321, 118.3171), "連江縣": (26.1608, 119.9512),
}
#: Short names in titles and the county they mean; the first that is found counts.
COUNTY_PATTERNS = (
    ("新北", "新北市"), ("台北|臺北|北市", "臺北市"), ("桃園", "桃園市"), ("台中|臺中|中市", "臺中市"), ("台南|臺南|南市", "臺南市"), ("高雄|高市", "高雄市"),
    ("基隆", "基隆市"), ("竹縣", "新竹縣"), ("新竹|竹市", "新竹市"), ("苗栗", "苗栗縣"), ("彰化", "彰化縣"), ("南投", "南投縣"), ("雲林", "雲林縣"),
    ("嘉縣", "嘉義縣"), ("嘉義|嘉市", "嘉義市"), ("屏東", "屏東縣"), ("宜蘭", "宜蘭縣"), ("花蓮", "花蓮縣"), ("台東|臺東", "臺東縣"), ("澎湖", "澎湖縣"),
    ("金門", "金門縣"), ("連江|馬祖", "連江縣"),
)
NATIONAL = "全國"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_number(c: Column) -> Column:
    """A number with thousands commas and revision marks r or p; null for blank and placeholder texts."""
    return F.trim(F.translate(_text(c), "rpRP,", "")).try_cast("double")


def cell_number(c: Column) -> Column:
    """A number with thousands commas; 0 for what is none."""
    return F.coalesce(F.trim(F.translate(_text(c), ",", "")).try_cast("double"), F.lit(0.0))


def format_ntd(c: Column) -> Column:
    """NT$ and the amount with thousands commas, up to three decimals as needed; what is no number stays as it is."""
    n = c.try_cast("double")
    return F.concat(F.lit("NT$"), F.coalesce(F.rtrim(F.rtrim(F.format_number(n, 3), F.lit("0")), F.lit(".")), c.cast("string"), F.lit("null")))


def parse_coord_pair(c: Column, lat: tuple[float, float] = (21, 26), lng: tuple[float, float] = (118, 122)) -> Column:
    """struct(lat, lng) of two numbers with a comma; their order is told by the bounds, else latitude is first; null without a pair."""
    p, t = r"(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)", _text(c)
    a, b = (F.regexp_extract(t, p, i).try_cast("double") for i in (1, 2))
    swapped = a.between(*lng) & b.between(*lat)
    return F.when(t.rlike(p), F.struct(F.when(swapped, b).otherwise(a).alias("lat"), F.when(swapped, a).otherwise(b).alias("lng")))


def valid_coord(lat: Column, lng: Column) -> Column:
    """Both are there, in range, and not both 0."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0)), F.lit(False))


def in_bbox(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Within bounds, edges included; false for a missing coordinate."""
    return F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))


def _first_of(choices: list[tuple[Column, Column]]) -> Column:
    out = F.when(*choices[0])
    for condition, value in choices[1:]:
        out = out.when(condition, value)
    return out


def county_of_address(c: Column) -> Column:
    """struct(region, lat, lng) of the first county whose name is in the address; null if none."""
    at = lambda name: F.struct(F.lit("臺" + name[1:] if name[0] == "台" else name).alias("region"), F.lit(COUNTIES[name][0]).alias("lat"), F.lit(COUNTIES[name][1]).alias("lng"))
    return _first_of([(F.contains(_text(c), F.lit(name)), at(name)) for name in COUNTIES])


def detect_county(c: Column, patterns: tuple[tuple[str, str], ...] = COUNTY_PATTERNS, centres: dict[str, tuple[float, float]] = COUNTIES, otherwise: str = NATIONAL) -> Column:
    """struct(region, lat, lng) of the first pattern found in a free text; `otherwise` without coordinates if none."""
    number = lambda x: F.lit(x).cast("double")
    at = lambda name: F.struct(F.lit(name).alias("region"), number(centres[name][0]).alias("lat"), number(centres[name][1]).alias("lng"))
    none = F.struct(F.lit(otherwise).alias("region"), number(None).alias("lat"), number(None).alias("lng"))
    return _first_of([(_text(c).rlike(p), at(name)) for p, name in patterns]).otherwise(none)


def district_of_address(c: Column, city: str = "臺北市", pattern: str = r"臺?北市([^，,]+?[區鄉鎮市])") -> Column:
    """The city and the district that an address names after it; the city alone if none."""
    return F.concat(F.lit(city), F.regexp_extract(_text(c), pattern, 1))


def coord_or_county(county: Column, lat: Column, lng: Column, text: Column) -> Column:
    """struct(region, lat, lng): the coordinates where they are numbers within 21-27, 118-123; else the centre of the county named in county and text."""
    y, x = lat.try_cast("double"), lng.try_cast("double")
    own = F.regexp_replace(county, "^台", "臺")
    found = county_of_address(F.concat(county, _text(text)))
    exact = F.struct(own.alias("region"), y.alias("lat"), x.alias("lng"))
    return F.when(in_bbox(y, x, 21, 118, 27, 123), exact).otherwise(F.coalesce(found, F.struct(own.alias("region"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """P20: great-circle distance in km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)))


def parse_casualties(c: Column) -> Column:
    """struct(deaths, injuries) as a text states them; 0 where it does not."""
    number = lambda word: F.coalesce(F.regexp_extract(_text(c), rf"{word}\s*(\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(number("死亡").alias("deaths"), number("受傷").alias("injuries"))


def clamp_enum(c: Column, values: tuple[str, ...], otherwise: str | None) -> Column:
    """The value if it is one of `values`, else `otherwise`."""
    return F.when(c.isin(*values), c).otherwise(F.lit(otherwise))


def clamp_score(c: Column, low: int = 0, high: int = 100) -> Column:
    """Rounded half up and kept within bounds; null for what is no number."""
    n = F.trim(_text(c)).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.least(F.greatest(n, F.lit(low - 1.0)), F.lit(high + 1.0)) + 0.5).cast("int"))))
