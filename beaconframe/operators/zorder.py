"""Tables clustered by place, of which a viewport reads a few files.

Latitude and longitude become cells of a grid whose bits are interleaved, so
places near each other mostly have near keys. A table is written in ranges of
the key with the key's bounds of each file beside it; bounds of a viewport
become ranges of keys, and only files that meet one of them are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions.places import valid_coord

#: Bits of each coordinate in a key, and the most ranges that a viewport becomes.
BITS, RANGES = 16, 64


def _spread(x: Column) -> Column:
    """Bits of a number below 2^16, with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _cell(value, low: float, width: float):
    """Number of the grid's row or column, as a Column or a number."""
    if isinstance(value, Column):
        return F.least(F.floor((value - low) / width * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    return min(int((value - low) / width * (1 << BITS) // 1), (1 << BITS) - 1)


def z_key(lat: Column, lng: Column) -> Column:
    """The interleaved key of a place; null if it is no place."""
    return F.when(valid_coord(lat, lng), F.shiftleft(_spread(_cell(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_cell(lng, -180.0, 360.0))))


def key_ranges(south: float, west: float, north: float, east: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) of keys, `most` at most, that cover the viewport: cells are quartered, those that meet its edge again while the number allows."""
    clip = lambda x, a, b: max(a, min(b, x))
    rows = (_cell(clip(south, -90, 90), -90.0, 180.0), _cell(clip(north, -90, 90), -90.0, 180.0))
    cols = (_cell(clip(west, -180, 180), -180.0, 360.0), _cell(clip(east, -180, 180), -180.0, 360.0))
    if rows[0] > rows[1] or cols[0] > cols[1]:
        return []
    whole, edge = [], [(0, 0, BITS)]  # quarters by their first row and column and their size's bits
    while edge and len(whole) + len(edge) + 3 <= most:
        edge.sort(key=lambda q: q[2])
        r, c, bits = edge.pop()
        size = 1 << bits
        if rows[0] <= r and r + size - 1 <= rows[1] and cols[0] <= c and c + size - 1 <= cols[1] or not bits:
            whole.append((r, c, bits))
            continue
        half = size >> 1
        edge += [(y, x, bits - 1) for y in (r, r + half) for x in (c, c + half) if y <= rows[1] and y + half > rows[0] and x <= cols[1] and x + half > cols[0]]

    def first(r: int, c: int) -> int:
        return sum((r >> i & 1) << 2 * i + 1 | (c >> i & 1) << 2 * i for i in range(BITS))

    out: list[tuple[int, int]] = []
    for a, b in sorted((first(r, c), first(r, c) + (1 << 2 * bits) - 1) for r, c, bits in whole + edge):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def write_clustered(df: DataFrame, path: str, files: int, lat: str = "lat", lng: str = "lng") -> None:
    """The rows with a place, in `files` files by ranges of their key, and beside them each file's first and last key."""
    spark = df.sparkSession
    keyed = df.withColumn("_z", z_key(F.col(lat), F.col(lng))).where("_z is not null")
    keyed.repartitionByRange(files, "_z", F.monotonically_increasing_id()).sortWithinPartitions("_z").write.parquet(f"{path}/rows")
    bounds = spark.read.parquet(f"{path}/rows").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min("_z").alias("first"), F.max("_z").alias("last"))
    bounds.coalesce(1).write.parquet(f"{path}/bounds")


def files_of(spark: SparkSession, path: str, south: float, west: float, north: float, east: float) -> list[str]:
    """The files of a clustered table that may hold rows of the viewport."""
    meets = F.lit(False)
    for a, b in key_ranges(south, west, north, east):
        meets |= (F.col("first") <= b) & (F.col("last") >= a)
    found = spark.read.schema("file string, first long, last long").parquet(f"{path}/bounds").where(meets).select("file").collect()  # files of the table at most
    return sorted(f"{path}/rows/{r['file']}" for r in found)


def read_viewport(spark: SparkSession, path: str, south: float, west: float, north: float, east: float, pad: float = 0.2, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """the rows of a clustered table within the bounds, `pad` of their height and width added on each side; all else is neither opened nor, within a file, read where its key is out of range."""
    dy, dx = (north - south) * pad, (east - west) * pad
    box = (south - dy, west - dx, north + dy, east + dx)
    schema = spark.read.parquet(f"{path}/rows").schema
    files = files_of(spark, path, *box)
    if not files:
        return spark.createDataFrame([], schema).drop("_z")
    near = F.lit(False)
    for a, b in key_ranges(*box):
        near |= F.col("_z").between(a, b)
    inside = F.col(lat).between(box[0], box[2]) & F.col(lng).between(box[1], box[3])
    return spark.read.schema(schema).parquet(*files).where(near & inside).drop("_z")
