"""Sources: file scans, strict JSON records, CSV of places, and binary vectors."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The image formats that a scan takes.
EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "cr2", "cr3", "nef", "arw", "dng", "raf", "orf")

BOX = T.ArrayType(T.DoubleType())
FACE = T.StructType([T.StructField("box", BOX), T.StructField("yaw", T.DoubleType()), T.StructField("pitch", T.DoubleType()), T.StructField("roll", T.DoubleType()), T.StructField("captureQuality", T.DoubleType()), T.StructField("outerLips", T.ArrayType(BOX))])
EXIF = T.StructType(
    [T.StructField("captureDate", T.DoubleType()), T.StructField("captureOffsetSec", T.IntegerType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("pixelWidth", T.IntegerType()), T.StructField("pixelHeight", T.IntegerType()), T.StructField("make", T.StringType()), T.StructField("model", T.StringType()), T.StructField("flashFired", T.BooleanType())]
)
COLOUR = T.StructType([T.StructField(c, T.DoubleType()) for c in ("r", "g", "b", "weight")])
RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("exif", EXIF),
        T.StructField("isUtility", T.BooleanType()),
        T.StructField("aestheticScore", T.DoubleType()),
        T.StructField("sharpness", T.DoubleType()),
        T.StructField("faces", T.ArrayType(FACE)),
        T.StructField("faceAreaFraction", T.DoubleType()),
        T.StructField("smileFraction", T.DoubleType()),
        T.StructField("saliencyBox", BOX),
        T.StructField("horizonTiltDeg", T.DoubleType()),
        T.StructField("sceneTags", T.ArrayType(T.StringType())),
        T.StructField("hasText", T.BooleanType()),
        T.StructField("palette", T.ArrayType(COLOUR)),
        T.StructField("warmth", T.DoubleType()),
        T.StructField("contrast", T.DoubleType()),
        T.StructField("clippedLow", T.DoubleType()),
        T.StructField("clippedHigh", T.DoubleType()),
        T.StructField("phash", T.DecimalType(20, 0)),
        T.StructField("featurePrint", T.StringType()),
        T.StructField("thumbnailPath", T.StringType()),
    ]
)
#: What every record must have.
REQUIRED = ("path", "hash", "width", "height", "exif", "isUtility", "aestheticScore", "sharpness", "faces", "faceAreaFraction", "sceneTags", "palette", "clippedLow", "clippedHigh")


LISTED = "path string, length long, modified timestamp, modified_ns long"


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _walk():
    """A function that lists folders, each with all below it, where it runs."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for folder in batch.column("folder").to_pylist():
                for at, folders, names in os.walk(folder):
                    folders[:] = sorted(f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(at, f)))
                    for name in names:
                        with contextlib.suppress(OSError):  # gone meanwhile
                            path = os.path.join(at, name)
                            found.append((path, os.stat(path)))
            stamps = [s.st_mtime_ns for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([s.st_size for _, s in found], pa.int64()), pa.array([n // 1000 for n in stamps], pa.timestamp("us", "UTC")), pa.array(stamps, pa.int64())], names=["path", "length", "modified", "modified_ns"])

    return run


def scan_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path``, ``length``, ``modified`` and ``modified_ns`` of the files under any of the roots, each once; contents aren't read.

    Names that begin with ``_`` count, unlike in Spark's own listing; folders that
    begin with a dot, linked folders, ``._`` companions and other formats don't.
    The driver lists the folders right under a root, tasks what is below them.  A
    root that can't be read is an error, a folder below it is left out.  Roots lie
    on a file system that every executor mounts.
    """
    import os

    folders, loose = [], []
    for root in dict.fromkeys(_local(r).rstrip("/") or "/" for r in roots):
        with os.scandir(root) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    folders += [] if e.name.startswith(".") else [(e.path,)]
                elif e.is_file():
                    s = e.stat()
                    loose.append((e.path, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), s.st_mtime_ns))
    out = spark.createDataFrame(loose, LISTED)
    if folders:
        below = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 1024))
        out = out.unionByName(below.mapInArrow(_walk(), LISTED))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return out.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions) & ~name.startswith("._")).dropDuplicates(["path"])


def scan_tolerant(spark: SparkSession, roots: list[str]) -> tuple[DataFrame | None, list[str]]:
    """A scan that lists unreadable roots instead of failing."""
    out, unreadable = None, []
    for root in dict.fromkeys(roots):
        try:
            found = scan_files(spark, [root])
        except OSError:
            unreadable.append(root)
            continue
        out = found if out is None else out.unionByName(found)
    return (out.dropDuplicates(["path"]) if out is not None else None), unreadable


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``pos``, ``path``, the SHA-256 of each file's bytes and an ``error``: one row a path, in which one of the two is null.

    Files are read in pieces where the task runs, so their size doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, errors = [], []
            for path in batch.column("path").to_pylist():
                own = hashlib.sha256()
                try:
                    with open(_local(path), "rb") as f:
                        while piece := f.read(1 << 20):
                            own.update(piece)
                except OSError as e:
                    hashes.append(None)
                    errors.append(e.strerror or type(e).__name__)
                else:
                    hashes.append(own.hexdigest())
                    errors.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("path"), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], names=["pos", "path", "hash", "error"])

    rows = spark.createDataFrame(list(enumerate(paths)), "pos long, path string").repartition(max(1, min(len(paths), 1024)))
    return rows.mapInArrow(run, "pos long, path string, hash string, error string")


def parse(df: DataFrame, json: str, schema: T.StructType = RECORD, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Rows whose record has every required key, as columns, and the rejected rows. An empty list isn't a missing one."""
    parsed = df.withColumn("_r", F.from_json(json, schema))
    good = F.col("_r").isNotNull()
    for key in required:
        good &= F.col(f"_r.{key}").isNotNull()
    return parsed.where(good).select(*[c for c in df.columns if c != json], "_r.*"), parsed.where(~F.coalesce(good, F.lit(False))).drop("_r")


def parse_all(df: DataFrame, json: str, schema: T.StructType = RECORD, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Like ``parse``, but a bad row stops the job."""
    parsed = df.withColumn("_r", F.from_json(json, schema))
    missing = F.filter(F.array(*[F.when(F.col(f"_r.{k}").isNull(), F.lit(k)) for k in required]), lambda k: k.isNotNull())
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("record lacks "), F.concat_ws(", ", missing))).cast("int")).otherwise(F.lit(1))
    return parsed.withColumn("_ok", checked).where("_ok = 1").select(*[c for c in df.columns if c != json], "_r.*")


def floats(text: Column) -> Column:
    """Base64 of little-endian floats as an array; null if it isn't whole floats. Built-in functions only.

    Bytes are read as hexadecimal, so each float is sign, exponent and fraction of 32 bits.
    """
    hexed = F.hex(F.unbase64(text))
    count = (F.length(hexed) / 8).cast("int")

    def value(i: Column) -> Column:
        part = lambda k: F.substring(hexed, i * 8 + 1 + 2 * k, F.lit(2))
        bits = F.conv(F.concat(part(3), part(2), part(1), part(0)), 16, 10).cast("long")
        sign = F.when(bits >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
        exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
        normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
        small = fraction / float(1 << 23) * F.pow(F.lit(2.0), F.lit(-126.0))
        return sign * F.when(exponent == 0, small).when((exponent == 255) & (fraction == 0), F.lit(float("inf"))).when(exponent == 255, F.lit(float("nan"))).otherwise(normal)

    whole = F.pmod(F.length(hexed), F.lit(8)) == 0
    return F.when(whole & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), value)).when(whole, F.array().cast("array<double>"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows ``time, lat, lon, rest`` without a header; malformed lines are left out."""
    return spark.read.csv(path, schema="time long, lat double, lon double, rest string", mode="DROPMALFORMED")


def layouts(spark: SparkSession, folder: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Every layout file of a folder, by file name; reserved ids are refused."""
    slot = T.StructType([T.StructField("rect", BOX), T.StructField("role", T.StringType()), T.StructField("bleed", T.ArrayType(T.StringType())), T.StructField("aspect_pref", BOX)])
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("slots", T.ArrayType(slot)), T.StructField("min_photos", T.IntegerType()), T.StructField("max_photos", T.IntegerType()), T.StructField("density", T.StringType()), T.StructField("energy", T.StringType())])
    found = spark.read.schema(schema).json(folder, multiLine=True).withColumn("_file", F.input_file_name())
    checked = F.when(F.col("id").isin(*reserved), F.raise_error(F.concat(F.lit("reserved id "), "id"))).otherwise(F.col("id")) if reserved else F.col("id")
    return found.withColumn("id", checked).orderBy("_file").drop("_file")


def decomposed(found: DataFrame) -> DataFrame:
    """Slots of spread layouts by page: ``side`` and the rectangle on that page; a slot across the fold is an error."""
    each = found.select("id", F.posexplode("slots").alias("slot", "s"))
    x, y, w, h = (F.element_at("s.rect", i) for i in range(1, 5))
    side = F.when(x + w <= 0.5 + 1e-9, "left").when(x >= 0.5 - 1e-9, "right").otherwise(F.raise_error(F.concat(F.lit("a slot crosses the fold in "), "id")))
    left = F.when(side == "left", x).otherwise(x - 0.5) * 2
    return each.select("id", "slot", side.alias("side"), F.struct(left.alias("x"), y.alias("y"), (w * 2).alias("w"), h.alias("h")).alias("rect"), F.col("s.role").alias("role"))
