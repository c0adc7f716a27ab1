"""Image files: scans of folders, single files and ZIP archives, and their validation."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archives as Z

# Limits and signatures.
MAX_BYTES = 25 * 1024 * 1024
MAX_SIDE = 12_000
MAX_PIXELS = 50_000_000
JPEG, PNG = "FFD8FF", "89504E470D0A1A0A"
SUFFIXES = Z.SUFFIXES


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1))


def magic(head: Column) -> Column:
    """``head``: the first bytes in hexadecimal."""
    return F.when(head.startswith(JPEG), "jpeg").when(head.startswith(PNG), "png")


def first_error(size: Column, path: Column, head: Column, width: Column, height: Column, max_bytes: int = MAX_BYTES) -> Column:
    """The first rule a file breaks, or null."""
    ext, kind = suffix(path), magic(head)
    agrees = ((kind == "jpeg") & ext.isin("jpg", "jpeg")) | ((kind == "png") & (ext == "png"))
    return (
        F.when(size == 0, "EMPTY_FILE")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when(~ext.isin(*SUFFIXES), "UNSUPPORTED_IMAGE")
        .when(~F.coalesce(agrees, F.lit(False)), "BAD_SIGNATURE")
        .when(width.isNull() | height.isNull(), "CORRUPT_IMAGE")
        .when((width > MAX_SIDE) | (height > MAX_SIDE) | (width.cast("long") * height > MAX_PIXELS), "IMAGE_TOO_LARGE")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (not below it) or one file: path, bytes, digest and size; the digest is taken
    before validation, so a bad file too is known when a batch is resumed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    files = files.select("path", "modificationTime", "length", "content").unionByName(_empty_files(spark, path))
    return files.select("path", "modificationTime", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 8)).alias("head"))


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """The file source passes over files without bytes; they are rows too, to be refused by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(conf).listStatus(at)
    rows = [(f.getPath().toString(), f.getModificationTime() / 1000) for f in found if f.isFile() and f.getLen() == 0]
    made = spark.createDataFrame(rows, "path string, seconds double")
    return made.select("path", F.timestamp_seconds("seconds").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


class InvalidInput(ValueError):
    """A file that validation refused; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG's or JPEG's header."""
    if content[:8] == bytes.fromhex(PNG) and content[12:16] == b"IHDR" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + max(2, int.from_bytes(content[at + 2 : at + 4], "big"))
    return None


def _sizes(contents: pd.Series) -> pd.DataFrame:
    found = [image_size(bytes(x)) if x is not None else None for x in contents]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})


def validated(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (path, size, head, content) with width, height and the first rule each breaks."""
    sized = files.withColumn("pixels_of", F.pandas_udf(_sizes, "width int, height int")("content"))
    sized = sized.withColumns({"width": F.col("pixels_of.width"), "height": F.col("pixels_of.height")}).drop("pixels_of")
    return sized.withColumn("error", first_error(F.col("size"), F.col("path"), F.col("head"), F.col("width"), F.col("height"), max_bytes))


def _whole(files: DataFrame, max_batch: int) -> DataFrame:
    """All of ``files`` in order of path, or an error for the batch: too many, or the first that is invalid."""
    if files.limit(max_batch + 1).count() > max_batch:
        raise InvalidInput("BATCH_TOO_LARGE", f"more than {max_batch} files")
    checked = validated(files)
    bad = checked.where("error is not null").orderBy("path").select("error", "path").first()
    if bad:
        raise InvalidInput(bad.error, bad.path)
    return checked.drop("error").orderBy("path")


def folder(spark: SparkSession, path: str, max_batch: int = 500) -> DataFrame:
    """The images of a folder (not below it), by their suffix, in order."""
    files = scan(spark, path)
    return _whole(files.where(suffix(F.col("path")).isin(*SUFFIXES)), max_batch)


def entries_of(spark: SparkSession, path: str) -> DataFrame:
    """An archive's entries, range by range where its path can be opened directly, else from its content."""
    try:
        system, at = Z.store(path)
        system.get_file_info(at)
    except (OSError, ValueError, NotImplementedError):
        return unzipped(spark, spark.read.format("binaryFile").load(path).select("path", "content"))
    return Z.entries(spark, path)


def archive(spark: SparkSession, path: str, max_batch: int = 500) -> DataFrame:
    """The valid images of a ZIP archive, in order; entries that are no images, or invalid, are left out with a ``warning`` row
    (no content); an unsafe or empty archive is an error."""
    entries = entries_of(spark, path)
    known = entries.select(F.concat("path", F.lit("!"), F.coalesce("name", F.lit(""))).alias("path"), "name", "content", "code", "message", F.length("content").cast("long").alias("size"), F.hex(F.substring("content", 1, 8)).alias("head"), F.sha2("content", 256).alias("sha256"))
    unsafe = known.where("code is not null and code <> 'SKIPPED'").select("code", "message").first()
    if unsafe:
        raise InvalidInput(unsafe.code, unsafe.message)
    checked = validated(known)
    reason = F.when(F.col("code") == "SKIPPED", F.concat(F.lit("Ignored "), "message", F.lit(": "), "name")).when(F.col("error").isNotNull(), F.concat(F.lit("Skipped invalid image "), "name", F.lit(": "), "error"))
    out = checked.withColumn("warning", reason).withColumn("content", F.when(reason.isNull(), F.col("content"))).drop("code", "message", "error")
    images = out.where("warning is null").limit(max_batch + 1).count()
    if not images:
        raise InvalidInput("EMPTY_ZIP", "no valid images")
    if images > max_batch:
        raise InvalidInput("BATCH_TOO_LARGE", f"more than {max_batch} files")
    return out.orderBy("path")


def inputs(spark: SparkSession, path: str, max_batch: int = 500) -> DataFrame:
    """Images of a folder, an archive or one file, whichever ``path`` is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(conf).getFileStatus(at).isDirectory():
        return folder(spark, path, max_batch)
    if path.lower().endswith(".zip"):
        return archive(spark, path, max_batch)
    return _whole(scan(spark, path), max_batch)


class _Unzip:
    def eval(self, content: bytes):
        yield from Z.unzip(io.BytesIO(content or b""))


def unzipped(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Entries of each archive (``content``), by a table function next to the archive's path, for paths that only Spark can read."""
    schema = T._parse_datatype_string(Z.SCHEMA.removeprefix("path string, "))
    spark.udtf.register("parcelmill_unzip", F.udtf(_Unzip, returnType=schema))
    return spark.sql("SELECT a.path, e.* FROM {a} a, LATERAL parcelmill_unzip(a.content) e", a=archives)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Images as the JVM decodes them: size, orientation, pixels (blue, green, red); unreadable ones are
    kept and marked instead of dropped."""
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    w, h = F.col("width"), F.col("height")
    turn = F.when(w > h, "LANDSCAPE").when(h > w, "PORTRAIT").otherwise("SQUARE")
    bad = h < 0
    return image.select("origin", F.when(~bad, w).alias("width"), F.when(~bad, h).alias("height"), F.when(~bad, turn).alias("orientation"), F.when(~bad, F.col("data")).alias("pixels"), bad.alias("corrupt"))
