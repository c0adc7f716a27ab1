"""What follows perception: schedules, clusters, names, unions and short lists, without pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of the detector, and other names for them.
CLASSES = ["parcel_full", "parcel_partial", "shipping_label_visible", "shipping_label_blocked", "hand_or_obstruction"]
ALIASES = {"barcode": "barcode_region", "qr code": "barcode_region", "cardboard box": "parcel_full", "package": "parcel_full", "parcel": "parcel_full", "gloves": "hand_or_obstruction", "hand": "hand_or_obstruction"}
STRONG_AWB = 0.86


def internal_class(raw: Column) -> Column:
    """The class a model's name stands for; null for names that are no evidence."""
    table = {n.replace("_", " "): n for n in CLASSES}
    names = F.create_map(*(F.lit(v) for kv in (ALIASES | table).items() for v in kv))
    return F.try_element_at(names, F.lower(F.replace(F.trim(raw), F.lit("_"), F.lit(" "))))


def class_list(raw: Column) -> Column:
    """Names of a model, from a list or a numbered mapping in text, by index; the own ones if unreadable."""
    pairs = F.regexp_extract_all(raw, F.lit(r"(\d+)\s*:\s*['\"]"), F.lit(1))
    names = F.regexp_extract_all(raw, F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1))
    mapped = F.transform(F.sort_array(F.zip_with(F.transform(pairs, lambda x: x.cast("int")), names, lambda i, n: F.struct(i.alias("i"), n.alias("n")))), lambda x: x["n"])
    own = F.array(*(F.lit(x) for x in CLASSES))
    return F.when(F.size(names) == 0, own).when(raw.rlike(r"\A\s*\{"), F.when(F.size(pairs) == F.size(names), mapped).otherwise(own)).otherwise(names)


def until_strong(passes: DataFrame) -> DataFrame:
    """Recognition passes of a crop up to the first that gives a strong identifier; the rest need not run."""
    first = passes.groupBy("image_id").agg(F.min(F.when(F.col("awb_confidence") >= STRONG_AWB, F.col("pass_no"))).alias("stop"))
    return passes.join(first, "image_id").where(F.col("stop").isNull() | (F.col("pass_no") <= F.col("stop"))).drop("stop")


def line_clusters(tokens: DataFrame, tolerance: float = 0.62) -> DataFrame:
    """Tokens of a page -> lines: from top to bottom, a token joins the line whose running centre is within
    ``tolerance`` of the taller height.  A fold over the page's tokens."""
    item = F.struct("center", "left", "height", "token")
    per = tokens.where("token <> ''").groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("all"))
    kind = per.schema["all"].dataType.simpleString()
    line = f"struct<sum:double,n:int,tall:double,parts:{kind}>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(None).cast(line).alias("now"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        tall = F.greatest(x["height"], now["tall"])
        fits = now.isNotNull() & (F.abs(x["center"] - now["sum"] / now["n"]) <= tall * tolerance)
        new = F.struct(x["center"].alias("sum"), F.lit(1).alias("n"), x["height"].alias("tall"), F.array(x).alias("parts"))
        grown = F.struct((now["sum"] + x["center"]).alias("sum"), (now["n"] + 1).alias("n"), tall.alias("tall"), F.array_append(now["parts"], x).alias("parts"))
        done = F.when(fits | now.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], now))
        return F.struct(done.alias("done"), F.when(fits, grown).otherwise(new).alias("now"))

    folded = F.aggregate("all", start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    words = lambda ln: F.array_join(F.transform(F.sort_array(F.transform(ln["parts"], lambda p: F.struct(p["left"], p["token"]))), lambda p: p["token"]), " ")
    return per.select("page", F.array_join(F.transform(folded, words), "\n").alias("text"))


def union_box(components: DataFrame, most: int = 12) -> DataFrame:
    """The box around the ``most`` components with the most pixels."""
    top = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("pixels", "x", "y", "w", "h")))), 1, most)
    per = components.groupBy("image_id").agg(top.alias("t"))
    low = lambda f: F.array_min(F.transform("t", f))
    high = lambda f: F.array_max(F.transform("t", f))
    return per.select("image_id", low(lambda b: b["x"]).alias("x"), low(lambda b: b["y"]).alias("y"), high(lambda b: b["x"] + b["w"]).alias("x2"), high(lambda b: b["y"] + b["h"]).alias("y2"))


def short_list(labels: DataFrame, most: int = 5) -> DataFrame:
    """Label proposals of an image, the detector's first, cut to ``most``."""
    order = F.struct((~F.col("by_detector")).alias("late"), (-F.col("score")).alias("s"), "box_id")
    per = labels.groupBy("image_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, most).alias("t"))
    return per.select("image_id", F.posexplode("t").alias("rank", "b")).select("image_id", "rank", F.col("b.box_id").alias("box_id"))


def observations(images: DataFrame) -> DataFrame:
    """Measures of each image as report columns; the overlay's box as one text."""
    box = F.concat_ws(",", *(F.col(f"overlay.{k}").cast("string") for k in ("x", "y", "width", "height")))
    return images.select("filename", "width", "height", "orientation", "blur_score", "brightness", "contrast", "underexposure_pct", "overexposure_pct", "edge_density", F.col("overlay").isNotNull().alias("overlay_detected"), box.alias("overlay_bbox"), "overlay_ocr_confidence", "parsed_field_count")


def to_recognise(ranked: DataFrame, n: int = 1) -> DataFrame:
    """The candidates that text recognition is asked to read."""
    return ranked.where(F.col("rank") < n)


def limited(passes: DataFrame, overlay_awb: Column, most: int = 6, with_overlay: int = 2) -> DataFrame:
    """Recognition passes up to the limit, which is lower where the overlay gave an identifier."""
    return passes.where(F.col("pass_no") <= F.when(overlay_awb, with_overlay).otherwise(most))


# Provenance that tells emissions of the same value apart.
PROVENANCE = ["ocr_engine", "variant", "rotation", "psm"]


def first_emissions(candidates: DataFrame) -> DataFrame:
    """Of the same value by the same engine, variant, rotation and page mode the first."""
    keys = ["image_id", "field_name", "normalised_value", *PROVENANCE]
    rest = [c for c in candidates.columns if c not in (*keys, "pos")]
    best = [F.min_by(c, "pos").alias(c) for c in rest]
    return candidates.groupBy(*keys).agg(F.min("pos").alias("pos"), *best)


def low_quality(c=F.col) -> Column:
    """Blurred, flat, too dark or too bright; a measure that is not known condemns nothing."""
    marks = (c("blur") < 60, c("contrast") < 18, c("under_pct") > 82, c("over_pct") > 35)
    return F.coalesce(F.array_max(F.array(*(F.coalesce(m, F.lit(False)) for m in marks))), F.lit(False))


def line_errors(line: Column, width: int = 640, height: int = 480, least: int = 4) -> Column:
    """What is wrong with an annotation line (class and box as shares of the picture), as a list."""
    f = F.split(F.trim(line), r"\s+")
    cls = F.get(f, F.lit(0)).try_cast("int")
    v = F.transform(F.slice(f, 2, 10), lambda x: x.try_cast("double"))
    number = cls.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    five = F.size(f) == 5
    whole = five & number
    tiny = (F.get(v, F.lit(2)) * width < least) | (F.get(v, F.lit(3)) * height < least)
    return F.array_compact(
        F.array(
            F.when(~five, "invalid_columns"), F.when(five & ~number, "invalid_number"), F.when(whole & ~cls.between(0, len(CLASSES) - 1), F.concat(F.lit("invalid_class:"), cls.cast("string"))),
            F.when(whole & F.exists(v, lambda x: (x < 0) | (x > 1)), "out_of_range"), F.when(whole & tiny, "tiny_box"),
        )
    )
