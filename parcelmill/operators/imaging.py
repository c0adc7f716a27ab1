"""Pixel measures and previews of decoded images as DataFrame operators.

Pictures cross to Python in Arrow batches, a few at a time; each function takes the picture as height x width x
(blue, green, red).  Unreadable pictures (null pixels) get null measures and are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions import shapes as S
from . import hamming as H
from .perception import low_quality
from .steps import cut


def _each(images: DataFrame, fields: dict[str, pa.DataType], schema: str, measure: Callable[..., dict], *more: str) -> DataFrame:
    """``images`` (origin, width, height, pixels, and ``more``) with the fields that ``measure`` gives for a picture."""
    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    kept = [c for c in images.columns if c != "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for k in range(batch.num_rows):
                data, w, h = (batch.column(c)[k].as_py() for c in ("pixels", "width", "height"))
                good = data is not None and w and h and len(data) == 3 * w * h
                rows.append(measure(np.frombuffer(data, np.uint8).reshape(h, w, 3), *(batch.column(c)[k].as_py() for c in more)) if good else {})
            made = [pa.array([r.get(n) for r in rows], kind) for n, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *fields])

    return images.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), schema]))


def measured(images: DataFrame) -> DataFrame:
    """Sharpness, brightness, contrast, clipped shares and edge density of each picture, and whether it is of low quality."""
    names = ["blur", "brightness", "contrast", "under_pct", "over_pct", "edge_density"]

    def measure(bgr: np.ndarray) -> dict:
        q = P.quality(bgr)
        return dict(zip(names, (q["blur"], q["brightness"], q["contrast"], q["under"], q["over"], P.edge_share(bgr))))

    out = _each(images, {n: pa.float64() for n in names}, ", ".join(f"{n} double" for n in names), measure)
    return out.withColumn("low_quality", low_quality())


def hashed(images: DataFrame) -> DataFrame:
    """The 64-bit difference hash of each picture."""
    return _each(images, {"bits": pa.int64()}, "bits long", lambda bgr: {"bits": P.difference_hash(bgr)})


def overlay_parts(images: DataFrame) -> DataFrame:
    """Groups of an overlay's pixels, a row each, the fullest first: pixels, x, y, w, h; see ``perception.union_box``."""
    part = pa.struct([(k, pa.int32()) for k in ("pixels", "x", "y", "w", "h")])
    found = lambda bgr: {"parts": [dict(zip(("pixels", "x", "y", "w", "h"), p)) for p in S.overlay_parts(P.opened(P.yellow(bgr)))]}
    out = _each(images, {"parts": pa.list_(part)}, "parts array<struct<pixels:int,x:int,y:int,w:int,h:int>>", found)
    return out.select(F.col("origin").alias("image_id"), F.inline("parts"))


def overlay_box(images: DataFrame) -> DataFrame:
    """``overlay``: the padded box (x, y, w, h) around the overlay's writing, null without one."""
    box = pa.struct([(k, pa.int32()) for k in "xywh"])
    found = lambda bgr: {"overlay": dict(zip("xywh", b)) if (b := S.overlay_box(P.opened(P.yellow(bgr)))) else None}
    return _each(images, {"overlay": box}, "overlay struct<x:int,y:int,w:int,h:int>", found)


def visual_groups(images: DataFrame, reach: int = 6) -> DataFrame:
    """``images`` (pos, sha256, and what ``hashed`` needs) in groups by look: each picture joins the first earlier leader within ``reach`` bits and takes the
    first 12 digits of that one's digest as ``group_id``.  Pictures that can't be read have none."""
    bits = hashed(images).select("pos", "sha256", "bits").where("bits is not null")
    led = H.leaders(cut(bits.select(F.lit(0).alias("set_id"), "pos", "bits")), reach)
    names = bits.select(F.col("pos").alias("leader"), F.substring("sha256", 1, 12).alias("group_id"))
    return bits.join(led.select("pos", "leader"), "pos").join(names, "leader").select("pos", "sha256", "bits", "group_id")


def upright(images: DataFrame, longest: int = 4096) -> DataFrame:
    """Pictures turned as their EXIF tag in ``content`` says, with the longest side brought down to ``longest``."""

    def turned(bgr: np.ndarray, content: bytes | None) -> dict:
        out = P.downscaled(P.upright(bgr, P.exif_orientation(content or b"")), longest)
        return {"upright_width": out.shape[1], "upright_height": out.shape[0], "upright_pixels": out.tobytes()}

    fields = {"upright_width": pa.int32(), "upright_height": pa.int32(), "upright_pixels": pa.binary()}
    out = _each(images, fields, "upright_width int, upright_height int, upright_pixels binary", turned, "content")
    return out.select(*(c for c in out.columns if c not in ("width", "height", "content", *fields)), F.col("upright_width").alias("width"), F.col("upright_height").alias("height"), F.col("upright_pixels").alias("pixels"))


def without_region(images: DataFrame) -> DataFrame:
    """Pictures with the ``region`` (struct x, y, w, h; null: none) painted black."""
    cover = lambda bgr, r: {"covered": (P.suppressed(bgr, r["x"], r["y"], r["w"], r["h"]) if r else bgr).tobytes()}
    out = _each(images, {"covered": pa.binary()}, "covered binary", cover, "region")
    return out.withColumnRenamed("covered", "pixels")


def previews(images: DataFrame) -> DataFrame:
    """``preview``: the picture with the outlines of ``boxes`` (array of struct x, y, w, h) and a banner in the colour of
    ``requires_review``, as PNG; ``warning`` says why there is none."""

    def drawn(bgr: np.ndarray, boxes: list | None, review: bool | None) -> dict:
        try:
            out = P.boxed(bgr, [(b["x"], b["y"], b["w"], b["h"]) for b in boxes or []])
            out[: max(1, out.shape[0] // 20)] = (0, 140, 255) if review else (0, 160, 0)
            return {"preview": P.png(out), "warning": None}
        except (ValueError, TypeError, KeyError) as error:
            return {"preview": None, "warning": f"Annotation generation failed: {type(error).__name__}"}

    return _each(images, {"preview": pa.binary(), "warning": pa.string()}, "preview binary, warning string", drawn, "boxes", "requires_review")
