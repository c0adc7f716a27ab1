"""Pixel measures in numpy, and the boundary for perception that needs other programs.

Images come as arrays of height x width x (blue, green, red).  A provider that is not installed
describes itself as unavailable; nothing is guessed in its place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shapes import edges


def grey(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def quality(bgr: np.ndarray) -> dict[str, float]:
    """Sharpness (variance of the Laplacian), brightness, contrast and clipped shares."""
    g = grey(bgr)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return {"blur": float(laplace.var()), "brightness": float(g.mean()), "contrast": float(g.std()), "under": float((g < 25).mean() * 100), "over": float((g > 230).mean() * 100)}


def edge_share(bgr: np.ndarray) -> float:
    """Share of pixels on thin edges."""
    return float(edges(grey(bgr)).mean())


def low_quality(m: dict[str, float]) -> bool:
    return m["blur"] < 60 or m["contrast"] < 18 or m["under"] > 82 or m["over"] > 35


def orientation(width: int, height: int) -> str:
    return "LANDSCAPE" if width > height else "PORTRAIT" if height > width else "SQUARE"


def fitted(width: int, height: int, longest: int = 4096) -> tuple[int, int]:
    """Size after the longest side is brought down to ``longest``."""
    scale = min(1.0, longest / max(width, height, 1))
    return max(1, int(width * scale)), max(1, int(height * scale))


# Hue (0 to 179), saturation and value of an overlay's writing.
YELLOW = (15, 80, 80), (42, 255, 255)


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in steps of two degrees, saturation and value as bytes, in 12-bit fixed point."""
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    top = np.maximum(np.maximum(b, g), r)
    span = top - np.minimum(np.minimum(b, g), r)
    part = lambda whole, by: np.where(by > 0, np.rint((whole << 12) / np.maximum(by, 1)).astype(np.int64), 0)
    turn = np.where(top == r, g - b, np.where(top == g, b - r + 2 * span, r - g + 4 * span))
    hue = (turn * part(30, span) + 2048) >> 12
    return np.where(hue < 0, hue + 180, hue), (span * part(255, top) + 2048) >> 12, top


def yellow(bgr: np.ndarray, low=YELLOW[0], high=YELLOW[1]) -> np.ndarray:
    """Mask of overlay pixels."""
    out = np.ones(bgr.shape[:2], bool)
    for value, a, b in zip(hsv(bgr), low, high):
        out &= (value >= a) & (value <= b)
    return out


def opened(mask: np.ndarray) -> np.ndarray:
    """Opening by a 2 x 2 square: single pixels and thin lines go."""
    p = np.pad(mask, ((1, 0), (1, 0)), constant_values=True)
    kept = p[1:, 1:] & p[:-1, 1:] & p[1:, :-1] & p[:-1, :-1]
    p = np.pad(kept, ((0, 1), (0, 1)), constant_values=False)
    return p[:-1, :-1] | p[1:, :-1] | p[:-1, 1:] | p[1:, 1:]


def suppressed(bgr: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    out = bgr.copy()
    out[max(0, y) : y + h, max(0, x) : x + w] = 0
    return out


def rotated(bgr: np.ndarray, degrees: int) -> np.ndarray:
    return np.ascontiguousarray(np.rot90(bgr, -degrees // 90))


def _taps(size: int, to: int) -> list[tuple[int, np.ndarray]]:
    """First pixel and fixed-point weights (22 bits) of a Lanczos filter of three lobes for each target pixel."""
    scale = size / to
    wide = max(scale, 1.0)
    out = []
    for k in range(to):
        center = (k + 0.5) * scale
        low, high = max(int(center - 3 * wide + 0.5), 0), min(int(center + 3 * wide + 0.5), size)
        x = (np.arange(low, high) - center + 0.5) / wide
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w /= w.sum()
        out.append((low, np.where(w < 0, np.ceil(w * (1 << 22) - 0.5), np.floor(w * (1 << 22) + 0.5)).astype(np.int64)))
    return out


def resized(channel: np.ndarray, width: int, height: int) -> np.ndarray:
    """One channel of bytes at another size by the Lanczos filter, columns first, rounded to bytes after each pass."""
    for axis, to in ((1, width), (0, height)):
        x = channel.astype(np.int64) if axis else channel.astype(np.int64).T
        if x.shape[1] != to:
            x = np.stack([(x[:, low : low + len(w)] @ w + (1 << 21)) >> 22 for low, w in _taps(x.shape[1], to)], axis=1)
        x = np.clip(x, 0, 255).astype(np.uint8)
        channel = x if axis else x.T
    return channel


def downscaled(bgr: np.ndarray, longest: int = 4096) -> np.ndarray:
    """With its longest side brought down to ``longest``."""
    width, height = fitted(bgr.shape[1], bgr.shape[0], longest)
    return bgr if (width, height) == bgr.shape[1::-1] else np.stack([resized(bgr[..., k], width, height) for k in range(3)], axis=2)


def luma(bgr: np.ndarray) -> np.ndarray:
    """Grey bytes in 16-bit fixed point."""
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def difference_hash(bgr: np.ndarray) -> int:
    """64 bits: whether each pixel of the picture at 9 x 8 is brighter to its right, as a signed number."""
    small = resized(luma(bgr), 9, 8).astype(np.int64)
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    return int(np.packbits(bits).view(">i8")[0])


# What to do for an orientation tag, as (mirror left-right, quarter turns anticlockwise).
ORIENTATIONS = {1: (False, 0), 2: (True, 0), 3: (False, 2), 4: (True, 2), 5: (True, 1), 6: (False, 3), 7: (True, 3), 8: (False, 1)}


def exif_orientation(data: bytes) -> int:
    """The orientation tag of a JPEG's EXIF block; 1 where there is none that can be read."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        block = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and block[:6] == b"Exif\0\0":
            tiff = block[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            first = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[first : first + 2], order)):
                entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x0112:
                    value = int.from_bytes(entry[8:10], order)
                    return value if value in ORIENTATIONS else 1
        at += 2 + max(size, 2)
    return 1


def upright(bgr: np.ndarray, orientation: int) -> np.ndarray:
    mirror, turns = ORIENTATIONS.get(orientation, (False, 0))
    return np.ascontiguousarray(np.rot90(bgr[:, ::-1] if mirror else bgr, turns))


def png(bgr: np.ndarray) -> bytes:
    """The picture as a PNG file."""
    import struct
    import zlib

    h, w = bgr.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(bgr[..., ::-1]).reshape(h, 3 * w)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def merged_boxes(boxes: list[tuple[int, int, int, int]], width: int, height: int, overlap: float = 0.28, gap: float = 0.045) -> list[tuple[int, int, int, int]]:
    """Boxes joined, again and again, while two of them overlap along one side by ``overlap`` of the shorter
    and are at most ``gap`` of the image apart along the other."""
    boxes = list(boxes)
    done = False
    while not done:
        done = True
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                (ax, ay, aw, ah), (bx, by, bw, bh) = boxes[i], boxes[j]
                over_x, over_y = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
                beside = over_y >= overlap * min(ah, bh) and -over_x <= gap * width
                above = over_x >= overlap * min(aw, bw) and -over_y <= gap * height
                if beside or above:
                    x, y = min(ax, bx), min(ay, by)
                    boxes[i] = (x, y, max(ax + aw, bx + bw) - x, max(ay + ah, by + bh) - y)
                    del boxes[j]
                    done = False
                    break
            if not done:
                break
    return boxes


@dataclass(frozen=True)
class Provider:
    """A perception program: what it is for, and whether it is here."""

    name: str
    flag: str
    available: bool = False
    version: str = ""
    error: str = "not installed"


def resolve(explicit: str | None, on_path: dict[str, bool]) -> Provider:
    """Text recognition: the named program, else the first that is found, else none."""
    for name in [explicit] if explicit else ["tesseract", "rapidocr"]:
        if on_path.get(name):
            return Provider(name, "OCR_UNAVAILABLE", True, error="")
    return Provider("NONE", "OCR_UNAVAILABLE")


def detector(model_path: str | None, size: int = 640) -> Provider:
    """The parcel detector behind onnxruntime; its version is the model's stem and digest."""
    import hashlib
    from pathlib import Path

    if not model_path or not Path(model_path).is_file():
        return Provider("onnx", "DETECTOR_UNAVAILABLE", error="model file not found")
    digest = hashlib.sha256(Path(model_path).read_bytes()).hexdigest()[:12]
    return Provider("onnx", "DETECTOR_UNAVAILABLE", True, f"{Path(model_path).stem}:{digest}:{size}", "")


def letterbox(width: int, height: int, size: int = 640) -> tuple[float, int, int]:
    """Scale and left and top margin of an image that is fitted into a square."""
    scale = min(size / width, size / height)
    return scale, (size - round(width * scale)) // 2, (size - round(height * scale)) // 2


def detection_rows(output: np.ndarray, classes: int) -> np.ndarray:
    """Model output with one row per box, whichever way round it came."""
    x = output[0] if output.ndim == 3 else output
    return x.T if x.shape[0] == classes + 4 and x.shape[1] != classes + 4 else x


def boxed(bgr: np.ndarray, boxes: list[tuple[int, int, int, int]], colour=(0, 200, 0), thick: int = 3) -> np.ndarray:
    """A preview with the outline of each box."""
    out = bgr.copy()
    for x, y, w, h in boxes:
        x2, y2 = min(x + w, out.shape[1]), min(y + h, out.shape[0])
        x, y = max(0, x), max(0, y)
        out[y : y + thick, x:x2] = out[max(y, y2 - thick) : y2, x:x2] = colour
        out[y:y2, x : x + thick] = out[y:y2, max(x, x2 - thick) : x2] = colour
    return out


def adverse(bgr: np.ndarray) -> dict[str, np.ndarray]:
    """Worse versions of an image, for tests: blurred, dark, bright, turned, cut, covered, empty."""
    p = np.pad(bgr.astype(np.float64), ((4, 4), (4, 4), (0, 0)), mode="edge")
    h, w = bgr.shape[:2]
    blur = sum(p[i : i + h, j : j + w] for i in range(9) for j in range(9)) / 81
    covered = bgr.copy()
    covered[h // 4 : h // 2, w // 4 : 3 * w // 4] = 40
    return {
        "blur": blur.astype(np.uint8),
        "dark": (bgr * 0.15).astype(np.uint8),
        "bright": np.clip(bgr * 1.8 + 60.0, 0, 255).astype(np.uint8),
        "turned": rotated(bgr, 90),
        "cut": bgr[: h // 2, : w // 2],
        "covered": covered,
        "empty": np.full_like(bgr, 235),
        "combined": (covered * 0.25).astype(np.uint8),
        "over": np.clip(bgr * 0.2 + 210.0, 0, 255).astype(np.uint8),
    }


def adverse_files(png_bytes: bytes, other: bytes) -> dict[str, list[bytes]]:
    """Adverse sets of whole files: a copy, two pictures of one name that conflict, a file that is cut off."""
    return {"duplicate": [png_bytes, png_bytes], "conflict": [png_bytes, other], "corrupt": [png_bytes[: len(png_bytes) // 3]]}
