"""Measurements of image pixels: re-compression error, edges, seals, hashes, layout.

The measurements are numpy functions of one image (height x width x 3, RGB, uint8) and
run in Spark tasks over the rows of the image source. What they mean is decided by
Column expressions elsewhere, so that thresholds can be tested without images. Pixel
kernels follow public descriptions; they are not bit for bit those of another library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

# The standard JPEG quantisation tables, luminance and chrominance.
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMINANCE = np.full((8, 8), 99)
CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8)) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def from_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB pixels of an image row."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.round(rgb.astype(np.float64) @ [0.299, 0.587, 0.114]).astype(np.uint8)


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane after the 8 x 8 cosine transform, quantisation and back."""
    h, w = plane.shape
    padded = np.pad(plane - 128.0, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    out = DCT.T @ (np.round(DCT @ blocks @ DCT.T / table) * table) @ DCT
    return out.swapaxes(1, 2).reshape(padded.shape)[:h, :w] + 128.0


def recompressed(rgb: np.ndarray, quality: int = 90) -> np.ndarray:
    """What a JPEG round trip loses; entropy coding loses nothing and is left out."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]
    x = rgb.astype(np.float64)
    y = x @ [0.299, 0.587, 0.114]
    planes = [_quantised(y, tables[0])]
    for weights in ([-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]):
        chroma = np.pad(x @ weights + 128, ((0, y.shape[0] % 2), (0, y.shape[1] % 2)), mode="edge")
        small = chroma.reshape(chroma.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3))
        planes.append(np.repeat(np.repeat(_quantised(small, tables[1]), 2, 0), 2, 1)[: y.shape[0], : y.shape[1]])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def error_level(rgb: np.ndarray, quality: int = 90) -> dict[str, float]:
    """Spread, mean and share of bright values of the tenfold re-compression error."""
    error = np.clip(np.abs(rgb.astype(np.float64) - recompressed(rgb, quality)) * 10, 0, 255).astype(np.uint8)
    return {"ela_std": round(float(error.std()), 2), "ela_mean": round(float(error.mean()), 2), "bright_ratio": round(float((error > 50).mean()), 4)}


def gradients(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel gradients with mirrored borders."""
    p = np.pad(plane.astype(np.float64), 1, mode="reflect" if min(plane.shape) > 1 else "edge")
    across = p[:, 2:] - p[:, :-2]
    down = p[2:, :] - p[:-2, :]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def photo_region(height: int, width: int, face: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
    """(top, bottom, left, right) of the portrait: the face with a margin, or upper right."""
    if face is None:
        return 0, int(height * 0.45), int(width * 0.6), width
    x1, y1, x2, y2 = map(int, face)
    return max(0, y1 - 30), min(height, y2 + 30), max(0, x1 - 30), min(width, x2 + 30)


def photo_edge(rgb: np.ndarray, face: tuple[float, float, float, float] | None = None) -> dict[str, float | None]:
    """Sharpness of the portrait's edges and its noise against that of the left side."""
    plane = gray(rgb)
    top, bottom, left, right = photo_region(*plane.shape, face)
    photo = plane[top:bottom, left:right]
    if photo.size == 0:
        return {"max_gradient": None, "mean_gradient": None, "noise_ratio": None}
    gx, gy = gradients(photo)
    size = np.hypot(gx, gy)
    side = plane[:, : int(plane.shape[1] * 0.55)]
    noise, around = float(photo.std()), float(side.std()) if side.size else float(photo.std())
    return {"max_gradient": round(float(size.max()), 2), "mean_gradient": round(float(size.mean()), 2), "noise_ratio": round(noise / (around + 1e-6), 4)}


def hue_saturation_value(rgb: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0-179), saturation and value in 0-255."""
    x = rgb.astype(np.float64)
    high, low = x.max(axis=2), x.min(axis=2)
    span = np.where(high > low, high - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(high == r, (g - b) / span, np.where(high == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30
    hue = np.where(high > low, np.round(hue) % 180, 0)
    return np.stack([hue, np.where(high > 0, np.round((high - low) / np.where(high > 0, high, 1) * 255), 0), high], axis=2)


def red(rgb: np.ndarray, low: int = 160, least: int = 50) -> np.ndarray:
    """Where an image is red: hue up to 10 or from ``low``, strong and bright enough."""
    h, s, v = np.moveaxis(hue_saturation_value(rgb), 2, 0)
    return ((h <= 10) | (h >= low)) & (s >= least) & (v >= least)


def seal(rgb: np.ndarray) -> dict[str, float]:
    """Red pixels, their share, and the variance of their colours."""
    mask = red(rgb)
    count = int(mask.sum())
    return {"red_count": count, "red_ratio": round(count / mask.size, 4), "color_variance": round(float(rgb[mask].astype(np.float64).var()), 2) if count else 0.0}


def shrunk(plane: np.ndarray, size: int) -> np.ndarray:
    """A plane averaged over size x size cells."""
    rows, cols = (np.linspace(0, n, size + 1) for n in plane.shape)

    def cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        at = np.floor(edges).astype(int)
        at[-1] = x.shape[0]
        part = total[at] + (edges - at)[:, None] * x[np.minimum(at, x.shape[0] - 1)]
        return np.diff(part, axis=0) / np.diff(edges)[:, None]

    return cells(cells(plane.astype(np.float64), rows).T, cols).T


# Parts of an image (top, bottom, left, right) that are hashed.
REGIONS = {"photo": (0.0, 0.5, 0.55, 1.0), "seal": (0.55, 1.0, 0.0, 1.0), "bottom": (0.8, 1.0, 0.0, 1.0), "full": (0.0, 1.0, 0.0, 1.0)}


def mean_hash(rgb: np.ndarray, region: str = "full", size: int = 16) -> str:
    """The cells of a region that are brighter than its mean, as hexadecimal digits; of
    the whole image if the region has no pixels."""
    plane = gray(rgb)
    a, b, c, d = REGIONS[region]
    h, w = plane.shape
    part = plane[int(h * a) : int(h * b), int(w * c) : int(w * d)]
    if not part.size:
        part = plane
    small = shrunk(part, size)
    return np.packbits((small > small.mean()).ravel()).tobytes().hex()


def asymmetry(rgb: np.ndarray, low: float = 50, high: float = 150) -> float:
    """How unlike the left and the right half are in the share of edge pixels."""
    edges = thin_edges(gray(rgb), low, high)
    half = edges.shape[1] // 2
    left, right = edges[:, :half].mean() if half else 0.0, edges[:, half:].mean()
    return float(abs(left - right) / (left + right + 1e-8))


def thin_edges(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges by gradient maxima and two thresholds, weak ones only beside strong ones."""
    gx, gy = gradients(plane)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    turn = (np.round(angle / 45) % 4).astype(int)
    steps = [((1, 2), (1, 0)), ((2, 2), (0, 0)), ((2, 1), (0, 1)), ((2, 0), (0, 2))]
    h, w = plane.shape
    top = np.zeros_like(size, dtype=bool)
    for k, ((r1, c1), (r2, c2)) in enumerate(steps):
        top |= (turn == k) & (size > p[r1 : r1 + h, c1 : c1 + w]) & (size >= p[r2 : r2 + h, c2 : c2 + w])
    strong, weak = top & (size > high), top & (size > low)
    while True:
        q = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([q[r : r + h, c : c + w] for r in range(3) for c in range(3)])
        if (grown == strong).all():
            return strong
        strong = grown | strong


def median_blurred(rgb: np.ndarray, size: int = 5) -> np.ndarray:
    """The median of the size x size pixels around each, edges repeated."""
    half = size // 2
    padded = np.pad(rgb, ((half, half), (half, half), (0, 0)), mode="edge")
    views = np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(0, 1))
    # row by row, so that memory is that of one row's windows
    return np.stack([np.median(row.reshape(row.shape[0], row.shape[1], -1), axis=2) for row in views]).astype(np.uint8)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of sRGB pixels, scaled to 0-255 with a and b around 128."""
    x = rgb.astype(np.float64) / 255
    linear = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / [0.950456, 1.0, 1.088754]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=2)
    return np.clip(np.round(out), 0, 255)


def color_features(rgb: np.ndarray) -> list[float]:
    """52 numbers of the blurred image: histograms of L, a and b in 16 bins, their means
    and the share of red."""
    soft = median_blurred(rgb)
    axes = np.moveaxis(lab(soft), 2, 0)
    out = [v for a in axes for v in (np.histogram(a, bins=16, range=(0, 256))[0] / a.size)]
    return [float(v) for v in (*out, *(a.mean() / 255 for a in axes), red(soft, 170, 70).mean())]


def border_histogram(rgb: np.ndarray, ratio: float = 0.13, bins: tuple[int, int, int] = (32, 16, 16)) -> list[float]:
    """Hue, saturation and value of the border as one unit vector; the values are brought
    to a mean of 128, so that the scan's brightness does not count."""
    h, w = rgb.shape[:2]
    bh, bw = int(h * ratio), int(w * ratio)
    border = np.ones((h, w), dtype=bool)
    border[bh : h - bh, bw : w - bw] = False
    pixels = hue_saturation_value(rgb)[border]
    if not len(pixels):
        return [0.0] * sum(bins)
    hue, saturation, value = np.floor(pixels[:, 0] * 255 / 180), pixels[:, 1], pixels[:, 2]
    if value.mean() > 1:
        value = np.floor(np.clip(value / value.mean() * 128, 0, 255))
    parts = [np.histogram(x, bins=n, range=(0, 255))[0] / (len(x) * 255 / n) for x, n in zip((hue, saturation, value), bins)]
    out = np.concatenate(parts)
    size = np.linalg.norm(out)
    return [float(v) for v in (out / size if size > 1e-8 else out)]


def mean_color(rgb: np.ndarray) -> list[float]:
    """Mean blue, green and red of the pixels that are neither nearly black nor nearly
    white, and ten times the share of red."""
    soft = median_blurred(rgb)
    inside = ((soft >= 20) & (soft <= 235)).all(axis=2)
    mean = (soft[inside] if inside.any() else soft.reshape(-1, 3)).mean(axis=0)[::-1] / 255
    return [float(v) for v in (*mean, red(soft, 170, 70).mean() * 10)]


def layout_diagnostics(rgb: np.ndarray) -> dict[str, float]:
    """Aspect, and how unlike the halves are in their gray levels, edges and brightness."""
    plane = gray(rgb)
    half = plane.shape[1] // 2
    left, right = (np.histogram(x, bins=64, range=(0, 256))[0] / max(1, x.size) for x in (plane[:, :half], plane[:, half:]))
    chi = float((((left - right) ** 2) / (left + right + 1e-8)).sum() / 2)
    dark = abs(float(plane[:, :half].mean() if half else 0.0) - float(plane[:, half:].mean())) / 255
    return {"aspect_ratio": plane.shape[1] / plane.shape[0], "hist_chi2": chi, "edge_asymmetry": asymmetry(rgb), "brightness_diff": dark}


def fold(rgb: np.ndarray) -> dict[str, float | bool]:
    """Signs of a fold down the middle: the strip's share of sideways gradients (5 x 5
    Sobel), and how much darker it is than the sides."""
    plane = gray(rgb).astype(np.float64)
    w, centre = plane.shape[1], plane.shape[1] // 2
    p = np.pad(plane, 2, mode="edge")
    across = sum(k * p[:, i : i + w] for i, k in enumerate((-1, -2, 0, 2, 1)))
    size = np.abs(sum(k * across[i : i + plane.shape[0]] for i, k in enumerate((1, 4, 6, 4, 1))))

    def split(x: np.ndarray, strip: int, margin: int = 0):
        return x[..., max(0, centre - strip) : centre + strip], x[..., margin : max(0, centre - strip)], x[..., centre + strip : w - margin]

    middle, left, right = split(size, max(int(w * 0.025), 3))
    sides = np.concatenate([left, right], axis=1)
    ratio = float(middle.mean() / sides.mean()) if sides.size and sides.mean() > 1e-6 else 0.0
    middle, left, right = split(plane.mean(axis=0), max(int(w * 0.03), 3), int(w * 0.1))
    side = (left.mean() + right.mean()) / 2 if left.size and right.size else 0.0
    dip = float((side - middle.mean()) / side) if side > 1e-6 else 0.0
    return {"edge_ratio": ratio, "brightness_dip": dip, "is_fold": ratio > 1.3 or dip > 0.03}


MEASURED = (
    "entity_id long, ela_std double, ela_mean double, bright_ratio double, max_gradient double, mean_gradient double, noise_ratio double, red_count long, red_ratio double,"
    " color_variance double, asymmetry double, photo_hash string, seal_hash string, bottom_hash string, full_hash string, color array<double>,"
    " border array<double>, mean_color array<double>, aspect_ratio double, hist_chi2 double, edge_asymmetry double, brightness_diff double,"
    " edge_ratio double, brightness_dip double, is_fold boolean, error string"
)


def measure(images: DataFrame) -> DataFrame:
    """All measurements of the rows of the image source, a batch or a stream: re-compression
    error, portrait, seal, hashes, colours, border, layout and fold. An image that doesn't
    decode, or fails to be measured, is a row with an error and nulls. A batch of rows is
    measured row by row, so that a task holds the pixels of one Arrow batch."""
    schema = to_arrow_schema(StructType.fromDDL(MEASURED))

    def one(row: dict) -> dict:
        rgb = from_bgr(row["data"], row["height"], row["width"], row["channels"])
        return {
            **error_level(rgb), **photo_edge(rgb), **seal(rgb), **{f"{r}_hash": mean_hash(rgb, r) for r in REGIONS}, "asymmetry": asymmetry(rgb),
            "color": color_features(rgb), "border": border_histogram(rgb), "mean_color": mean_color(rgb), **layout_diagnostics(rgb), **fold(rgb),
        }

    def measured(row: dict) -> dict:
        found = {"entity_id": row["entity_id"], "error": row["error"]}
        if row["error"] is None:
            try:
                found |= one(row)
            except (ValueError, IndexError, TypeError) as e:
                found["error"] = str(e)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([measured(row) for row in batch.to_pylist()], schema)

    return images.select("entity_id", "height", "width", "channels", "data", "error").mapInArrow(run, MEASURED)


def measured_stream(images: DataFrame, results: str, checkpoint: str) -> StreamingQuery:
    """Measure the images that have arrived since the last call; each is one stored row, also
    if a call fails and is repeated."""
    return measure(images).writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
