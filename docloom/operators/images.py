"""Image operators as numpy kernels over rows of (height, width, channels, data), channels in BGR order.

They are definitions of this engine: they follow the usual formulas and do not claim to equal any
image library bit by bit. `transformed` applies named kernels to an image table in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(img: np.ndarray) -> np.ndarray:
    """Luma of BGR; images of one channel stay."""
    return img if img.ndim == 2 else ((img[..., :3].astype(np.int32) @ np.array([114, 587, 299], np.int32) + 500) // 1000).astype(np.uint8)


def _windows(img: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(img, n // 2, mode="edge"), (n, n))


def box_mean(img: np.ndarray, n: int) -> np.ndarray:
    p = np.pad(img.astype(np.float64), n // 2, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def gaussian(img: np.ndarray, n: int) -> np.ndarray:
    sigma = 0.3 * ((n - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(img.astype(np.float64), n // 2, mode="edge")
    p = np.apply_along_axis(np.convolve, 0, p, k, "valid")
    return np.apply_along_axis(np.convolve, 1, p, k, "valid")


def dilate(img: np.ndarray, n: int) -> np.ndarray:
    p = np.pad(img, n // 2, mode="edge")
    p = np.lib.stride_tricks.sliding_window_view(p, n, axis=0).max(-1)
    return np.lib.stride_tricks.sliding_window_view(p, n, axis=1).max(-1)


def adaptive_threshold(img: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    g = gray(img)
    return np.where(g > gaussian(g, block) - c, 255, 0).astype(np.uint8)


def otsu(img: np.ndarray) -> np.ndarray:
    """Black and white at the threshold of greatest variance between the two sides."""
    g = gray(img)
    p = np.bincount(g.ravel(), minlength=256) / g.size
    w, m = p.cumsum(), (p * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * w - m) ** 2 / (w * (1 - w)))
    return np.where(g > between.argmax(), 255, 0).astype(np.uint8)


def shadow_free(img: np.ndarray, n: int = 25) -> np.ndarray:
    g = gray(img).astype(np.float64)
    return _byte(g / np.maximum(dilate(g, n), 1) * 255)


def background_normalised(img: np.ndarray, n: int = 51, power: float = 1.2) -> np.ndarray:
    g = gray(img)
    return gamma(_byte(g / np.maximum(np.median(_windows(g, min(n, 2 * (min(g.shape) // 2) + 1)), axis=(2, 3)), 1) * 255), power)


def gamma(img: np.ndarray, power: float) -> np.ndarray:
    return _byte((np.arange(256) / 255) ** (1 / power) * 255)[img]


def stretched(img: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    a, b = np.percentile(img, [low, high])
    return img if b <= a else _byte((img - a) / (b - a) * 255)


def denoised(img: np.ndarray, h: float = 10, patch: int = 3, search: int = 5) -> np.ndarray:
    """Non-local means: neighbours weighted by how alike their patches are."""
    g = gray(img).astype(np.float64)
    r = search // 2
    p = np.pad(g, r, mode="edge")
    total, weight = np.zeros_like(g), np.zeros_like(g)
    for dy in range(search):
        for dx in range(search):
            other = p[dy : dy + g.shape[0], dx : dx + g.shape[1]]
            w = np.exp(-box_mean((g - other) ** 2, patch) / (h * h))
            total += w * other
            weight += w
    return _byte(total / weight)


def clahe(img: np.ndarray, clip: float = 2, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles with clipped counts; each pixel blends its four nearest tiles."""
    g = gray(img)
    ys, xs = (np.array_split(np.arange(n), min(tiles, n)) for n in g.shape)
    maps = np.empty((len(ys), len(xs), 256))
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            n = np.bincount(g[np.ix_(y, x)].ravel(), minlength=256).astype(np.float64)
            top = max(1.0, clip * n.sum() / 256)
            n = np.minimum(n, top) + np.maximum(n - top, 0).sum() / 256
            maps[i, j] = n.cumsum() / n.sum() * 255

    def blend(parts, size):
        at = np.interp(np.arange(size), [p.mean() for p in parts], np.arange(len(parts)))
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, len(parts) - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = blend(ys, g.shape[0]), blend(xs, g.shape[1])
    pick = lambda a, b: maps[a[:, None], b[None, :], g]
    top, low = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx, pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return _byte(top * (1 - fy[:, None]) + low * fy[:, None])


def laplacian_variance(img: np.ndarray) -> float:
    g = np.pad(gray(img).astype(np.float64), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def sharpened_if_soft(img: np.ndarray, least: float = 100) -> np.ndarray:
    g = gray(img)
    return g if laplacian_variance(g) >= least else _byte(1.5 * g.astype(np.float64) - 0.5 * gaussian(g, 5))


def crop_border(img: np.ndarray, threshold: int = 200, pad: int = 10) -> np.ndarray:
    dark = gray(img) < threshold
    if not dark.any():
        return img
    y, x = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    return img[max(0, y[0] - pad) : y[-1] + pad + 1, max(0, x[0] - pad) : x[-1] + pad + 1]


def skew_angle(img: np.ndarray, most: float = 15, step: float = 0.25) -> float:
    """The angle at which dark pixels fall into the sharpest rows, in degrees."""
    y, x = np.nonzero(gray(img) < 128)
    if len(y) < 2:
        return 0.0
    best = (-1.0, 0.0)
    for a in sorted(np.arange(-most, most + step, step), key=abs):
        rows = np.rint(y * np.cos(np.radians(a)) - x * np.sin(np.radians(a))).astype(int)
        best = max(best, (float((np.bincount(rows - rows.min()).astype(float) ** 2).sum()), float(a)), key=lambda t: t[0])
    return best[1]


def deskewed(img: np.ndarray) -> np.ndarray:
    """Turned by its skew on a canvas that grows, white outside; small angles stay."""
    a = skew_angle(img)
    if abs(a) < 0.5:
        return img
    t, (h, w) = np.radians(a), img.shape[:2]
    nh, nw = int(abs(h * np.cos(t)) + abs(w * np.sin(t))) + 1, int(abs(w * np.cos(t)) + abs(h * np.sin(t))) + 1
    yy, xx = np.mgrid[:nh, :nw]
    y, x = yy - nh / 2, xx - nw / 2
    sy, sx = np.rint(y * np.cos(t) + x * np.sin(t) + h / 2).astype(int), np.rint(-y * np.sin(t) + x * np.cos(t) + w / 2).astype(int)
    ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full((nh, nw, *img.shape[2:]), 255, np.uint8)
    out[ok] = img[sy[ok], sx[ok]]
    return out


def upscaled(img: np.ndarray, least: int = 300) -> np.ndarray:
    """Bilinear enlargement towards a resolution estimated from the shorter side, four times at most."""
    scale = min(least / max(min(img.shape[:2]) / 4, 72), 4)
    if scale <= 1:
        return img
    h, w = int(img.shape[0] * scale), int(img.shape[1] * scale)
    y, x = np.linspace(0, img.shape[0] - 1, h), np.linspace(0, img.shape[1] - 1, w)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if img.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    f = img.astype(np.float64)
    return _byte((f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy)


def text_mask(img: np.ndarray) -> np.ndarray:
    ink = 255 - adaptive_threshold(img)
    return dilate(dilate(ink, 5), 5) > 0


def ssim(a: np.ndarray, b: np.ndarray, n: int = 7) -> float:
    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = box_mean(a, n), box_mean(b, n)
    va, vb, ab = box_mean(a * a, n) - ma**2, box_mean(b * b, n) - mb**2, box_mean(a * b, n) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * ab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def compare(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Similarity, shares of like pixels overall and in the text of a, and their mean."""
    a, b = gray(a), gray(b)
    like = np.abs(a.astype(int) - b.astype(int)) <= 30
    mask = text_mask(a)
    s, p, t = ssim(a, b), 100 * like.mean(), 100 * like[mask].mean() if mask.any() else 100.0
    return {"ssim": round(s, 4), "pixel_match": round(float(p), 2), "text_match": round(float(t), 2), "overall": round(float((s * 100 + p + t) / 3), 2)}


def difference_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(gray(a).astype(int) - gray(b).astype(int)).astype(np.uint8)


def _luma(img: np.ndarray, f) -> np.ndarray:
    """f on the lightness of a colour image, whose colours follow by the same step; on a gray one f alone."""
    if img.ndim == 2:
        return f(img)
    light = img[..., :3].max(-1).astype(np.float64) / 2 + img[..., :3].min(-1) / 2
    new = f(_byte(light)).astype(np.float64)
    return _byte(img + (new - light)[..., None])


def denoised_colour(img: np.ndarray) -> np.ndarray:
    """Non-local means of each channel."""
    return denoised(img) if img.ndim == 2 else np.stack([denoised(img[..., k]) for k in range(img.shape[2])], axis=-1)


def clahe_colour(img: np.ndarray) -> np.ndarray:
    """Equalised lightness, colours kept."""
    return _luma(img, clahe)


def parts(mask: np.ndarray) -> np.ndarray:
    """A number for each part of a mask whose pixels touch by a side, and mask.size elsewhere: numbers are
    carried along rows and columns, the least wins, until none changes."""
    n = mask.size
    label = np.where(mask, np.arange(n).reshape(mask.shape), n)
    while True:
        before = label
        for axis in (0, 1):
            for flip in (False, True):
                x = np.flip(label, axis) if flip else label
                x = np.moveaxis(x, axis, 0).copy()
                for k in range(1, len(x)):
                    x[k] = np.where(x[k] < n, np.minimum(x[k], x[k - 1]), n)
                x = np.moveaxis(x, 0, axis)
                label = np.flip(x, axis) if flip else x
        if (label == before).all():
            return label


def largest_part(mask: np.ndarray) -> np.ndarray:
    label = parts(mask)
    ids, counts = np.unique(label[label < mask.size], return_counts=True)
    return label == ids[counts.argmax()] if len(ids) else mask


def equation_regions(img: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) that may be displayed equations, from top to bottom: dark pixels joined across 20 columns
    and 5 rows, whose parts are wide and low enough."""
    ink = otsu(img) == 0
    for axis, n in ((0, 5), (1, 20)):
        p = np.pad(ink, [(n // 2, n - 1 - n // 2) if k == axis else (0, 0) for k in (0, 1)])
        ink = np.lib.stride_tricks.sliding_window_view(p, n, axis=axis).any(-1)
    label = parts(ink)
    out = []
    for k in np.unique(label[label < ink.size]):
        y, x = np.nonzero(label == k)
        box = (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1)
        if 200 < box[2] < 800 and 20 < box[3] < 150:
            out.append(box)
    return sorted(out, key=lambda b: (b[1], b[0]))


def page_corners(img: np.ndarray) -> np.ndarray | None:
    """Corners (x, y) of the largest bright area, from the upper left clockwise; null unless they make a convex
    shape of 1000 pixels or more that fills most of the area."""
    part = largest_part(otsu(img) > 0)
    y, x = np.nonzero(part)
    if len(y) < 1000:
        return None
    at = [(x + y).argmin(), (x - y).argmax(), (x + y).argmax(), (y - x).argmax()]
    c = np.array([(x[k], y[k]) for k in at], np.float64)
    side = np.roll(c, -1, axis=0) - c
    turn = side[:, 0] * np.roll(side, -1, axis=0)[:, 1] - side[:, 1] * np.roll(side, -1, axis=0)[:, 0]
    area = abs((c[:, 0] * np.roll(c[:, 1], -1) - np.roll(c[:, 0], -1) * c[:, 1]).sum()) / 2
    return c if (turn > 0).all() and area >= 1000 and area >= 0.8 * len(y) else None


def flattened(img: np.ndarray, least: int = 100) -> np.ndarray:
    """The page that fills the image, seen from above; images without four corners, or with a side under `least`, stay."""
    c = page_corners(img)
    if c is None:
        return img
    length = lambda a, b: float(np.hypot(*(c[a] - c[b])))
    w, h = int(max(length(0, 1), length(3, 2))), int(max(length(0, 3), length(1, 2)))
    if min(w, h) < least:
        return img
    flat = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], np.float64)
    rows, right = [], []
    for (u, v), (x, y) in zip(flat, c, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    v, u = np.mgrid[:h, :w]
    x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]).astype(np.float64), axes=1)
    sx, sy = np.clip(np.rint(x / z), 0, img.shape[1] - 1).astype(int), np.clip(np.rint(y / z), 0, img.shape[0] - 1).astype(int)
    return img[sy, sx]


def variants(img: np.ndarray) -> dict[str, np.ndarray]:
    """What a recogniser is shown: as it is, prepared, with an even background, and enlarged where it is small."""
    out = {"original": img, "prepared": img, "background": img}
    for s in PREPROCESS:
        out["prepared"] = KERNELS[s](out["prepared"])
    out["background"] = background_normalised(img, 15)
    if min(img.shape[:2]) < 800:
        out["enlarged"] = upscaled(img)
    return out


def bar_text(canvas: np.ndarray, text: str, x: int, y: int, w: int, h: int, alpha: float) -> None:
    """Stands in for a font: a bar for each visible character, as wide as its share of the box."""
    step = w / max(1, len(text))
    for k, c in enumerate(text):
        if not c.isspace():
            a, b = int(x + k * step), max(int(x + k * step) + 1, int(x + (k + 0.7) * step))
            part = canvas[max(0, y) : max(0, y + h), max(0, a) : max(0, b)]
            part[...] = _byte(part * (1 - alpha))


def reconstructed(img: np.ndarray, boxes: list[tuple], draw=bar_text) -> np.ndarray:
    """A page drawn from its kept boxes (text, confidence, x, y, w, h), largest first, over a faint original.

    The renderer is injected: it gets the canvas, text, place, height and how dark to draw.
    """
    g = gray(img).astype(np.float64)
    out = _byte(255 - (255 - g) * FAINT / 255)
    h_, w_ = out.shape
    for text, confidence, x, y, w, h in sorted(boxes, key=lambda b: -b[4] * b[5]):
        dark = FAINT / 255 if w * h > 15000 and confidence < 0.85 else 1.0
        out[max(0, int(y)) : int(y + h), max(0, int(x)) : int(x + w)] = 255
        draw(out, text, int(x), int(y), min(int(w), w_), min(int(h * 0.8), h_), dark)
    return out


def verify(img: np.ndarray, boxes: list[tuple], draw=bar_text, passes: int = 3, enough: float = 95.0) -> dict[str, float]:
    """The comparison of a page with what its boxes give back; the best of several passes by its text."""
    best: dict[str, float] = {}
    for _ in range(passes):
        found = compare(img, reconstructed(img, boxes, draw))
        if not best or found["text_match"] > best["text_match"]:
            best = found
        if found["overall"] >= enough:
            break
    return best


#: How dark a faint part is, of 255.
FAINT = 40
def heat_map(difference: np.ndarray) -> np.ndarray:
    """Differences in colour: blue for none, green for half, red for all."""
    d = difference.astype(int)
    return np.stack([255 - d, 255 - np.abs(2 * d - 255), d], axis=-1).astype(np.uint8)


KERNELS = {
    "gray": gray,
    "shadow_free": shadow_free,
    "denoise": denoised,
    "deskew": deskewed,
    "binarise": adaptive_threshold,
    "otsu": otsu,
    "clahe": clahe,
    "crop": crop_border,
    "stretch": stretched,
    "sharpen": sharpened_if_soft,
    "background": background_normalised,
    "upscale": upscaled,
    "denoise_colour": denoised_colour,
    "clahe_colour": clahe_colour,
    "flatten": flattened,
    "gamma": lambda img: gamma(img, 1.2),
    "heat": lambda img: heat_map(gray(img)),
    "upside_down": lambda img: img[::-1, ::-1],
    "text_mask": lambda img: np.where(text_mask(img), 255, 0).astype(np.uint8),
}
#: The usual order before recognition.
PREPROCESS = ["gray", "shadow_free", "denoise", "deskew", "binarise"]

#: The order for weak scans: contrast first, then noise, local contrast and ink.
RECOGNITION = ["gray", "upscale", "stretch", "denoise", "clahe", "sharpen", "otsu"]


def transformed(images: DataFrame, steps: list[str] = PREPROCESS) -> DataFrame:
    """Image rows after the named kernels; images that a kernel cannot take keep null data and the error."""

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                try:
                    img = _image(r)
                    for s in steps:
                        img = KERNELS[s](img)
                    out.append((r.origin, img.shape[0], img.shape[1], 1 if img.ndim == 2 else img.shape[2], np.ascontiguousarray(img).tobytes(), None))
                except (ValueError, IndexError) as e:
                    out.append((r.origin, r.height, r.width, r.channels, None, str(e)))
            yield pd.DataFrame(out, columns=["origin", "height", "width", "channels", "data", "error"])

    return images.select("origin", "height", "width", "channels", "data").mapInPandas(run, "origin string, height int, width int, channels int, data binary, error string")


def _image(r) -> np.ndarray:
    img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
    return img[..., 0] if r.channels == 1 else img


BOX = "text string, confidence double, x double, y double, w double, h double"


def recognised(images: DataFrame, recognise) -> DataFrame:
    """(origin, variant, seq, box columns) from an injected recogniser, which gets an image and gives
    (text, confidence, x, y, w, h); a variant that it fails on has no boxes. Boxes of enlarged images are put back to scale."""

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                img, seq = _image(r), 0
                for name, v in variants(img).items():
                    try:
                        found = recognise(v)
                    except Exception:  # noqa: BLE001  whatever a recogniser raises
                        continue
                    fy, fx = (img.shape[0] / v.shape[0], img.shape[1] / v.shape[1]) if name == "enlarged" else (1.0, 1.0)
                    for text, c, x, y, w, h in found:
                        out.append((r.origin, name, seq, text, c, x * fx, y * fy, w * fx, h * fy))
                        seq += 1
            yield pd.DataFrame(out, columns=["origin", "variant", "seq", "text", "confidence", "x", "y", "w", "h"])

    return images.select("origin", "height", "width", "channels", "data").mapInPandas(run, f"origin string, variant string, seq long, {BOX}")


def verified(images: DataFrame, boxes: DataFrame, draw=bar_text) -> DataFrame:
    """(origin, ssim, pixel_match, text_match, overall): each page against its reconstruction from its boxes, which
    are first suppressed and freed of watermarks."""
    from pyspark.sql import functions as F

    from docloom.operators import layout

    sized = boxes.join(images.select("origin", "height", "width"), "origin")
    clean = sized.filter(~layout.is_watermark(F.col("width"), F.col("height"))).drop("height", "width").withColumnRenamed("origin", "doc")
    kept = layout.suppress(clean.select("doc", "seq", "text", "confidence", "x", "y", "w", "h"))
    of_page = kept.groupBy(F.col("doc").alias("origin")).agg(F.collect_list(F.struct("text", "confidence", "x", "y", "w", "h")).alias("boxes"))  # of one page

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                found = verify(_image(r), [tuple(b.values()) if isinstance(b, dict) else tuple(b) for b in (r.boxes if r.boxes is not None else ())], draw)
                out.append((r.origin, *(found[c] for c in ("ssim", "pixel_match", "text_match", "overall"))))
            yield pd.DataFrame(out, columns=["origin", "ssim", "pixel_match", "text_match", "overall"])

    joined = images.join(of_page, "origin", "left").select("origin", "height", "width", "channels", "data", "boxes")
    return joined.mapInPandas(run, "origin string, ssim double, pixel_match double, text_match double, overall double")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(origin, ssim, pixel_match, text_match, overall, difference) of pictures of one size and name."""
    columns = ("height", "width", "channels", "data")
    b = right.select("origin", *[right[c].alias(f"b_{c}") for c in columns])

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                x, y = (np.frombuffer(d, np.uint8).reshape(h, w, c) for h, w, c, d in ((r.height, r.width, r.channels, r.data), (r.b_height, r.b_width, r.b_channels, r.b_data)))
                x, y = (z[..., 0] if z.shape[2] == 1 else z for z in (x, y))
                found = compare(x, y)
                out.append((r.origin, *(found[c] for c in ("ssim", "pixel_match", "text_match", "overall")), difference_map(x, y).tobytes()))
            yield pd.DataFrame(out, columns=["origin", "ssim", "pixel_match", "text_match", "overall", "difference"])

    joined = left.select("origin", *columns).join(b, "origin")
    return joined.mapInPandas(run, "origin string, ssim double, pixel_match double, text_match double, overall double, difference binary")


def write_files(images: DataFrame, folder: str) -> DataFrame:
    """(origin, name, content): portable gray or colour maps of image rows, ready for a binary sink."""

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                img = _image(r)
                kind = b"P5" if img.ndim == 2 else b"P6"
                pixels = img if img.ndim == 2 else img[..., 2::-1]
                out.append((r.origin, f"{folder}/{r.origin.rsplit('/', 1)[-1]}.{'pgm' if img.ndim == 2 else 'ppm'}", b"%s %d %d 255\n" % (kind, r.width, r.height) + np.ascontiguousarray(pixels).tobytes()))
            yield pd.DataFrame(out, columns=["origin", "name", "content"])

    return images.select("origin", "height", "width", "channels", "data").mapInPandas(run, "origin string, name string, content binary")
