"""Queries of image kernels, over small pictures made of the embeddings: 8 by 8 gray, or 4 by 5 in colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import images as I
from docloom.operators import layout as L
from docloom.plans.catalog import query
from docloom.session import table

PIXELS = """WITH p AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS k, CAST(floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 300) AS INT) % 256 AS v FROM embeddings)"""
HEX = "string_agg(printf('%02X', CAST({} AS INT)), '' ORDER BY {})"


def pictures(spark, sf_dir, height: int = 8, width: int = 8, channels: int = 1):
    value = lambda x: F.lpad(F.hex((F.floor(F.abs(x.cast("double")) * 300) % 256).cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, height * width * channels), value), ""))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), data.alias("data"))


def shown(rows):
    return rows.select(F.col("origin").cast("long").alias("vec_id"), "height", "width", F.hex("data").alias("data"))


@query("F2_gray", PIXELS + f", c AS (SELECT vec_id, k // 3 AS k, (sum(CASE k % 3 WHEN 0 THEN 114 WHEN 1 THEN 587 ELSE 299 END * v) + 500) // 1000 AS v FROM p WHERE k < 60 GROUP BY vec_id, k // 3) SELECT vec_id, 4 AS height, 5 AS width, {HEX.format('v', 'k')} AS data FROM c GROUP BY vec_id")
def f2(spark, sf_dir):
    return shown(I.transformed(pictures(spark, sf_dir, 4, 5, 3), ["gray"]))


@query("F8_shadow", PIXELS + f", c AS (SELECT *, greatest(1, max(v) OVER (PARTITION BY vec_id)) AS top FROM p) SELECT vec_id, 8 AS height, 8 AS width, {HEX.format('round_even(v * 255.0::DOUBLE / top, 0)', 'k')} AS data FROM c GROUP BY vec_id")
def f8(spark, sf_dir):
    """Every 25 by 25 neighbourhood of so small a picture is the whole of it."""
    return shown(I.transformed(pictures(spark, sf_dir), ["shadow_free"]))


@query("F16_gamma", PIXELS + f" SELECT vec_id, 8 AS height, 8 AS width, {HEX.format('round_even(pow(v / 255.0::DOUBLE, 1 / 1.2::DOUBLE) * 255, 0)', 'k')} AS data FROM p GROUP BY vec_id")
def f16(spark, sf_dir):
    return shown(I.transformed(pictures(spark, sf_dir), ["gamma"]))


@query("F20_difference", PIXELS + f" SELECT vec_id, {HEX.format('abs(v - w)', 'k')} AS data FROM (SELECT a.vec_id, a.k, a.v, b.v AS w FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.k = 63 - a.k) GROUP BY vec_id")
def f20(spark, sf_dir):
    """Each picture against itself turned upside down."""
    own = pictures(spark, sf_dir)
    return I.compared(own, I.transformed(own, ["upside_down"])).select(F.col("origin").cast("long").alias("vec_id"), F.hex("difference").alias("data"))


@query("F18_compare")
def f18(spark, sf_dir):
    own = pictures(spark, sf_dir)
    return I.compared(own, I.transformed(own, ["gamma"])).select(F.col("origin").cast("long").alias("vec_id"), "ssim", "pixel_match", "text_match", "overall")


@query("F_kernels")
def kernels(spark, sf_dir):
    """Every kernel over every picture: the shape and a digest of what comes out."""
    own = pictures(spark, sf_dir)
    out = None
    for name in sorted(I.KERNELS):
        one = I.transformed(own, [name]).select(F.col("origin").cast("long").alias("vec_id"), F.lit(name).alias("kernel"), "height", "width", "channels", F.md5("data").alias("md5"), "error")
        out = one if out is None else out.unionByName(one)
    return out


def brightness(img):
    """Stands in for a recogniser: one box for each quarter of the picture, named by its brightness."""
    h, w = img.shape[0] // 2, img.shape[1] // 2
    parts = [(y, x, float(img[y : y + h, x : x + w].mean())) for y in (0, h) for x in (0, w)]
    return [(f"b{int(m) // 64}", 0.5 + m / 512, float(x), float(y), float(w), float(h)) for y, x, m in parts]


@query("E1_variants")
def e1(spark, sf_dir):
    """Boxes of all variants, and the text and confidence that their votes give."""
    found = I.recognised(pictures(spark, sf_dir), brightness).withColumnRenamed("origin", "doc")
    return L.merged_text(found, 4).select(F.col("doc").cast("long").alias("vec_id"), "text", F.round("confidence", 6).alias("confidence"))


@query("F21_verify")
def f21(spark, sf_dir):
    own = pictures(spark, sf_dir)
    found = I.recognised(own, brightness).filter("variant = 'original'").drop("variant")
    return I.verified(own, found).select(F.col("origin").cast("long").alias("vec_id"), "ssim", "pixel_match", "text_match", "overall")
