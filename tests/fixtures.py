"""Sample inputs from the reference (FIXTURES.md §1) as Spark frames."""

from pyspark.sql import types as T

from revlens.sources.samples import SAMPLE_ROWS as SAMPLE_A  # noqa: E402
from revlens.sources.samples import SAMPLE_SCHEMA  # noqa: E402

SCHEMA_A = T.StructType(SAMPLE_SCHEMA.fields[:-1])

# ---- fixed values: the 10-row upload file (B / C) -----------------------------
UPLOAD_CSV = """product_name,rating,review_text,ltv
Atlas Desk,2.5,Poor quality materials,10000
Atlas Desk,1.8,Broke after 2 weeks,10000
Pulse Earbuds,3.8,Great sound quality,8000
Pulse Earbuds,4.2,Excellent bass,8000
North Mug,3.9,Love the design,5000
North Mug,4.1,Perfect for coffee,5000
Harbor Lamp,2.2,LED flickering,7000
Harbor Lamp,1.9,Stopped working,7000
Summit Bottle,4.5,Keeps drinks cold,6000
Summit Bottle,4.6,Highly recommend,6000
"""


def upload_rows():
    lines = UPLOAD_CSV.strip().splitlines()[1:]
    out = []
    for ln in lines:
        name, rating, text, ltv = ln.split(",")
        out.append((name, float(rating), text, int(ltv)))
    return out


SCHEMA_UPLOAD = "product_name string, rating double, review_text string, ltv bigint"


def sample_a(spark):
    return spark.createDataFrame(SAMPLE_A, SCHEMA_A)


def upload(spark):
    return spark.createDataFrame(upload_rows(), SCHEMA_UPLOAD)
