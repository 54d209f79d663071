"""File sources. Schemas are declared; nothing is inferred from data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import irradiance_reason, monthly
from ..operators.catalogue import duplicates, must_be_empty, require_columns
from .schemas import COORDINATES, IRRADIANCE, MANIFEST


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV columns found by their header name, in any order, cast to `schema`; others are not read.

    A missing column is an error at once, a value that does not fit its type is one when the row is read.
    """
    want = dict(c.split() for c in schema.split(","))
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, list(want))

    def cast(c: str, kind: str):
        got = F.col(c).try_cast(kind)
        wrong = F.raise_error(F.concat(F.lit(f"{c} is not {kind}: "), F.col(c))).cast(kind)
        return F.when(F.col(c).isNotNull() & got.isNull(), wrong).otherwise(got).alias(c)

    return raw.select(*[cast(c, kind) for c, kind in want.items()])


def scan_catalogue(spark: SparkSession, csv: str, manifest: str) -> DataFrame:
    """Coordinates joined to their manifest; a repeated sampleid in either file is an error."""
    coords = read_csv(spark, csv, COORDINATES)
    rows = read_csv(spark, manifest, "sampleid bigint, filename string")
    for name, df in (("coordinates", coords), ("manifest", rows)):
        must_be_empty(duplicates(df, ["sampleid"]), f"repeated sampleid in {name}")
    return rows.join(coords, "sampleid")


def scan_manifests(spark: SparkSession, files: dict[str, str], expected: dict[str, int] | None = None) -> DataFrame:
    """Split CSVs stacked with a `source` tag; columns a file lacks become null, wrong row counts raise."""
    out = None
    for source, path in files.items():
        df = spark.read.option("header", True).csv(path)
        require_columns(df, ["filename"])
        if expected and source in expected:
            n = df.count()
            if n != expected[source]:
                raise ValueError(f"{source}: expected {expected[source]} rows, found {n}")
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    known = dict(c.split() for c in MANIFEST.split(","))
    return out.withColumns({c: F.col(c).try_cast(known[c]) for c in out.columns if c in known})


COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,area:double,iscrowd:int,bbox:array<double>,segmentation:string>>"
)


def scan_coco(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, polygon annotations, and quarantined run-length annotations of COCO files.

    The segmentation is read as text because one file mixes polygon lists and run-length objects. Land
    large annotation sets as many documents (files, or lines with `multi_line=False`): one JSON document is
    read by one task.
    """
    doc = spark.read.schema(COCO).option("multiLine", multi_line).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumn("file_name", F.regexp_extract("file_name", r"([^/\\]*)$", 1))
    ann = doc.select(F.explode("annotations").alias("a")).select("a.*")
    rle = F.col("segmentation").startswith("{")
    polygons = ann.where(F.coalesce(~rle, F.lit(True))).withColumn("segmentation", F.from_json("segmentation", "array<array<double>>"))
    coded = ann.where(rle).withColumn("segmentation_rle", F.from_json("segmentation", "struct<size:array<int>,counts:string>")).drop("segmentation")
    return images, polygons, coded


def scan_split_ids(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """{"train": [ids], ...} to (split, image_id); one document per file or per line."""
    doc = spark.read.text(path, wholetext=whole_file).select(F.from_json("value", "map<string,array<bigint>>").alias("m"))
    return doc.select(F.explode("m").alias("split", "ids")).select("split", F.explode("ids").alias("image_id"))


def scan_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved per-image metrics, from Parquet or CSV."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def file_inventory(spark: SparkSession, root: str, glob: str = "*.bmp", label: str = "_label") -> tuple[DataFrame, DataFrame]:
    """Images paired with their `<stem>_label` mask, and the images whose mask is missing. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length")
    return pair_masks(files, label)


# fixed values: the endings of world files
WORLD = ("pgw", "tfw", "jgw", "wld")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def world_file_count(files: DataFrame, images: Sequence[str] = ("png", "jpg")) -> DataFrame:
    """Per folder of a listing (path, length): images, world files, and images that have one of the same stem."""
    named = files.select(
        F.regexp_extract("path", r"^(.*?)[^/\\]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/\\]*)\.[^./\\]+$", 1).alias("stem"),
        F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).alias("ending"),
    )
    image, world = F.col("ending").isin(*images), F.col("ending").isin(*WORLD)
    per = named.groupBy("folder", "stem").agg(F.count_if(image).alias("i"), F.count_if(world).alias("w"))
    return per.groupBy("folder").agg(
        F.sum("i").alias("images"), F.sum("w").alias("world_files"), F.sum(F.when(F.col("w") > 0, F.col("i")).otherwise(0)).alias("with_world_file")
    )


def pair_masks(files: DataFrame, label: str = "_label") -> tuple[DataFrame, DataFrame]:
    """Image rows with their mask's path, and image rows without one, from a listing (path, length)."""
    stem = F.regexp_extract("path", r"^(.*)\.[^./\\]+$", 1)
    files = files.withColumn("stem", stem)
    masks = files.where(F.col("stem").endswith(label)).select(
        F.expr(f"left(stem, length(stem) - {len(label)})").alias("stem"), F.col("path").alias("mask_path")
    )
    images = files.where(~F.col("stem").endswith(label)).join(masks, "stem", "left").drop("stem")
    return images.where("mask_path is not null"), images.where("mask_path is null")


def parse_irradiance(df: DataFrame, body: str) -> DataFrame:
    """Climatology JSON text to annual value, monthly map and reject reason."""
    doc = df.withColumn("__j", F.from_json(body, IRRADIANCE))
    values = F.col("__j.properties.parameter.ALLSKY_SFC_SW_DWN")
    ann = F.try_element_at(values, F.lit("ANN"))
    out = doc.withColumns({"ann": ann, "monthly_values": monthly(values), "reason": irradiance_reason(ann)})
    return out.drop("__j", body)


def scan_irradiance(spark: SparkSession, path: str) -> DataFrame:
    """Landed climatology responses, one JSON document per file."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return parse_irradiance(texts, "body")
