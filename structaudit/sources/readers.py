"""Scans. Schemas are fixed, nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structaudit.functions.boxes import image_label
from structaudit.functions.keys import known_confidence

RECORD = "inchikey string, formula string, smiles string, iupac string, title string, cid bigint"
READ = "engine string, raw string, inchikey string, confidence double"
ELEMENT = (
    "deck string, page int, pos int, kind string, group_id string, x0 double, y0 double, x1 double, y1 double, "
    "weight int, text string, n_bytes bigint, px_w int, px_h int, content binary"
)
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg")


def _struct_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ") for part in ddl.split(", ")))


_READ_STRUCT = _struct_fields(READ)
ITEM_DDL = (
    f"index bigint, name string, smiles string, variant string, path string, inchikey string, reads array<struct<{_READ_STRUCT}>>"
)
ITEM_STRUCT = (
    f"index: bigint, name: string, smiles: string, variant: string, path: string, inchikey: string, reads: array<struct<{_READ_STRUCT}>>"
)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Decoded page elements. Rectangles are outlines and are dropped in the scan; a line counts
    two points, whatever its weight says."""
    rows = spark.read.schema(ELEMENT).parquet(path).where("kind <> 'rect'")
    return rows.withColumn("weight", F.when(F.col("kind") == "line", 2).otherwise(F.col("weight")))


def dictionary_rows(json_text: Column) -> Column:
    """Generator of (name, record) from the text of a dictionary file; nothing for a broken one."""
    parsed = F.from_json(json_text, f"entries map<string, struct<{_struct_fields(RECORD)}>>")
    return F.explode(parsed["entries"])


#: A record of a dictionary document up to its closing brace: the first one behind the document's head, the others behind a comma.
_NAME, _RECORD = r'("(?:[^"\\]|\\.)*+")', r"(\{[^{}]*+)"
_HEAD = rf'(?s)^\s*\{{[^{{}}]*"entries"\s*:\s*\{{\s*{_NAME}\s*:\s*{_RECORD}$'
_NEXT = rf"(?s)^\s*,\s*{_NAME}\s*:\s*{_RECORD}$"


def _dictionary_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary document cut at its closing braces: (kind, name, record). The cuts let several tasks read one file."""
    text = F.col("value")
    quotes = F.length(F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '[^"]', ""))
    found = F.when(text.rlike(_HEAD), F.lit(_HEAD)).when(text.rlike(_NEXT), F.lit(_NEXT))
    pieces = spark.read.text(path, lineSep="}").select(text, found.alias("form"), (quotes % 2).alias("open"))
    name = F.coalesce(*[F.when(F.col("form") == form, F.regexp_extract(text, form, 1)) for form in (_HEAD, _NEXT)])
    record = F.coalesce(*[F.when(F.col("form") == form, F.concat(F.regexp_extract(text, form, 2), F.lit("}"))) for form in (_HEAD, _NEXT)])
    parsed = F.try_parse_json(record).isNotNull()
    kind = (
        F.when(F.col("open") == 1, "broken").when((F.col("form") == _HEAD) & parsed, "first").when((F.col("form") == _NEXT) & parsed, "next")
        .when(F.col("form").isNull() & ~F.contains(text, F.lit("{")), "rest").otherwise("broken")
    )
    return pieces.select(kind.alias("kind"), name.alias("name"), record.alias("record"))


def _cuts_fit(pieces: DataFrame) -> bool:
    """Whether the pieces are one whole document: one head, nothing broken, and both outer braces closed."""
    n = {r["kind"]: r["n"] for r in pieces.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return n.get("first") == 1 and "broken" not in n and n.get("rest", 0) in (2, 3)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary files: ``{"entries": {name: record}}`` as JSON, or Parquet rows. A JSON file
    that is missing or cannot be parsed is an empty table; a Parquet path that cannot be read is an error.

    A JSON document of any size is read in pieces by several tasks, if braces only open and close its
    records. One that is cut otherwise (braces in a name, say) is parsed whole by one task.
    """
    columns = ["name_key", "inchikey", "formula", "smiles", "iupac", "title", "cid"]
    if not path.endswith(".json"):
        return spark.read.schema(f"name_key string, {RECORD}").parquet(path)
    try:
        pieces = _dictionary_pieces(spark, path)
        if _cuts_fit(pieces):
            name = F.from_json(F.concat(F.lit("["), "name", F.lit("]")), "array<string>")[0]
            rows = pieces.where("record is not null").select(name.alias("name"), F.from_json("record", RECORD).alias("record"))
        else:
            text = spark.read.text(path, wholetext=True)
            rows = text.select(dictionary_rows(F.col("value")).alias("name", "record"))
        return rows.select(F.lower(F.trim("name")).alias("name_key"), "record.*").select(*columns)
    except AnalysisException:
        return spark.createDataFrame([], f"name_key string, {RECORD}")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Term list: one row per compound with its four alias arrays and its answer."""
    lists = "id string, en array<string>, iupac array<string>, ko array<string>, abbr array<string>"
    schema = f"compounds array<struct<{_struct_fields(lists)}, answer: struct<{_struct_fields(RECORD)}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("compounds").alias("c"))
    empty = F.array().cast("array<string>")
    arrays = [F.coalesce(f"c.{k}", empty).alias(k) for k in ("en", "iupac", "ko", "abbr")]
    return rows.select("c.id", *arrays, "c.answer")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Label manifest: its entries, with the source of the labels on every row."""
    entry = "slide int, image string, truth string, smiles string, note string"
    schema = f"source string, labelled_by string, entries array<struct<{_struct_fields(entry)}>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("source", F.inline("entries"))


def replay_rows(items: DataFrame) -> DataFrame:
    """Stored items to one row per reading; an item without readings keeps one row of NULLs.

    Rows hold one reading with its number (``read``), or all of an item as an array (``reads``), numbered from 0.
    """
    one = items
    if "reads" in items.columns:
        one = items.select("*", F.posexplode_outer("reads").alias("_at", "_r")).withColumn(
            "read", F.when(F.col("_r").isNotNull(), F.struct(F.col("_at").alias("read_no"), "_r.engine", "_r.raw", "_r.inchikey", "_r.confidence"))
        )
    return one.select(
        F.col("index").alias("item_id"), "name", "variant", F.col("inchikey").alias("true_key"), F.col("read.read_no").cast("int").alias("read_no"),
        "read.engine", "read.raw", F.col("read.inchikey").alias("inchikey"), known_confidence(F.col("read.confidence")).alias("confidence"),
    )


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Stored readings: a document with ``items``, or one reading per line as the sink writes them."""
    if path.endswith(".json"):
        nested = f"items array<struct<{ITEM_STRUCT}>>"
        items = spark.read.schema(nested).json(path, multiLine=True).select(F.inline("items"))
        return replay_rows(items)
    line = ITEM_DDL.replace(f"reads array<struct<{_READ_STRUCT}>>", f"read struct<read_no: int, {_READ_STRUCT}>")
    return replay_rows(spark.read.schema(line).json(path))


def read_image_labels(paths: DataFrame) -> DataFrame:
    """Model, compound and crop flag from image file names; other files are ignored.

    ``paths(path)``, for instance from ``spark.read.format("binaryFile")`` without the content.
    """
    file = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    return (
        paths.select(file.alias("file"))
        .where(suffix.isin(*IMAGE_SUFFIXES))
        .select("file", image_label(stem).alias("label"))
        .select("file", "label.*")
    )
