"""Tables of the audit derived from the given ones, once for Spark and once as SQL.

``lineitem`` becomes the readings (an order is an item, its lines are readings), ``benchmark``
the name dictionary, ``documents`` the pages, ``part`` and ``orders`` the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structaudit.operators.evaluate import VARIANTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enc(value: str, n: int, text: str) -> str:
    """SQL: ``n`` capital letters that stand for a value."""
    return f"upper(translate(substr(md5(cast({value} as {text})), 1, {n}), '0123456789abcdef', 'ABCDEFGHIJKLMNOP'))"


def key(skeleton: str, stereo: str, text: str) -> str:
    """SQL: a well-formed identifier key."""
    return f"concat({enc(skeleton, 14, text)}, '-', {enc(stereo, 8, text)}, 'SA-N')"


ENGINE = "case read_no % 3 when 0 then 'readera@v310' when 1 then 'readerb/x1' else 'readerb/x0.9' end"
CONFIDENCE = (
    "case when read_no % 3 = 0 then cast(70 + 3 * cast(round(disc * 100) as int) as double) / cast(100 as double) end"
)
RAW = (
    "case when suppkey % 17 = 0 then 'C*CC*' when suppkey % 19 = 0 then 'C.C.CC.CCC.O' "
    "else concat(repeat('C', cast(partkey % 9 + 1 as int)), case partkey % 4 when 0 then '(=O)N' when 1 then 'c1ccncc1Cl' "
    "when 2 then '[C@@H](O)Br' else repeat('S', cast(partkey % 50 as int)) end, "
    "case when suppkey % 7 = 0 then '.[Na+]' when suppkey % 23 = 0 then '.[I-].[I-]' else '' end) end"
)
VARIANT = "case item_id % 8 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(VARIANTS)) + " end"


def read_key(text: str) -> str:
    return (
        "case when suppkey % 13 = 0 then null else "
        + key("case when suppkey % 9 = 0 then partkey else truth_part end",
              "case when suppkey % 11 = 0 then 'flip' else 'base' end", text)
        + " end"
    )


def ref_key(text: str) -> str:
    return f"case when item_id % 5 = 0 then {key('truth_part + 1', chr(39) + 'base' + chr(39), text)} else {key('truth_part', chr(39) + 'base' + chr(39), text)} end"


def true_key(text: str) -> str:
    return key("truth_part", "'base'", text)


TRUTH = "case when item_id % 5 = 0 then 'skeleton_diff' else 'same' end"


#: Lines that one task groups and sorts.
LINES = 600_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as the lines have need of. The session's own number is the same for a table of any size."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(table(spark, sf_dir, "lineitem").count() / LINES))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``lineitem``, dealt out before anything is grouped: a split of the file alone may hold 128 MB.

    An item's lines are in one task, so who groups by item needs no other exchange.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("read_no"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_discount").alias("disc"),
    ).repartition(tasks(spark, sf_dir), "item_id")


def truth_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("item_id").agg(F.min("partkey").alias("truth_part"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, read_no, engine, raw, inchikey, confidence)."""
    # Lines without an order are no item's readings.
    found = lines(spark, sf_dir).where("item_id is not null").groupBy("item_id", "read_no").agg(
        F.min("partkey").alias("partkey"), F.min("suppkey").alias("suppkey"), F.max("disc").alias("disc")
    )
    return found.withColumn("truth_part", F.min("partkey").over(Window.partitionBy("item_id"))).select(
        "item_id", "read_no",
        F.expr(ENGINE).alias("engine"), F.expr(RAW).alias("raw"),
        F.expr(read_key("string")).alias("inchikey"), F.expr(CONFIDENCE).alias("confidence"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, name, variant, inchikey, ref_key, truth)."""
    return truth_parts(spark, sf_dir).select(
        "item_id", F.expr("concat('part ', cast(truth_part as string))").alias("name"),
        F.expr(VARIANT).alias("variant"), F.expr(true_key("string")).alias("inchikey"),
        F.expr(ref_key("string")).alias("ref_key"), F.expr(TRUTH).alias("truth"),
    )


def refs(item_rows: DataFrame) -> DataFrame:
    """The claimed name's reference per item: (item_id, ref_no, name, inchikey)."""
    return item_rows.select("item_id", F.lit(0).alias("ref_no"), "name", F.col("ref_key").alias("inchikey"))


READS_SQL = f"""
l as (select l_orderkey as item_id, l_linenumber as read_no, min(l_partkey) as partkey,
             min(l_suppkey) as suppkey, max(l_discount) as disc
      from lineitem group by 1, 2),
t as (select item_id, min(partkey) as truth_part from l group by 1),
reads as (select item_id, read_no, {ENGINE} as engine, {RAW} as raw, {read_key('varchar')} as inchikey,
                 {CONFIDENCE} as confidence
          from l join t using (item_id)),
r as (select *, regexp_replace(engine, '[/@-].*$', '') as family, left(inchikey, 14) as skeleton,
             coalesce(confidence, -1) as conf
      from reads),
items as (select item_id, concat('part ', cast(truth_part as varchar)) as name, {VARIANT} as variant,
                 {true_key('varchar')} as inchikey, {ref_key('varchar')} as ref_key, {TRUTH} as truth
          from t)
"""


# Dictionary and pages ----------------------------------------------------------------------

WORD_KEY = "concat({0}, '-', {1}, 'SA-N')"


def words(spark: SparkSession, sf_dir: str, source: str = "benchmark", column: str = "text") -> DataFrame:
    """Distinct words of five letters and more."""
    found = F.explode(F.regexp_extract_all(F.lower(column), F.lit("([a-z]{5,})"), F.lit(1)))
    return table(spark, sf_dir, source).select(found.alias("w")).distinct()


def word_key(text: str) -> str:
    return f"concat({enc('substr(w, 1, 5)', 14, text)}, '-', {enc('w', 8, text)}, 'SA-N')"


# A formula-like string and an identifier number come with every word, so that joins carry them.
WORD_SMILES = "concat(repeat('C', cast(length(w) as int)), case when length(w) % 2 = 0 then 'N' else 'O' end)"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_key, inchikey, formula, smiles, iupac, title, cid); words of five equal letters share a skeleton."""
    return words(spark, sf_dir).select(
        F.col("w").alias("name_key"), F.expr(word_key("string")).alias("inchikey"), F.lit("").alias("formula"),
        F.expr(WORD_SMILES).alias("smiles"), F.lit("").alias("iupac"), F.upper("w").alias("title"),
        F.expr("cast(conv(substr(md5(w), 1, 8), 16, 10) as bigint)").alias("cid"),
    )


DICT_SQL = f"""
words as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) as w from benchmark),
dict as (select w as name_key, {word_key('varchar')} as inchikey, {WORD_SMILES} as smiles, upper(w) as title,
                cast(concat('0x', substr(md5(w), 1, 8)) as bigint) as cid
         from words)
"""


def with_cte(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + select
