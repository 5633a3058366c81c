"""Page elements: texts, figures and drawing regions; stored readings and dictionary files."""

from __future__ import annotations

from pyspark.sql import functions as F

from structaudit.functions import boxes as bx
from structaudit.operators import figures as fg
from structaudit.plans import derived as d
from structaudit.plans.derived import DICT_SQL, READS_SQL, with_cte
from structaudit.sources.readers import dictionary_rows, replay_rows
from structaudit.sources.writers import replay_items

QUERIES, SQL = {}, {}


def query(name, sql=None, *ctes):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_cte(*ctes, select=sql) if ctes else sql
        return fn

    return register


@query(
    "page_text",
    """select conv_id % 10 as deck, conv_id as page, turn as part, regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as text
    from (select *, case when turn % 3 = 2 then chr(10) || chr(9) else chr(10) || ' ' || text || chr(9) || chr(10) end as t from conversations)
    where regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> ''""",
)
def page_text(spark, sf):
    elements = d.table(spark, sf, "conversations").select(
        (F.col("conv_id") % 10).alias("deck"), F.col("conv_id").alias("page"), F.col("turn").alias("pos"),
        F.when(F.col("turn") % 3 == 2, "\n\t").otherwise(F.concat(F.lit("\n "), "text", F.lit("\t\n"))).alias("text"),
    )
    return fg.page_text(elements)


PICTURES_SQL = """
pictures as (select source as deck, cast(doc_id // 5 as int) as page, cast(doc_id % 5 as int) as pos, n_chars * 9 as n_bytes, text,
                    case when doc_id % 11 = 0 then null else n_chars % 700 + 20 end as px_w, case when doc_id % 11 = 0 then null else n_chars % 500 + 20 end as px_h from documents),
kept as (select deck, page, pos, sha256(text) as digest, row_number() over (partition by deck, page order by pos) as number
         from pictures where n_bytes >= 4096 and coalesce(least(px_w, px_h) >= 80, true)),
on_pages as (select deck, digest, page, min(pos) as pos, arg_min(number, pos) as number from kept group by 1, 2, 3)
"""


def pictures(spark, sf):
    return d.table(spark, sf, "documents").selectExpr(
        "source as deck", "cast(doc_id div 5 as int) as page", "cast(doc_id % 5 as int) as pos", "n_chars * 9 as n_bytes",
        "case when doc_id % 11 = 0 then null else n_chars % 700 + 20 end as px_w",
        "case when doc_id % 11 = 0 then null else n_chars % 500 + 20 end as px_h", "cast(text as binary) as content",
    )


@query("page_figures", "select * from on_pages", PICTURES_SQL)
def page_figures(spark, sf):
    return fg.page_figures(pictures(spark, sf))


@query(
    "figures",
    """select deck, digest, printf('s%03d_%02d', arg_min(page, page)::bigint, arg_min(number, page)::bigint) as name, min(page) as first_page, arg_min(pos, page) as first_pos, count(*) as n_pages
    from on_pages group by 1, 2""",
    PICTURES_SQL,
)
def figures(spark, sf):
    return fg.figures(fg.page_figures(pictures(spark, sf)))


# Boxes: an order's lines are strokes on a page of letter size, pages hold four orders.
BOX = {
    "deck": "cast(l_orderkey % 9 as int)", "page": "cast(floor(l_orderkey / 36) as int)", "pos": "l_linenumber",
    "kind": "case l_suppkey % 7 when 0 then 'raster' when 1 then 'rect' when 2 then 'curve' else 'line' end",
    "x0": "cast(l_partkey * 7 % 500 as double)", "y0": "cast(l_partkey * 13 % 650 as double)",
    "x1": "cast(l_partkey * 7 % 500 as double) + l_quantity + 5", "y1": "cast(l_partkey * 13 % 650 as double) + l_suppkey % 50 + 3",
    "weight": "cast(l_quantity as int)",
}


def boxes(spark, sf):
    return d.table(spark, sf, "lineitem").selectExpr(*[f"{sql} as {name}" for name, sql in BOX.items()])


NEAR_SQL = "placed as (select l_orderkey * 8 + l_linenumber as box_id, " + ", ".join(f"{BOX[n]} as {n}" for n in ("deck", "page", "x0", "y0", "x1", "y1")) + (
    " from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity from lineitem group by 1, 2))"
)


@query(
    "near_boxes",
    """select a.deck, a.page, a.box_id, count(b.box_id) as n_near, arg_min(b.box_id, row(distance, b.box_id)) as nearest, round(min(distance), 9) as distance
    from placed a left join lateral (
      select box_id, sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2)) as distance
      from placed b where a.deck = b.deck and a.page = b.page and a.box_id <> b.box_id
        and a.x0 - 12 <= b.x1 and b.x0 - 12 <= a.x1 and a.y0 - 12 <= b.y1 and b.y0 - 12 <= a.y1) b on true
    group by a.deck, a.page, a.box_id""",
    NEAR_SQL,
)
def near_boxes(spark, sf):
    # A line number may occur twice in an order; as elsewhere it is one line then.
    lines = d.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    rows = lines.selectExpr("l_orderkey * 8 + l_linenumber as box_id", *[f"{BOX[n]} as {n}" for n in ("deck", "page", "x0", "y0", "x1", "y1")])
    return fg.near_boxes(rows).withColumn("distance", F.round("distance", 9))


BOXES_SQL = "boxes as (select *, row_number() over () as unused from (select " + ", ".join(f"{s} as {n}" for n, s in BOX.items()) + ", l_extendedprice as price from lineitem))"


# Each round a box grows over all that is near it, until no box of its layer has grown.
GROWN_SQL = """
drawn as (select *, row_number() over (partition by deck, page, layer) as id from (
  select deck, page, x0, y0, x1, y1, case kind when 'raster' then 'raster' else 'vector' end as layer,
         case kind when 'raster' then 1 when 'line' then 2 else weight end as weight from boxes where kind in ('raster', 'line', 'curve'))),
grown(round, deck, page, layer, id, weight, x0, y0, x1, y1, moved) as (
  select 0, deck, page, layer, id, weight, x0, y0, x1, y1, true from drawn
  union all
  select a.round + 1, a.deck, a.page, a.layer, a.id, a.weight, min(b.x0), min(b.y0), max(b.x1), max(b.y1),
         max((min(b.x0) < a.x0 or min(b.y0) < a.y0 or max(b.x1) > a.x1 or max(b.y1) > a.y1)::int) over (partition by a.deck, a.page, a.layer) = 1
  from grown a join grown b on a.deck = b.deck and a.page = b.page and a.layer = b.layer
       and a.x0 - 12 <= b.x1 and b.x0 - 12 <= a.x1 and a.y0 - 12 <= b.y1 and b.y0 - 12 <= a.y1
  where a.moved group by a.round, a.deck, a.page, a.layer, a.id, a.weight, a.x0, a.y0, a.x1, a.y1),
merged as (
  select deck, page, layer, x0, y0, x1, y1, sum(weight)::bigint as weight from grown where not moved group by all)
"""


@query(
    "drawing_regions",
    """select *, row_number() over (partition by deck, page order by x0, y0, x1, y1, layer) as region_no
    from merged where x1 - x0 >= 40 and y1 - y0 >= 40 and (layer = 'raster' or weight >= 6)""",
    "recursive " + BOXES_SQL, GROWN_SQL,
)
def drawing_regions(spark, sf):
    return fg.cluster_regions(boxes(spark, sf))


@query(
    "box_columns",
    """select deck, page, x0, y0, x1, y1, price, x0 - 12 <= 300 and 200 - 12 <= x1 and y0 - 12 <= 400 and 250 - 12 <= y1 as near,
    x1 - x0 >= 40 and y1 - y0 >= 40 as big, least(x0, 200) as merged_x0, greatest(y1, 400) as merged_y1,
    case when least(612, x1 + 6) > greatest(0, x0 - 6) and least(500, y1 + 6) > greatest(0, y0 - 6) then least(500, y1 + 6) end as padded_y1,
    round((1 - y1 / 1000) * 792, 6) as point_y0, round((x0 + 10) / 914400 , 12) as fraction_x1 from boxes""",
    BOXES_SQL,
)
def box_columns(spark, sf):
    rows = d.table(spark, sf, "lineitem").selectExpr(
        *[f"{sql} as {name}" for name, sql in BOX.items() if name not in ("kind", "pos", "weight")], "l_extendedprice as price"
    )
    lit = lambda v: F.lit(float(v))
    box = F.struct("x0", "y0", "x1", "y1")
    other = bx.box(lit(200), lit(250), lit(300), lit(400))
    fraction = bx.box(*[F.col(c) / 1000.0 for c in ("x0", "y0", "x1", "y1")])
    extent = bx.extent_to_fraction(F.col("x0"), F.col("y0"), lit(10), lit(10), lit(914400), lit(685800))
    return rows.select(
        "*", bx.is_near(box, other).alias("near"), bx.big_enough(box).alias("big"),
        bx.merged(box, other)["x0"].alias("merged_x0"), bx.merged(box, other)["y1"].alias("merged_y1"),
        bx.padded(box, lit(612), lit(500))["y1"].alias("padded_y1"),
        F.round(bx.fraction_to_points(fraction, lit(612), lit(792))["y0"], 6).alias("point_y0"),
        F.round(extent["x1"], 12).alias("fraction_x1"),
    )


SHAPES_SQL = """
shapes as (select cast(l_orderkey % 9 as int) as deck, cast(floor(l_orderkey / 18) as int) as page,
             case when l_orderkey % 3 = 0 then null else cast(l_orderkey as varchar) end as group_id,
             case when l_linenumber = 1 and l_orderkey % 3 <> 0 then 'group' when l_linenumber = 7 then 'picture' else 'shape' end as kind,
             case l_partkey % 10 when 0 then 'label' when 1 then chr(10) when 2 then chr(9) || ' ' else '' end as text,
             cast(l_partkey % 100 as double) as x0, cast(l_suppkey % 90 as double) as y0, cast(l_partkey % 100 as double) + l_quantity as x1, cast(l_suppkey % 90 as double) + l_quantity as y1
           from lineitem)
"""


@query(
    "shape_regions",
    """select deck, page, group_id, count(*) filter (where shape) as part_count, min(x0) filter (where edge) as x0, min(y0) filter (where edge) as y0,
      max(x1) filter (where edge) as x1, max(y1) filter (where edge) as y1, group_id is not null as grouped
    from (select *, kind = 'shape' and trim(text, ' ' || chr(9) || chr(10)) = '' as shape, case when group_id is null then kind = 'shape' and trim(text, ' ' || chr(9) || chr(10)) = '' else kind = 'group' end as edge from shapes)
    group by 1, 2, 3 having count(*) filter (where shape) >= 3 and count(*) filter (where edge) > 0""",
    SHAPES_SQL,
)
def shape_regions(spark, sf):
    elements = d.table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey % 9 as int) as deck", "cast(floor(l_orderkey / 18) as int) as page",
        "case when l_orderkey % 3 = 0 then null else cast(l_orderkey as string) end as group_id",
        "case when l_linenumber = 1 and l_orderkey % 3 <> 0 then 'group' when l_linenumber = 7 then 'picture' else 'shape' end as kind",
        "case l_partkey % 10 when 0 then 'label' when 1 then '\\n' when 2 then '\\t ' else '' end as text",
        "cast(l_partkey % 100 as double) as x0", "cast(l_suppkey % 90 as double) as y0",
        "cast(l_partkey % 100 as double) + l_quantity as x1", "cast(l_suppkey % 90 as double) + l_quantity as y1",
    )
    return fg.shape_regions(elements, min_shapes=3)


# Stored forms ------------------------------------------------------------------------------


@query(
    "stored_replay",
    """select item_id, cast(read_no as int) as read_no,
    name, variant, i.inchikey as true_key, engine, raw, r.inchikey, round(confidence, 4) as confidence from items i join r using (item_id)""",
    READS_SQL,
)
def stored_replay(spark, sf):
    items = d.items(spark, sf).select("item_id", "name", "variant", "inchikey")
    first = d.reads(spark, sf)
    return replay_rows(replay_items(first, items))


@query(
    "dictionary_from_json", "select name_key, inchikey, title, cid from dict", DICT_SQL,
)
def dictionary_from_json(spark, sf):
    record = F.struct("inchikey", "formula", "smiles", "iupac", "title", "cid")
    text = F.to_json(F.struct(F.create_map(F.upper("name_key"), record).alias("entries")))
    rows = d.dictionary(spark, sf).select(text.alias("value")).select(dictionary_rows(F.col("value")).alias("name", "record"))
    return rows.select(F.lower("name").alias("name_key"), "record.inchikey", "record.title", "record.cid")
