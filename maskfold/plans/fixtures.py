"""Stand-in inputs built from the given tables.

Every view is one SQL text that Spark and any ANSI engine read alike; the few words that differ
between dialects are written {LIKE_THIS}. All coordinates and ids come from integer arithmetic, so both
sides rebuild the same rows. Object ids come from the row's own keys, so no window is needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

MODELS = ("m0", "m1", "m2")

SPARK_WORDS = {
    "MODEL_NO": "explode(array(0, 1, 2))",
    "CELLS": "explode(sequence(0, 63))",
    "AT": "element_at(embedding, pos + 1)",
    "K": "try_cast(get_json_object(props, '$.k') as bigint)",
    "SHA": "sha2(text, 256)",
    "WORDS": "size(split(text, ' '))",
    "DAY": "dayofmonth(ts)",
}
ANSI_WORDS = {
    "MODEL_NO": "unnest([0, 1, 2])",
    "CELLS": "unnest(range(0, 64))",
    "AT": "embedding[pos + 1]",
    "K": "try_cast(json_extract_string(props, '$.k') as bigint)",
    "SHA": "sha256(text)",
    "WORDS": "len(string_split(text, ' '))",
    "DAY": "day(ts)",
}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_scene": (
        (),
        """select o_orderkey as image_id, o_orderkey as sampleid,
       concat(cast(o_orderkey as string), '.0_', case when o_orderkey % 6 = 0 then '0' else '1' end, '.0.png') as filename,
       case when o_orderkey % 6 = 0 then 0 else 1 end as has_solar, 640 as width, 640 as height,
       8000000 + (o_custkey * 7919 + o_orderkey * 104729) % 30000000 + case when o_orderkey % 500 = 7 then 40000000 else 0 end as lat_e6,
       68000000 + (o_custkey * 6101 + o_orderkey * 15485863) % 30000000 as lon_e6,
       case when o_orderkey % 20 < 14 then 'train' when o_orderkey % 20 < 17 then 'val' else 'test' end as split,
       o_custkey % 145 as strip, o_orderpriority as category, o_custkey as custkey
from orders""",
    ),
    "fx_item": (
        (),
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (l_partkey * 10000000 + l_suppkey) * 8 + l_linenumber as idx,
       cast((l_partkey * 13) % 560 as int) as x0, cast((l_suppkey * 29 + l_linenumber * 83) % 560 as int) as y0,
       20 + cast(max(l_quantity) as int) as w, cast(20 + l_partkey % 40 as int) as h, max(l_returnflag) as flag
from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    ),
    "fx_gt": (
        ("fx_item", "fx_scene"),
        """select i.l_orderkey as image_id, i.idx as gt_idx, i.x0, i.y0, i.x0 + i.w as x1, i.y0 + i.h as y1,
       cast(i.w * i.h as bigint) as area
from fx_item i join fx_scene s on s.image_id = i.l_orderkey where s.has_solar = 1""",
    ),
    "fx_det": (
        ("fx_item", "fx_scene"),
        """select concat('m', cast(m as string)) as model, image_id, pred_idx, score_pct, x0, y0, x0 + w as x1, y0 + h as y1,
       cast(w * h as bigint) as area
from (
  select m, l_orderkey as image_id, 3 * idx as pred_idx,
         cast(50 + (l_partkey * 7 + l_suppkey * 3 + m * 11) % 51 as int) as score_pct,
         cast(x0 + (l_partkey * (m + 1)) % 9 as int) as x0, cast(y0 + (l_suppkey + m) % 7 as int) as y0, w, h
  from (select {MODEL_NO} as m, i.* from fx_item i join fx_scene s on s.image_id = i.l_orderkey where s.has_solar = 1) a
  where (l_partkey + l_linenumber + m) % 5 <> 0
  union all
  select m, l_orderkey as image_id, 3 * idx + 1 as pred_idx,
         cast(50 + (l_partkey * 3 + l_suppkey * 5 + m * 17) % 41 as int) as score_pct,
         (x0 + 300) % 560 as x0, (y0 + 200) % 560 as y0, w, h
  from (select {MODEL_NO} as m, i.* from fx_item i where i.flag = 'R') b
  where (l_partkey + m) % 4 = 0
  union all
  select m, l_orderkey as image_id, 3 * idx + 2 as pred_idx,
         cast(50 + (l_partkey * 5 + m * 7) % 51 as int) as score_pct, x0 + 3 as x0, y0 + 2 as y0, w, h
  from (select {MODEL_NO} as m, i.* from fx_item i join fx_scene s on s.image_id = i.l_orderkey where s.has_solar = 1) c
  where (l_partkey + l_suppkey) % 4 = 0
) t""",
    ),
    # 8 x 8 probability maps; the ground-truth bit is the sign of the same cell seven vectors later
    "fx_raster": (
        (),
        """select a.vec_id as image_id, cast(floor(a.pos / 8) as int) as y, cast(a.pos % 8 as int) as x,
       a.e * 10.0 as logit, round(1.0 / (1.0 + exp(-10.0 * a.e)), 6) as p,
       case when a.e >= 0 then 1 else 0 end as pred, case when b.e >= 0 then 1 else 0 end as gt, a.label as label
from (select vec_id, label, pos, later, cast({AT} as double) as e
      from (select vec_id, label, embedding, {CELLS} as pos, later from
            (select e.*, (vec_id + 7) % n as later from embeddings e cross join (select count(*) as n from embeddings) c) u) t) a
join (select vec_id, pos, cast({AT} as double) as e from (select vec_id, embedding, {CELLS} as pos from embeddings) t) b
  on b.vec_id = a.later and b.pos = a.pos""",
    ),
    "fx_image8": ((), "select vec_id as image_id, 8 as width, 8 as height from embeddings"),
    "fx_docs": (
        (),
        """select d.doc_id, d.text, {SHA} as sha, d.lang, d.source, d.n_chars, cast({WORDS} as bigint) as n_words,
       case when d.doc_id % 20 < 14 then 'train' when d.doc_id % 20 < 17 then 'val' else 'test' end as split,
       concat('doc_', cast(d.doc_id as string), '.png') as filename
from documents d""",
    ),
    # review table: one labelled candidate per detection of m0
    "fx_labelled": (
        ("fx_item", "fx_scene"),
        """select l_orderkey as image_id, idx as cand_id, cast((l_partkey % 4) as int) as label,
       cast((l_partkey + case when l_suppkey % 3 = 0 then 1 else 0 end) % 4 as int) as predicted,
       cast(l_suppkey % 5 as int) as fold,
       cast(50 + (l_partkey * 7 + l_suppkey * 3) % 51 as int) as score_pct,
       w, h, x0, y0, cast(w * h as bigint) as area
from fx_item""",
    ),
    "fx_history": (
        (),
        """select case when event_id % 10 = 9 then event_id - 1 else event_id end as rid, event_id as seq, ts as created,
       user_id, event_type, value,
       case when event_type = 'error' and event_id % 3 = 0 then 'delete' else 'put' end as op, {K} as k
from events""",
    ),
    "fx_geo": (
        (),
        """select p_partkey as image_id, cast(p_partkey % 6 as int) as kind, cast(10 + p_size as double) / 100 as sx, cast(12 + p_size as double) / 100 as sy
from part""",
    ),
    "fx_manual": (
        (),
        """select p_partkey as image_id,
       cast(case cast(p_partkey % 8 as int) when 0 then 0.25 when 1 then 1.0 when 2 then 1.0 when 3 then 0.5 when 4 then -1.0
            when 5 then 0.001 when 6 then 250.0 else null end as double) as gsd,
       case cast(p_partkey % 8 as int) when 2 then 'flight log 2024-03-11' when 3 then 'short' else null end as citation
from part""",
    ),
    "fx_irradiance": (
        (),
        """select c_custkey as custkey,
       case when c_custkey % 37 = 0 then cast(-999 as double) when c_custkey % 41 = 0 then cast(13 as double) else cast(30 + c_custkey % 40 as double) / 10 end as ann,
       case when c_custkey % 37 = 0 then cast(-999 as double) else cast(20 + c_custkey % 40 as double) / 10 end as jan,
       case when c_custkey % 11 = 0 then cast(-999 as double) else cast(40 + c_custkey % 40 as double) / 10 end as jul
from customer""",
    ),
    "fx_log": (
        (),
        "select event_type as run, cast({DAY} as int) as epoch, round(avg(value), 6) as val_loss from events group by event_type, cast({DAY} as int)",
    ),
    "fx_file": (
        (),
        """select doc_id, concat('/landing/', source, '/doc_', cast(doc_id as string),
              case when doc_id % 7 = 0 then '.gif' when doc_id % 7 = 1 then '.TIFF' when doc_id % 7 = 2 then '.jpg' else '.png' end) as path,
       case when doc_id % 13 = 0 then cast(0 as bigint) when doc_id % 17 = 0 then n_chars + 52428800 else n_chars end as length
from documents""",
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def _text(names: tuple[str, ...], words: dict[str, str]) -> str:
    parts = []
    for n in _needed(names):
        body = VIEWS[n][1]
        for k, v in words.items():
            body = body.replace("{" + k + "}", v)
        parts.append(f"{n} as (\n{body}\n)")
    return ",\n".join(parts)


def ansi(names: str, body: str) -> str:
    """Oracle text: the named views as CTEs in front of `body` (which may start with its own CTEs)."""
    ctes = _text(tuple(names.split()), ANSI_WORDS)
    body = body.strip()
    if not ctes:
        return body
    low = body.lower()
    if low.startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if low.startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"


_plans: dict[tuple[str, str, str], DataFrame] = {}
_sizes: dict[tuple[str, str, str], int] = {}

#: rows of a table in one partition of a view: what a task holds does not grow with the table
ROWS_PER_TASK = 100_000


class Inputs:
    """The given tables and the stand-in views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def _once(self, name: str, make) -> DataFrame:
        # plans only: reading a footer and analysing a view is not repeated within a session
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _plans:
            _plans[key] = make()
        return _plans[key]

    def parts(self, name: str) -> int:
        """Partitions for a shuffle of a given table, by its rows (footers only); a task for each core at least."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _sizes:
            _sizes[key] = self.table(name).count()
        return max(self.spark.sparkContext.defaultParallelism, -(-_sizes[key] // ROWS_PER_TASK))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        return self._once(name, lambda: self._view(name))

    def _view(self, name: str) -> DataFrame:
        if name in FORMS:
            return FORMS[name](self)
        return self.sql_view(name)

    def sql_view(self, name: str) -> DataFrame:
        """The view as its SQL text says."""
        text = _text((name,), SPARK_WORDS)
        for t in TABLES:
            if t in text:
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(f"with {text}\nselect * from {name}")


ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _items(t: Inputs, flag: Column | None = None) -> DataFrame:
    """fx_item dealt by order, so whatever is done per image afterwards needs no further shuffle. `flag` in place of the highest letter.

    The number of partitions follows the table: left to the engine, a few partitions would grow with it.
    """
    c = F.col
    rows = t.lineitem.select(*ITEM, "l_quantity", "l_returnflag").repartition(t.parts("lineitem"), "l_orderkey")
    rows = rows.groupBy(*ITEM).agg((F.lit(20) + F.max("l_quantity").cast("int")).alias("w"), (F.max("l_returnflag") if flag is None else flag).alias("flag"))
    return rows.select(
        *ITEM, ((c("l_partkey") * 10000000 + c("l_suppkey")) * 8 + c("l_linenumber")).alias("idx"),
        ((c("l_partkey") * 13) % 560).cast("int").alias("x0"), ((c("l_suppkey") * 29 + c("l_linenumber") * 83) % 560).cast("int").alias("y0"),
        "w", (20 + c("l_partkey") % 40).cast("int").alias("h"), "flag",
    )


def _dets(t: Inputs) -> DataFrame:
    """fx_det with one reading of the items: each stands for up to three detections a model, of the kinds 0, 1 and 2 of the text."""
    # 1 if the highest letter is R: numbers are summed up without a sort
    top = F.max(F.expr("case when l_returnflag > 'R' then 2 when l_returnflag = 'R' then 1 else 0 end"))
    scenes = t.orders.where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("l_orderkey")).repartition(t.parts("lineitem"), "l_orderkey")
    scenes = scenes.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    each = _items(t, top).join(scenes, "l_orderkey", "left")
    each = each.select("*", F.explode(F.array(*[F.lit(m) for m in range(3)])).alias("m"))
    each = each.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("kind"))
    times = F.expr(
        """case kind when 0 then if((l_partkey + l_linenumber + m) % 5 <> 0, n, 0) when 1 then if(flag = 1 and (l_partkey + m) % 4 = 0, 1, 0)
        else if((l_partkey + l_suppkey) % 4 = 0, n, 0) end"""
    )
    each = each.withColumn("times", times).where("times > 0")
    rows = each.select("*", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).selectExpr(
        "concat('m', cast(m as string)) as model", "l_orderkey as image_id", "3 * idx + kind as pred_idx",
        """cast(case kind when 0 then 50 + (l_partkey * 7 + l_suppkey * 3 + m * 11) % 51 when 1 then 50 + (l_partkey * 3 + l_suppkey * 5 + m * 17) % 41
        else 50 + (l_partkey * 5 + m * 7) % 51 end as int) as score_pct""",
        "cast(case kind when 0 then x0 + (l_partkey * (m + 1)) % 9 when 1 then (x0 + 300) % 560 else x0 + 3 end as int) as x0",
        "cast(case kind when 0 then y0 + (l_suppkey + m) % 7 when 1 then (y0 + 200) % 560 else y0 + 2 end as int) as y0", "w", "h",
    )
    return rows.selectExpr("model", "image_id", "pred_idx", "score_pct", "x0", "y0", "x0 + w as x1", "y0 + h as y1", "cast(w * h as bigint) as area")


def _gts(t: Inputs) -> DataFrame:
    c = F.col
    scenes = t.orders.where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.fx_item.join(scenes, "l_orderkey").select(
        c("l_orderkey").alias("image_id"), c("idx").alias("gt_idx"), "x0", "y0", (c("x0") + c("w")).alias("x1"), (c("y0") + c("h")).alias("y1"),
        (c("w") * c("h")).cast("bigint").alias("area"),
    )


#: views that Spark builds with fewer shuffles than their text; the rows are those of the text (a test holds them to it)
FORMS = {"fx_item": _items, "fx_gt": _gts, "fx_det": _dets}


def sql_half_even(x: str, places: int) -> str:
    """Twin of `half_even` as one SQL expression."""
    k = float(10**places)
    return (
        f"list_transform(list_transform([cast({x} as double)], lambda v: {{'v': v, 'p': v * {k}::double, 'h': (v * 134217729.0::double) - ((v * 134217729.0::double) - v)}}), "
        f"lambda s: (floor(s.p) + case when s.p - floor(s.p) > 0.5 or (s.p - floor(s.p) = 0.5 and ((s.h * {k}::double - s.p) + (s.v - s.h) * {k}::double > 0 "
        f"or ((s.h * {k}::double - s.p) + (s.v - s.h) * {k}::double = 0 and floor(s.p) % 2 <> 0))) then 1 else 0 end) / {k}::double)[1]"
    )
