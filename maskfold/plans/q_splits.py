"""Queries on splits, folds and leakage audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue, leakage, splits
from .materialise import materialise
from .registry import query

ANN = "ann as (select s.*, count(g.gt_idx) as annotation_count from fx_scene s left join fx_gt g on g.image_id = s.image_id group by all)"


def annotated(t):
    per = t.fx_gt.groupBy("image_id").agg(F.count("*").alias("annotation_count"))
    return t.fx_scene.join(per, "image_id", "left").withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0).cast("bigint")))


def h(key: str, seed: int) -> str:
    return f"md5(concat('{seed}|', cast({key} as string)))"


@query("g1_locked_split", "fx_scene fx_gt", "with " + ANN + f""",
k as (select image_id, case when has_solar = 1 and image_id % 50 = 7 then 'positive_unannotated' when has_solar = 1 and annotation_count = 0 then 'zero_annotation' when has_solar = 1 and split = 'test' then 'protected' when has_solar = 1 then 'positive_annotated' else 'negative' end as kind from ann),
p as (select *, row_number() over (partition by kind order by {h('image_id', 42)}, image_id) as pos, count(*) over (partition by kind) as n from k)
select image_id, case kind when 'zero_annotation' then 'excluded' when 'positive_unannotated' then 'excluded' when 'protected' then 'test' when 'positive_annotated' then case when pos <= floor(n * 0.1) then 'val' else 'train' end
  else case when pos <= floor(n * 0.64) then 'train' when pos <= floor(n * 0.64) + floor(n * 0.16) then 'val' else 'test' end end as split,
  case when kind = 'protected' then 'positive_annotated' else kind end as dataset_type from p""")
def _(t):
    # every fiftieth scene counts as never annotated
    count = F.when(F.col("image_id") % 50 != 7, F.col("annotation_count"))
    s = annotated(t).select("image_id", "has_solar", "split", count.alias("annotation_count"))
    protected = s.where("has_solar = 1 and split = 'test' and annotation_count > 0").select("image_id")
    s = s.drop("split")
    return splits.locked_split(s, protected, "image_id", 0.1, (0.64, 0.16)).select("image_id", "split", "dataset_type")


@query("g2_fraction_split", "fx_scene", f"""with p as (select image_id, row_number() over (order by {h('image_id', 7)}, image_id) as pos, count(*) over () as n from fx_scene)
select image_id, case when pos <= floor(n * 0.7) then 'train' when pos <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from p""")
def _(t):
    return splits.fraction_split(t.fx_scene.select("image_id"), "image_id", seed=7)


GS = f"""c as (select strip, count(*) as n from fx_scene group by strip),
o as (select *, row_number() over (order by {h('strip', 830)}, strip) as rn from c), tot as (select cast(count(*) as double) as t from fx_scene),
w(rn, strip, a, b, c, pick) as (select cast(0 as bigint), cast(null as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), -1
  union all select o.rn, o.strip, a + case when p = 0 then q.n else 0 end, b + case when p = 1 then q.n else 0 end, c + case when p = 2 then q.n else 0 end, p
  from (select w.*, o.rn as orn, o.strip as ostrip, o.n, case when a / (t * 0.7::double) <= b / (t * 0.15::double) and a / (t * 0.7::double) <= c / (t * 0.15::double) then 0 when b / (t * 0.15::double) <= c / (t * 0.15::double) then 1 else 2 end as p
        from w join o on o.rn = w.rn + 1 cross join tot) q join o on o.rn = q.orn)
"""


@query("g3_group_split", "fx_scene", "with recursive " + GS + "select s.image_id, s.strip, case w.pick when 0 then 'train' when 1 then 'val' else 'test' end as split from fx_scene s join w on w.strip = s.strip")
def _(t):
    return splits.group_split(t.fx_scene.select("image_id", "strip"), "strip").select("image_id", "strip", "split")


@query("g3_group_split_hashed", "fx_scene", f"""with b as (select image_id, strip, cast('0x' || substr({h('strip', 830)}, 1, 8) as bigint) % 10000 as b from fx_scene)
select image_id, strip, case when b < 7000 then 'train' when b < 8500 then 'val' else 'test' end as split from b""")
def _(t):
    return splits.group_split_hashed(t.fx_scene.select("image_id", "strip"), "strip")


#: the library's dealing, position by position
DEALT = "rn % 2147483648 * 1327217885 % 2147483648"


@query("g3_group_split_dealt", "fx_labelled", f"""with c as (select image_id, count(*) as n from fx_labelled group by 1), o as (select *, row_number() over (order by n, {h('image_id', 830)}, image_id) as rn from c)
select image_id, n, case when {DEALT} < cast(floor(2147483648 * 0.7::double) as bigint) then 'train' when {DEALT} < cast(floor(2147483648 * 0.85::double) as bigint) then 'val' else 'test' end as split from o""")
def _(t):
    return splits.group_split(t.fx_labelled.select("image_id"), "image_id", turns=0).groupBy("image_id", "split").agg(F.count("*").alias("n"))


@query("g4_pilot_sample", "fx_scene fx_gt", "with " + ANN + f"select image_id from ann where has_solar = 1 and annotation_count > 0 and split <> 'test' order by {h('image_id', 42)}, image_id limit 100")
def _(t):
    ok = annotated(t).where("has_solar = 1 and annotation_count > 0").select("image_id")
    return splits.pilot_sample(ok, t.fx_scene.where("split = 'test'"), "image_id", 100)


@query("g5_stratified_kfold", "fx_labelled", f"""select image_id, cand_id, label, cast((row_number() over (partition by label order by {h('cand_id', 42).replace('cast(cand_id as string)', "concat(cast(image_id as string), '|', cast(cand_id as string))")}, image_id, cand_id) - 1) % 5 as int) as fold from fx_labelled""")
def _(t):
    return splits.stratified_kfold(t.fx_labelled.select("image_id", "cand_id", "label"), "label", ["image_id", "cand_id"])


COUNTS = "array[" + ", ".join(f"count(*) filter (where label = {v})" for v in range(4)) + "]"


def fold_walk(k: int, c: int) -> str:
    """SQL that walks groups one by one: s holds k x c loads, each group goes to the fold of the least cost."""
    def cost(fold: int) -> str:
        spread = []
        for ci in range(1, c + 1):
            share = [f"((s[{f * c + ci}] + {f'n[{ci}]' if f == fold else 0}) / cast(tot[{ci}] as double))" for f in range(k)]
            mean = f"(({' + '.join(share)}) / {k})"
            spread.append("sqrt((" + " + ".join(f"({v} - {mean}) * ({v} - {mean})" for v in share) + f") / {k})")
        return f"{{'c': round(({' + '.join(spread)}) / {c}, 12), 'z': list_sum(s[{fold * c + 1} : {fold * c + c}]), 'f': {fold}}}"

    new = "[" + ", ".join(f"s[{f * c + ci}] + case when fold = {f} then n[{ci}] else 0 end" for f in range(k) for ci in range(1, c + 1)) + "]"
    return f"""w(rn, g, fold, s) as (select cast(0 as bigint), cast(null as bigint), -1, list_transform(range({k * c}), lambda i: cast(0 as bigint))
  union all select rn, g, fold, {new} from (select o.rn, o.g, o.n, w.s, list_min([{', '.join(cost(f) for f in range(k))}]).f as fold from w join o on o.rn = w.rn + 1) q)"""


UNEVEN = "round(list_sum(list_transform(n, lambda v: (v - list_sum(n) / cast(4.0 as double)) * (v - list_sum(n) / cast(4.0 as double)))), 6)"
#: the largest 5,000 groups in turn, the others dealt in the shares of what the folds lack
FOLDS = f"""p as (select g, {COUNTS} as n from l group by 1), tot as (select {COUNTS} as tot from l),
big as (select p.* from p cross join tot order by greatest({", ".join(f"n[{i}] / cast(tot[{i}] as double)" for i in range(1, 5))}) desc, {h('g', 42)}, g limit 5000),
o as materialized (select big.*, tot, row_number() over (order by {UNEVEN} desc, {h('g', 42)}, g) as rn from big cross join tot),
{fold_walk(4, 4)},
lack as (select fold, (select {" + ".join(f"greatest(0.0, 0.25 - w.s[f.fold * 4 + {i}] / cast(tot[{i}] as double))" for i in range(1, 5))} from w, tot where rn = (select max(rn) from w)) as v from (select unnest(range(4)) as fold) f),
ends as (select fold, cast(floor(2147483648 * case when sum(v) over () > 0 then sum(v) over (order by fold) / sum(v) over () else (fold + 1) * 0.25 end) as bigint) as e from lack),
small as (select g, row_number() over (order by n, {h('g', 42)}, g) as rn from p where g not in (select g from big)),
folds as (select g, fold from w where rn > 0 union all select g, cast((select count(*) from ends where fold < 3 and e <= {DEALT}) as int) from small)"""


@query("g6_stratified_group_kfold", "fx_labelled", f"with recursive l as (select image_id as g, label from fx_labelled), {FOLDS} select folds.fold, label, count(*) as n from l join folds using (g) group by 1, 2")
def _(t):
    folds = splits.stratified_group_kfold(t.fx_labelled.select("image_id", "cand_id", "label"), "label", "image_id")
    return folds.groupBy("fold", "label").agg(F.count("*").alias("n"))


@query("g6_stratified_group_kfold_strips", "fx_labelled fx_scene", f"with recursive l as (select s.strip as g, f.label from fx_labelled f join fx_scene s on s.image_id = f.image_id), {FOLDS} select g as strip, fold from folds")
def _(t):
    rows = t.fx_labelled.select("image_id", "label").join(t.fx_scene.select("image_id", "strip"), "image_id")
    return splits.stratified_group_kfold(rows, "label", "strip").select("strip", "fold").distinct()


@query("g6_stratified_group_kfold_dealt", "fx_labelled", f"""with g as (select image_id, {COUNTS} as n from fx_labelled group by 1), o as (select *, row_number() over (order by n, {h('image_id', 42)}, image_id) as rn from g)
select image_id, cast(({DEALT}) // 536870912 as int) as fold from o""")
def _(t):
    return splits.stratified_group_kfold(t.fx_labelled.select("image_id", "label"), "label", "image_id", turns=0).select("image_id", "fold").distinct()


HARD = "hard as (select distinct d.image_id from fx_det d join fx_scene s on s.image_id = d.image_id where s.has_solar = 0 and s.split = 'train' and d.model = 'm0' and d.score_pct >= 75)"


def hard_names(t):
    neg = t.fx_scene.where("has_solar = 0 and split = 'train'")
    hit = t.fx_det.where("model = 'm0' and score_pct >= 75").select("image_id").distinct()
    return neg.join(hit, "image_id", "left_semi").select("filename")


@query("g7_replay_manifest", "fx_scene fx_det", "with " + HARD + """select filename, 'positive' as source, 0 as replay from fx_scene where has_solar = 1 and split = 'train'
union all select filename, 'negative', 0 from fx_scene where has_solar = 0 and split = 'train' union all select filename, 'hard_negative_replay', 1 from fx_scene s join hard h on h.image_id = s.image_id""")
def _(t):
    train = t.fx_scene.where("split = 'train'")
    return splits.replay_manifest(train.where("has_solar = 1"), train.where("has_solar = 0"), hard_names(t))


@query("g8_balanced_interleave", "fx_scene", """with a as (select image_id, row_number() over (order by image_id) - 1 as i, count(*) over () as n from fx_scene where has_solar = 1),
b as (select image_id, row_number() over (order by image_id) - 1 as i, count(*) over () as n from fx_scene where has_solar = 0), m as (select greatest((select count(*) from a), (select count(*) from b)) as m),
s as (select unnest(range(0, 2 * m)) as position from m)
select s.position, 'a' as domain, a.image_id from s join a on s.position % 2 = 0 and (s.position // 2) % a.n = a.i union all
select s.position, 'b', b.image_id from s join b on s.position % 2 = 1 and (s.position // 2) % b.n = b.i""")
def _(t):
    return splits.balanced_interleave(t.fx_scene.where("has_solar = 1"), t.fx_scene.where("has_solar = 0"), "image_id")


@query("g9_seeded_shuffle", "fx_scene", f"select image_id, row_number() over (order by {h('image_id', 42)}, image_id) as shuffle_pos from fx_scene")
def _(t):
    return splits.seeded_shuffle(t.fx_scene.select("image_id"), "image_id")


@query("p13_tag_split", "fx_scene", "select split, case when has_solar = 1 then 'positive_annotated' else 'negative' end as dataset_type, count(*) as n from fx_scene group by 1, 2")
def _(t):
    kind = F.when(F.col("has_solar") == 1, "positive_annotated").otherwise("negative")
    return splits.tag(t.fx_scene, F.col("split"), kind).groupBy("split", "dataset_type").agg(F.count("*").alias("n"))


@query("p14_require_columns", "fx_scene", "select count(*) as n from fx_scene")
def _(t):
    return catalogue.require_columns(t.fx_scene, ["image_id", "filename", "split"]).agg(F.count("*").alias("n"))


@query("u1_union_tagged", "fx_scene fx_gt", "with " + ANN + "select filename, annotation_count, 'positive' as source from ann where has_solar = 1 union all select filename, null, 'negative' from fx_scene where has_solar = 0")
def _(t):
    pos = annotated(t).where("has_solar = 1").select("filename", "annotation_count", F.lit("positive").alias("source"))
    return splits.union_tagged(pos, t.fx_scene.where("has_solar = 0").select("filename", F.lit("negative").alias("source")))


@query("u2_overlap_gate", "fx_scene", "select strip, min(split) as first_split, max(split) as last_split, count(*) as n from fx_scene group by strip having min(split) <> max(split)")
def _(t):
    return splits.overlap(t.fx_scene, "strip")


@query("u3_cross_split_audit", "fx_scene", "select (select count(*) from fx_scene where split = 'test') as test_rows, count(*) as in_other_train from (select image_id from fx_scene where split = 'test' intersect select image_id from fx_scene where custkey % 3 > 0) q")
def _(t):
    test = t.fx_scene.where("split = 'test'").select("image_id")
    shared = test.intersect(t.fx_scene.where("custkey % 3 > 0").select("image_id"))
    return test.agg(F.count("*").alias("test_rows")).join(F.broadcast(shared.agg(F.count("*").alias("in_other_train"))))


@query("u5_coverage_gate", "fx_scene fx_gt", """select 'missing' as side, image_id from fx_scene s where has_solar = 1 and not exists (select 1 from fx_gt g where g.image_id = s.image_id)
union all select 'unknown', image_id from (select distinct image_id from fx_gt) g where not exists (select 1 from fx_scene s where s.image_id = g.image_id and s.has_solar = 1)""")
def _(t):
    missing, unknown = splits.coverage_gate(t.fx_scene.where("has_solar = 1"), t.fx_gt.select("image_id").distinct(), "image_id")
    return missing.select(F.lit("missing").alias("side"), "image_id").unionAll(unknown.select(F.lit("unknown").alias("side"), "image_id"))


@query("j4_in_list", "fx_scene", "select case when split = 'test' then 'protected' else 'rest' end as part, count(*) as n from fx_scene group by 1")
def _(t):
    inside, rest = splits_protect(t)
    return inside.agg(F.count("*").alias("n")).select(F.lit("protected").alias("part"), "n").unionAll(rest.agg(F.count("*").alias("n")).select(F.lit("rest").alias("part"), "n"))


def splits_protect(t):
    return catalogue.protect(t.fx_scene, t.fx_scene.where("split = 'test'"), "filename")


@query("j5_one_to_one_join", "fx_scene fx_det", """select s.image_id as sampleid, count(d.image_id) as n_files from fx_scene s
  left join (select distinct image_id, model from fx_det) d on d.image_id = s.image_id group by 1""")
def _(t):
    files = t.fx_det.select(F.col("image_id").alias("sampleid"), F.col("model").alias("filename")).distinct()
    good, bad = catalogue.join_exactly_one(t.fx_scene.select(F.col("image_id").alias("sampleid")), files)
    return good.select("sampleid", F.lit(1).cast("bigint").alias("n_files")).unionAll(bad.select("sampleid", "n_files"))


@query("j5_offending_files", "fx_scene fx_det", """with f as (select distinct image_id, model from fx_det), n as (select image_id, count(*) as n from f group by 1)
select s.image_id as sampleid, coalesce(n.n, 0) as n_files, f.model as filename from fx_scene s left join n using (image_id) left join f using (image_id) where coalesce(n.n, 0) <> 1""")
def _(t):
    files = t.fx_det.select(F.col("image_id").alias("sampleid"), F.col("model").alias("filename")).distinct()
    files = materialise(files, "files")  # read twice
    _, bad = catalogue.join_exactly_one(t.fx_scene.select(F.col("image_id").alias("sampleid")), files)
    return catalogue.files_of(bad, files)


@query("j25_leak_guard", "fx_scene fx_det", """with mined as (select filename, split from fx_scene s where has_solar = 0 and exists (select 1 from fx_det d where d.image_id = s.image_id and d.score_pct >= 75))
select filename, 'not_in_train' as violation from mined where split <> 'train' union all select filename, 'in_test' from mined where split = 'test'""")
def _(t):
    s = t.fx_scene
    mined = s.where("has_solar = 0").join(t.fx_det.where("score_pct >= 75").select("image_id").distinct(), "image_id", "left_semi").select("filename")
    return splits.leak_guard(mined, s.where("split = 'train'"), s.where("split = 'test'"))


@query("a30_duplicate_gate", "", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(t):
    return catalogue.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


CATS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("a33_split_summary", "fx_scene", "select split, count(*) as images, count(distinct strip) as strips, round(count(*) / (select count(*) from fx_scene) * 100.0, 4) as percent, "
       + ", ".join(f"count(*) filter (where category = '{c}') as \"{c}\"" for c in CATS) + " from fx_scene group by split")
def _(t):
    return splits.split_summary(t.fx_scene, categories=CATS)


@query("a34_set_fingerprint", "fx_scene", """with ids as (select distinct split, cast(filename as string) as id, substr(sha256(filename), 1, 3) as b from fx_scene),
l0 as (select split, b, sha256(string_agg(id, chr(10) order by id)) as g from ids group by 1, 2),
l1 as (select split, substr(b, 1, 2) as c, sha256(string_agg(g, chr(10) order by b)) as g from l0 group by 1, 2),
l2 as (select split, substr(c, 1, 1) as e, sha256(string_agg(g, chr(10) order by c)) as g from l1 group by 1, 2)
select split, sha256(string_agg(g, chr(10) order by e)) as fingerprint, 'tree-3' as form from l2 group by split""")
def _(t):
    return splits.set_fingerprint(t.fx_scene, "filename", ["split"])


@query("a34_set_fingerprint_plain", "fx_scene", "select split, sha256(string_agg(distinct filename, chr(10) order by filename)) as fingerprint, 'plain' as form from fx_scene group by split")
def _(t):
    return splits.set_fingerprint(t.fx_scene, "filename", ["split"], depth=0)


# ------------------------------------------------------------------ leakage

PTS = """pt as (select image_id, split, 20 + (lat_e6 % 3000000) / 1e6 as latitude, 75 + (lon_e6 % 3000000) / 1e6 as longitude from fx_scene),
near as (select a.image_id as a_id, b.image_id as b_id, 6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) as distance from (
  select a.image_id, b.image_id as bid, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2) as h
  from pt a join pt b on a.split = 'train' and b.split = 'test' and b.latitude between a.latitude - 0.003 and a.latitude + 0.003 and abs(a.longitude - b.longitude) <= 0.003 and abs(a.latitude - b.latitude) <= 0.003) a join pt b on b.image_id = a.bid)"""


def near_df(t):
    pts = t.fx_scene.select("image_id", "split", (20 + (F.col("lat_e6") % 3000000) / 1e6).alias("latitude"), (75 + (F.col("lon_e6") % 3000000) / 1e6).alias("longitude"))
    return leakage.near_points(pts.where("split = 'train'"), pts.where("split = 'test'"))


@query("j13_near_pairs", "fx_scene", "with " + PTS + "select a_id, b_id, round(distance, 2) as distance from near where distance <= 200")
def _(t):
    return near_df(t).select("a_id", "b_id", F.round("distance", 2).alias("distance"))


TOWN = "tn as (select split, lat_e6 % 20000 / 1000000.0::double + 21 as la, lon_e6 % 30000 / 1000000.0::double + 72 as lo from fx_scene)"


@query("j13_town_counts", "fx_scene", "with " + TOWN + """, p as (select 2 * 6371000.0::double * asin(least(1.0, sqrt(pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) as d
  from tn a join tn b on a.split = 'train' and b.split = 'test' and abs(a.la - b.la) <= 0.003 and abs(a.lo - b.lo) <= 0.003)
select """ + ", ".join(f"count(*) filter (where d <= {r}) as within_{r}m" for r in leakage.RADII) + " from p")
def _(t):
    town = t.fx_scene.select("split", (F.col("lat_e6") % 20_000 / 1_000_000.0 + 21).alias("latitude"), (F.col("lon_e6") % 30_000 / 1_000_000.0 + 72).alias("longitude"))
    return leakage.near_counts_of(town.where("split = 'train'"), town.where("split = 'test'"))


@query("j13_near_counts", "fx_scene", "with " + PTS + "select " + ", ".join(f"count(*) filter (where distance <= {r}) as within_{r}m" for r in leakage.RADII) + " from near")
def _(t):
    return leakage.near_counts(near_df(t))


HASH = """bits as (select image_id, cast(y * 7 + x as int) as i, case when lead(logit) over (partition by image_id, y order by x) > logit then 1 else 0 end as bit, x from fx_raster),
hs as (select image_id, cast(sum(bit * (cast(1 as bigint) << cast(55 - i as int))) as bigint) as hash from bits where x < 7 group by image_id)"""


def hash_df(t):
    """8 rows of 8 grey values per vector: seven comparisons a row, 56 bits."""
    grids = t.embeddings.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("grid"))
    return leakage.dhash(grids, "grid", width=7, height=8)


@query("h22_dhash", "fx_raster", "with " + HASH + "select image_id, hash from hs")
def _(t):
    return hash_df(t).select("image_id", "hash")


@query("j14_hamming_pairs", "fx_scene", """with q as (select image_id, split, (custkey << 40) | (strip << 20) | has_solar as hash from fx_scene),
a as (select hash, count(*) as n, min(image_id) as id from q where split = 'train' group by hash), b as (select hash, count(*) as n, min(image_id) as id from q where split = 'test' group by hash)
select a.hash as a_hash, a.n as a_rows, a.id as a_id, b.hash as b_hash, b.n as b_rows, b.id as b_id, cast(bit_count(xor(a.hash, b.hash)) as int) as hamming from a join b on bit_count(xor(a.hash, b.hash)) <= 3""")
def _(t):
    key = F.shiftleft("custkey", 40).bitwiseOR(F.shiftleft("strip", 20)).bitwiseOR(F.col("has_solar"))
    hs = t.fx_scene.select("image_id", "split", key.alias("hash"))
    return leakage.hamming_pairs(hs.where("split = 'train'"), hs.where("split = 'test'"))


@query("j15_exact_duplicates", "fx_docs", "select sha, count(*) as copies, string_agg(distinct split, ',' order by split) as splits, min(filename) as first_file from fx_docs group by sha having count(*) > 1")
def _(t):
    return leakage.exact_duplicates(t.fx_docs)


@query("j15_duplicate_members", "fx_docs", "select sha, copies, split, filename from (select *, count(*) over (partition by sha) as copies from fx_docs) q where copies > 1")
def _(t):
    d = t.fx_docs.select("sha", "split", "filename")
    return leakage.duplicate_members(d, leakage.exact_duplicates(d))


@query("j16_content_lookup", "fx_docs", "select i.doc_id, coalesce(c.hits, 0) as hits, c.first_match from fx_docs i left join (select sha, count(*) as hits, min(filename) as first_match from fx_docs where split = 'train' group by sha) c on c.sha = i.sha where i.split = 'test'")
def _(t):
    d = t.fx_docs
    return leakage.content_lookup(d.where("split = 'test'").select("doc_id", "sha"), d.where("split = 'train'")).select("doc_id", "hits", "first_match")


@query("a44_dataset_audit", "fx_scene fx_gt fx_file", "with " + ANN + """select (select count(*) from fx_scene) as rows, (select count(*) from fx_scene where has_solar = 1) as positives, (select count(*) from fx_gt) as annotations,
  (select count(*) from fx_file) as files, (select count(*) from fx_file where length = 0) as zero_byte_files, (select count(*) from ann where has_solar = 1 and annotation_count = 0) as positives_without_annotation,
  (select count(*) from fx_gt g where not exists (select 1 from fx_scene s where s.image_id = g.image_id)) as annotations_without_image,
  (select count(*) from fx_scene where not (lat_e6 between 8000000 and 38000000 and lon_e6 between 68000000 and 98000000)) as coordinate_outliers,
  (select count(*) from (select doc_id from fx_file group by doc_id having count(*) > 1) q) as multi_file_ids""")
def _(t):
    inside = F.col("lat_e6").between(8000000, 38000000) & F.col("lon_e6").between(68000000, 98000000)
    parts = [
        t.fx_scene.agg(F.count("*").alias("rows"), F.count_if(F.col("has_solar") == 1).alias("positives"), F.count_if(~inside).alias("coordinate_outliers")),
        t.fx_gt.agg(F.count("*").alias("annotations")),
        t.fx_file.agg(F.count("*").alias("files"), F.count_if(F.col("length") == 0).alias("zero_byte_files")),
        annotated(t).where("has_solar = 1").agg(F.count_if(F.col("annotation_count") == 0).alias("positives_without_annotation")),
        t.fx_gt.join(t.fx_scene, "image_id", "left_anti").agg(F.count("*").alias("annotations_without_image")),
        catalogue.duplicates(t.fx_file, ["doc_id"]).agg(F.count("*").alias("multi_file_ids")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out
