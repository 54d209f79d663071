"""Mosaics of snapped boxes: ids beyond a bigint, and images above and below the limits."""
import duckdb
import pytest
from pyspark.sql import functions as F

from maskfold.operators import copies
from maskfold.plans.fixtures import Inputs
from maskfold.plans.q_matching import snapped
from maskfold.plans.workload import ORACLES, QUERIES

FROM = "/root/testdata/sf0.001"
NAMES = ["j6_shape_pairs", "j7_match_copies"]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with the part keys of sixty copies."""
    to = tmp_path_factory.mktemp("far")
    for t in ("orders", "lineitem"):
        cols = "* replace (l_partkey + 1180000 as l_partkey)" if t == "lineitem" else "*"
        duckdb.sql(f"copy (select {cols} from '{FROM}/{t}.parquet') to '{to}/{t}.parquet' (format parquet)")
    return str(to)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(float(v)) if c == "iou" and v is not None else str(v) for c, v in zip(cols, r)) for r in df.select(*cols).collect())


def asked(folder, text):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    return sorted(tuple(repr(float(r[names.index(c)])) if c == "iou" and r[names.index(c)] is not None else str(r[names.index(c)]) for c in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_ids_beyond_a_bigint(spark, far, name):
    with pytest.raises(duckdb.OutOfRangeException):
        asked(far, ORACLES[name])
    wide = ORACLES[name].replace("idx * 131072", "idx::hugeint * 131072").replace("cast(null as bigint)", "cast(null as hugeint)")
    wide = wide.replace("cast([] as bigint[])", "cast([] as hugeint[])").replace("struct(g bigint, i double)", "struct(g hugeint, i double)")
    got = rows(QUERIES[name](spark, far))
    assert len(got) > 1000 and got == asked(far, wide)


@pytest.mark.parametrize("name", NAMES)
def test_ids_that_fit_stay_bigint(spark, name):
    df = QUERIES[name](spark, FROM)
    assert {t for c, t in df.dtypes if c in ("pred_idx", "gt_idx", "pred_shape", "gt_shape")} == {"bigint"}
    assert rows(df) == asked(FROM, ORACLES[name])


def test_crowded_mosaics_give_the_same_rows(spark):
    dets, gts = (df.where("image_id % 10 < 2").persist() for df in snapped(Inputs(spark, FROM)))
    assert dets.groupBy("image_id").count().agg(F.max("count")).first()[0] > 40
    calm, busy = (rows(copies.box_pairs(dets, gts, limit=n)) for n in (10**6, 40))
    assert calm == busy and len(calm) > 100
    calm, busy = (rows(copies.match_boxes(dets, gts, pair_limit=200, limit=n).drop("x0", "x1", "y0", "y1", "area")) for n in (10**6, 40))
    assert calm == busy == rows(copies.match_masks(dets, gts, pair_limit=200).drop("x0", "x1", "y0", "y1", "area"))
