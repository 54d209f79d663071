"""All models of an image are walked in one row, beside one copy of its ground truths."""
import pytest

from maskfold.operators import images
from maskfold.plans import fixtures

BOX = "x0 int, y0 int, x1 int, y1 int, area long"


@pytest.fixture(scope="module")
def shared(spark):
    b = (0, 0, 10, 10, 100)
    dets = [("a", 1, 0, 90, *b), ("b", 1, 0, 80, *b), ("b", 1, 1, 95, *b), (None, 1, 0, 70, *b), ("a", 2, 0, 60, *b)]
    gts = [(1, 7, *b), (1, None, *b), (3, 7, *b)]
    return (spark.createDataFrame(dets, f"model string, image_id long, pred_idx long, score_pct int, {BOX}"),
            spark.createDataFrame(gts, f"image_id long, gt_idx long, {BOX}"))


def test_each_model_takes_ground_truths_for_itself(shared):
    d, g = shared
    got = {(r.model, r.image_id, r.pred_idx): (r.gt_idx, r.iou, r.is_tp) for r in images.match(d, g).collect()}
    hit, miss = (7, 1.0, 1), (None, None, 0)
    assert got == {("a", 1, 0): hit, ("b", 1, 0): miss, ("b", 1, 1): hit, (None, 1, 0): hit, ("a", 2, 0): miss}
    far = {(r.model, r.image_id, r.pred_idx): (r.max_gt_iou, r.max_matched_iou) for r in images.max_iou_any(d, g).collect()}
    assert far == {("b", 1, 0): (1.0, 1.0), ("a", 2, 0): (0.0, 0.0)}
    left = sorted(images.missed_gt(d, g, ("a", "c")).select("image_id", "model", "gt_idx").collect(), key=str)
    assert left == sorted([(1, "a", None), (1, "c", 7), (1, "c", None), (3, "a", 7), (3, "c", 7)], key=str)


def test_ground_truths_are_gathered_and_joined_once_an_image(spark, shared):
    d, g = shared
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (images.match(d, g), images.max_iou_any(d, g), images.missed_gt(d, g, ("a", "b"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MergeJoin") == 1
            assert plan.count("collect_list") and "keys=[model" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_task_holds_no_more_than_100_000_rows(spark, tmp_path):
    spark.range(1_000_001).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert fixtures.Inputs(spark, str(tmp_path)).parts("lineitem") == 11
