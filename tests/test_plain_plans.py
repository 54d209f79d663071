"""Plans that move less data give the rows of the plain ones."""
from __future__ import annotations

import pytest

from maskfold.plans.fixtures import Inputs

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fx_item", "fx_gt", "fx_det"])
def test_views_are_their_text(spark, name):
    t = Inputs(spark, SMALL)
    form, text = getattr(t, name), t.sql_view(name)
    assert form.dtypes == text.dtypes
    assert form.count() == text.count() > 0
    assert form.exceptAll(text).isEmpty() and text.exceptAll(form).isEmpty()


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("fx_item", 1), ("fx_gt", 2), ("fx_det", 2)])
def test_views_are_dealt_once_a_table(spark, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Inputs(spark, SMALL)
        assert exchanges(getattr(t, name).groupBy("image_id" if name != "fx_item" else "l_orderkey").count()) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
