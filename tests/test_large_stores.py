"""What registered queries over stores keep off the driver."""

import pytest

from weftline import engine, stores
from weftline.functions import text as say

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["w_compacted", "w_delete_marks", "w_update_marks", "x_action_undone", "x_action_writes"])
def test_rows_that_a_batch_wrote_stay_off_the_driver(spark, monkeypatch, name):
    """At 60 times sf0.1 an update returns 1.7 million rows of lineitem, which a driver can't hold as dicts and text."""

    def brought(*_):
        raise AssertionError("rows of a write were brought to the driver")

    monkeypatch.setattr(engine._Run, "rows", brought)
    monkeypatch.setattr(say.Rows, "__iter__", brought)
    assert stores.queries()[name](spark, SF).count() > 0
