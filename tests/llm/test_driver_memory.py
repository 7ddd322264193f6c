"""What the driver's JVM holds outside its heap."""

import pytest

from cairnlake.llm import common


def test_native_memory_goes_back_after_each_table(spark, monkeypatch):
    said = common.trimmed(spark)
    if said is None:
        pytest.skip("this JVM can't trim its native heap")
    assert "Trim" in said
    asked = []
    monkeypatch.setattr(common, "trimmed", asked.append)
    monkeypatch.setattr(common, "_collected", [0.0])
    table = common.persist(spark.range(3))
    assert len(asked) == 1
    common.release(table)
    assert len(asked) == 2
