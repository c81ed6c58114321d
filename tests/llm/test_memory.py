import pandas as pd

from plumbline.llm.common import tidy


def test_tidy_changes_no_batch():
    def twice(batches):
        for batch in batches:
            yield batch
            yield batch * 2

    given = [pd.DataFrame({"a": [k, None]}) for k in range(3)]
    found = list(tidy(twice)(iter(given)))
    wanted = list(twice(given))
    assert len(found) == len(wanted) == 6
    for a, b in zip(found, wanted):
        pd.testing.assert_frame_equal(a, b)
    assert list(tidy(twice)(iter([]))) == []


def test_tidy_in_tasks(spark):
    rows = spark.range(50, numPartitions=4).mapInPandas(
        tidy(lambda batches: (b[b["id"] % 2 == 0] for b in batches)), "id long"
    )
    assert sorted(r["id"] for r in rows.collect()) == list(range(0, 50, 2))
