import os
from urllib.parse import urlparse

from trustfold.session import clear_scratch, scratch_path


def test_scratch_tables_are_removed(spark):
    paths = [scratch_path(spark, "test") for _ in range(2)]
    for p in paths:
        spark.range(3).write.parquet(p)
    assert all(os.path.isdir(urlparse(p).path) for p in paths) and len(set(paths)) == 2
    assert clear_scratch(spark) >= 2
    assert not any(os.path.exists(urlparse(p).path) for p in paths) and clear_scratch(spark) == 0
