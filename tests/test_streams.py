"""Streams read the whole table, whether it is a file or a folder of part files."""

from __future__ import annotations

import shutil

import pyarrow.parquet as pq
import pytest
from basalt.queries import queries

QUERIES = ["stream_tumbling", "stream_session", "stream_dedup"]


@pytest.mark.parametrize("layout", ["file", "parts", "partitioned"])
def test_stream_reads_the_table_of_its_layout(spark, sf, tmp_path, layout):
    table, other = tmp_path / "events.parquet", tmp_path / "old" / "events.parquet"
    events = spark.read.parquet(f"{sf}/events.parquet")
    if layout == "file":
        shutil.copy(f"{sf}/events.parquet", table)
    elif layout == "parts":
        events.repartition(3).write.parquet(str(table))
    else:
        events.repartition(2).write.partitionBy("event_type").parquet(str(table))
    other.parent.mkdir()
    pq.write_table(pq.read_table(f"{sf}/events.parquet").slice(0, 7), other)  # not part of the table
    for name in QUERIES:
        want = queries()[name](spark, sf).collect()
        got = queries()[name](spark, str(tmp_path)).collect()
        assert want and sorted(map(repr, got)) == sorted(map(repr, want)), name
