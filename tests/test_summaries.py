"""Per-video summaries over a table of several files, against the SQL read in the order of the rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import compare

from strandline.plans import registry


def test_sums_follow_the_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    n, folder = 40_000, tmp_path / "lineitem.parquet"
    folder.mkdir()
    flags = np.array(["A", "N", "R", None], dtype=object)[rng.integers(0, 4, n)]
    video = rng.integers(0, n // 7, n).astype(object)
    video[::997] = None
    discount = (rng.integers(0, 11, n) / 100).astype(object)
    discount[video == 5] = None
    rows = pa.table({
        "l_orderkey": pa.array(video, pa.int64()), "l_partkey": pa.array(rng.integers(1, 200, n), pa.int64()), "l_suppkey": pa.array(rng.integers(1, 10, n), pa.int64()), "l_linenumber": pa.array(rng.integers(1, 8, n), pa.int32()),
        "l_quantity": rng.integers(1, 51, n).astype(float), "l_extendedprice": rng.integers(1000, 9000, n) / 10, "l_discount": pa.array(discount, pa.float64()), "l_returnflag": pa.array(flags, pa.string()),
    })
    for i in range(8):
        pq.write_table(rows.slice(i * n // 8, n // 8), folder / f"part-{i}.parquet", row_group_size=1000)
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, the SQL's sums add up in another order
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    compare(registry.QUERIES["u14_video_summaries"](spark, str(tmp_path)), con, registry.ORACLES["u14_video_summaries"])
