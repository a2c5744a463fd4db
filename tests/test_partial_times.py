"""Queries against their SQL on a table whose last time point is not whole."""

import duckdb
import pytest

from lumenplane.plans import registry

#: Planes in the table: two time points and 17 planes, and fewer than one time point.
COUNTS = (117, 30)


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """Folders of the first planes of sf0.1, by their count."""
    found = {n: tmp_path_factory.mktemp(f"first{n}") for n in COUNTS}
    for n, folder in found.items():
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < {n}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return found


@pytest.mark.parametrize("count", COUNTS)
@pytest.mark.parametrize("name", ["ome_companion", "scan_dcimg_group", "channel_merger", "channel_stats", "dimension_reorder", "level_index", "plane_coordinates", "scan_czi", "scan_imagej"])
def test_last_time_point_in_part(spark, cut, name, count):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{cut[count]}/embeddings.parquet')")
    want = con.sql(registry.ORACLES[name])
    if name == "plane_coordinates" and count < 50:
        pytest.skip("its SQL divides by the number of whole time points")
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, str(cut[count]))
    assert sorted(got.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


def test_merged_channels_keep_their_places(spark):
    from lumenplane.operators import reshape

    df = spark.createDataFrame([("d", 0, 1, 0, [5.0]), ("d", 1, 0, 0, [6.0]), ("d", 1, 2, 0, [7.0])], "dataset_id string, z int, c int, t int, samples array<double>")
    got = reshape.merge_channels(df, reshape.F.lit(3)).orderBy("z").collect()
    assert [(r.c, r.samples, r.channels) for r in got] == [(0, [None, 5.0, None], [1]), (0, [6.0, None, 7.0], [0, 2])]
    alone = reshape.merge_channels(df, reshape.F.lit(5)).orderBy("z", "c").collect()
    assert [(r.c, r.samples, r.channels) for r in alone] == [(1, [5.0], None), (0, [6.0], None), (2, [7.0], None)]


def test_planes_without_a_number_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    duckdb.sql(f"COPY (SELECT vec_id, CASE WHEN vec_id IN (3, 30) THEN list_transform(embedding, lambda v: CAST('nan' AS FLOAT)) ELSE embedding END AS embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < 117) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(registry.ORACLES["channel_stats"] + " ORDER BY c").fetchall()
    got = registry.QUERIES["channel_stats"](spark, str(tmp_path)).orderBy("c").collect()
    assert [tuple(r) for r in got] == want and want[0][3] == 14
