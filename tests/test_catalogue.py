import glob
import os

import duckdb
import pandas as pd
import pytest

from wavelot.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(frame, columns):
    return frame[columns].map(lambda x: "NULL" if x is None or x != x else str(x)).sort_values(columns).to_numpy().tolist()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert plain(got, columns) == plain(want, columns)
    else:
        assert len(got)


def test_even_mix_of_heavy_datasets(spark, duck, tmp_path):
    docs = pd.DataFrame({"doc_id": range(400), "text": "a", "lang": (["en"] * 5 + ["de", "fr", None]) * 50, "source": "s", "n_chars": [i * 7919 % 40_009 + 900_000 for i in range(400)]})
    docs.to_parquet(tmp_path / "documents.parquet", index=False)
    columns = ["dataset", "doc_id", "position", "rank"]
    got = catalogue.QUERIES["weighted_mux_order"](spark, str(tmp_path)).toPandas()
    want = duck.execute(f"WITH documents AS (SELECT * FROM read_parquet('{tmp_path}/documents.parquet')) SELECT * FROM ({catalogue.SQL['weighted_mux_order']})").df()
    assert plain(got, columns) == plain(want, columns)
    assert sorted(got["position"]) == list(range(350))


def test_pages_that_share_a_url_keep_their_own_manifests(spark, duck, tmp_path):
    pages = pd.DataFrame({"page_id": [0, 1, 2, 3, 4, 5, 7, 7], "url": ["a", "a", "a", "a", "b", "b", None, "c"], "html": ""})
    pages.to_parquet(tmp_path / "pages.parquet", index=False)
    columns = ["key", "manifest", "page_id"]
    got = catalogue.QUERIES["manifest_pairs"](spark, str(tmp_path)).toPandas()
    want = duck.execute(f"WITH pages AS (SELECT * FROM read_parquet('{tmp_path}/pages.parquet')) SELECT * FROM ({catalogue.SQL['manifest_pairs']})").df()
    assert plain(got, columns) == plain(want, columns)
