"""Every query against its SQL, over the smallest tables."""

import duckdb
import pytest

from annolith.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, D).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


def test_addresses_of_whole_pages(spark, tmp_path):
    """Pages with every kind of image address, at any page_id, against a list made by hand."""
    kinds = ['{{"ou" : "{}"}}', '{{"imgurl":"{}"}}', '<a data-iurl="{}">', '<a href="/imgres?imgurl={}&x=1">']
    rows, images, numbers = [], [], []
    for i in range(12):
        mine = [f"https://i.example/{i}-{k}.jpg" for k in range(4)]
        forms = [mine[0].replace("/", "\\/"), mine[1], mine[2].replace("https:", ""), mine[3].replace(":", "%3A").replace("/", "%2F")]
        html = "".join(t.format(u) + "<p>text</p>" for t, u in zip(kinds, forms, strict=True)) + '<a data-iurl="data:x">' if i % 4 else "<p>none</p>"
        url = ["https://a.example/s?q=x&p={}", "https://a.example/s?pn={}#p=9", "https://a.example/s?page={}&q=y", "https://a.example/{}"][i % 4].format(i)
        rows.append((i, url, html))
        images += [(i, u) for u in mine] if i % 4 else [(i, None)]
        numbers.append((i, str(i) if i % 4 < 3 else None))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["page_image_urls"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, images))
    assert sorted(map(tuple, catalog.queries()["page_number"](spark, str(tmp_path)).collect())) == numbers
