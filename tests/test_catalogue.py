"""Every query against its SQL on the smallest tables, and that plans don't depend on partitioning."""

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from kairograph import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    assert got
    if sql := catalogue.oracle_sql().get(name):
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_shuffle_partitions_do_not_matter(spark, sf):
    q = catalogue.queries()["recent_k_stats"]
    a = Counter(map(tuple, q(spark, sf).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert Counter(map(tuple, q(spark, sf).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_only_needed_columns_are_read(spark, sf, capsys):
    catalogue.queries()["degree_weighted"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "price" not in "".join(line for line in plan.splitlines() if "ReadSchema" in line)


def test_entry_works_without_the_optional_operators(tmp_path):
    """The guard's other branch: a copy of the repository without the training-data operators."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "kairograph")
    for p in os.listdir(f"{root}/kairograph"):
        if p != "llm":
            os.symlink(f"{root}/kairograph/{p}", tmp_path / "kairograph" / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=env)


def test_publication_adds_in_the_order_of_rows(spark, tmp_path):
    """Two customers with the same items in other orders: their states lie just 40 apart, but for the last bits of the sums."""
    first, second = ((4, 9, 1), (10, 9, 9, 4, 2, 4)), ((9, 4, 1), (9, 2, 10, 4, 9, 4))
    orders, items = [], []
    for cust, mine, other in ((1, first, second), (2, second, first)):
        for month, day in enumerate(("2020-01-01", "2020-02-05")):
            key, last = 2 * cust + month, (50, 32)[month]
            orders.append(f"({key}, {cust}, TIMESTAMP '{day}')")
            places = list(other[month])  # the part's id, and with it the edge's position, follows the other customer's order
            for i, disc in enumerate(mine[month]):
                at = places.index(disc)
                places[at] = None
                items.append(f"({key}, {at}, {last if i == 0 else (50, 30)[month]}::DOUBLE, 1.0::DOUBLE, {disc}::DOUBLE / 100, 0.0::DOUBLE)")
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE TABLE orders AS FROM (VALUES {', '.join(orders)}) t(o_orderkey, o_custkey, o_orderdate)")
    c.execute(f"CREATE TABLE lineitem AS FROM (VALUES {', '.join(items)}) t(l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax)")
    for t in ("orders", "lineitem"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    expected = sorted(c.execute(catalogue.oracle_sql()["publish_filter"]).fetchall())
    assert [r[2] for r in expected] == [True, True, True, False]
    got = catalogue.queries()["publish_filter"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == expected
