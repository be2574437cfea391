"""Copies between databases, on in-memory ones (whose driver takes no null texts from Spark, so nulls are numbers here)."""

import pytest

from millrace.sources import io

TABLES = {"PARENT": "ID", "CHILD": "ID"}


@pytest.fixture(scope="module")
def urls(spark):
    made = []
    for name in ("copyfrom", "copyto", "copybare"):
        url = f"jdbc:derby:memory:{name};create=true"
        con = spark.sparkContext._jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(url, None)
        if name != "copybare":
            con.createStatement().execute("create table PARENT (ID bigint primary key, NAME varchar(40))")
            con.createStatement().execute("create table CHILD (ID bigint primary key, PARENT_ID bigint references PARENT (ID), AMOUNT double)")
        con.close()
        made.append(url)
    spark.createDataFrame([(i, f"name {i}") for i in range(1200)], "ID long, NAME string").write.mode("append").jdbc(made[0], "PARENT")
    spark.createDataFrame([(i, i % 1200, None if i % 7 == 0 else i / 4) for i in range(3000)], "ID long, PARENT_ID long, AMOUNT double").write.mode("append").jdbc(made[0], "CHILD")
    return made


def test_copy_refuse_and_replace(spark, urls):
    source, target, bare = urls
    with pytest.raises(io.Refused, match="one database"):
        io.copy_database(spark, source, source, TABLES)
    with pytest.raises(io.Refused, match="can't be read"):
        io.copy_database(spark, source, bare, TABLES)
    assert sorted(map(tuple, io.copy_database(spark, source, target, TABLES).collect())) == [("CHILD", 3000), ("PARENT", 1200)]
    with pytest.raises(io.Refused, match="not empty"):
        io.copy_database(spark, source, target, TABLES)
    assert io.copy_database(spark, source, target, {"CHILD": "ID"}, replace=True).first().n == 3000
    for name in TABLES:
        assert spark.read.jdbc(source, name).exceptAll(spark.read.jdbc(target, name)).isEmpty()
