"""The target as a data source with pushed filters."""

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tessera.operators import publish as P
from tessera.sources import target_source as TS
from tests.test_load_and_publish import MODEL, frames


def test_reads_only_the_parts_of_the_keys_asked_for(spark, workdir):
    target = os.path.join(workdir, "t")
    many = tuple((i, f"t{i % 7}") for i in range(300))
    P.publish(spark, MODEL, {"site": frames(spark, [], sites=many)["site"]}, target, parts=16)
    site = MODEL.entity("site")
    df = TS.read_target_source(spark, target, site)
    assert df.columns == ["s", "town"] and df.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, df.collect())) == sorted(many)
    one = df.where("s = 17")
    assert one.rdd.getNumPartitions() == 1 and [tuple(r) for r in one.collect()] == [(17, "t3")]
    some = df.where(F.col("s").isin(3, 4, 99999))
    assert some.rdd.getNumPartitions() <= 3 and sorted(r["s"] for r in some.collect()) == [3, 4]
    assert df.where("s > 290 AND town = 't3'").count() == sum(s > 290 and t == "t3" for s, t in many)
    assert df.where("s = 1 AND s = 2").count() == 0
    # parts are those of a publish
    got = spark.createDataFrame([(i,) for i in range(50)], "s int").select("s", P.part_number(["s"], 16).alias("p")).collect()
    assert all(TS.part_of((r["s"],), 16) == r["p"] for r in got)
    mixed = spark.createDataFrame([(1, "ü", dt.date(2020, 2, 3), True)], "a int, b string, c date, d boolean")
    assert mixed.select(P.part_number(["a", "b", "c", "d"], 1 << 20).alias("p")).first()["p"] == TS.part_of(
        (1, "ü", dt.date(2020, 2, 3), True), 1 << 20)


def test_filters_that_cannot_choose_parts(spark, workdir):
    target = os.path.join(workdir, "t")
    assert TS.read_target_source(spark, target, MODEL.entity("site")).count() == 0
    P.publish(spark, MODEL, {"site": frames(spark, [])["site"]}, target, parts=4)
    df = TS.read_target_source(spark, target, MODEL.entity("site"))
    assert df.where("town IS NULL OR s = 1").count() == 1 and df.where("upper(town) = 'A'").count() == 1
    reader = TS.TargetReader(MODEL.entity("site").publish_schema, {"key": '["s"]', "deal": "4", "parts": "[]"})
    filters = [EqualTo(("town",), "a"), GreaterThan(("s",), 0), In(("s",), (1, 2))]
    assert list(reader.pushFilters(filters)) == filters and reader.numbers == {TS.part_of((1,), 4), TS.part_of((2,), 4)}
