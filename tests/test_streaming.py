from __future__ import annotations

from weft.functions.predicates import Compare
from weft.plans.joingraph import JoinGraph
from weft.streaming.joins import drain, read_stream


def test_stream_joins_tables(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    nation, region = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("nation", "region"))
    nation.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), nation.schema, Compare("n_nationkey", ">", 2), files_per_trigger=1)
    make = lambda n: JoinGraph({"n": n, "r": region}, equal=[(("n", "n_regionkey"), ("r", "r_regionkey"))])
    steps = [(frozenset("n"), frozenset("r"))]
    drain(make(stream).join(steps).select("n__n_name", "r__r_name"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = make(nation.where("n_nationkey > 2")).plan().select("n__n_name", "r__r_name")
    assert sorted(got.collect()) == sorted(want.collect())
