import json
import os

import pytest
from pyspark.sql import functions as F

from hanok.operators.guards import GuardError
from hanok.plans import update as up
from hanok.sources import part_store as ps
from hanok.sources.parts import escape_script

ROW = "struct<id:string,name:string,region:string,price:int>"


def documents(spark, price=1, names=("검증 </script> 단지",), n=40):
    """Complexes whose declared order goes to and fro between two regions."""
    rows = [(["영등포구", "마포구"][i % 2], i, f"A{i}", names[i % len(names)], price) for i in range(n)]
    df = spark.createDataFrame(rows, "region string, ord int, id string, name string, price int")
    return df.select("region", "ord", "id", escape_script(F.to_json(F.struct("id", "name", "region", "price"))).alias("json"))


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def problems(spark, path, **options):
    return {(r.guard, r.detail) for r in ps.load_store(spark, path, ROW, **options)[1].collect()}


def test_round_trip_keeps_order_and_the_version_before(spark, tmp_path):
    path = str(tmp_path)
    for price in (1, 2, 3):
        ps.write_store(documents(spark, price), path, f"v{price}", 900)
    for which, price in (("current", 3), ("previous", 2)):
        rows, wrong = ps.load_store(spark, path, ROW, which)
        assert wrong.isEmpty()
        got = [(r.ord, r.id, r.name, r.region, r.price) for r in rows.orderBy("ord").collect()]
        assert got == [(i, f"A{i}", "검증 </script> 단지", ["영등포구", "마포구"][i % 2], price) for i in range(40)]
    manifests = [ps.Store(path).manifest(w) for w in ("current", "previous")]
    listed = {p[k] for m in manifests for p in m["parts"] for k in ("file", "order")}
    assert set(files(path)) == listed | {ps.MANIFEST, ps.PREVIOUS}  # nothing of the first version or of any run
    assert all(len(open(f"{path}/{p['file']}", "rb").read()) == p["bytes"] <= 900 for m in manifests for p in m["parts"])
    assert not any("</script" in open(f"{path}/{f}", encoding="utf-8").read() for f in listed if f.endswith(".js"))


def test_a_document_over_the_cap_or_a_failure_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    big = documents(spark, names=("x", "<" * 100), n=6)  # six bytes each once escaped
    with pytest.raises(Exception, match="alone exceeds a part"):
        ps.write_store(big, path, "v1", 500)
    assert files(path) == [] and [d for d in os.listdir(path) if d.startswith("_run")] == []
    ps.write_store(documents(spark), path, "v1", 900)
    before = {f: open(f"{path}/{f}", "rb").read() for f in files(path)}
    with pytest.raises(Exception, match="alone exceeds a part"):
        ps.write_store(big, path, "v2", 500)
    assert {f: open(f"{path}/{f}", "rb").read() for f in files(path)} == before and problems(spark, path) == set()


def test_broken_stores_are_reported_whole(spark, tmp_path):
    path = str(tmp_path)
    ps.write_store(documents(spark), path, "v1", 900)
    store = ps.Store(path)
    good = store.read(ps.MANIFEST)

    def broken(change):
        manifest = json.loads(good)
        change(manifest["parts"])
        store.write(ps.MANIFEST, json.dumps(manifest).encode())
        return problems(spark, path)

    assert broken(lambda p: p[0].update(sha256="0")) == {("part", "hash"), ("complex_count", str(40 - json.loads(good)["parts"][0]["count"]))}
    assert ("part", "count") in broken(lambda p: p[1].update(count=99))
    assert ("part", "region") in broken(lambda p: p[1].update(region="강남구"))
    assert ("part", "missing") in broken(lambda p: p[2].update(file="regions/none.js"))
    assert {g for g, _ in broken(lambda p: p.append(p[0]))} == {"part_listed_twice", "complex_id_twice", "complex_order"}
    # an order that declares other complexes than the part holds, or a place twice
    part = json.loads(good)["parts"][0]
    order = json.loads(store.read(part["order"]))

    def declared(rows):
        import hashlib

        data = json.dumps(rows).encode()
        store.write("orders/other.json", data)
        return lambda p: p[0].update(order="orders/other.json", order_sha256=hashlib.sha256(data).hexdigest())

    assert ("part", "order") in broken(declared(list(reversed(order))))
    assert broken(declared([[order[0][0], i] for _, i in order])) == {("complex_order", str(len(order)))}
    store.write(part["file"], b"")
    assert ("part", "hash") in broken(lambda p: None)


def test_a_region_filter_opens_only_its_parts(spark, tmp_path):
    path = str(tmp_path)
    ps.write_store(documents(spark), path, "v1", 900)
    for part in ps.Store(path).manifest()["parts"]:
        if part["region"] == "마포구":
            os.remove(f"{path}/{part['file']}")
    assert ("part", "missing") in problems(spark, path)
    assert problems(spark, path, regions=["영등포구"]) == set()
    before = spark.conf.get(ps.PUSHDOWN, None)
    spark.conf.set(ps.PUSHDOWN, "true")
    try:
        for rows in (ps.read_store(spark, path).filter("region = '영등포구'"), ps.read_store(spark, path).filter("region in ('영등포구', '강남구')")):
            assert rows.count() == 20 and rows.rdd.getNumPartitions() == sum(p["region"] == "영등포구" for p in ps.Store(path).manifest()["parts"])
    finally:
        spark.conf.unset(ps.PUSHDOWN) if before is None else spark.conf.set(ps.PUSHDOWN, before)


def test_the_job_checks_sizes_as_they_are_written(spark, tmp_path):
    c = spark.createDataFrame([("A", "x", "<" * 60), ("B", "x", "b")], "complex_id string, region string, name string")
    sales = spark.createDataFrame([("A", "2025-01", 5), ("B", "2025-01", 7)], "complex_id string, ym string, price int")
    tables = {"complexes": c, "sales": sales, "leases": sales.withColumnRenamed("price", "deposit")}
    with pytest.raises(GuardError, match="complex_too_large: A"):
        up.publish_parts(spark, str(tmp_path), "v1", tables, 600)
    assert files(str(tmp_path)) == []
    up.publish_parts(spark, str(tmp_path), "v1", tables, 900)
    rows, wrong = ps.load_store(spark, str(tmp_path), "struct<id:string,name:string,tx:array<struct<price:int>>>")
    assert wrong.isEmpty() and {(r.id, r.name, r.tx[0].price) for r in rows.collect()} == {("A", "<" * 60, 5), ("B", "b", 7)}


def test_documents_are_built_and_parts_are_opened_once(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def document(i):
        built.add(1)
        return '{"id":"' + str(i) + '","region":"강남구"}'

    documents = spark.range(40).select(F.lit("강남구").alias("region"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), document("id").alias("json"))
    ps.write_store(documents, str(tmp_path / "store"), "v1", 400)
    assert built.value == 40
    rows, wrong = ps.load_store(spark, str(tmp_path / "store"), ROW)
    for part in ps.Store(str(tmp_path / "store")).names("regions"):
        (tmp_path / "store" / part).unlink()  # nothing opens them again
    assert wrong.count() == 0 and rows.count() == 40
