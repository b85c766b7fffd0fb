import glob
import os

import pytest
from pyspark.sql import functions as F

from hanok.functions.fixed_values import ARCHIVE_FIELDS
from hanok.operators import guards as g
from hanok.operators import incremental as inc
from hanok.plans import publish as pb
from hanok.sources import envelope as ev
from hanok.sources import lookups
from hanok.sources import parts as pt
from hanok.sources import tabular as tb
from hanok.streaming import trades as tr

ROW = "struct<id:string,name:string,region:string>"


def documents(spark, names):
    rows = [(region, i, f"A{i}", name) for i, (region, name) in enumerate(names)]
    df = spark.createDataFrame(rows, "region string, ord int, id string, name string")
    return df.select("region", "ord", pt.escape_script(F.to_json(F.struct("id", "name", "region"))).alias("json"))


def test_parts_round_trip_and_stay_below_the_limit(spark, tmp_path):
    names = [("영등포구", "검증 </script> 단지 ")] + [(r, "이름" * 20) for r in ("마포구", "영등포구") for _ in range(40)]
    path = str(tmp_path / "parts")
    packed = pt.pack_parts(documents(spark, names), max_bytes=1500).cache()
    pt.write_parts(packed, path)
    manifest = packed.drop("text")
    assert manifest.agg(F.max("bytes")).first()[0] <= 1500 and manifest.count() > 8
    rows, problems = pt.load_parts(spark, path, manifest, 81, ROW)
    assert problems.isEmpty() and rows.count() == 81
    assert rows.filter("id = 'A0'").first().name == "검증 </script> 단지 "
    files = glob.glob(path + "/file=*/*.txt")
    assert not any("</script>" in open(f, encoding="utf-8").read() for f in files)

    body = open(files[0], encoding="utf-8").read()
    os.remove(os.path.join(os.path.dirname(files[0]), f".{os.path.basename(files[0])}.crc"))  # the local file system's own check
    open(files[0], "w", encoding="utf-8").write(body.replace("이름", "다름", 1) if "이름" in body else body + " ")
    rest = manifest.unionByName(manifest.limit(1).withColumn("file", F.lit("region-missing")))
    found = {(r.guard, r.detail) for r in pt.load_parts(spark, path, rest, 81, ROW)[1].collect()}
    assert ("part", "hash") in found and ("part", "missing") in found


def test_oversized_complex_is_told_before_it_is_built(spark):
    sizes = spark.createDataFrame([("A", 10), ("B", 9_000_000)], "complex_id string, bytes bigint")
    assert [r.key for r in pt.oversized(sizes).collect()] == ["B"]


def table(spark, price):
    return spark.createDataFrame([("A1", "r1", price), ("A2", "r2", price)], "complex_id string, region string, price int")


def test_two_versions_are_kept_and_failures_change_nothing(spark, tmp_path):
    root = str(tmp_path / "site")
    put = lambda v, price, checks=lambda staged: []: pb.publish_snapshot(spark, root, v, {"sales": (table(spark, price), "region", ("complex_id",))}, checks)
    put("v1", 1)
    put("v2", 2)
    put("v3", 3)
    price = lambda which: pb.load_snapshot(spark, root, which)["sales"].agg(F.max("price")).first()[0]
    assert (price("current"), price("previous")) == (3, 2)
    assert sorted(os.listdir(root + "/versions")) == ["v2", "v3"]
    with pytest.raises(g.GuardError):
        put("v4", 4, lambda staged: [g.minimum_rows(staged["sales"], 10)])
    assert (price("current"), price("previous")) == (3, 2) and sorted(os.listdir(root + "/versions")) == ["v2", "v3"]


def test_changed_snapshot_is_not_loaded(spark, tmp_path):
    root = str(tmp_path / "site")
    pb.publish_snapshot(spark, root, "v1", {"sales": (table(spark, 1), "region", ("complex_id",))})
    table(spark, 7).drop("region").coalesce(1).write.mode("overwrite").parquet(root + "/versions/v1/sales/region=r1")
    with pytest.raises(g.GuardError, match="snapshot_changed"):
        pb.load_snapshot(spark, root)


def test_envelope_pages_move_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), None if i % 3 else f"a\"{i}") for i in range(25)], "no string, name string").coalesce(1)
    texts = ev.to_envelopes(rows, page=10)
    assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()
    texts.write.option("compression", "gzip").option("maxRecordsPerFile", 2).text(str(tmp_path / "pages"))
    back = ev.read_envelopes(spark, str(tmp_path / "pages"), lines=True)
    assert sorted(len(r.rows) for r in back.collect()) == [5, 10, 10]
    got = {(r.no, r.name) for r in ev.envelope_rows(back, ["no", "name"]).collect()}
    assert got == {(r.no, r.name) for r in rows.collect()}
    assert ev.to_envelopes(rows.limit(0)).count() == 0


def test_items_are_written_compressed_in_bounded_files(spark, tmp_path):
    rows = [(str(i), None, "당산동") if i % 2 else (None, f"<a&{i}>", " ") for i in range(25)]
    items = spark.createDataFrame(rows, "aptNm string, `아파트` string, umdNm string").coalesce(1)
    tb.write_items(items, str(tmp_path / "items"), file_rows=10)
    files = glob.glob(str(tmp_path / "items" / "part-*"))
    assert len(files) == 3 and all(f.endswith(".xml.gz") for f in files)
    got = sorted((r.name, r.legal_dong) for r in tb.read_items(spark, str(tmp_path / "items")).collect())
    assert got == sorted((a or b, (c or "").strip()) for a, b, c in rows)


def test_staged_items_take_a_fraction_of_their_text(spark, tmp_path):
    from hanok.queries.sources import xml_items
    from hanok.starmap import Star

    q = F.col("id")
    lineitem = spark.range(2000).select(
        (q % 7).alias("l_suppkey"), (q % 50).cast("double").alias("l_quantity"), (q % 5 + 1).cast("int").alias("l_linenumber"), (q * 3 + 1000.5).alias("l_extendedprice"),
        F.when(q % 11 == 0, 0.07).otherwise(0.02).alias("l_tax"), F.when(q % 13 == 0, "R").otherwise("N").alias("l_returnflag"), F.when(q % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
        F.timestamp_add("DAY", (q % 400).cast("int"), F.lit("2001-01-30").cast("timestamp_ntz")).alias("l_shipdate"),
    )
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"집{i}") for i in range(7)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    out = xml_items(Star(spark, str(tmp_path)))
    wanted = {}
    for r in spark.read.parquet(str(tmp_path / "lineitem.parquet")).collect():
        area = r.l_quantity + 40
        if r.l_returnflag != "R" and r.l_tax < 0.07 and (45 <= area < 75 or 82 <= area <= 86.5):
            key = (f"집{r.l_suppkey}", area, r.l_linenumber, int(r.l_extendedprice), r.l_shipdate.strftime("%Y-%m-%d"))
            wanted[key] = wanted.get(key, 0) + 1
    assert {tuple(r)[:5]: r.n for r in out.collect()} == wanted and len(wanted) > 1000
    files = [f.removeprefix("file://") for f in out.inputFiles()]
    assert all(f.endswith(".gz") for f in files) and sum(map(os.path.getsize, files)) < 2000 * 100  # about 450 bytes an item as text


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"DATA":[{"BDRG_SN":100000000000000000001,"Name":"x"},{"name":"y"}]}')
    (tmp_path / "b.json").write_text('{\n "DATA": [\n {"name": "z"}\n ]\n}')
    good = ev.read_envelopes(spark, str(tmp_path))
    got = {(r.bdrg_sn, r.name) for r in ev.envelope_rows(good, ["bdrg_sn", "name"]).collect()}
    assert got == {("100000000000000000001", "x"), (None, "y"), (None, "z")}
    assert ev.envelope_violations(good).isEmpty()
    for i, bad in enumerate(("<html>maintenance</html>", '{"DATA":[]}', "{}")):
        folder = tmp_path / f"bad{i}"
        folder.mkdir()
        (folder / "x.json").write_text(bad)
        assert ev.envelope_violations(ev.read_envelopes(spark, str(folder))).count() == 1
    assert ev.envelope_violations(ev.read_envelopes(spark, str(tmp_path / "bad1")), allow_empty=True).isEmpty()


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp949"])
def test_archive(spark, tmp_path, encoding):
    names = list(ARCHIVE_FIELDS)
    line = lambda district: ",".join(district if n == "자치구코드" else "검증아파트" if n == "건물명" else "1" for n in names)
    (tmp_path / "a.csv").write_bytes("\r\n".join([",".join(names), line("11560"), line("11440")]).encode(encoding))
    got = tb.read_archive(spark, str(tmp_path / "a.csv"), "11560").collect()
    assert [(r.cgg_cd, r.bldg_nm) for r in got] == [("11560", "검증아파트")]


def test_archive_fields_may_hold_quotes_and_commas(spark, tmp_path):
    names = list(ARCHIVE_FIELDS)
    told = ['"가 ""나"", 다"' if n == "건물명" else "11560" if n == "자치구코드" else "1" for n in names]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), ",".join(told)]))
    assert [r.bldg_nm for r in tb.read_archive(spark, str(tmp_path / "a.csv"), "11560").collect()] == ['가 "나", 다']


def test_archive_without_a_column_stops(spark, tmp_path):
    (tmp_path / "a.csv").write_text("자치구코드,층\n11560,1\n")
    with pytest.raises(tb.SourceError):
        tb.read_archive(spark, str(tmp_path / "a.csv"), "11560")


def test_listing(spark):
    from hanok.sources import listing as ls

    def offer(year, seq, day):
        return f"<tr class='odd'>\n <td>{day}</td><td><ul><li>안내</li></ul></td><td onclick=\"downloadFile('{seq}')\">서울특별시_전월세가_{year}.zip</td></tr>"

    pages = [offer(2019, 41, "2020.05.06.") + "<tr><td>다른 파일</td></tr>" + offer(2021, 43, "2022.03.01."), offer(2019, 57, "2023.07.08.")]
    listed = ls.archive_index(spark.createDataFrame(list(enumerate(pages)), "at int, html string"), page_order="at").collect()
    assert sorted(tuple(r) for r in listed) == [(2019, "57", "2023.07.08."), (2021, "43", "2022.03.01.")]

    def row(day, seq, number, title="관리비공개의무단지 기본정보"):
        return f"""<tr><td>{day}</td><td><ul><li>{title}</li><li>첨부</li></ul></td><td><a onclick='fileDown("{seq}", "03", "{number}")'>받기</a></td></tr>"""

    def latest(html):
        return [tuple(r) for r in ls.latest_attachment(spark.createDataFrame([(html,)], "html string")).collect()]

    # a list inside a table row does not end the row
    table = "<table>" + row("2021-04-05", 7, 2) + row("2022-08-09", 31, 5) + row("2024-01-01", 99, 1, "기타 자료") + "</table>"
    assert latest(table) == [("2022-08-09", "31", "5")]
    assert latest("<ul><li>관리비공개의무단지 기본정보 2020.02.03 <a href=\"fileDown('4','03','6')\"></a></li></ul>") == [("2020-02-03", "4", "6")]
    assert latest("<p>점검 중</p>") == []


def test_lookup_configuration(spark):
    with pytest.raises(ValueError):
        lookups.region_codes(spark, [{"code": "1", "name": "a"}, {"code": "1", "name": "b"}])
    with pytest.raises(ValueError):
        lookups.region_codes(spark, [])


def test_refresh_and_due(spark):
    meta = spark.createDataFrame(
        [("2026-09", "2024-01", "2026-10", False, True, "2025-11"), ("2024-08", "2024-01", "2026-10", False, True, "2024-09"), ("2026-09", "2024-01", "2026-10", True, True, "2024-01"),
         (None, "2024-01", "2026-10", False, True, "2024-01"), ("2026-12", "2024-01", "2027-01", False, True, "2026-02"), ("2026-09", "2024-01", "2026-10", False, False, "2024-01")],
        "previous string, configured string, end string, full boolean, verified boolean, want string",
    )
    assert all(r.refresh_start == r.want for r in inc.with_refresh_start(meta).collect())
    runs = spark.createDataFrame(
        [("schedule", "2026-09", "2026-10", True), ("schedule", "2026-10", "2026-10", False), ("push", "2026-09", "2026-10", True), ("workflow_dispatch", "2026-10", "2026-10", True),
         ("pull_request", None, "2026-10", False), ("schedule", None, "2026-10", True)],
        "event string, published string, closed string, want boolean",
    )
    assert all(r.due == r.want for r in inc.with_due(runs).collect())


def test_three_way_merge(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "path string, value string")
    base = {"same": "1", "local": "1", "remote": "1", "both": "1", "gone_local": "1", "gone_remote": "1", "gone_edited": "1"}
    local = {"same": "1", "local": "2", "remote": "1", "both": "2", "gone_remote": "1", "gone_edited": "2", "new": "9"}
    remote = {"same": "1", "local": "1", "remote": "3", "both": "3", "gone_local": "1"}
    got = {r.path: r.value for r in inc.three_way(make(base), make(local), make(remote), ["path"]).collect()}
    assert got == {"same": "1", "local": "2", "remote": "3", "both": "2", "gone_edited": "2", "new": "9"}


def test_newest_and_diff(spark):
    rows = spark.createDataFrame([("u", i) for i in range(15)] + [("v", 1)], "owner string, at int")
    got = sorted(r.at for r in inc.newest(rows, "owner", [F.desc("at")]).filter("owner = 'u'").collect())
    assert got == list(range(5, 15))
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert {tuple(r) for r in inc.snapshot_diff(a, b, ["x"]).collect()} == {(1, "removed", 1), (2, "removed", 1), (3, "added", 1)}


def test_streamed_cancellation_may_come_first(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "trade string, cancelled boolean"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        updates = tr.active_trades(spark.readStream.schema(schema).parquet(str(source)), ["trade"])
        tr.write_updates(updates, out, str(tmp_path / "cp")).awaitTermination()
        return {r.trade: r.active for r in tr.latest(spark.read.option("basePath", out).parquet(out), ["trade"]).collect()}

    arrive([("a", False), ("b", True), ("c", False), ("c", False)])
    assert run() == {"a": 1, "b": 0, "c": 2}
    arrive([("a", True), ("b", False), ("c", True)])
    assert run() == {"a": 0, "b": 0, "c": 1}


def test_streamed_months_replace_only_what_arrives(spark, tmp_path):
    source, stored = str(tmp_path / "in"), str(tmp_path / "stored")
    schema = "price int, ym string"
    spark.createDataFrame([(1, "2026-08"), (2, "2026-09")], schema).write.partitionBy("ym").parquet(stored)
    spark.createDataFrame([(3, "2026-09"), (4, "2026-10")], schema).write.parquet(source)
    tr.replace_months(spark.readStream.schema(schema).parquet(source), stored, str(tmp_path / "cp")).awaitTermination()
    assert {(r.price, r.ym) for r in spark.read.schema(schema).parquet(stored).collect()} == {(1, "2026-08"), (3, "2026-09"), (4, "2026-10")}


def test_a_month_may_come_in_several_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "price int, run string, response string, ym string"
    spark.createDataFrame([(7, None, None, "2025-01"), (8, None, None, "2025-02")], schema).write.partitionBy("ym").parquet(out)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        tr.replace_months(stream, out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.ym, r.price) for r in spark.read.schema(schema).parquet(out).collect())

    other = ("2025-02", 8)
    assert arrive((1, "b", "p1", "2025-01")) == [("2025-01", 1), other]
    assert arrive((2, "b", "p2", "2025-01")) == [("2025-01", 1), ("2025-01", 2), other]  # the same run goes on
    assert arrive((3, "b", "p1", "2025-01")) == [("2025-01", 2), ("2025-01", 3), other]  # a response sent again
    assert arrive((9, "a", "p1", "2025-01")) == [("2025-01", 2), ("2025-01", 3), other]  # an earlier run, late
    assert arrive((4, "c", "p1", "2025-01"), (5, "c", "p1", "2025-03")) == [("2025-01", 4), other, ("2025-03", 5)]


def test_a_growing_month_keeps_its_files(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    schema = "price int, run string, response string, ym string"
    spark.createDataFrame([(7, "a", "p0", "2025-01")], schema).write.partitionBy("ym").parquet(str(out))

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        tr.replace_months(spark.readStream.schema(schema).parquet(source), str(out), str(tmp_path / "cp")).awaitTermination()
        return {f.name for f in (out / "ym=2025-01").glob("*.parquet")}, sorted(r.price for r in spark.read.schema(schema).parquet(str(out)).collect())

    first, rows = arrive((1, "b", "p1", "2025-01"), (0, "a", "p0", "2025-01"), (5, "b", "p1", None))
    assert rows == [1]
    second, rows = arrive((2, "b", "p2", "2025-01"))
    assert rows == [1, 2] and first < second  # what was stored is not written again
    third, rows = arrive((9, None, "p3", "2025-01"))
    assert rows == [1, 2] and third == second
    fourth, rows = arrive((3, "b", "p2", "2025-01"))
    assert rows == [1, 3] and not second & fourth


def test_documents_are_built_and_parts_are_parsed_once(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        built.add(1)
        return text

    names = [(r, f"이름{i}") for r in ("마포구", "영등포구") for i in range(40)]
    path = str(tmp_path / "parts")
    docs = documents(spark, names).withColumn("json", counted("json"))
    packed = pt.pack_parts(docs, max_bytes=1500).cache()
    pt.write_parts(packed, path)
    assert built.value == 80
    manifest = packed.drop("text")
    rows, problems = pt.load_parts(spark, path, manifest.unionByName(manifest.limit(1)), 81, ROW)
    for f in glob.glob(path + "/file=*/*.txt"):
        os.remove(f)
    found = {(r.guard, r.detail) for r in problems.collect()}
    assert ("part_listed_twice", "2") in found and ("complex_id_twice", "2") in found and not {g for g, _ in found} & {"part"}
    assert rows.select("id").distinct().count() == 80 < rows.count()
