import json

import pytest
from pyspark.sql import functions as F

from rosterline import sources
from rosterline.operators import release
from rosterline.sources import contract


def test_registry_gets_synthetic_keys_and_refuses_repeats(spark, tmp_path):
    path = str(tmp_path / "registry")
    schema = "detention_facility_code string, name string, latitude double, geometry binary"
    spark.createDataFrame([("A", "Lake", float("nan"), None), (None, "Hill (North)", 1.0, None)], schema).write.parquet(path)
    rows = {r.detention_facility_code: r.latitude for r in sources.load_registry(spark, path).collect()}
    assert rows == {"A": None, "SYNTH-HILL-NORTH": 1.0}
    assert "geometry" not in sources.load_registry(spark, path).columns
    spark.createDataFrame([("A", "Again", 1.0, None)], schema).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="duplicate"):
        sources.load_registry(spark, path)


def test_events_are_pruned_and_parsed_leniently(spark, tmp_path):
    path = str(tmp_path / "stays")
    spark.createDataFrame([("p", "2026-01-01 10:00:00", 1), ("q", "soon", 2)], "id string, at string, other int").write.parquet(path)
    df = sources.load_events(spark, path, ["id", "at"], timestamps=["at"])
    assert df.columns == ["id", "at"] and [r.at is None for r in df.orderBy("id").collect()] == [False, True]
    assert "other" not in df._jdf.queryExecution().executedPlan().toString()


def test_header_is_located_by_content(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    body = "\n".join(f"Place {i},{i} Road,TX" for i in range(200))
    path.write_text('Title,,\n"Notes, with comma",,\n,,\n Name , Address,State\n' + body + "\n,no name,TX\n")
    df = sources.read_located_header(spark, str(path), ["name", "address"])
    assert df.columns == ["Name", "Address", "State"] and df.count() == 200
    assert df.filter("Name = 'Place 7'").first().Address == "7 Road"
    with pytest.raises(ValueError, match="no header"):
        sources.read_located_header(spark, str(path), ["zip"])


def test_located_header_in_a_split_file(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("x\nName,Address\n" + "\n".join(f"n{i},a{i}" for i in range(20_000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = sources.read_located_header(spark, str(path), ["name", "address"])
        assert df.rdd.getNumPartitions() > 3
        assert df.count() == df.select("Name").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers_of_many_files_lie_where_they_lie(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(40):
        titles = "".join(f'"Title, with ""quotes"" {k}",,\n' for k in range(i % 7))
        (folder / f"part {i:02d}.csv").write_text(titles + f' Name ,"Address",State\n"Place, {i}",{i} Road,TX\n')
    df = sources.read_located_header(spark, str(folder), ["name", "address"])
    assert df.columns == ["Name", "Address", "State"]
    assert {(r.Name, r.Address) for r in df.collect()} == {(f"Place, {i}", f"{i} Road") for i in range(40)}
    (folder / "part 40.csv").write_text("Address,Name\nx,y\n")
    with pytest.raises(ValueError, match="disagree"):
        sources.read_located_header(spark, str(folder), ["name", "address"])
    (folder / "part 41.csv").write_text("nothing here\n")
    with pytest.raises(ValueError, match="part%2041"):
        sources.read_located_header(spark, str(folder), ["name", "address"])


def test_gazetteer_files(spark, tmp_path):
    head = "USPS\tNAME \tALAND\tINTPTLAT\tINTPTLONG   \n"
    places = tmp_path / "places.txt"
    places.write_text(head + "tx\tAustin city\t 10\t30.1\t-97.5 \nTX\tBad\t1\tn/a\t1\nTX\tSmall CDP\t\t1\t2\nTX\tOdd\tx\t1\t2\n")
    got = {r.name: (r.state, r.area, r.longitude) for r in sources.load_places(spark, str(places)).collect()}
    assert got == {"Austin city": ("TX", 10.0, -97.5), "Small CDP": ("TX", 0.0, 2.0)}
    counties = tmp_path / "counties.txt"
    counties.write_text(head + "TX\tTravis County\t1\t30\t-97\nTX\tBad County\t1\t\t\n")
    assert [r.name for r in sources.load_counties(spark, str(counties)).collect()] == ["Travis County"]


def test_overrides(spark, tmp_path):
    keys = tmp_path / "keys.csv"
    keys.write_text('ice_name,state,detention_facility_code,evidence\n" Lake, Jail ",tx,A1,"said ""so"", twice"\n'
                    "Hill,TX,,none\nlake,TX,B1,\nLake,tx, B2 ,\n")
    got = {(r.name_key, r.state): r.code for r in sources.load_key_overrides(spark, str(keys)).collect()}
    assert got == {("LAKE, JAIL", "TX"): "A1", ("LAKE", "TX"): "B2"}
    assert sources.load_key_overrides(spark, str(tmp_path / "absent.csv")).isEmpty()
    points = tmp_path / "points.csv"
    points.write_text("name,state,latitude,longitude,precision,matched_to,evidence\n"
                      'Agana,gu,13.4,144.7,manual_city_centroid,"Hagatna, GU", old name \nBad,GU,x,1,,,\nPlain,GU,1,2,,,\n')
    got = {r.name_key: r.located for r in sources.load_location_overrides(spark, str(points)).collect()}
    assert set(got) == {"AGANA", "PLAIN"}
    assert got["AGANA"].matched_to == "Hagatna, GU" and got["AGANA"].source == "Hand-placed: old name"
    assert got["PLAIN"].precision == "manual" and got["PLAIN"].matched_to == ""


def test_newest_release_goes_by_the_date_in_the_name(spark, tmp_path):
    for name in ("FY26_stats01152026.xlsx", "FY25_stats12312025.xlsx", "FY27_notes.xlsx"):
        (tmp_path / name).write_text("x")
    files = sources.release_files(spark, str(tmp_path))
    assert sources.newest_release(files).first().file_name == "FY26_stats01152026.xlsx"
    assert sources.newest_release(files, by="name").first().file_name == "FY27_notes.xlsx"


def test_contract_and_provenance(spark):
    df = spark.range(10)
    assert contract.require_contract(df, ["id"], 10) is df
    with pytest.raises(ValueError, match="missing columns: x"):
        contract.require_contract(df, ["id", "x"])
    with pytest.raises(ValueError, match="at least 11"):
        contract.require_contract(df, ["id"], 11)
    row = contract.provenance(df, "ids", as_of="2026-08-01").first()
    assert (row.source, row.as_of, row.rows, row.url) == ("ids", "2026-08-01", 10, None)


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(100)], "i int, t string")
    for algorithm in ("xxhash64", "md5"):
        base = contract.table_fingerprint(df, algorithm).first()
        assert base == contract.table_fingerprint(df.orderBy(F.desc("i")).repartition(7), algorithm).first()
        changed = df.withColumn("t", F.when(F.col("i") == 5, "y").otherwise(F.col("t")))
        assert base != contract.table_fingerprint(changed, algorithm).first()
        assert base != contract.table_fingerprint(df.unionByName(df.limit(1)), algorithm).first()


def test_needs_build(spark):
    old = contract.fingerprint_table({"a": spark.range(3), "b": spark.range(4)})
    same = contract.fingerprint_table({"b": spark.range(4), "a": spark.range(3)})
    new = contract.fingerprint_table({"a": spark.range(3), "c": spark.range(5)})
    assert not contract.needs_build(old, same)
    assert contract.needs_build(old, same, force=True) and contract.needs_build(old, same, outputs_exist=False)
    assert contract.needs_build(old, new)
    states = {r.source: r.state for r in contract.changed_sources(old, new).collect()}
    assert states == {"a": "unchanged", "b": "removed", "c": "added"}


def test_release_collection_keeps_the_last_of_a_code(spark, tmp_path):
    def feature(code, adp, **extra):
        return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-97.0, 38.0]},
                "properties": {"code": code, "name": "N", "adp": adp, "inspection": {"last_rating": "Pass"}, **extra}}

    path = tmp_path / "release.json"
    path.write_text(json.dumps({
        "metadata": {"sources": [{"source": "first", "as_of": "2026-07-20"}, {"source": "x", "as_of": "2026-01-01"}]},
        "features": [feature("A", 1.0), feature("", 2.0), feature(None, 3.0), feature("A", 4.5)]}, indent=1))
    df = sources.load_release(spark, str(path), form="collection")
    assert [(r.code, r.adp, r.as_of, r.last_rating) for r in df.collect()] == [("A", 4.5, "2026-07-20", "Pass")]
    assert release.release_diff(df, df).isEmpty()


def test_diff_and_profile_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "added", "x"), ("B", "removed", "y")], "code string, change_type string, detail string")
    sources.write_diff(df, str(tmp_path / "diff"))
    assert spark.read.json(str(tmp_path / "diff")).filter("change_type = 'added'").first().code == "A"
    stats = spark.createDataFrame([("A", 3)], "code string, n int")
    cells = spark.createDataFrame([("A", "g", "x", 1)], "code string, dim string, value string, n int")
    sources.write_profiles(stats, cells, str(tmp_path / "profiles"))
    assert spark.read.parquet(str(tmp_path / "profiles/cells")).first().dim == "g"


def test_the_last_line_over_several_files_wins(spark, tmp_path):
    folder = tmp_path / "overrides"
    folder.mkdir()
    head = "ice_name,state,detention_facility_code\n"
    (folder / "a.csv").write_text(head + "Lake,TX,FIRST\n")
    (folder / "b.csv").write_text(head + "Hill,TX,OTHER\n" * 500 + "Lake,TX,LAST\n")
    codes = {r.name_key: r.code for r in sources.load_key_overrides(spark, str(folder)).collect()}
    assert codes == {"LAKE": "LAST", "HILL": "OTHER"}


def test_fingerprint_tells_null_from_text(spark):
    one = spark.createDataFrame([(None,)], "t string")
    for text in ("\\N", "n", ""):
        other = spark.createDataFrame([(text,)], "t string")
        for algorithm in ("md5", "xxhash64"):
            prints = [contract.table_fingerprint(df, algorithm).first().fingerprint for df in (one, other)]
            assert prints[0] != prints[1]
