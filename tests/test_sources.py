from pyspark.sql import functions as F

from lakestone import sources as io
from lakestone.schemas import EVENTS_RAW, READINGS_RAW
from lakestone.session import local_path


def test_csv_four_null_tokens(spark, scratch, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        "sensor_id,timestamp,ubicacion,temperatura_c,humedad_pct,velocidad_viento_ms,presion_hpa,seeing_arcsec,transparencia\n"
        "SENS-001,2024-03-01T00:00:00,Norte,16.5,NA,5.1,745.2,0.61,0.9\n"
        "NULL,2024-03-01T00:05:00,null,,10.0,5.2,745.3,0.62,NA\n", encoding="utf-8")
    df = io.read_csv_tokens(spark, str(path), READINGS_RAW)
    rows = df.collect()
    assert rows[0].humedad_pct is None and rows[0].temperatura_c == 16.5
    assert rows[1].sensor_id is None and rows[1].ubicacion is None and rows[1].temperatura_c is None
    assert rows[1].transparencia is None
    assert dict(df.dtypes)["timestamp"] == "string"


def test_ndjson_roundtrip_keeps_nulls_and_accents(spark, scratch):
    rows = [("OBS-2024-0001", None, "2024-03-01T20:00:00", "M31 (Andrómeda)", 1.5, 10.0, -20.0, 30, "Espectrógrafo", "completada")]
    df = spark.createDataFrame(rows, EVENTS_RAW)
    path = io.write_ndjson(df, scratch("ev"))
    text = "".join(open(f, encoding="utf-8").read() for f in __import__("glob").glob(local_path(path) + "/*.json"))
    assert '"sensor_id":null' in text and "Andrómeda" in text
    back = io.read_ndjson(spark, path, EVENTS_RAW)
    assert back.collect() == df.collect()


def test_csv_written_by_other_tools(spark, tmp_path):
    schema = "t string, n int"
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(schema)
    path = tmp_path / "c.csv"
    path.write_text('t,n\n"say ""hi""",1\n"say ""hi"", ok",2\n"ends in \\",3\n  pad ,4\nNA,5\n', encoding="utf-8")
    got = {r.n: r.t for r in io.read_csv_tokens(spark, str(path), schema).collect()}
    assert got == {1: 'say "hi"', 2: 'say "hi", ok', 3: "ends in \\", 4: "  pad ", 5: None}
    lines = tmp_path / "l.csv"
    lines.write_text('t,n\n"two\nlines",1\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_csv_tokens(spark, str(lines), schema, multi_line=True).collect()] == [("two\nlines", 1)]


def test_csv_keeps_blanks_and_quotes(spark, scratch):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("t string, n int")
    rows = [("  pad ", 1), ('"q", x', 2), ("back\\", 3), (None, 4), ('\\"', 5)]
    path = io.write_csv(spark.createDataFrame(rows, schema), scratch("csv"))
    assert sorted(tuple(r) for r in io.read_csv_tokens(spark, path, schema).collect() if r.t) == sorted(r for r in rows if r[0])


def test_json_document_nested_access(spark, scratch):
    doc = spark.sql("SELECT map('t', named_struct('filas_validas', 7)) AS fuentes, named_struct('gold', array(1, 2, 3)) AS etapas")
    path = io.write_json_document(doc, scratch("doc"))
    got = io.read_json_document(spark, path).select(F.col("fuentes.t.filas_validas").alias("v"),
                                                    F.size("etapas.gold").alias("n")).first()
    assert (got.v, got.n) == (7, 3)


def test_discover_takes_every_form_of_a_folder(spark, scratch):
    import pytest
    base = local_path(scratch("forms"))
    base = "/" + base.lstrip("/")
    for name in ("b", "a"):
        io.write_parquet(spark.range(3), f"{base}/{name}.parquet")
    for form in (base, f"file:{base}", f"file://{base}", base + "/"):
        assert [p.rsplit("/", 1)[-1] for p in io.discover(spark, form, "*.parquet")] == ["a.parquet", "b.parquet"], form
    with pytest.raises(FileNotFoundError):
        io.discover(spark, base, "*.orc")


def test_discover_inventory_upload(spark, scratch):
    base = scratch("lake_src")
    for name in ("b", "a"):
        io.write_parquet(spark.range(5 if name == "a" else 3), f"{base}/{name}.parquet")
    found = io.discover(spark, base, "*.parquet")
    assert found == sorted(found) and len(found) >= 2
    inv = io.inventory(spark, base, "*.parquet").collect()
    assert all(r.size_kb > 0 for r in inv)
    assert [p.rsplit("/", 1)[-1] for p in found] == ["a.parquet", "b.parquet"]
    lake = scratch("lake")
    from lakestone.plans.gold import table_totals
    io.upload_tables(spark, found, lake)
    totals = {r.tabla: r.filas for r in table_totals(spark, lake, ["a", "b"]).collect()}
    assert totals == {"a": 5, "b": 3, "total": 8}


def test_lake_options_reach_the_session(spark):
    from lakestone.sources.lake import configure_lake, s3a_options
    opts = s3a_options("storage:9000", "user", "secret", ssl=False, path_style=True)
    assert opts["fs.s3a.connection.ssl.enabled"] == "false" and opts["fs.s3a.path.style.access"] == "true"
    configure_lake(spark, opts)
    assert spark.conf.get("fs.s3a.endpoint") == "storage:9000"
    from lakestone.sources.readers import table_path
    assert table_path("s3a://bucket/prefix/", "lecturas_limpias") == "s3a://bucket/prefix/lecturas_limpias.parquet"
    for k in opts:
        spark.conf.unset(k)


def test_variant_document_needs_no_schema(spark, tmp_path):
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "a.json").write_text('{"s": {"x": {"n": 5, "r": {"a.b": {"p": 2}, "c": {"p": 2.5, "q": [1, 2]}}},\n "y": null, "z": {"n": 1}}}')
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    doc = io.read_variant_document(spark, str(tmp_path / "doc"))
    sources = io.members(doc, F.variant_get("doc", "$.s", "variant"), "source", "v")
    rules = io.members(sources, F.variant_get("v", "$.r", "variant"), "rule", "w")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before  # nothing has run so far
    got = rules.select("source", "rule", F.variant_get("v", "$.n", "int"), F.variant_get("w", "$.p", "double"),
                       F.size(F.variant_get("w", "$.q", "array<variant>"))).collect()
    calls = sorted(tuple(r) for r in got)
    assert [c[:4] for c in calls] == [("x", "a.b", 5, 2.0), ("x", "c", 5, 2.5)] and calls[1][4] == 2
    assert sorted(r.source for r in sources.collect()) == ["x", "y", "z"]
