import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.clean import clean_cascade
from quarry.plans.stages import Config, Plan, Stage, preflight
from quarry.sources import io
from quarry.sources.records import parse_or_error, read_records
from quarry.streaming.incremental import run_available, windowed_counts

RECORD = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:c="urn:c">
<dc:title xml:lang="en">English</dc:title><dc:title>Other</dc:title>
<c:description><c:type>abstract</c:type><c:notation xml:lang="EN">&lt;p&gt;First  one&lt;/p&gt;</c:notation></c:description>
<c:description><c:type>abstract</c:type><c:notation>Second</c:notation></c:description>
<c:creator><c:personName>A</c:personName><c:affiliationName>X</c:affiliationName></c:creator><c:creator><c:personName>B</c:personName></c:creator>
<c:productIdentifier><c:identifier rdf:datatype="NAID">1</c:identifier></c:productIdentifier>
<c:productIdentifier><c:identifier rdf:datatype="urn:DOI">10.1/x</c:identifier></c:productIdentifier>
<c:publication><c:publicationName>J</c:publicationName><c:volume>7</c:volume></c:publication>
<c:topic dc:title="t1"/><c:topic dc:title="t2"/><c:createdAt>2001</c:createdAt><c:createdAt>2002</c:createdAt></rdf:RDF>"""


def test_records(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.rdf").write_text(RECORD)
    (tmp_path / "b.rdf").write_text("<rdf:RDF")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.file.rpartition("/")[2]: r for r in read_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.rdf", "b.rdf"}
    a = rows["a.rdf"]
    assert (a.title, a.abstract, a.language, a.doi, a.journal, a.volume, a.created_at, a.error) == ("Other", "First one", "en", "10.1/x", "J", "7", "2002", None)
    assert (a.authors, a.affiliations, a.topics, a.related_titles) == (["A", "B"], ["X"], ["t1", "t2"], None)
    assert rows["b.rdf"].error and rows["b.rdf"].title is None
    assert parse_or_error("x", b"<a><notation> <b/> </notation></a>")["abstract"] is None


def test_csv_and_shards(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1,\n,b\n", encoding="utf-8")
    assert [tuple(r) for r in io.read_csv_strings(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect()] == [("1", ""), ("", "b")]
    out = str(tmp_path / "shards")
    io.write_shards(spark.range(10), out, "id", 4)
    io.repair_shards(spark.createDataFrame([(5,)], "id long"), out, "id", 4)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 5, 8, 9]
    assert spark.read.parquet(out).where("shard_id = 1").count() == 1


def test_conform(spark):
    df = io.union_conformed([spark.createDataFrame([("t",)], "title string"), spark.createDataFrame([("f", 1)], "file string, more int")], io.RECORD)
    assert df.columns == [f.name for f in io.RECORD] and df.count() == 2


def test_vectors_from_text(spark):
    df = spark.createDataFrame([("[1, 2]",), ("1,2",), ("x",), (None,)], "t string").select(io.vectors_from_text(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()][:2] == [[1.0, 2.0], [1.0, 2.0]]
    assert {r["size"]: r.n for r in io.vector_sizes(df.limit(2), "v").collect()} == {2: 2}


def test_cascade(spark):
    long = "We measure " + "long text, " * 20
    rows = [("A", long, "en"), ("A", long, "eng"), ("LHD #1", long, "en"), (" ", long, "en"), ("A", "short.", "en"), ("A", "日本" * 60 + "。", "en"), ("A", long, None)]
    kept, other = clean_cascade(spark.createDataFrame(rows, "title string, abstract string, lang string"))
    assert kept.count() == 1 and other.count() == 3


def test_stages_resume(spark, tmp_path):
    ran = []

    def stage(name, fn):
        return Stage(name, lambda s, d: (ran.append(name), fn(s, d))[1])

    made = [stage("a", lambda s, d: s.range(3)), stage("b", lambda s, d: d.where("id > 0"))]
    Plan(str(tmp_path), "r", made).execute(spark)
    assert [x for _, x in Plan(str(tmp_path), "r", made).execute(spark)] == ["skip", "skip"]
    assert [x for _, x in Plan(str(tmp_path), "r", made).execute(spark, force={"a"})] == ["run", "run"]
    assert ran == ["a", "b", "a", "b"]


def test_stages_report_and_keep_their_state(spark, tmp_path):
    counts = lambda d: d.groupBy().count()
    fail = {"now": False}

    def second(s, d):
        if fail["now"]:
            raise RuntimeError("no")
        return d.where("id > 0")

    plan = lambda: Plan(str(tmp_path), "r", [Stage("a", lambda s, d: s.range(3), report=counts), Stage("b", second, needs=("id",))])
    plan().execute(spark)
    assert plan().state(spark) == {"a": "run", "b": "run"} and spark.read.parquet(plan().path("a") + ".report").first()[0] == 3
    fail["now"] = True
    with pytest.raises(RuntimeError):
        plan().execute(spark, force={"b"})
    assert plan().state(spark) == {"a": "skip", "b": "failed"} and spark.read.parquet(plan().path("b")).count() == 2
    assert [x for _, x in plan().execute(spark, force={"a"}, skip={"b"})] == ["run", "skip"]
    assert [x for _, x in plan().execute(spark, only_reports=True)] == ["skip", "skip"]
    with pytest.raises(ValueError, match="no output"):
        Plan(str(tmp_path), "new", plan().stages).execute(spark, skip={"a"})


def test_preflight_and_config(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t"))
    assert preflight(spark, {str(tmp_path / "t"): ("id",)}, 1, str(tmp_path)) == []
    found = preflight(spark, {str(tmp_path / "t"): ("id", "x"), str(tmp_path / "u"): ()}, 1 << 60, str(tmp_path))
    assert [x.rpartition("/")[2].split()[1] for x in found[:2]] == ["lacks", "is"] and "free" in found[2]
    assert Config.from_environment({"QUARRY_RAW": "/x"}, base="/y") == Config("/x", "/y")


def test_incremental(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for n in (3, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(src)
        run_available(spark, src, spark.range(1).schema, out, ck, lambda d: d.where("id > 0"))
    assert spark.read.parquet(out).count() == 2 + 4


def test_windowed_stream(spark, tmp_path):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 05:00:00', 'a', 2.0D")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) n from w").first().n == 1  # the last window is still open


def test_outputs_are_replaced_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "o")
    io.replace(spark.range(3), out)
    broken = spark.range(5).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        io.replace(broken, out)
    assert spark.read.parquet(out).count() == 3
    io.replace(spark.range(4), out)
    assert spark.read.parquet(out).count() == 4 and not (tmp_path / "o.old").exists()


def test_csv_with_mark_and_without_lists(spark, tmp_path):
    df = spark.createDataFrame([("é", ["x", "y"])], "a string, l array<string>").coalesce(1)
    io.write_csv(df, str(tmp_path / "m"), bom=True, lists="drop")
    (written,) = (tmp_path / "m").glob("part-*.csv")
    assert written.read_bytes() == b"\xef\xbb\xbfa\n\xc3\xa9\n"
    io.write_csv(df, str(tmp_path / "n"))
    (written,) = (tmp_path / "n").glob("part-*.csv")
    assert written.read_text() == "a,l\né,x; y\n"


def test_positions_and_exact_shards(spark, tmp_path):
    df = spark.range(0, 103).select((F.col("id") * 37 % 101).alias("v"), "id").repartition(5)
    placed = {r.id: r.position for r in io.with_position(df, "v", "id").collect()}
    expected = sorted(range(103), key=lambda i: (i * 37 % 101, i))
    assert [placed[i] for i in expected] == list(range(103))
    assert sorted(r.position for r in io.rows_between(io.with_position(df, "id"), 7, 11).collect()) == [7, 8, 9, 10]
    out = str(tmp_path / "s")
    io.write_exact_shards(df, out, 25, "id")
    sizes = {r.shard_id: r["count"] for r in spark.read.parquet(out).groupBy("shard_id").count().collect()}
    assert sizes == {0: 25, 1: 25, 2: 25, 3: 25, 4: 3} and io.completed_shards(spark, out) == [0, 1, 2, 3, 4]
    io.replace(spark.createDataFrame([(1, 25), (4, 3)], "shard_id long, n long"), out + ".manifest")
    assert io.read_completed(spark, out).count() == 28
    assert io.with_position(df.limit(0), "v").count() == 0


def test_batches_are_merged(spark, tmp_path):
    spark.createDataFrame([("t",)], "title string").write.parquet(str(tmp_path / "b" / "batch_1"))
    spark.createDataFrame([("f", "u")], "file string, title string").write.parquet(str(tmp_path / "b" / "batch_2"))
    assert io.merge_batches(spark, str(tmp_path / "b"), str(tmp_path / "all"), io.RECORD) == 2
    assert {r.title for r in spark.read.parquet(str(tmp_path / "all")).collect()} == {"t", "u"} and not list((tmp_path / "b").iterdir())
    assert io.merge_batches(spark, str(tmp_path / "b"), str(tmp_path / "all"), io.RECORD) == 0


def test_unreadable_files_are_named(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "broken.parquet").write_bytes(b"PAR1 not at all")
    assert io.read_tolerant(spark, str(tmp_path / "p"), spark.range(1).schema).count() == 3
    (found,) = io.unreadable(spark, str(tmp_path / "p"), spark.range(1).schema)
    assert found.endswith("broken.parquet")


def test_folders_are_sampled_and_copied(spark, tmp_path):
    for k in range(6):
        (tmp_path / "src" / f"d{k}").mkdir(parents=True)
        (tmp_path / "src" / f"d{k}" / "x").write_text(str(k))
    a = io.copy_sample(spark, str(tmp_path / "src"), str(tmp_path / "to"), 3, seed=4)
    assert len(a) == 3 and sorted(p.name for p in (tmp_path / "to").iterdir()) == a == io.copy_sample(spark, str(tmp_path / "src"), str(tmp_path / "again"), 3, seed=4)
    assert io.copy_sample(spark, str(tmp_path / "src"), str(tmp_path / "first"), 2) == ["d0", "d1"]


def test_models_and_index_files(spark, tmp_path):
    weights = {"bb.0": np.arange(6.0).reshape(2, 3), "head": np.zeros(2)}
    io.save_model(spark, str(tmp_path / "m"), weights, {"div": ["a", "b"]}, {"acc": 0.5})
    got, classes, metrics = io.load_model(spark, str(tmp_path / "m"), {"bb.": "backbone."})
    assert set(got) == {"backbone.0", "head"} and (got["backbone.0"] == weights["bb.0"]).all() and classes == {"div": ["a", "b"]} and metrics == {"acc": 0.5}
    io.write_index(spark.range(5).coalesce(1), str(tmp_path / "i"), batch=2)
    parts = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "i" / "documents").glob("part-*"))
    assert parts == [1, 2, 2] and "typo" in (tmp_path / "i" / "settings.json").read_text()


def test_cascade_detects_the_language(spark):
    long = "We measure the time of the flight, and it is in the range that was expected for this kind of a particle in air."
    german = "Wir messen die Zeit und die Länge, und das ist in dem Bereich, der für eine solche Messung auch nicht zu klein ist."
    kept, other = clean_cascade(spark.createDataFrame([("A", long), ("B", german), ("C", "1234567890, " * 10)], "title string, abstract string"))
    assert [r.abstract_lang for r in kept.collect()] == ["en"] and sorted(r.abstract_lang for r in other.collect()) == ["de", "unknown"]


def test_cleaned_texts_are_made_once(spark):
    df = spark.createDataFrame([("A", "text", "en")], "title string, abstract string, lang string")
    from quarry.functions import text as T

    kept, _ = clean_cascade(df, T.basic_unescape)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\\[a-zA-Z]+\\{") <= 2 and plan.count("lower(btrim(regexp_replace") <= 1


def test_references_are_resolved(spark):
    from quarry.functions import text as T

    df = spark.createDataFrame([("caf&eacute; &#233; &lt;b&gt;x &amp;lt;",)], "t string")
    r = df.select(T.decode_abstract(F.col("t")).alias("d"), T.clean_text(F.col("t")).alias("c")).first()
    assert r.d == "café é x &lt;" and r.c == "café é <b>x &lt;"


def test_row_groups_are_read_alone(spark, tmp_path):
    """One row group of four is broken: its rows are counted as lost, the others are whole; so with a file without a footer."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    folder = tmp_path / "g"
    folder.mkdir()
    made = pa.table({"id": list(range(400)), "t": [f"text {i}" for i in range(400)], "extra": [0.5] * 400})
    pq.write_table(made, folder / "a.parquet", row_group_size=100)
    pq.write_table(made.slice(0, 0), folder / "empty.parquet")
    pq.write_table(made.select(["id"]).slice(0, 5), folder / "narrow.parquet")
    (folder / "broken.parquet").write_bytes(b"PAR1 not at all")
    chunk = pq.ParquetFile(folder / "a.parquet").metadata.row_group(2).column(1)
    start = min(x for x in (chunk.data_page_offset, chunk.dictionary_page_offset) if x)
    raw = bytearray((folder / "a.parquet").read_bytes())
    raw[start : start + chunk.total_compressed_size] = b"\xff" * chunk.total_compressed_size
    (folder / "a.parquet").write_bytes(raw)
    schema = StructType([StructField("t", StringType()), StructField("id", LongType()), StructField("none", StringType())])
    rows = io.read_row_groups(spark, str(folder), schema).collect()
    good = [r for r in rows if r._error is None]
    assert sorted(r.id for r in good) == sorted([*range(200), *range(300, 400), *range(5)])
    assert all(r.none is None and r.t == (None if r._path.endswith("narrow.parquet") else f"text {r.id}") for r in good)
    lost = {(r._path.rsplit("/", 1)[1], r._row_group): r._lost for r in rows if r._error is not None}
    assert lost == {("a.parquet", 2): 100, ("broken.parquet", None): None}
    assert [p.rsplit("/", 1)[1] for p in io.unreadable(spark, str(folder), StructType([StructField("id", LongType())]))] == ["broken.parquet"]
