"""Models, sinks, vectors and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from docframe import schemas
from docframe.operators import graph, vectors
from docframe.operators import model as M
from docframe.operators.graph import Link, NodeTable
from docframe.session import stage
from docframe.sources import sinks
from docframe.streaming import status

T0 = datetime.datetime(2024, 1, 1)


def col(name, pk=False, kind="string"):
    return (name, kind, None, pk)


def models(spark, tables, links=()):
    rel = [(*link, "natural_key", None, True, True) for link in links]
    return spark.createDataFrame([("j-1", ("table_graph", [(t, None, cols) for t, cols in tables], rel))], f"job_id string, model {schemas.MODEL}")


def test_lint(spark):
    m = M.normalize_identifiers(models(spark, [("Order", [col("id"), col("9x"), col("!"), col("A b"), col("a-b")]), ("ok", [])]))
    found = {(r.kind, r.column_name, r.problem) for r in M.identifier_errors(m).collect()}
    assert found == {("table", None, "reserved word"), ("column", "id", "reserved for provenance"), ("column", "9x", "starts with a digit"), ("column", "", "empty"), ("column", "a_b", "duplicate")}


def test_downgrades_and_order(spark):
    tables = [("c", [col("x", True), col("p")]), ("p", [col("k", True), col("v"), col("up")])]
    links = [("zz", "x", "p", "k"), ("c", "p", "zz", "k"), ("c", "zz", "p", "k"), ("c", "p", "p", "zz"), ("c", "p", "p", "v"), ("c", "p", "p", "k"), ("p", "up", "p", "k")]
    m = models(spark, tables, links)
    down = M.downgrade_relationships(m).orderBy("rel_no").collect()
    assert [r.enabled for r in down] == [False] * 5 + [True, True]
    assert [r.note and r.note.split(":")[1].split()[0] for r in down[:5]] == ["source_table", "references_table", "column", "column", "p.v"]
    order = M.load_order(m, M.downgrade_relationships(m)).orderBy("load_no").collect()
    assert [(r.table_name, r.depth) for r in order] == [("p", 0), ("c", 1)]
    cycle = models(spark, tables, [("c", "p", "p", "k"), ("p", "up", "c", "x")])
    assert [(r.table_name, r.depth) for r in M.load_order(cycle, M.downgrade_relationships(cycle)).orderBy("load_no").collect()] == [("c", None), ("p", None)]
    ddl = M.render_ddl(m, M.downgrade_relationships(m)).first().ddl
    assert ddl.startswith('CREATE TABLE "job_j_1"."c" (\n    "id" BIGSERIAL PRIMARY KEY,\n    "x" TEXT,') and ddl.count("ADD CONSTRAINT") == 4
    assert "ARRAY<INT>" in M.render_ddl(m, M.downgrade_relationships(m), "spark").first().ddl


def test_schema_of_a_model():
    assert M.model_to_schema([("a", "integer")], ["a", "b"]).simpleString() == "struct<a:bigint,b:string>"


def test_sql_sink(spark):
    parent = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 0, 2)], "k string, chunk_index int, row_no int")
    child = spark.createDataFrame([(1, "a", 0, 0), (2, "zz", 0, 1), (3, None, 0, 2)], "i int, k string, chunk_index int, row_no int")
    sink = sinks.SqlSink(spark, {"parent": ["k"], "child": ["i"]}, [("child", "k", "parent", "k")], materialise=stage)
    assert sink.provision({"parent": parent, "child": child}, "job_x") == {"parent": 2, "child": 2}
    sink.delete_output("job_x")
    assert not spark.catalog.databaseExists("job_x")
    # children given first, and a value that its column can't take
    sink = sinks.SqlSink(spark, {"parent": ["k"]}, [("child", "k", "parent", "k")], materialise=stage, kinds={"parent": {"n": "integer"}})
    assert sink.load_order(["child", "parent"]) == ["parent", "child"]
    typed = spark.createDataFrame([("a", "x", 0, 0), ("b", "7", 0, 1)], "k string, n string, chunk_index int, row_no int")
    got = sink.survivors({"child": child, "parent": typed})
    assert [r.n for r in got["parent"].collect()] == [7] and sorted(r.i for r in got["child"].collect()) == [3]


def test_a_sink_is_chosen_by_name(spark, tmp_path):
    choices = {"sql": lambda: sinks.SqlSink(spark, {}), "graph": lambda: sinks.GraphSink(spark, str(tmp_path))}
    assert isinstance(sinks.sink_for("GRAPH", **choices), sinks.GraphSink)
    with pytest.raises(ValueError, match="graph, sql"):
        sinks.sink_for("tape", **choices)


def test_graph_sink(spark, tmp_path):
    company = NodeTable(spark.createDataFrame([("acme", "Acme Inc")], "company_id string, name string"), {"company_id": "string"}, ("company_id",))
    invoice = NodeTable(spark.createDataFrame([("inv-1", "ACME")], "invoice_id string, company_id string"), {"invoice_id": "string"}, ("invoice_id",), (Link("company_id", "company", "company_id", 0),))
    tables = {"company": company, "invoice": invoice}
    sink = sinks.GraphSink(spark, str(tmp_path))
    for scope in ("job_123", "job_123", "job_789"):
        assert sink.provision(tables, scope) == {"company": 1, "invoice": 1}
    assert sink.read("nodes").filter("__job_scope = 'job_123'").count() == 2
    assert [r.type for r in sink.read("edges").filter("__job_scope = 'job_123'").collect()] == ["INVOICE_TO_COMPANY"]
    sink.delete_output("job_789")
    assert {r[0] for r in sink.read("nodes").select("__job_scope").collect()} == {"job_123"}
    # of rows of one key the last in load order is the node
    twice = NodeTable(spark.createDataFrame([("acme", "zzz", 0), ("ACME", "aaa", 1)], "company_id string, name string, n int"), {"company_id": "string"}, ("n",))
    assert sink.provision({"company": twice}, "job_5") == {"company": 1}
    assert [r.props for r in sink.read("nodes").filter("__job_scope = 'job_5'").collect()] == ['{"company_id":"ACME","name":"aaa","n":1}']


def test_vector_sink(spark, tmp_path):
    rows = spark.createDataFrame([("inv-1", 10.5), ("inv-2", 25.0)], "invoice_id string, total double")
    embedded = vectors.embed_with(rows, lambda texts: [[0.1, 0.2, 0.3, 0.4] for _ in texts], "invoice_id")
    p = vectors.points(embedded, "invoice", "job_456", ["invoice_id", "total"], ["invoice_id"], "embedding")
    sink = sinks.VectorSink(spark, str(tmp_path), lambda made: vectors.embed_with(made, lambda texts: [[0.5] for _ in texts]).withColumnRenamed("embedding", "vector"))
    sink.provision_points(p, "job_456")
    sink.provision_points(p, "job_456")
    got = sink.read().collect()
    assert len(got) == 2 and {r.text for r in got} == {"table: invoice\ninvoice_id: inv-1\ntotal: 10.5", "table: invoice\ninvoice_id: inv-2\ntotal: 25.0"}
    with pytest.raises(ValueError):
        sink.provision_points(p.withColumn("vector", F.lit(None).cast("array<float>")), "job_456")
    invoices = NodeTable(rows, {}, ("invoice_id",))
    assert sink.provision({"invoice": invoices}, "job_7") == {"invoice": 2}
    # a collection that is provisioned again without rows is empty, others stay
    assert sink.provision({"invoice": NodeTable(rows.limit(0), {}, ("invoice_id",))}, "job_7") == {"invoice": 0}
    assert {r[0] for r in sink.read().select("collection").collect()} == {"job_456"}


def test_loads_are_all_or_nothing(spark, tmp_path, monkeypatch):
    """A failure before the last table, or before the manifest, leaves the former output whole in all three sinks."""
    from docframe.sources.published import Published

    a = lambda n: spark.createDataFrame([(f"k{i}", "v", 0, i) for i in range(n)], "k string, v string, chunk_index int, row_no int")
    node = lambda n: {"company": NodeTable(spark.createDataFrame([(f"c{i}", "x") for i in range(n)], "company_id string, name string"), {"company_id": "string"}, ("company_id",)), "invoice": NodeTable(spark.createDataFrame([(f"i{i}", "c0") for i in range(n)], "invoice_id string, company_id string"), {"invoice_id": "string"}, ("invoice_id",), (Link("company_id", "company", "company_id", 0),))}
    embed = lambda made: vectors.embed_with(made, lambda texts: [[0.5] for _ in texts]).withColumnRenamed("embedding", "vector")
    sql = sinks.SqlSink(spark, {"one": ["k"]}, path=str(tmp_path / "sql"))
    graph_sink, points = sinks.GraphSink(spark, str(tmp_path / "graph")), sinks.VectorSink(spark, str(tmp_path / "points"), embed)

    def state():
        tables = {t: (sql.read("job_all", t).count(), spark.table(f"job_all.{t}").count()) for t in ("one", "two")}
        return tables, graph_sink.read("nodes").count(), graph_sink.read("edges").count(), points.read().count()

    def load(n):
        done = []
        for run in (lambda: sql.provision({"one": a(n), "two": a(n)}, "job_all"), lambda: graph_sink.provision(node(n), "g"), lambda: points.provision({"company": node(n)["company"]}, "p")):
            try:
                done.append(run())
            except OSError:
                done.append(None)
        return done

    assert load(3)[0] == {"one": 3, "two": 3}
    before = state()
    assert before == ({"one": (3, 3), "two": (3, 3)}, 6, 3, 3)
    write, publish, n = Published._write, Published._publish, []

    def breaks(self, df, folder, parts):
        n.append(folder)
        write(self, df, folder, parts)
        if "/two/" in folder or "/edges/" in folder or "/points/" in folder:
            raise OSError("disk full")

    monkeypatch.setattr(Published, "_write", breaks)
    assert load(5) == [None, None, None] and state() == before
    monkeypatch.setattr(Published, "_write", write)

    def silent(self, scope, versions):
        raise OSError("gone")

    monkeypatch.setattr(Published, "_publish", silent)
    assert load(5) == [None, None, None] and state() == before
    monkeypatch.setattr(Published, "_publish", publish)
    load(4)
    load(4)
    load(2)
    assert state() == ({"one": (2, 2), "two": (2, 2)}, 4, 2, 2)
    assert len(list((tmp_path / "sql" / "one" / "scope=job_all").iterdir())) == 2, "the former version stays, older ones go"
    sql.delete_output("job_all")
    graph_sink.delete_output("g")
    points.delete_output("p")
    assert not spark.catalog.databaseExists("job_all") and graph_sink.read("nodes").count() == points.read().count() == 0


def test_two_writers_of_a_scope(spark, tmp_path):
    from docframe.sources.published import Published

    one, two = (Published(spark, str(tmp_path)) for _ in range(2))
    df = spark.range(2)
    one.replace("a/b c", {"t": (df, [])})
    numbers = two._numbers
    two._numbers = lambda scope: numbers(scope)[:-1]  # it has looked before the other has published
    with pytest.raises(RuntimeError, match="meanwhile"):
        two.replace("a/b c", {"t": (spark.range(9), [])})
    assert one.read("t", "id long").count() == 2 and one.scopes() == ["a/b c"] and one.read("none", "id long").count() == 0


def test_approximate_retrieval(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    chunks = e.withColumnRenamed("vec_id", "chunk_id")
    exact = {r.chunk_id for r in vectors.retrieve(chunks, e.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")).collect()}
    near = {r.chunk_id for r in vectors.retrieve_approx(chunks, [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]).collect()}
    assert len(exact & near) >= 9


def events(spark, rows):
    return spark.createDataFrame([(j, s, p, m, c, T0 + datetime.timedelta(seconds=t)) for j, s, p, m, c, t in rows], schemas.JOB_EVENT)


EVENTS = [
    ("a", "EXTRACTING", 0.5, None, "pg://x", 1), ("a", "COMPLETED", 1.0, None, None, 2), ("a", "EXTRACTING", 0.1, None, None, 3),
    ("b", "FAILED", 0.0, "boom", None, 1), ("c", "PROFILING", 0.2, None, None, 1), ("c", "EXTRACTING", 0.4, None, None, 4),
]


def test_streams_equal_their_stored_twins(spark, tmp_path):
    from docframe.operators.jobs import latest_status, until_terminal

    source = str(tmp_path / "events")
    for at in range(1, 5):
        events(spark, [e for e in EVENTS if e[-1] == at]).coalesce(1).write.mode("append").parquet(source) if any(e[-1] == at for e in EVENTS) else None
    stream = status.read_events(spark, source, 1)
    q = status.stream_latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    stored = latest_status(events(spark, EVENTS))
    assert sorted(map(tuple, spark.table("latest").collect()), key=repr) == sorted(map(tuple, stored.collect()), key=repr)
    q = status.stream_until_terminal(stream).writeStream.outputMode("append").format("memory").queryName("until").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    twin = until_terminal(events(spark, EVENTS))
    assert sorted(map(tuple, spark.table("until").collect()), key=repr) == sorted(map(tuple, twin.select(*spark.table("until").columns).collect()), key=repr)


def test_a_streamed_feed_equals_the_stored_one(spark, tmp_path):
    """The present state first, then later events; what is kept in the end is that jobs have closed, and nothing of open ones."""
    from docframe.operators.jobs import status_feed
    from docframe.plans.jobs import job_events

    source, since = str(tmp_path / "events"), datetime.datetime(2024, 1, 1, 12)
    every = job_events(spark, "/root/testdata/sf0.001").select("job_id", "event_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    later = every.filter(F.col("ts") > F.lit(since))
    cuts = [since + (later.agg(F.max("ts")).first()[0] - since) * k / 4 for k in range(5)]
    for low, high in zip(cuts, cuts[1:]):
        later.filter((F.col("ts") > F.lit(low)) & (F.col("ts") <= F.lit(high))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)
    feed = status.stream_feed(stream, every, since, order=("ts", "event_id"), keep="40 days", late="1 minute")
    seen = []

    def note(batch, epoch):
        seen.extend((epoch, tuple(r)) for r in batch.collect())

    q = feed.writeStream.foreachBatch(note).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    twin = status_feed(every, F.lit(since), order=("ts", "event_id")).select("job_id", "event_id", "status", "ts", "current")
    assert sorted(r for _, r in seen) == sorted(map(tuple, twin.collect()))
    told = {}
    for epoch, (job, _, _, _, current) in seen:
        assert not (current and job in told), "the present state comes first"
        told[job] = epoch


def test_closed_jobs_are_forgotten(spark, tmp_path):
    source, since = str(tmp_path / "events"), T0
    rows = [(f"j{k}", "FAILED" if k % 2 else "PROFILING", T0 - datetime.timedelta(minutes=k)) for k in range(40)]
    later = [[(f"j{k}", "COMPLETED", T0 + datetime.timedelta(minutes=1 + k)) for k in range(0, 30)], [("x", "PROFILING", T0 + datetime.timedelta(hours=3))], [("x", "FAILED", T0 + datetime.timedelta(hours=9))], [("y", "PROFILING", T0 + datetime.timedelta(hours=20))]]
    frame = lambda r: spark.createDataFrame(r, "job_id string, status string, ts timestamp")
    for r in later:
        frame(r).coalesce(1).write.mode("append").parquet(source)
    feed = status.stream_feed(spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(source), frame(rows), since, keep="2 hours", late="1 minute")
    q = feed.writeStream.outputMode("append").format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    kept = [p["stateOperators"][0]["customMetrics"]["numValueStateVars"] and p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = {(r.job_id, r.status, r.current) for r in spark.table("fed").collect()}
    assert got == {(j, s, True) for j, s, _ in rows} | {(f"j{k}", "COMPLETED", False) for k in range(0, 30, 2)} | {("x", "PROFILING", False), ("x", "FAILED", False), ("y", "PROFILING", False)}
    assert max(kept) >= 40 and kept[-1] == 0, kept


def test_document_stream(spark, tmp_path):
    """Repeated and replayed documents change nothing, changed ones take the place of what they gave before."""
    from docframe.sources.readers import regions_from_text

    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    arrive = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string, day int").coalesce(1).write.mode("append").parquet(source)
    latest = {}

    def run(**options):
        status.stream_documents(spark, source, "doc_id long, text string, day int", regions_from_text, out, check, order=["day"], **options).awaitTermination()
        want = regions_from_text(spark.createDataFrame([(i, t) for i, t in latest.items()], "doc_id long, text string"))
        got = status.read_processed(spark, out).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)

    arrive((1, "a\nb", 1), (2, "c", 1), (3, None, 1), (None, "nobody's", 1))
    latest |= {1: "a\nb", 2: "c"}
    run()
    run()  # nothing new
    arrive((1, "a\nb", 2), (2, "c", 9))  # as they were
    run()
    assert spark.read.parquet(f"{out}/versions").count() == 3
    arrive((1, "z", 3), (1, "y\ny", 4), (4, "new", 3))  # changed, twice in one batch
    latest |= {1: "y\ny", 4: "new"}
    run()
    arrive((2, "", 5))  # nothing is left of it
    del latest[2]
    run()
    arrive((2, "c", 6))
    latest[2] = "c"
    run(files_per_batch=1)
    assert spark.read.parquet(f"{out}/versions").filter("doc_id = 2").count() == 3


def test_a_batch_of_documents_that_runs_again_changes_nothing(spark, tmp_path):
    from docframe.sources.readers import regions_from_text

    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string").write.parquet(source)
    broken = lambda df: regions_from_text(df).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        status.stream_documents(spark, source, "doc_id long, text string", broken, out, check).awaitTermination()
    status.stream_documents(spark, source, "doc_id long, text string", regions_from_text, out, check).awaitTermination()
    assert sorted(r.text for r in status.read_processed(spark, out).collect()) == ["a", "b", "c"]


def test_run_files(spark, tmp_path):
    rows = spark.createDataFrame([("j", "t", 0, 0, {"a": "1"})], "job_id string, table_name string, chunk_index int, row_no int, row map<string,string>")
    sinks.write_buckets(rows, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 1
    updates = spark.createDataFrame([("j", "RUNNING", None, 1), ("j", None, 5, 2)], "job_id string, status string, provisioned_rows int, updated_at int")
    sinks.audit_jobs(updates, str(tmp_path / "a"))
    assert tuple(sinks.read_audit(spark, str(tmp_path / "a")).first()) == ("j", "RUNNING", 5, 2)


def test_a_dump_of_many_jobs_has_few_files_and_loses_none(spark, tmp_path):
    from pathlib import Path

    path, names = str(tmp_path / "b"), ["", None, "007", "7", "a/b=c", "é "]
    many = spark.range(4000).select(F.concat(F.lit("job"), F.col("id") % 1000).alias("job_id"), F.col("id").cast("int").alias("row_no"))
    odd = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "job_id string, row_no int")
    rows = many.repartition(4).unionByName(odd)
    for _ in range(2):  # a dump takes the place of the one before
        sinks.write_buckets(rows, path)
    files = [f for f in Path(path).rglob("part-*") if f.is_file()]
    assert len(files) <= sinks.JOB_FOLDERS
    plain = lambda df: sorted(((r.job_id, r.row_no) for r in df.collect()), key=repr)
    schema = "job_id string, row_no int"
    assert plain(sinks.read_buckets(spark, path, schema)) == plain(rows)
    some = sinks.read_buckets(spark, path, schema, ["job5", "007", "", "none"])
    assert plain(some) == plain(rows.filter("job_id IN ('job5', '007', '')"))
    assert some.select(F.input_file_name()).distinct().count() <= 3
    assert plain(sinks.read_buckets(spark, path, schema, [])) == []
    sinks.write_buckets(rows.limit(0), path)
    assert plain(sinks.read_buckets(spark, path, schema)) == []


def test_a_job_of_many_rows_is_dumped_by_several_tasks(spark, tmp_path):
    from pathlib import Path

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(0, 40_000, 1, 8).select(F.lit("j").alias("job_id"), F.md5(F.col("id").cast("string")).alias("row"))
    kept = spark.conf.get(size)
    try:
        spark.conf.set(size, "200k")
        sinks.write_buckets(rows, str(tmp_path / "b"))
    finally:
        spark.conf.set(size, kept)
    assert len([f for f in Path(tmp_path / "b").rglob("part-*") if f.is_file()]) > 2
    assert sinks.read_buckets(spark, str(tmp_path / "b"), "job_id string, row string", ["j"]).exceptAll(rows).isEmpty()


def test_proposed_model(spark):
    tables = {"p": spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-02-01")], "p_key int, p_name string, p_day string"), "c": spark.createDataFrame([(7, 1, 0.5), (8, 1, 2.0)], "c_id int, c_key int, c_v double")}
    model = M.propose_model(tables, "j").first().model
    assert model.extraction_type == "table_graph"
    assert {c.name: (c.type, c.is_primary_key) for t in model.tables for c in t.columns} == {"p_key": ("integer", True), "p_name": ("string", False), "p_day": ("date", False), "c_id": ("integer", True), "c_key": ("integer", False), "c_v": ("float", False)}
    assert [(r.source_column, r.references_column) for r in model.relationships] == [("c_key", "p_key")]
    assert M.propose_model(tables, "j", lambda t: t["p"]) is tables["p"]


def test_user_reader(spark):
    from docframe.sources.readers import read_with

    files = spark.createDataFrame([("a.pdf", bytearray(b"x y"))], "path string, content binary")
    got = read_with(files, lambda path, content: [{"page_number": 1, "region_type": "text", "text": w} for w in content.decode().split()]).collect()
    assert [(r.region_no, r.text, r.x1) for r in got] == [(0, "x", 0), (1, "y", 0)]


def test_status_feed(spark):
    from docframe.operators.jobs import status_feed, until_terminal

    rows = [("a", "EXTRACTING", 1), ("a", "COMPLETED", 2), ("a", "FAILED", 2), ("a", "MERGING", 2), ("a", "MERGING", 3), ("b", "PROFILING", 1), ("b", "EXTRACTING", 3), ("b", "FAILED", 4)]
    df = spark.createDataFrame(rows, "job_id string, status string, ts int")
    feed = lambda since: sorted((r.job_id, r.ts, r.status, r.current) for r in status_feed(df, F.lit(since)).collect())
    assert sorted((r.job_id, r.ts, r.status) for r in until_terminal(df).collect()) == [("a", 1, "EXTRACTING"), ("a", 2, "COMPLETED"), ("a", 2, "MERGING"), ("b", 1, "PROFILING"), ("b", 3, "EXTRACTING"), ("b", 4, "FAILED")]
    assert feed(2) == [("a", 2, "COMPLETED", True), ("b", 1, "PROFILING", True), ("b", 3, "EXTRACTING", False), ("b", 4, "FAILED", False)]
    assert feed(0) == sorted((j, t, s, False) for j, t, s in [("a", 1, "EXTRACTING"), ("a", 2, "MERGING"), ("a", 2, "COMPLETED"), ("b", 1, "PROFILING"), ("b", 3, "EXTRACTING"), ("b", 4, "FAILED")])


def test_hashed_embedding(spark):
    import math
    from collections import Counter

    from pyspark.ml.feature import HashingTF

    texts = ["a b a", "b c", "", None, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.embedding for r in vectors.hash_embed(df, dimension=16).collect()}
    place = HashingTF(numFeatures=16).indexOf
    counts = [Counter(map(place, (t or "").split())) for t in texts]
    for i, tf in enumerate(counts):
        v = [tf[d] * math.log((len(texts) + 1) / (1 + sum(d in c for c in counts))) for d in range(16)]
        norm = math.sqrt(sum(x * x for x in v))
        assert got[i] == pytest.approx([x / norm if norm else 0 for x in v], abs=1e-6)


def test_stages_can_be_cleared(spark, tmp_path):
    import os
    import urllib.parse

    from docframe import session

    df = stage(spark.range(3), "kept")
    folder = os.path.dirname(urllib.parse.urlparse(df.inputFiles()[0]).path)
    assert df.count() == 3 and os.path.isdir(folder)
    kept, session._paths[spark.sparkContext.applicationId] = session._paths[spark.sparkContext.applicationId], [folder]
    assert session.clear_stages(spark) == 1 and not os.path.isdir(folder)
    session._paths[spark.sparkContext.applicationId] = kept
