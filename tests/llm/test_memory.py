"""The pipeline's Python tasks hold small batches and a small cache: an executor keeps the memory of all stages."""

import pyarrow as pa
import pytest

import corpus_pipeline
from docframe.llm.bpe import PieceEncoder, encoder, vocabulary_path
from docframe.llm.common import BATCH_BYTES
from docframe.llm.exact_dedup import drop_exact_copies
from docframe.llm.packing import pack

DATA = "/root/testdata/sf0.001"
CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("step", ["quality", "near_dedup", "pack"])
def test_stages_send_small_batches(spark, step):
    def sizes(batches):  # workers can't import this module
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    session = spark.newSession()
    docs = session.read.parquet(f"{DATA}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[step](session, docs, DATA)
    long = session.range(0, 9000, 1, 1).selectExpr("id", "repeat('word ', 400) AS text")
    got = long.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 9000 and max(r.bytes for r in got) < 1.1 * BATCH_BYTES
    assert out.count() > 0


def test_a_bound_of_the_user_stays(spark):
    session = spark.newSession()
    session.conf.set(CONF, "1m")
    corpus_pipeline.pack_windows(session, session.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert session.conf.get(CONF) == "1m"


def test_cache_size_changes_no_ids(spark):
    path = vocabulary_path()
    small, usual = encoder(path, 40), encoder(path)
    assert small is encoder(path, 40) and small is not usual and isinstance(small, PieceEncoder)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).coalesce(1)
    texts = [r.text for r in docs.collect()]
    assert small.encode(texts) == usual.encode(texts) and len(small._pieces) <= 40
    assert sorted(pack(docs, cache_pieces=40).collect()) == sorted(pack(docs).collect())


def test_exact_copies_shuffle_whole_rows_once(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(1, "a b"), (1, "a b"), (None, "a  b"), (None, "only"), (None, "only"), (2, "a\tb"), (0, None), (3, ""), (1, "other")]
    docs = session.createDataFrame(rows, "doc_id long, text string")
    kept = drop_exact_copies(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # whole rows, and the groups' digests
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a b"), (None, "only"), (0, None), (1, "other")], key=repr)
