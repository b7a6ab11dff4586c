import random

import pytest
from pyspark.sql import functions as F

from docframe.operators import extract, text
from docframe.sources import readers


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")


def test_line_chunks_by_hand(spark):
    full = "--- Page 2 ---\n  first line \n\nsecond\n--- Page 3 ---\n" + "x" * 70 + "\nlast\n--- Page 9 ---"
    rows = text.chunk_lines(documents(spark, [full, "", "  \n", "--- Page x ---\na"]), 60, 10).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.chunk_text, r.page_number) for r in rows] == [
        (0, 0, "first line\nsecond", 3), (0, 1, "ine\nsecond\n" + "x" * 70, 3), (0, 2, "x" * 10 + "\nlast", 9), (3, 0, "a", 1),
    ]


def test_line_chunks_hold_every_line_once(spark):
    """Chunks overlap by the end of the one before; without overlaps they are the lines in order, and only a line too long by itself exceeds the size."""
    rng, size, overlap = random.Random(4), 60, 10
    texts = ["\n".join("".join(rng.choices("abé ", k=rng.randint(0, 45))) if rng.random() < 0.9 else f"--- Page {rng.randint(1, 9)} ---" for _ in range(rng.randint(1, 40))) for _ in range(30)]
    got = {}
    for r in text.chunk_lines(documents(spark, texts), size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, full in enumerate(texts):
        lines = [x.strip() for x in full.split("\n") if x.strip() and not x.startswith("--- Page")]
        chunks, at = got.get(k, []), 0
        assert [r.chunk_index for r in chunks] == list(range(len(chunks)))
        for n, r in enumerate(chunks):
            body = r.chunk_text
            own = max(m for m in range(1, len(lines) - at + 1) if body.endswith("\n".join(lines[at : at + m])))
            tail = body[: len(body) - len("\n".join(lines[at : at + own]))].rstrip("\n")
            at += own
            assert (n == 0 and tail == "") or (n > 0 and chunks[n - 1].chunk_text.endswith(tail) and len(tail) <= overlap)
            assert len(body) <= size or own == 1
        assert at == len(lines)


def test_paragraph_chunks(spark):
    short = "  --- Page 1 ---\nkept as it is  "
    long = "--- Page 1 ---\n" + "a" * 30 + "\n\n" + "b" * 100 + "\n\n--- Page 2 ---\n" + "c" * 20
    rows = text.chunk_paragraphs(documents(spark, [short, long]), 60, 10).orderBy("doc_id", "chunk_index").collect()
    assert rows[0].text == short and rows[0].pages == [1] and (rows[0].start_char, rows[0].end_char) == (0, len(short))
    chunks = rows[1:]
    assert chunks[0].text == "--- Page 1 ---\n" + "a" * 30 and chunks[0].start_char == 2 and chunks[0].pages == [1]
    assert chunks[1].text == "a" * 10 + "\n\n" + "b" * 100 and chunks[1].pages == []
    assert chunks[2].text == "b" * 10 + "\n\n--- Page 2 ---\n" + "c" * 20 and chunks[2].pages == [2]


def sampled(spark, kinds):
    df = spark.createDataFrame([(1, p, k) for p, k in kinds.items()], "doc_id int, page_number int, n_types int")
    return sorted(r.page_number for r in text.sample_pages(df).collect())


@pytest.mark.parametrize("n", [0, 1, 3, 5, 15])
def test_short_documents_are_sampled_whole(spark, n):
    assert sampled(spark, {p: 1 for p in range(1, n + 1)}) == list(range(1, n + 1))


def test_sampled_pages_by_hand(spark):
    # 20 pages: the ends, the three most diverse between them (7, 9, then the lower of 11 and 13), and every second page until there are 15
    kinds = {p: 1 for p in range(1, 21)} | {7: 4, 9: 4, 11: 3, 13: 3}
    assert sampled(spark, kinds) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14, 16, 19, 20]
    # diversity at the ends takes no place of the inner ones
    assert {4, 5, 6} <= set(sampled(spark, {p: 9 if p in (1, 2, 40) else 1 for p in range(1, 41)}))


@pytest.mark.parametrize("n", [16, 40, 200])
def test_sampled_pages_have_ends_diversity_and_a_bound(spark, n):
    kinds = {p: 1 + (p * 7) % 4 for p in range(1, n + 1)}
    got = sampled(spark, kinds)
    inner = sorted((p for p in kinds if 3 < p < n - 1), key=lambda p: (-kinds[p], p))[:3]
    assert {1, 2, 3, n - 1, n, *inner} <= set(got) and len(set(got)) == len(got) <= 15


def test_page_route(spark):
    pages = [("", 0), ("%%% ---", 0), ("a" * 99, 1), ("a" * 100, 1), ("a" * 99, 0), ("éé éé a", 0), (None, 0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "k int, t string, i int")
    assert [r[0] for r in df.orderBy("k").select(text.route_page(F.col("t"), F.col("i"))).collect()] == ["ocr", "ocr", "ocr", "native", "native", "ocr", "ocr"]


def test_routing(spark):
    chunks = spark.createDataFrame([(1, 0, [1]), (1, 1, [2, 3]), (1, 2, [])], "doc_id int, chunk_index int, pages array<int>")
    tables = spark.createDataFrame([(1, t) for t in ("free", "early", "nowhere")], "doc_id int, table_name string")
    sections = spark.createDataFrame([(1, "early", 1, 2), (1, "nowhere", 9, 9)], "doc_id int, table_name string, first_page int, last_page int")
    got = {(r.table_name, r.chunk_index) for r in extract.route_chunks(chunks, tables, sections).collect()}
    assert got == {("free", 0), ("free", 1), ("free", 2), ("early", 0), ("early", 1)}


def test_layout_files(spark, tmp_path):
    (tmp_path / "ocr_result.json").write_text('{"page_count": 1, "pages": [{"page_number": 1, "width": 10, "height": 20,\n "regions": [{"region_type": "text", "bbox": [1, 2, 3, 4], "text": "a", "confidence": 0.5}]}]}')
    r = readers.read_regions_json(spark, str(tmp_path)).first()
    assert (r.page_number, r.region_no, r.x1, r.y2, r.text, r.confidence) == (1, 0, 1, 4, "a", 0.5)
    (tmp_path / "a.PDF").write_bytes(b"x")
    assert {(r.extension, r.accepted) for r in readers.read_uploads(spark, str(tmp_path)).collect()} == {("json", False), ("pdf", True)}


def test_user_extractor(spark):
    pairs = spark.createDataFrame([("j", "t", 0, "a=1;b=2"), ("j", "t", 1, "")], "job_id string, table_name string, chunk_index int, text string")
    rows = extract.extract_with(pairs, lambda text, table: [dict([p.split("=")]) for p in text.split(";") if p]).collect()
    assert [(r.chunk_index, r.row_no, r.row) for r in rows] == [(0, 0, {"a": "1"}), (0, 1, {"b": "2"})]


def test_labelled_rows(spark):
    chunks = spark.createDataFrame([(0, "Name: Ada \n Total : 7\namount (usd): 5\naxb: no"), (1, "nothing")], "chunk_index int, text string")
    rows = extract.extract_labelled(chunks, "t", ["name", "total", "amount (usd)", "a.b"]).collect()
    assert [r.row for r in rows] == [{"name": "Ada", "total": "7", "amount (usd)": "5", "a.b": None}]
