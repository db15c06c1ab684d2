from tessera.operators import parsing as P
from tessera.operators.evaluation import bootstrap_interval, sign_test
from tessera.sources.files import lockfile, target_parts


def test_markers():
    assert [P.marker_label(x) for x in ("b)", "NOTE 2", "—", " ", "note", "12B.")] == ["b", "NOTE 2", "-", "-", "NOTE", "12b"]
    assert [P.marker_style(x) for x in ("-", "3", "a", "iv", "3a", "NOTE 1")] == ["bullet", "numeric", "alpha", "roman", "alnum", "symbol"]


def test_reconstruct_gives_markers_to_lines():
    rows = P.reconstruct(["1a 1b 1c", "First", "++", "Second", "+", "Third", "++"])
    assert rows == [["1a", "First", "++"], ["1b", "Second", "+"], ["1c", "Third", "++"]]
    assert P.reconstruct(["1b 1c", "a", "b", "Interface test", "Fault injection test"]) == [["1b", "Interface test"], ["1c", "Fault injection test"]]


def test_table_quality_and_preference():
    q = P.quality_of([["1a", "text"], ["1b", ""], ["1c", "text 1d"]])
    assert (q.markers, q.described, q.sparse, q.overloaded, q.observed, q.expected) == (3, 2, 1, 1, 4, 4)
    assert P.prefer(P.Quality(rows=5, markers=5, sparse=4, described=1), P.Quality(rows=5, markers=5, sparse=1, described=4))
    assert not P.prefer(P.Quality(rows=2), P.Quality(rows=1, markers=1))


def test_table_rows_are_aligned():
    assert P.merge_continuations([["1a", "x"], ["tail"], ["1b", "y"]]) == [["1a", "x tail"], ["1b", "y"]]
    assert P.split_ratings([["1a", "Description ++ + o -"]]) == [["1a", "Description", "++", "+", "o", "-"]]
    rows = P.spread_ratings([["1a", "a"], ["1b", "b"], ["1c", "c"], ["1d", "d", *["+"] * 8]])
    assert [len(r) for r in rows] == [6, 6, 2, 2]
    assert [r[2:] for r in P.backfill_ratings([["1a", "x"], ["1b", "y"]], "ASIL A B C D ++ + ++ +".split())] == [["+"], ["++"]]
    assert P.header_rows([["Requirement", "ASIL A"], ["1a", "description"]]) == 1
    rows, fell_back = P.table_rows("Table 1 X\n\nMeasure  IL 1\n1a Test  ++", "Table 1 X")
    assert not fell_back and len(rows) == 2
    assert P.table_rows("", None) == ([], True)


def test_lists_and_notes():
    items, fell_back, seen = P.list_items("H\nNOTE 1 line\na) one\nb) two", "H")
    assert [i.label for i in items] == ["a", "b"] and not fell_back and seen
    assert [(i.style, i.depth) for i in P.list_items("1) x\n  a) y\n    - z")[0]] == [("numeric", 1), ("alpha", 2), ("bullet", 3)]
    assert P.list_items("NOTE 1 x\nNOTE 2 y") == ([], False, False)
    assert P.note_items("NOTE 1 x\nNOTE 2 y\na) z") == [("NOTE 1", "x"), ("NOTE 2", "y")]
    assert [i.label for i in P.list_items("c) x\na) y\nb) z")[0]] == ["a", "b", "c"]


def test_paragraphs():
    assert P.paragraphs("One here.\n\nTwo there.") == ["One here.", "Two there."]
    assert len(P.paragraphs("A sentence.\nNOTE 1 x\na) y")) == 3
    assert P.paragraphs("goes on;\nhere") == ["goes on; here"]
    assert P.paragraphs("") == []


def test_pages():
    pages, done = P.normalise_pages([f"Head\nbody {i}\nFoot" for i in range(3)])
    assert pages == ["body 0", "body 1", "body 2"] and (done["headers"], done["footers"]) == (3, 3)
    assert P.normalise_pages(["soft-\nware unit"]) == (["software unit"], {"headers": 0, "footers": 0, "merges": 1})
    assert P.normalise_pages([]) == ([], {"headers": 0, "footers": 0, "merges": 0})


def test_headings_and_chunks():
    assert P.heading_of("1.2 Scope ..... 12") is None
    assert P.heading_of("Table 3 — Methods") == ("table", "Table 3")
    assert P.heading_of("Annex B (informative) Uses") == ("annex", "Annex B")
    assert P.heading_of("5.4.1 " + "x" * 141) is None
    chunks = P.chunks_of(["lost\n1.1 One\nbody", "more\n1.2 Two"])
    assert [(c.ref, c.page_start, c.page_end, c.text) for c in chunks] == [("1.1", 1, 2, "1.1 One\n\nbody\nmore"), ("1.2", 2, 2, "1.2 Two")]


def test_windows():
    w = P.word_windows(" ".join(map(str, range(1200))), 900, 75)
    assert [len(x.split()) for x in w] == [900, 375] and w[1].startswith("825 ")
    long = P.Chunk("clause", "1.1", "1.1 H", 1, 2, ["w " * 1200])
    assert len(P.split_long(long)) == 2 and all(x.startswith("1.1 H\n\n") for x in P.split_long(long))
    assert P.word_windows("", 9, 3) == []


def test_render():
    assert P.markdown([["a", "b"], ["c"]]) == "| a | b |\n|---|---|\n| c |  |"
    assert P.csv_line(["a b", "c", 'd"e']) == '"a b",c,"d""e"'


def test_statistics():
    assert sign_test(5, 0) == 0.0625 and sign_test(0, 0) is None
    low, high = bootstrap_interval([0.1, 0.2, -0.1, 0.05, 0.3, 0.0], 500, 0xC0FFEE)
    assert (low, high) == bootstrap_interval([0.1, 0.2, -0.1, 0.05, 0.3, 0.0], 500, 0xC0FFEE) and low <= high
    assert bootstrap_interval([], 10) is None


def test_commands_and_lockfiles(tmp_path):
    assert target_parts("x ingest --target-part 8 2 8") == [2, 8]
    assert target_parts("x ingest --target-part 3 --target-part=4") == [3, 4]
    assert len(lockfile(str(tmp_path / "a" / "lock.json"), {"run": 1})) == 64
    try:
        lockfile(str(tmp_path / "b.json"), {"entries": [{"text": "x"}]})
    except ValueError:
        pass
    else:
        raise AssertionError


def test_banners_go_and_ratings_lose_their_punctuation():
    banner = ["ISO Store Order: 12 / Downloaded: 2020-01-01", "Single user licence only, copying and networking prohibited.", "Licensed to X / License # 1 / Downloaded: y"]
    assert P.normalise_pages(["\n".join([*banner, "body"])])[0] == ["body"]
    assert P.normalise_pages(["networking prohibited\nbody"])[0] == ["networking prohibited\nbody"]
    assert P.split_ratings([["1a", "Description (++), + o; -."]]) == [["1a", "Description", "++", "+", "o", "-"]]
    assert P.split_ratings([["1a", "++ +"]]) == [["1a", "++ +"]]
    lines = ["asil", "A", "B", "C", "D", "(++)", "+,"]
    assert P.backfill_ratings([["1a", "x"], ["1b", "y"]], lines) == [["1a", "x", "+"], ["1b", "y", "++"]]
    assert P.backfill_ratings([["1a", "x"]], ["ASIL A B C D ++"]) == [["1a", "x"]]
    assert P.backfill_ratings([["1a", "x", "(++)"]], lines) == [["1a", "x", "(++)"]]


def test_outline_and_candidates():
    xml = '<item page="3">4 General &amp; scope</item><item page="9">4 Again</item><item page="5">Foreword</item><item page="7">5&#160;Terms</item>'
    assert P.sections_of(xml) == [("4", "General & scope", 3), ("5", "Terms", 7)]
    pages = ["minimal", "x" * 200, "tiny"]
    assert P.ocr_candidates(pages, "auto", 10) == [1, 3] and P.ocr_candidates(pages, "off") == [] and P.ocr_candidates(pages, "force") == [1, 2, 3]


def test_node_tree():
    pages = ["4.1 First\nThe unit shall stop.\na) one\nb) two\nTable 1 Rates\nMethod  A\nReview  ++", "", "7.3 Far\nNOTE 1 remark\nAnnex B More\ntext"]
    nodes = {n.node_id.removeprefix("d:node:"): n for n in P.nodes_of("d", pages, "Title", [("4", "General", 1)], with_pages=True)}
    assert nodes["document"].path == "document:Title" and nodes["section_heading:4"].path == "document:Title > section_heading:4"
    assert [k for k in nodes if k.startswith("page")] == ["page:0001", "page:0003"]
    clause, far, table = nodes["clause:4_1:001"], nodes["clause:7_3:001"], nodes["table:table_1:001"]
    assert clause.parent == "d:node:section_heading:4" and far.parent == "d:node:document" and table.parent == clause.node_id
    assert table.path == "document:Title > section_heading:4 > clause:4.1 > table:Table 1" and nodes["annex:annex_b:001"].parent == "d:node:document"
    items = [n for n in nodes.values() if n.kind == "list_item"]
    assert [(n.label, n.list_depth, n.item_index) for n in items] == [("a", 1, 1), ("b", 1, 2)]
    assert nodes["clause:4_1:001:req:001"].text == "The unit shall stop" and nodes["clause:7_3:001:note:001:item:001"].label == "NOTE 1"
    head = nodes["table:table_1:001:cell:001:001"]
    assert head.is_header and nodes["table:table_1:001:row:002"].is_header is False and head.col == 1
    assert [n.order for n in nodes.values()] == list(range(1, len(nodes) + 1))


def test_parsed_tables_have_markdown_and_csv(spark):
    df = spark.createDataFrame([(1, "d", ["Table 1 Rates\nMethod  A\nReview  ++\nTest, long  +"]), (2, "d", None)], "extract_id long, doc_id string, pages array<string>")
    row = P.structured_chunks(df).first()
    assert row["table_md"].splitlines()[1] == "|---|---|" and row["table_csv"].splitlines()[2] == '"Test, long",+' and (row["rows"], row["header_rows"], row["markers"], row["fell_back"]) == (3, 1, 0, False)
    assert P.structured_nodes(df, with_pages=True).where("node_type = 'page'").count() == 1


def test_files_are_read_and_replaced(spark, tmp_path):
    from tessera.sources import files
    from tessera.streaming import jobs

    for name in ("RDS-3;2018.pdf", "RDS-1;2020.PDF", "note.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.checked(files.inventory(spark, str(tmp_path)), "documents").collect()
    assert [(r["filename"], r["part"], r["year"]) for r in found] == [("RDS-1;2020.PDF", 1, 2020), ("RDS-3;2018.pdf", 3, 2018)]
    docs = spark.read.format("binaryFile").load(f"{tmp_path}/*.[pP][dD][fF]").selectExpr("path as filename", "content")
    pages = files.extract_pages(docs, text_layer=lambda b: ["x" * 200, "low"], ocr=lambda b: ["scan 1", "scan 2"]).collect()
    assert {(r["page_pdf"], r["text"], r["backend"], r["reason"]) for r in pages} == {(1, "x" * 200, "text_layer", "text_ok"), (2, "scan 2", "ocr", "low_text")}
    (tmp_path / "m").mkdir()
    for i in (1, 2):
        files.write_json(str(tmp_path / "m" / f"run_{i}.json"), {"run_id": f"r{i}", "processed_parts": [i]})
    runs = files.manifests(spark, f"{tmp_path}/m/*.json", "run_id string, processed_parts array<int>, note string").orderBy("manifest").collect()
    assert [(r["manifest"], r["run_id"], r["note"]) for r in runs] == [("run_1.json", "r1", None), ("run_2.json", "r2", None)]
    files.write_csv(spark.range(2), str(tmp_path / "csv"))
    files.write_jsonl(spark.range(2), str(tmp_path / "jsonl"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "jsonl")).count() == 2
    schema = "extract_id long, doc_id string, pages array<string>"
    for i, text in enumerate(["1.1 One\nold", "1.1 One\nnew"]):
        spark.createDataFrame([(7, "d", [text])], schema).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), schema).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1.1 One\n\nnew"]
