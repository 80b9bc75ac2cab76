from textloom.sources import files


def test_readers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1|2|x|5|Red car|3|4|t\n1|2|y||Blue|||\n")
    rows = files.entity_file(spark, str(tmp_path / "e.txt")).orderBy("id").collect()
    assert [(r.id, r.relevance) for r in rows] == [("x", 5), ("y", 0)]
    (tmp_path / "p.txt").write_text("d|T1|0|title\nd|T0|1|body\n")
    assert [r.weight for r in files.phrase_file(spark, str(tmp_path / "p.txt")).orderBy("number").collect()] == [6, 1]
    (tmp_path / "s.txt").write_text("car auto\nalone\n")
    assert files.synonym_file(spark, str(tmp_path / "s.txt")).count() == 2
    assert files.text_files(spark, str(tmp_path), "*.txt").count() == 3


def test_record_readers(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<r><entlist c="1" s="8"><e i="A"><n>Time</n><n>Hour</n></e><e i="B" s="9" r="3"/></entlist></r>')
    rows = files.entity_xml(spark, str(tmp_path / "e.xml")).orderBy("id", "name").collect()
    assert [(r.cls, r.sub, r.id, r.relevance, r.name) for r in rows] == [(1, 8, "A", 0, "Hour"), (1, 8, "A", 0, "Time"), (1, 9, "B", 3, None)]
    (tmp_path / "l.xml").write_text('<z><E c="1" s="2" i="x" w="2"><D i="d1"/><D i="d2" w="0.5"/></E></z>')
    assert [(r.doc, r.weight) for r in files.link_xml(spark, str(tmp_path / "l.xml")).orderBy("doc").collect()] == [("d1", 2.0), ("d2", 0.5)]
    (tmp_path / "f.tsv").write_text("x\t7\tRed car\ny\tbad\tBlue\n")
    got = files.formatted_file(spark, str(tmp_path / "f.tsv"), "id=0;name=2;relevance=1").orderBy("id").collect()
    assert [(r.id, r.name, r.relevance) for r in got] == [("x", "Red car", 7), ("y", "Blue", 0)]
    (tmp_path / "c.txt").write_text("TITLE|9|Early\nC_BEGIN|1\none\ntwo\nC_END|1\nTITLE|1|A|B\nPOP.WEIGHT|1|3\nC_BEGIN|2\nC_END|2\nDOC_TAGID|2|t\n")
    texts, facts = files.content_file(spark, str(tmp_path / "c.txt"))
    assert [(r.doc, r.text) for r in texts.orderBy("doc").collect()] == [("1", "one\ntwo"), ("2", "")]
    assert sorted((r.doc, r.kind, r.value) for r in facts.collect()) == [("1", "title", "A|B"), ("1", "weight", "3"), ("2", "tag", "t"), ("9", "title", "Early")]
    (tmp_path / "w.txt").write_text("Car 5\ncar\n\nbus x\n")
    assert sorted((r.word, r.freq) for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()) == [("bus", 1), ("car", 6)]
    page = spark.createDataFrame([("<p>a &amp;lt; b<script>x<y</script><!-- c --> &quot;d&quot;</p>",)], "h string")
    assert page.select(files.html_content(page.h).alias("t")).first().t == 'a &lt; b "d"'


def test_chunks_keep_their_distance(spark):
    from textloom.operators import names

    rows = [(1, 1, p) for p in (0, 1, 2, 15, 30, 31)] + [(1, 2, 5)]
    got = names.chunks(spark.createDataFrame(rows, "item_id int, doc_id int, pos int"), 10).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.pos, r.weight) for r in got] == [(1, 0, 3), (1, 30, 2), (1, 15, 1), (2, 5, 1)]
