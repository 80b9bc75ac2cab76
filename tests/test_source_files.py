from pyspark.sql import functions as F

from textloom.sources import files, rulefiles


def _file(tmp_path, text, name="f"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_quotes_and_bars_are_text(spark, tmp_path):
    path = _file(tmp_path, 'd1|T0|0|"he said\nd1|T1|0|a | b|c\n# note\n\nd2|t2|x|\nshort\n')
    rows = [tuple(r) for r in files.phrase_file(spark, path).collect()]
    assert rows == [("d1", "T0", 0, '"he said', 1), ("d1", "T1", 0, "a | b|c", 6), ("d2", "T2", 0, "", 2)]
    entities = _file(tmp_path, '1|2|x|5|"quoted|3|4|t\n1|2|"y||name\n#c\n1|2|z|bad|', "e")
    rows = [tuple(r) for r in files.entity_file(spark, entities).collect()]
    assert rows == [(1, 2, "x", 5, '"quoted', 3, 4, "t"), (1, 2, '"y', 0, "name", None, None, None), (1, 2, "z", 0, None, None, None, None)]
    rows = [tuple(r) for r in files.formatted_file(spark, _file(tmp_path, 'a\t"b\t7\n', "t"), "id=0;name=1;relevance=2").collect()]
    assert rows == [("a", '"b', 7)]


def test_entity_properties(spark, tmp_path):
    rows = [tuple(r) for r in files.entity_properties(spark, _file(tmp_path, "1|2|x|5|long name\n1|2|x|0|nm\n1|3|y||\n")).orderBy("id").collect()]
    assert rows == [(1, 2, "x", "long name", 5), (1, 3, "y", None, 0)]


def test_records_and_phrases(spark, tmp_path):
    path = _file(tmp_path, '<root><table ID="7" ModuleID="3" DocName="A title" Content="&lt;p&gt;First part; second&lt;/p&gt;. x" Keywords="k one;k two" BegDate="2011"/><table ID="8" ModuleID="3" DocName="B"/></root>')
    records = files.faq_xml(spark, path)
    assert [r.doc for r in records.orderBy("doc").collect()] == ["3.7", "3.8"] and records.filter("doc = '3.7'").first().content == "<p>First part; second</p>. x"
    got = [(r.doc, r.section, r.number, r.text) for r in files.faq_phrases(records).orderBy("doc", "section", "number").collect()]
    assert ("3.7", "T1", 0, "A title") in got and [t for d, s, _, t in got if s == "T2"] == ["k one", "k two"] and not any(len(t) < 2 for *_, t in got)
    assert [t for d, s, _, t in got if s == "T0"] == ["First part", "second"]


def test_meanings(spark, tmp_path):
    path = _file(tmp_path, '<synonyms><m n="car" p="5"><w v="Auto"/><w v="wagen"/></m><m n="self" p="30"><w v="auto"/></m><m n="dog"><w v="dog"/></m></synonyms>')
    table = files.meanings_xml(spark, path)
    assert {tuple(r) for r in table.collect()} == {("car", 5, "auto"), ("car", 5, "wagen"), ("self", 30, "auto"), ("dog", 100, "dog")}
    pick = lambda mode: {tuple(r) for r in files.expandable(table, mode).collect()}
    assert pick("one") == {("wagen", "car")} and pick("dominant") == {("auto", "car"), ("wagen", "car"), ("dog", "dog")} and pick("none") == set()


def test_synonyms_are_stemmed(spark, tmp_path):
    path = _file(tmp_path, "cars autos\ncar cars\nalone\n")
    got = files.synonym_file(spark, path, lambda w: F.regexp_replace(w, "s$", ""))
    assert sorted(r.word for r in got.collect()) == ["auto", "car"]


def test_configuration():
    c = rulefiles.load_config("""<config><parse><stem/></parse><rules><file class="a" name="b">r.xml</file></rules><entities2><file>e.xml</file></entities2>
    <users><user id="3" flags="cs"><spell maindict="m"><extra>w.txt</extra></spell><trieset><trie class="" name=""/><trie class="a" name="b"><topic c="1" s="2" i="x" w="50"/></trie></trieset></user></users><instance><threads>4</threads></instance></config>""")
    u = c.users[3]
    assert c.stem and c.rules == [("r.xml", "a", "b")] and c.entities == ["e.xml"] and c.threads == 4
    assert u.grammars == [("", ""), ("a", "b")] and u.topics == {("a", "b"): [("1", "2", "x", 50.0)]} and u.dictionaries == ["w.txt"] and u.spelling == {"maindict": "m"}


def test_side_tables(spark):
    xml = """<s xmlns="urn:x"><stmt><pat><t>old</t><t>town</t></pat><tran><mkent c="1" s="2" i="x" r="4" p="1.5,2" v.zip="99" zd="d1|d2" tc="7" ts="8" ti="t" tg="3"><nv n="k" v="w"/></mkent></tran></stmt>
    <stmt><pat><t>q</t></pat><tran><func n="mkERC"><mkent c="1" s="3" i="y"/></func></tran></stmt></s>"""
    t = rulefiles.side_tables(xml)
    assert t.entities == [(1, 2, "x", "old town", 4), (1, 3, "y", None, 0)] and t.points == [(1, 2, "x", 1.5, 2.0)]
    assert t.properties == [(1, 2, "x", "zip", "99"), (1, 2, "x", "k", "w")] and [r[-1] for r in t.documents] == ["d1", "d2"] and t.topics == [(1, 2, "x", 7, 8, "t", 3)]
    assert t.frames(spark)["topics"].count() == 1 and rulefiles.side_tables("<s/>").frames(spark)["points"].count() == 0
