import datetime
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from textloom.plans import answers, library, requests, rewriter, rules

TABLES = library.Tables(entities=[{"cls": 1, "sub": 2, "id": "rome", "name": "Rome", "relevance": 3}])
XML = """<s><stmt n="1"><pat><t>rome</t></pat><tran><mkent c="1" s="2" i="rome"/></tran></stmt>
<stmt n="2"><pat><t>between</t><n/><t>and</t><n/></pat><tran><func name="mkRange"><var w="1"/><var w="2"/></func></tran></stmt>
<stmt n="3"><pat><ent c="1"/><range/></pat><tran><func name="mkERC"><var w="1"/><var w="2"/></func></tran></stmt>
<stmt n="4"><pat><t>today</t></pat><tran><func name="mkDay"><rn v="0"/></func></tran></stmt>
<stmt n="5"><pat><t>me</t></pat><tran><var name="who" r="y"/></tran></stmt></s>"""
GRAMMARS = [rewriter.Grammar(rules.compile_rules(rules.load_rules(XML, source="own")))]
NOW = datetime.date(2011, 5, 23)


def test_json_and_xml():
    chain, used = rewriter.parse("see Rome between 9 and 3 today", GRAMMARS, NOW)
    out = json.loads(answers.answer_json(chain, TABLES, used, rewriter.chain_topics(chain), 7, 1))
    erc = out["beads"][1]
    assert out["beads"][0] == {"type": "token", "value": "see", "src": "see", "markup": [[0, 3]]}
    assert erc["ent"] == {"class": "1", "subclass": "2", "id": "rome", "name": "Rome", "rel": 3} and (erc["range"]["lo"], erc["range"]["hi"]) == (3, 9)
    assert out["beads"][2]["value"] == "2011-05-23" and {"source": "own", "stmt": 3, "emit": 0} in out["trace"]
    assert out["topics"][0]["strength"] == 3 and out["qid"] == 7
    tree = ET.fromstring(answers.answer_xml(chain, TABLES, used, 7))
    assert [b[0].tag for b in tree.findall("bead")] == ["token", "erc", "date"] and tree.find(".//hi/num").text == "9"
    assert tree.find("bead[2]/srctok").text == "rome between 9 and 3" and tree.find("bead[2]/srctok").get("origmarkup").startswith("4,4;9,7")


@pytest.mark.parametrize(
    "bead",
    [("number", 1.5), ("number", None), ("time", 55800), ("datetime", [20110105, None]), ("datetime", [None, 60]), ("range", [None, 3]), ("entities", [["1", "2", "rome"], ["1", "2", None]]),
     ("ercexpr", {"op": "OR", "of": [{"entity": ["1", "2", "a"], "range": [1, 2], "unit": None}]}), ("evr", {"entity": ["1", "2", "a"], "values": [["p", {"kind": "number", "value": 1}]]}), ("fluff", "<&>"), ("expression", {"tag": "a"})],
)
def test_every_kind_can_be_written(bead):
    made = library.made(*bead)
    ET.fromstring(answers.value_xml(made, TABLES))
    json.dumps(answers.value_json(made, TABLES))


def test_confidence_and_left_over():
    b = lambda words, **more: {"kind": "entity", "value": ["1", "2", "rome"], "src": words.split(), "at": []} | more
    c = lambda *a, **k: answers.confidence(b(*a, **k), TABLES)
    assert (c("Rome"), c("roma"), c("old rome"), c("roma", boost=2), c("roma", boost=-1)) == ("high", "medium", "high", "high", "low")
    assert c("roma", corrections=[("roma", "rome")]) == "low" and c("the old romaa", corrections=[("romaa", "roma")]) == "high"
    assert c("abcdefgh", corrections=[("abcdefgh", "abcdefgx")]) == "medium" and c("ab cd", corrections=[("ab", "xy"), ("cd", "zw")]) == "low"
    assert answers.confidence({"kind": "word", "value": "x", "src": ["x"], "at": []}) is None
    chain, _ = rewriter.parse("see rome between 9 and 3 and more", GRAMMARS, NOW)
    assert answers.left_over("see rome between 9 and 3 and more", chain) == {"high": ["see", "and more"], "medium": [], "low": []}
    assert answers.distance("kitten", "sitting") == 3


def test_requests():
    r = requests.parse_request("<query u='3' qid='9' ret='json' now='2011-05-23T10:00' flag='t' flt='i,o,size,1,2;d,r,price,1.5,9' zdtag='a|b'>rome today<var n='who'><num>5</num></var></query>")
    assert (r.user, r.qid, r.now, r.text, r.tags) == (3, "9", NOW, "rome today", ["a", "b"]) and r.filters == [("size", "o", [1, 2]), ("price", "r", [1.5, 9.0])]
    out = json.loads(requests.answer(r, GRAMMARS, TABLES))
    assert [x["type"] for x in out["beads"]] == ["entity", "date"] and out["topics"][0]["strength"] == 100
    block = requests.parse_request("<qblock><query>me</query><query>today</query><var n='who'><ent c='4' s='5' i='z'/></var></qblock>")
    tree = ET.fromstring(requests.answer(block, GRAMMARS, TABLES, NOW))
    assert tree.find(".//entity").get("id") == "z" and tree.find(".//date").text == "2011-05-23"
    for bad in ("<blah/>", "<query foo='1'/>", "<query ret='yaml'/>", "<query flt='x,o,a,1'/>", "<query flt='i,r,a,1'/>", "<query><blah/></query>"):
        with pytest.raises(ValueError):
            requests.parse_request(bad)
    assert requests.flags_of("dT", requests.SEARCH_FLAGS) == {"chunks": True, "tags": False}


def test_request_table_and_filters(spark):
    rows = [(1, "<query ret='sjson'>rome</query>"), (2, "<query"), (3, None)]
    got = {r.id: (r.answer, r.error) for r in requests.answered(spark.createDataFrame(rows, "id int, request string"), GRAMMARS, "id", tables=TABLES).collect()}
    assert json.loads(got[1][0])["beads"] == [{"type": "entity", "id": "rome", "name": "Rome", "rel": 3}] and got[2][1] and got[3] == (None, None)
    docs = spark.createDataFrame([(1, 1, 2.0), (2, 2, 20.0), (3, None, 3.0)], "id int, size int, price double")
    assert [r.id for r in docs.filter(requests.filter_column([("size", "o", [1, 2]), ("price", "r", [1.5, 9.0])])).collect()] == [1]
    assert docs.filter(requests.filter_column([])).count() == 3 and isinstance(requests.filter_column([]), type(F.lit(1)))
