import datetime
import json

import pytest
from pyspark.sql import functions as F

from textloom import engine as E
from textloom.operators import index
from textloom.plans.requests import parse_request
from textloom.sources.rulefiles import load_config

RULES = """<s><stmt m="city"><pat><any><t>rome</t><t>roma</t></any></pat></stmt>
<stmt n="1"><pat><expand n="city"/></pat><tran><mkent c="1" s="2" i="rome" n="Rome" r="3" tc="9" ts="1" ti="t"/></tran></stmt>
<stmt n="2"><pat><t>twice</t><n/></pat><tran><func n="opMult"><var w="1"/><rn v="2"/></func></tran></stmt></s>"""


def test_rules_by_user_and_commands(tmp_path):
    (tmp_path / "r.xml").write_text(RULES)
    config = load_config(f"<config><rules><file class='a' name='b'>{tmp_path}/r.xml</file></rules><users><user id='5'><trieset><trie class='a' name='b'/></trieset></user><user id='6'><trieset><trie class='no' name='no'/></trieset></user></users></config>")
    e = E.Engine(config)
    assert [b["value"] for b in e.parse("roma twice 4", 5)[0]] == [["1", "2", "rome"], 8] and len(e.parse("roma twice 4", 6)[0]) == 3
    assert e.tables.entities[0]["name"] == "Rome" and e.tables.topics == {("1", "2", "rome"): [("9", "1", "t")]}
    assert json.loads(e.answer("<query ret='json' u='5'>rome</query>"))["beads"][0]["name"] == "Rome"
    call = lambda *a: json.loads(e.command(*a))
    assert call("COUNT_EMIT", "<pat><any><t>a</t><t>b</t></any><n/></pat>") == 2 and call("EMIT", "<pat><any><t>a</t><t>b</t></any><n/></pat>") == ["a [n]", "b [n]"]
    assert call("ENTRULES", "1", "2", "rome") == [[f"{tmp_path}/r.xml", 1]] and call("EN2RU", "zhizn") == "жизн" and call("RU2EN", "жизнь") == "zhizn'"
    assert call("MATCH_XML", "twice 4", "<pat><t>twice</t><n/></pat>") is True and call("MATCH_XML", "twice", "<pat><t>twice</t><n/></pat>") is False
    assert call("ADD_STMSET", "<s><stmt n='7'><pat><t>old</t><expand t='b' n='city'/></pat><tran><rn v='1'/></tran></stmt></s>", "x", "y", "own") == 1
    assert [b["value"] for b in e.parse("old roma")[0]][-1] in (1, ["1", "2", "rome"]) and call("STMT_REMOVE", "own", "7", "x", "y") == 1
    assert "opPlus" in call("HELP")["functions"] and call("CLEAR_TRIE", "x", "y") is None
    with pytest.raises(ValueError, match="unknown command"):
        e.command("RUN")
    with pytest.raises(ValueError):
        e.add_rules("<s><stmt><pat><perm>" + "<t>a</t>" * 8 + "</perm></pat><tran/></stmt></s>", "a", "b")
    assert len(e.sets["a", "b"].rules) == 2


def test_tables_of_requests_and_routes(spark):
    e = E.Engine()
    e.add_rules(RULES)
    table = spark.createDataFrame([(1, "<query ret='json' now='2020-01-02'>twice 4</query>")], "id int, request string")
    assert json.loads(e.answers(table, "id", now=datetime.date(2020, 1, 1)).first().answer)["beads"][0]["value"] == 8
    docs = spark.createDataFrame([(1, "a a b", 5), (2, "b c", 50)], "doc_id int, text string, size int")
    links = index.postings(docs)
    assert {r.gram: r.cnt for r in E.route(links, "doc.features", "1").collect()} == {"a": 2, "b": 1}
    assert {r.doc_id for r in E.route(links, "feature.docs", "b").collect()} == {1, 2} and E.route(links, "docid", "9").count() == 0
    with pytest.raises(ValueError, match="unknown route"):
        E.route(links, "nothing", "1")
    hits = E.searched(docs, parse_request("<zurch qid='q' flt='i,r,size,1,9' max='3' flag='g'>b c</zurch>")).collect()
    assert [(r.item_id, r.doc_id) for r in hits] == [("q", 1)]
    points = spark.createDataFrame([(1, 1.0, 1.0, 7), (2, 1.5, 1.0, 8), (3, -1.0, -1.0, 7)], "id int, lon double, lat double, sub int")
    near = lambda x: [r.id for r in E.found_entities(points, parse_request(x)).collect()]
    assert near("<findents lon='1' lat='1' dist='1'/>") == [1, 2] and near("<findents lon='-1' lat='-1' dist='1'/>") == [3] and near("<findents lon='1' lat='1' dist='1' es='8'/>") == [2]
    done = E.completion_json(spark.createDataFrame([("a", "ab", 2), ("a", "aa", 1)], "prefix string, name string, rank long")).first()
    assert [x["name"] for x in json.loads(done.answer)["completions"]] == ["aa", "ab"]
    words = E.normalised(spark.createDataFrame([("cities",)], "tok string")).first()
    assert (words.stem, words.russian) == ("city", "цитиес") and E.spelled("cities", True) == words.russian
    assert E.guess_language(spark.createDataFrame([(1, "aaa aab", "x"), (2, "zzz zzy", "y")], "doc_id int, text string, lang string")).filter(F.col("guess") == "y").first().doc_id == 2
