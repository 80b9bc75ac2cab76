import random
import re

from textloom import queries as engine


def test_chunk_ranks_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    docs = {i: " ".join(rng.choice("abcdefgh") * 2 for _ in range(90)) for i in range(6)}
    items = {3: "aa bb", 10: "cc", 17: "dd ee ff zz"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for q, item in items.items():
        for d, text in docs.items():
            at = [k for k, w in enumerate(re.findall(r"\w+", text)) if w in item.split()]
            chosen = []
            for w, pos in sorted((-sum(abs(x - y) <= 10 for y in at), x) for x in at):
                if all(abs(pos - y) >= 20 for y in chosen):
                    chosen.append(pos)
                    want.add((q, d, len(chosen), pos, -w))
    got = {(r.item_id, r.doc_id, r["rank"], r.pos, r.weight) for r in engine.QUERIES["chunk_ranks"](spark, str(tmp_path)).collect()}
    assert got == want and max(x[2] for x in got) > 1
