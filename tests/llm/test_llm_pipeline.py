"""The pipeline, stage by stage, against plain Python; and the registered queries."""

import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sievemill.llm import packing, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def test_stages_on_the_sample(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, schema = docs.columns, docs.schema
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        by_id = {r["doc_id"]: r for r in before}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            good, bad = ([i for i in by_id if labels.get(i) == q] for q in (1, 0))
            assert kept.issuperset(good) and len(kept.intersection(bad)) <= 0.15 * len(bad) and all(by_id[r["doc_id"]] == r for r in after)
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append((-len(r["text"]), r["doc_id"]))
            assert sorted(r["doc_id"] for r in after) == sorted(min(g)[1] for g in groups.values())
        if name == "near_dedup":
            sets = {i: shingles(r["text"]) for i, r in by_id.items()}
            least = {}
            for i in sorted(sets):
                todo = [i]
                while todo:
                    j = todo.pop()
                    if j not in least:
                        least[j] = i
                        todo += [k for k in sets if 5 * len(sets[j] & sets[k]) >= 4 * len(sets[j] | sets[k])]
            assert sorted(r["doc_id"] for r in after) == sorted(set(least.values()))
        if name == "mask_secrets":
            assert sorted(by_id) == sorted(r["doc_id"] for r in after)
            for r in after:
                text = re.sub(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}", "[SECRET]", by_id[r["doc_id"]]["text"])
                assert r["text"] == text and r["n_chars"] == (len(text) if text != by_id[r["doc_id"]]["text"] else by_id[r["doc_id"]]["n_chars"])
        if name == "pack":
            sizes = defaultdict(int)
            for r in after:
                sizes[r["doc_id"]] += r["length"]
            counted = packing.count_tokens(spark.createDataFrame(before, schema)).collect()
            assert sizes == {r["doc_id"]: r["tokens"] for r in counted}


def test_stages_on_awkward_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (4, "a  b c", "en", "s", 6)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.exact_dedup(spark, docs, SF).collect()) == [0, 1, 4]
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 1, 3]
    assert corpus_pipeline.mask_secrets(spark, docs, SF).count() == 7
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()} <= {None, 1, 2, 3, 4}
    long = " ".join(f"w{k}" for k in range(60_000))
    more = docs.unionByName(spark.createDataFrame([(5, long, "en", "s", 1), (6, long + " end", "en", "s", 1)], schema))
    clash = more.selectExpr("*", "1 AS score", "2 AS kept", "3 AS sig", "4 AS findings", "5 AS tokens", "6 AS _hash", "7 AS row", "8 AS `a b`")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash, SF)
        assert name == "pack" or got.columns == clash.columns
        ids = sorted(r["doc_id"] or 0 for r in got.select("doc_id").distinct().collect())
        assert ids == {"exact_dedup": [0, 1, 4, 5, 6], "near_dedup": [0, 1, 3, 5]}.get(name, ids if name == "quality" else [0, 1, 2, 3, 4, 5, 6])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    found = entry.queries()[name](spark, SF)
    assert found.select("doc_id").distinct().count() == 200


def test_op9_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    expected = sorted(c.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.SQL['op9_exact']})").fetchall())
    found = entry.queries()["op9_exact"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found)) == expected
