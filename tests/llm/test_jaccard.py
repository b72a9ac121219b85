"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import random
import re

import pytest

import corpus_pipeline
from sievemill.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(rows)):
        for j in range(k):
            if similar(sets[k], sets[j]):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def texts():
    """Copies with some words changed, about the limit; a passage that many texts share; crowds; short and empty texts."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = some(40)
    out = ["", None, " \n", "One two", "one  TWO", "one two three four five", "one two three four five six"]
    for size, copies in ((60, 6), (150, 6), (300, 6), (120, 45), (80, 45)):
        base = some(size)
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(size // 40 + 2)):
                copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    out += [" ".join(some(rng.randrange(5, 60)) + passage + some(rng.randrange(5, 60))) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("bucket", [16, 2])
def test_near_duplicates_against_brute_force(spark, bucket):
    rows = texts()
    expected = plain_components(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket=bucket).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected and len(got) == len(rows)
    assert 3 < len(set(expected.values())) < len(rows) - 50


def test_stage_removes_near_copies(spark):
    """Copies of similarity 0.8 or more, most of which differ in more than two bits of a SimHash fingerprint."""
    rows = texts()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted(set(plain_components(rows).values()))


def test_one_stays_without_distinct_ids(spark):
    """Groups without any id, and near copies that share the smallest id."""
    word = lambda k, n: " ".join(f"{k}{j}" for j in range(n))
    groups = {(None, None): "a", (3, 3): "b", (None, 5, 5): "c"}
    rows = [(i, word(k, 60) + f" tail{n}", "en", "s", 0) for ids, k in groups.items() for n, i in enumerate(ids)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["text"][0], r["doc_id"]) for r in got) == [("a", None), ("b", 3), ("c", 5)]


def test_near_fingerprints_against_brute_force(spark):
    rng = random.Random(9)
    values = [0, -1, 5, 5, 5]
    for _ in range(40):
        bits = rng.getrandbits(64)
        for flips in (0, 0, 1, 2, 3):
            other = bits
            for k in rng.sample(range(64), flips):
                other ^= 1 << k
            values.append(other - (1 << 64) if other >> 63 else other)
    least = {}
    for sig, value in enumerate(values):
        least.setdefault(value, sig)
    expected = {(least[v], sig) for sig, v in enumerate(values) if least[v] != sig}
    for v in least:
        for w in least:
            if v < w and ((v ^ w) & (2**64 - 1)).bit_count() <= 2:
                expected.add((min(least[v], least[w]), max(least[v], least[w])))
    marks = spark.createDataFrame(list(enumerate(values)), "sig long, fingerprint long").repartition(3)
    got = jaccard._near_fingerprints(marks, 2).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_fingerprints_link_first(spark, monkeypatch):
    """With no shingle to meet at, near copies are found by their fingerprints alone, and only those of the similarity."""
    word = lambda k, n: " ".join(f"{k}{j}" for j in range(n))
    rows = [(k, word("a", 4000) + f" end{k}", "en", "s", 0) for k in range(6)] + [(k, word(f"c{k}_", 50), "en", "s", 0) for k in (6, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(jaccard, "prefix", lambda found, *_: found[:0])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 6, 7]
    monkeypatch.setattr(jaccard, "majority", lambda _: 7)  # one fingerprint for all: the check on the sets still decides
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 6, 7]
