"""SimHash classes against all pairs, on fingerprints that crowd together and on texts."""

import random

import pytest
import xxhash

from corpusflow.llm import simhash
from corpusflow.llm.components import components

SF = "/root/testdata/sf0.001"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [8, 40, 2048])
def test_links_keep_all_connections(spark, block):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for centre in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    got = [(r.a, r.b) for r in simhash.links(nodes, block=block).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in got)
    every = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    assert roots(signed, got) == roots(signed, every)


def test_components_of_chains_stars_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (500, 499), (499, 501), (0, 40)]
    df = spark.createDataFrame(pairs + [(None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == roots(nodes, pairs)
    assert components(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"w{i}" for i in range(900))
    odd = [(None, ""), (10_001, None), (10_002, " \n"), (10_003, text), (10_004, text.upper()), (10_005, text.replace("w5 ", "x5 ")),
           (10_006, text), (10_006, text), (10_007, "A b\x0bc"), (10_008, "a  b c"), (10_009, "a b\xa0c"), (None, "only null ids here")]
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("doc_id", "text", "1 AS fp", "2 AS component_id")


def test_near_duplicates(docs):
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    every = [(a, b) for a in set(prints) for b in set(prints) if a < b and bin(a ^ b).count("1") <= 4]
    root = roots(set(prints), every)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[root[p]] = min(least.get(root[p], r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{p:016x}", str(least.get(root[p]))) for r, p in zip(rows, prints))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least.get(x)) for x in {root[p] for p in prints})
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_long_text(spark):
    text = " ".join(f"word{i % 977} t{i}" for i in range(70_000))
    assert simhash.fingerprint_of(text) & (2**64 - 1) == plain_fingerprint(text)
