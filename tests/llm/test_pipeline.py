"""The pipeline against brute force on a small fixture, stage by stage; the entry names it."""

import base64
import random
import re

import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers as P
from corpusflow.llm import quality, toxicity
from tests.llm.test_pii import plain
from tests.llm.test_simhash import plain_fingerprint, roots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows, labels = [], []
    for i in range(160):
        text = prose(rng.randint(60, 400))
        labels.append((i, int(i % 4 == 0)))
        if i % 4 == 0:
            text += " you filthy moron and stupid idiot " + prose(20)
        rows.append((i, text, "en", "src", len(text)))
    line = prose(30)
    extra = [None, "", "short text", (line + "\n") * 40, " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(900)), rows[5][1], rows[5][1].upper(),
             "write to me.now@mail.example.com or +1 (017) 555-7713 " + prose(80), "you filthy moron and stupid idiot " + prose(100)]
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(extra)] + [rows[6], (None, prose(100), "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return False
    raw = text.encode()

    def outside(x):
        low, high = [b[1:] for b in quality.BANDS if b[0] <= len(x)][-1]
        r = len(x) / len(zstandard.compress(x, 3))
        return not low <= r <= high

    chunks = [raw[i:i + 4096] for i in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    return not outside(raw) and 2 * sum(map(outside, chunks)) <= len(chunks)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        out = stage(spark, state, folder)
        after = out.collect()
        if name == "quality rules":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if brute_quality(r.text))
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {1000, 1001, 1002, 1003, 1004}
        elif name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            model = toxicity.fit(state, spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(doc_id AS string)) % 3 <> 1"))
            assert sorted(map(str, after)) == sorted(str(r) for r, s in zip(before, model.scores([r.text for r in before])) if s < 0.7)
            # few labels, so one or two may be wrong
            assert 1008 in gone and len((gone - {1008}) ^ set(range(0, 160, 4))) <= 2
        elif name == "SimHash near-dedup":
            prints = [plain_fingerprint(r.text) for r in before]
            root = roots(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and bin(a ^ b).count("1") <= 4])
            groups = {}
            for r, p in zip(before, prints):
                groups.setdefault(root[p], []).append(r)
            want = [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in groups.values()]
            assert sorted(map(str, after)) == sorted(map(str, want))
            assert not {1005, 1006} & {r.doc_id for r in after} and sum(r.doc_id == 6 for r in after) == 1
        elif name == "PII":
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in after} == set(texts) and len(after) == len(before)
            assert {r.doc_id: r.text for r in after}[1007].startswith("write to <email> or <phone> ")
            assert all(not plain(r.text) and r.n_chars == len(r.text) for r in after)
            assert all(r.text == texts[r.doc_id] for r in after if not plain(texts[r.doc_id]))
        else:
            tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
            assert {r.doc_id: r.doc_tokens for r in after} == want and sum(r.length for r in after) == sum(want.values())
        if name != "packing":
            assert out.columns == columns
            state = spark.createDataFrame(after, docs.schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, after), key=str)


def test_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_entry_has_them():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
