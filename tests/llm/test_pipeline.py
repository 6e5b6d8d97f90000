"""The pipeline against plain versions of its stages, and its registration."""

import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from kmerloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "un") for b in ("da", "fen", "gar", "hu")]
    base = [(i, " ".join(r.choices(words, k=r.randint(4, 200))), ["en", "de"][i % 2], ["hot", None, "b"][i % 3], 0) for i in range(60)]
    extra = [(100, None, "en", "b", 0), (101, "12 34 !", "en", "b", 0), (102, "", None, None, 0), (103, base[5][1].replace(" ", "\n") + " ", "en", "b", 0), base[7]]
    long = next(x for x in base if len(x[1].split()) > 150)
    near = (104, long[1] + " " + words[0], "de", "hot", 0)
    return [*base, *extra, near]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
            now = spark.createDataFrame(seen[name], SCHEMA)
    assert sorted(x.doc_id for x in seen["language_id"]) == sorted(x[0] for x in rows() if x[0] not in (100, 101, 102))
    texts = {}
    for x in seen["language_id"]:
        texts.setdefault(re.sub(r"\s", "", x.text), []).append((-len(x.text), x.doc_id))
    assert sorted(x.doc_id for x in seen["exact_dedup"]) == sorted(min(g)[1] for g in texts.values())
    left = {x.doc_id for x in seen["near_dedup"]}
    assert 104 not in left and left == {x.doc_id for x in seen["exact_dedup"]} - {104}
    size = Counter()
    for x in seen["near_dedup"]:
        size[x.source] += len(x.text.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target, got = dict(zip(order, mixing.targets([size[s] for s in order]), strict=True)), Counter()
    for x in seen["mixing"]:
        got[x.source] += len(x.text.split())
    assert all(abs(got[s] - target[s]) <= 110 for s in order) and max(Counter(x.doc_id for x in seen["mixing"]).values()) <= 3
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(x.length for x in seen["packing"]) == sum(len(whole.encode(x.text, add_special_tokens=False).ids) + 1 for x in seen["mixing"])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in final) == Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in seen["packing"])


def test_texts_with_a_letter_stay_if_no_language_is_learnt(spark):
    unlabelled = [(*x[:2], None, *x[3:]) for x in rows()]
    got = corpus_pipeline.identify(spark, spark.createDataFrame(unlabelled, SCHEMA).repartition(3), "").collect()
    assert Counter(map(tuple, got)) == Counter(x for x in unlabelled if x[0] not in (100, 101, 102))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5
