"""The pipeline of all stages, and each stage on its own, over small tables with odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lockstep.llm.op3_packing import vocabulary

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_text string, removed_spans int, N_Bytes int, score double, fingerprint string, file string"
ITEM = "what is the name of the long river that flows through the old town in the north"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    shared = "this passage of some more than fifty bytes stands in two of the documents as it is"
    texts = {i: prose(rng, 60) for i in range(40)}
    texts |= {100: texts[3], 101: texts[4], 102: None, 103: "", 104: prose(rng, 30) + " " + ITEM + " " + prose(rng, 30), 105: prose(rng, 40) + " " + shared, 106: shared + " " + prose(rng, 40), 107: prose(rng, 30000)}
    texts |= {i: prose(rng, 30) + " you idiot and pathetic moron you worthless loser" for i in range(200, 260)}
    rows = [(i, t, "en", "s", len(t or ""), "own", 7, 8, 0.5, "f", "g") for i, t in texts.items()]
    rows += [rows[5], (None, "a text without an id that is kept as it is", None, None, None, None, None, None, None, None, None)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in [*range(40), *range(200, 260)]] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def ids(df):
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect())


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, folder)
    assert ids(clean) == sorted([-1, *range(40), 5, *range(100, 108)])
    single = dict(corpus_pipeline.STAGES)["simhash"](spark, clean, folder)
    assert ids(single) == sorted([-1, *range(40), 5, *range(102, 108)])[:1] + sorted([*range(40), 5, 102, *range(104, 108)])  # 103 is empty as 102 is
    cut = dict(corpus_pipeline.STAGES)["substrings"](spark, single, folder)
    assert ids(cut) == ids(single)
    rows = {r["doc_id"]: r for r in cut.collect()}
    whole = {r["doc_id"]: r["text"] for r in single.collect()}
    plain = brute.op2([(i if i is not None else -1, t) for i, t in whole.items()])
    for i, r in rows.items():
        if plain[i if i is not None else -1][1] == 0:
            assert r["text"] == (whole[i] or "")
        assert hashlib.sha256(r["text"].encode()).hexdigest() == plain[i if i is not None else -1][3]
        if i is not None:
            assert (r["n_chars"], r["kept_text"], r["removed_spans"], r["N_Bytes"]) == (len(r["text"]), "own", 7, 8)
    assert "this passage" not in rows[106]["text"]
    assert "this passage" in rows[105]["text"]
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, cut, folder)
    assert ids(left) == [i for i in ids(cut) if i != 104]
    for stage in (clean, single, cut, left):
        assert stage.columns == docs.columns
    placed = dict(corpus_pipeline.STAGES)["packing"](spark, left, folder).collect()
    model = Tokenizer.from_file(vocabulary())
    want = sum(len(model.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in left.collect())
    assert sum(r["length"] for r in placed) == want
    used = {}
    for r in placed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select(columns).collect())) == sorted(map(str, docs.select(columns).collect()))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
