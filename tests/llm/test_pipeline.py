"""The pipeline over a small corpus with planted cases: stage by stage, and as a whole against plain Python."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from bagloom.llm import packing, pii, registry, toxicity

from test_operators import ids_of, jaccard_groups

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, comp string, part int"


def text(seed, n=120):
    r = random.Random(seed)
    return [f"{seed}x{r.randrange(10**6)}" for _ in range(n)]


ITEM = text("item", 30)


def planted():
    docs, labels = {}, []
    for i in range(200):
        w = text(f"d{i}")
        if i % 4 == 0:
            w[3:3] = ["vile", "nasty", "vile"]
        docs[i] = " ".join(w)
        labels.append((i, 0, int(i % 4 == 0)))
    copy = docs[1].split()
    copy[50] = "edited"
    docs[300] = docs[1]
    docs[301] = " ".join(copy)
    docs[302] = " ".join([*text("c", 40), *ITEM[5:17], *text("e", 40)])
    docs[303] = "mail und.34@mail7.example.com " + " ".join(text("p"))
    docs[304] = " ".join([*text("half", 60), *docs[1].split()[:60]])
    docs[305], docs[306] = None, ""
    docs[307] = " ".join(text("long", 3000)) + " from +44 20 7946 0958 or 10.1.2.3"
    return docs, labels


def write(spark, folder, docs, labels, repeated=()):
    rows = [(i, t, "en", "src0", None if t is None else len(t), "clash", 7) for i, t in [*docs.items(), *repeated]]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    docs, labels = planted()
    write(spark, tmp_path, docs, labels)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    kept, rows = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = rows.columns
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in rows.select("doc_id").collect()}
        assert name == "packing" or rows.columns == columns
    clean = {i for i in docs if i >= 300 or i % 4}
    assert kept["toxicity"] == clean
    assert kept["ngram_join"] == clean - {300, 301}
    assert kept["decontamination"] == kept["pii"] == kept["packing"] == clean - {300, 301, 302}
    hidden = spark.read.parquet(f"{tmp_path}/pii").where("doc_id = 303").first().text
    assert "und.34" not in hidden and hidden.endswith(docs[303].partition("com ")[2]) and "@mail7.example.com" in hidden


def test_run_against_plain_python(spark, tmp_path):
    """run()'s rows: which documents stay is decided by plain Python, and the sequences hold their ids in order."""
    docs, labels = planted()
    write(spark, tmp_path, docs, labels, repeated=[(1, docs[1]), (305, None), (5, docs[5])])
    rows = corpus_pipeline.run(spark, str(tmp_path)).cache()

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    chance = lambda t: 1 / (1 + np.exp(model.thresholds[0] - model.score(None if t is None else t.encode())))
    ids = [i for i in sorted(docs) if chance(docs[i]) < model.bound]
    groups = jaccard_groups([docs[i] for i in ids], 5, 80)
    ids = [i for at, i in enumerate(ids) if groups[at][1] == at]
    windows = {" ".join(ITEM[i : i + 10]) for i in range(len(ITEM) - 9)}
    ids = [i for i in ids if not any(w in (docs[i] or "") for w in windows)]
    hidden = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")).collect()}
    want = {i: [*x, 1] for i, x in zip(ids, ids_of([hidden[i] for i in ids]), strict=True)}

    pieces = sorted(rows.collect(), key=lambda r: (r.doc_id, r.start))
    made = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(rows).collect()}
    assert {r.doc_id for r in pieces} == set(ids) and sum(r.doc_id == 305 for r in pieces) == 2  # rows without words all stay
    for i in ids:
        mine = [r for r in pieces if r.doc_id == i][: None if i != 305 else 1]
        assert [x for r in mine for x in made[r.sequence_id][r.offset : r.offset + r.length].tolist()] == want[i]
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(want[i]) for r in mine)


def test_run_over_empty_tables(spark, tmp_path):
    write(spark, tmp_path, {}, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (2, 1, 0)]])
def test_run_without_toxic_labels(spark, tmp_path, labels):
    write(spark, tmp_path, {1: "a b c d e f", 2: "g h i j k l", 3: None}, labels)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_registry_names_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
