"""ARFF files, the generator, experiment drivers and streams."""

import pytest
from pyspark.sql import functions as F

from bagloom.operators import cluster, scaling
from bagloom.plans import experiment
from bagloom.sources import arff, synthetic
from bagloom.streaming.assign import assign_stream

TEXT = """% a comment
@relation small

@attribute 'mol id' {m1,m2,m3}
@attribute bag relational
  @attribute f1 numeric
  @attribute f2 real
@end bag
@attribute class {0,1}
@data

m1,"1,2\\n3,?",1
'm2',"0.5,-1e3",0
% another
m3,"",1
"""


def test_read(spark, tmp_path):
    path = tmp_path / "small.arff"
    path.write_text(TEXT)
    data = arff.read_arff(spark, str(path))
    rows = data.bags.orderBy("pos").collect()
    assert data.name == "small" and [a.name for a in data.attributes] == ["f1", "f2"]
    assert [(r.pos, r.bag_id, r.label, len(r.instances)) for r in rows] == [(0, "m1", "1", 2), (1, "m2", "0", 1), (2, "m3", "1", 0)]
    assert rows[0].instances[1][1] != rows[0].instances[1][1] and rows[1].instances == [[0.5, -1000.0]]
    latin = tmp_path / "latin.arff"
    latin.write_bytes(TEXT.replace("m2", "é2").encode("latin-1"))
    assert arff.read_arff(spark, str(latin), encoding="ISO-8859-1").bags.where("bag_id = 'é2'").count() == 1


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        arff.read_arff(spark, str(tmp_path / "none.arff"))
    for name, text in (("bag", TEXT.replace("bag relational", "sack relational")), ("class", TEXT.replace("class {", "kind {")), ("attributes", TEXT.replace("  @attribute f1 numeric\n  @attribute f2 real\n", "")), ("date", TEXT.replace("f2 real", "f2 date"))):
        (tmp_path / f"{name}.arff").write_text(text)
        with pytest.raises(ValueError):
            arff.read_arff(spark, str(tmp_path / f"{name}.arff"))
    (tmp_path / "width.arff").write_text(TEXT.replace("0.5,-1e3", "0.5"))
    with pytest.raises(Exception, match="do not have 2 values"):
        arff.read_arff(spark, str(tmp_path / "width.arff")).bags.collect()
    assert arff.files_of(spark, str(tmp_path / "nowhere")) == []


def test_round_trip_and_grid(spark, tmp_path):
    data = synthetic.two_clouds(spark, seed=3)
    assert data.bags.count() == 35 and data.bags.exceptAll(synthetic.two_clouds(spark, seed=3).bags).isEmpty()
    arff.write_arff(data, str(tmp_path / "out"))
    back = arff.read_arff(spark, str(tmp_path / "out"), name=data.name)
    assert back.equals(data)
    found = {(r.eps, r.min_pts): r for r in experiment.grid(data.bags, (0.05, 3.0), (2,)).collect()}
    assert found[0.05, 2].clusters == 35 and found[0.05, 2].interpretation == "over-segmented"
    assert found[3.0, 2].precision == 1.0 and 2 <= found[3.0, 2].clusters <= 7


def test_batch_keeps_going(spark, tmp_path):
    (tmp_path / "bad.arff").write_text("@relation bad\n@data\n")
    arff.write_arff(synthetic.two_clouds(spark), str(tmp_path / "w"), single=True)
    part = next((tmp_path / "w").glob("part-*"))
    part.rename(tmp_path / "good.arff")
    found = experiment.batch(spark, str(tmp_path), out=str(tmp_path / "out"), eps=3.0, scaler="minmax")
    rows = {r.dataset: r for r in found.collect()}
    assert rows["bad.arff"].status == "failed" and rows["good"].status == "ok"
    assert (rows["good"].train_bags, rows["good"].test_bags) == (24, 11)
    assert experiment.single(synthetic.two_clouds(spark), scaler="none")[1] == "failed"
    lines = next((tmp_path / "out" / "results_summary_scaled_MinMax.csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "Dataset,Status,Execution_Time,Train_Bags,Test_Bags,Clusters,Noise_Pct,Precision,Recall,F1,Specificity,Error_Msg"
    assert sorted(x.split(",")[1] for x in lines[1:]) == ["Failed", "Success"]
    assert experiment.as_table(found.select("dataset")).splitlines()[0] == "| dataset  |"


def test_run_with_its_reports(spark, tmp_path):
    experiment.log_to(str(tmp_path / "run.log"))
    try:
        assert experiment.run(spark, str(tmp_path / "none.arff")) is None
        arff.write_arff(synthetic.two_clouds(spark), str(tmp_path / "clouds"))
        out = experiment.run(spark, str(tmp_path / "clouds"), eps=3.0)
    finally:
        for handler in list(experiment.log.handlers):
            experiment.log.removeHandler(handler)
            handler.close()
    assert out["train"].count() == 24 and out["test"].count() == 11 and out["plot"].count() == 24
    text = (tmp_path / "run.log").read_text()
    assert "cannot be read" in text and text.count("precision") == 2 and "24 training bags" in text


MIXED = """@relation mixed
@attribute id {a,@b,c}
@attribute bag relational
@attribute size numeric
@attribute colour {red,'dark blue'}
@attribute note string
@end bag
@attribute class {0,1}
@data
a,"1,red,x y\\n2,'dark blue',?",1
@b,"3,red,z",0
c,"5,?,z",0
"""


def test_attributes_that_are_no_numbers(spark, tmp_path):
    (tmp_path / "mixed.arff").write_text(MIXED)
    data = arff.ArffSource().load(spark, str(tmp_path / "mixed.arff"))
    rows = list(data)
    assert [r.bag_id for r in rows] == ["a", "@b", "c"] and "@b" in data and "z" not in data and len(data) == 3
    assert rows[0].texts == [["1", "red", "x y"], ["2", "'dark blue'", "?"]]
    assert [v[:2] for v in rows[0].instances] == [[1.0, 0.0], [2.0, 1.0]] and all(v[2] != v[2] for r in rows for v in r.instances)
    assert data.numeric_dimensions == [0] and [r.instances for r in data.numeric()] == [[[1.0], [2.0]], [[3.0]], [[5.0]]]
    scaled = scaling.MinMax().fit_transform(data)
    assert scaled.name == "mixed_transformed" and [v[:2] for v in list(scaled)[0].instances] == [[0.0, 0.0], [0.25, 1.0]]
    arff.write_arff(data, str(tmp_path / "again"))
    assert [r.texts for r in arff.read_arff(spark, str(tmp_path / "again"))] == [r.texts for r in rows]
    (tmp_path / "wrong.arff").write_text(MIXED.replace("3,red", "3,green"))
    with pytest.raises(Exception, match="not in its domain"):
        list(arff.read_arff(spark, str(tmp_path / "wrong.arff")))
    with pytest.raises(ValueError, match="@data"):
        (tmp_path / "cut.arff").write_text(MIXED.partition("@data")[0])
        arff.read_arff(spark, str(tmp_path / "cut.arff"))


def test_values_are_set_by_type(spark, tmp_path):
    (tmp_path / "mixed.arff").write_text(MIXED)
    data = arff.read_arff(spark, str(tmp_path / "mixed.arff"))
    changed = {r.bag_id: r for r in data.with_value("a", 1, 1, "red").with_value("a", 0, 0, 9)}
    assert [v[:2] for v in changed["a"].instances] == [[9.0, 0.0], [2.0, 0.0]] and changed["a"].texts[1][1] == "red" and changed["@b"].instances[0][0] == 3.0
    for k, value in ((0, "1"), (1, "green"), (1, 0), (2, 5)):
        with pytest.raises(TypeError):
            data.with_value("a", 0, k, value)
    with pytest.raises(IndexError):
        data.with_value("a", 0, 3, 1.0)
    with pytest.raises(Exception, match="no instance"):
        list(data.with_value("a", 2, 0, 1.0))
    whole = arff.Attribute("n", "integer")
    assert whole.accepts(3) and not whole.accepts(3.5) and not whole.accepts("3") and arff.Attribute("x", "real").accepts(3)


def test_lines_of_any_length(spark, tmp_path):
    wide = ",".join(str(i % 97) for i in range(2000))
    bag = "\\n".join([wide] * 150)
    head = "@relation wide\n@attribute id string\n@attribute bag relational\n" + "".join(f"@attribute f{i} numeric\n" for i in range(2000)) + "@end bag\n@attribute class {0,1}\n@data\n"
    (tmp_path / "wide.arff").write_text(head + f'b0,"{bag}",1\nb1,\'{bag}\',0\n')
    rows = list(arff.read_arff(spark, str(tmp_path / "wide.arff")))
    assert len(bag) > 800_000 and [(r.label, len(r.instances), len(r.instances[0])) for r in rows] == [("1", 150, 2000), ("0", 150, 2000)]


def test_scalers_check_the_schema(spark):
    two, one = synthetic.two_clouds(spark), synthetic.two_clouds(spark)
    one.attributes = one.attributes[:1]
    for scaler in (scaling.MinMax(), scaling.ZScore()):
        fitted = scaler.fit(two)
        with pytest.raises(ValueError, match="attributes"):
            fitted.transform(one)
        with pytest.raises(ValueError, match="attributes"):
            fitted.transform(arff.Dataset("x", two.bags, [arff.Attribute("x", "real"), arff.Attribute("y", "integer")]))
        assert fitted.inverse(fitted.transform(two)).bags.count() == 35
        with pytest.raises(Exception, match="fitted on 2 dimensions"):
            fitted.transform(two.bags.withColumn("instances", F.transform("instances", lambda p: F.array_append(p, F.lit(1.0))))).collect()


def test_stream_is_predicted_like_a_batch(spark, tmp_path):
    bags = synthetic.two_clouds(spark).bags
    model = cluster.fit(bags, 3.0, 2, "strict")
    bags.write.parquet(str(tmp_path / "in"))
    got = []
    query = assign_stream(spark.readStream.schema(bags.schema).parquet(str(tmp_path / "in")), model, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.bag_id, r.cluster_id) for r in got) == sorted((r.bag_id, r.cluster_id) for r in model.predict(bags).collect())
