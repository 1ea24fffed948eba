import base64
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import alignment
from lodestone.sources import readers, writers


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"input": f"q{i}", "answers": [f"a{i}", "z"], "context": "c"}) for i in range(2000)]
    lines[3], lines[5] = "{broken", "   "
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"))
        assert got.count() == 1998
        assert {(r.doc_index, r.input) for r in got.collect()} == {(i, f"q{i}") for i in range(2000) if i not in (3, 5)}
        assert [r.input for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), start=6, end=8).orderBy("doc_index").collect()] == ["q6", "q7"]
        assert readers.point_read(spark, str(tmp_path / "x.jsonl"), 1234).first().input == "q1234"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(IndexError):
        readers.point_read(spark, str(tmp_path / "x.jsonl"), 9999)
    with pytest.raises(Exception, match="malformed line 3"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=True).count()
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    item = readers.normalized_items(got).where("doc_index = 0").first()
    assert (item.question, item.answer, item.truths) == ("q0", "a0", ["a0", "z"])
    assert readers.first_path(spark, str(tmp_path / "none"), str(tmp_path)) == str(tmp_path)


def test_other_formats(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": 1}\n\n{\n "a": 2}{"a":3}')
    assert [r.a for r in readers.read_json_stream(spark, str(tmp_path / "s.json"), "a long").orderBy("a").collect()] == [1, 2, 3]
    m = np.arange(6, dtype=np.float32).reshape(2, 3)
    store = {"embedding_dim": 3, "data": [{"__id__": "x", "entity_name": "X"}, {"__id__": "y"}], "matrix": base64.b64encode(m.tobytes()).decode()}
    (tmp_path / "v.json").write_text(json.dumps(store))
    got = {r.id: r.embedding for r in readers.read_vector_store(spark, str(tmp_path / "v.json")).collect()}
    assert got == {"x": [0, 1, 2], "y": [3, 4, 5]}
    (tmp_path / "set_4.json").write_text(json.dumps({"chunk_list": ["a", {"content": "b"}], "score_list": [0.5, 0.25]}))
    (tmp_path / "set_5.json").write_text("{oops")
    rows = readers.read_alignment(spark, str(tmp_path / "set_*.json")).orderBy("chunk_ord").collect()
    assert [(r.doc_index, r.content, r.score) for r in rows] == [(4, "a", 0.5), (4, "b", 0.25)]


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 'a<"&', "T"), (1, "b", "U")], "graph_id long, entity_name string, entity_type string")
    edges = spark.createDataFrame([(1, 'a<"&', "b", 2.5)], "graph_id long, a string, b string, weight double")
    writers.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = readers.read_graphml(spark, str(tmp_path / "g" / "graph_id=1"))
    assert {r.entity_name: r.attrs["entity_type"] for r in n.collect()} == {'a<"&': "T", "b": "U"}
    assert [(r.a, r.b, r.attrs["weight"]) for r in e.collect()] == [('a<"&', "b", "2.5")]


def test_graphml_of_any_layout(spark, tmp_path):
    """Many splits, one line or many, raw ">", namespaces, comments, CDATA, nested graphs and yFiles' data."""
    many = "".join(f'<node id="n{i}"><data key="k">{i}</data></node>' for i in range(3000))
    (tmp_path / "a.graphml").write_text(f'<graphml><key id="k" attr.name="size"/><graph>{many}</graph></graphml>')
    (tmp_path / "b.graphml").write_text("""<?xml version="1.0" encoding="ISO-8859-1"?>
<!DOCTYPE graphml [<!ENTITY who "Ann">]>\r\n<g:graphml xmlns:g="x" xmlns:y="y"><!-- a > b <node id="no"/> --><g:key id="k" attr.name="size"/>
<g:graph><g:node id="a>b"><g:data key="k">1 > \u00e9 &who;\n<![CDATA[<node id="no">]]></g:data><g:data key="other"/><g:graph><g:node id="inner"/></g:graph></g:node>
<g:edge target="a>b" source="inner"><g:data key="k"> \t<y:Shape>no</y:Shape>no</g:data></g:edge></g:graph></g:graphml><!-- end -->""", newline="")
    (tmp_path / "c.graphml").write_text("<graphml/>\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        n, e = readers.read_graphml(spark, str(tmp_path / "*.graphml"))
        got = {(r.file[-9:], r.entity_name, tuple(sorted(r.attrs.items()))) for r in n.collect()}
        edges = [(r.a, r.b, r.attrs) for r in e.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.graphml", f"n{i}", (("size", str(i)),)) for i in range(3000)} | {
        ("b.graphml", "a>b", (("other", ""), ("size", '1 > \u00e9 Ann\n<node id="no">'))), ("b.graphml", "inner", ())}
    assert edges == [("a>b", "inner", {"size": " \t"})]
    for name, text in (("cut", "<graphml><graph><node id='a'/>"), ("late", "<graphml><graph><node id='a'><data key='k'>1</data></node></graph><key id='k' attr.name='size'/></graphml>")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="no element found|declared behind its use"):
            readers.read_graphml(spark, str(tmp_path / name))[0].count()


def test_graphml_leaves_before_its_file_is_read():
    pulled = []

    def batches():
        pieces = b"<graphml><graph>".split(b">")[:-1] + [x for i in range(500) for x in (b'<node id="%d"' % i, b"</node")] + [b"</graph", b"</graphml"]
        for at in range(0, len(pieces), 100):
            pulled.append(at)
            value = pieces[at : at + 100]
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(value)), pa.array(value)], names=["file", "value"])

    found = readers._graphml(batches())
    first = next(found).num_rows  # the 49th node's ">" comes with the next piece
    assert first == 48 and pulled == [0]
    assert first + sum(b.num_rows for b in found) == 500 and len(pulled) == 11


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("d", "m", 1), ("d", "n", 2)], "dataset string, model string, f1 int")
    writers.write_results(df, df, str(tmp_path / "r"), 5)
    back = spark.read.json(str(tmp_path / "r" / "raw" / "sample_5"), schema="f1 int, dataset string, model string")
    assert back.count() == 2
    scored = spark.createDataFrame([(1, i, float(i), -float(i), 0.0, float(i), "c") for i in range(12)], "item long, ord long, forward double, backward double, parameter double, score double, content string")
    writers.write_ranked(scored, str(tmp_path / "k"), ["item"], "ord", 3)
    assert spark.read.parquet(str(tmp_path / "k" / "top")).count() == 3
    assert spark.read.parquet(str(tmp_path / "k" / "rank_lists")).first().backward_rank == list(range(12))
    assert spark.read.parquet(str(tmp_path / "k" / "full")).where(F.col("score_rank") == 1).first().ord == 11


def test_ranked_outputs_are_cut_from_one_table(spark, tmp_path):
    data = [(i % 3, i, float(-(i * 7 % 11)), None if i % 4 else 0.5, float(i % 5), 12, f"part -- {i}") for i in range(30)]
    scored = alignment.scores(spark.createDataFrame(data, "item long, ord long, forward double, backward double, parameter double, tokens long, content string"), ["item"])
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    writers.write_ranked(scored.mapInPandas(counted, scored.schema), str(tmp_path / "r"), ["item"], "ord", 3)
    assert calls.value == 30
    for name, df in writers.ranked_outputs(scored, ["item"], "ord", 3).items():
        got = spark.read.parquet(str(tmp_path / "r" / name))
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.collect())), name
