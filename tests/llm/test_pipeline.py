import corpus_pipeline as C
import __spark_entry__ as E
from clickspark.llm import quality_model, quality_rules, secret_scan, simhash
from clickspark.llm.common import DOCUMENT_COLUMNS
from clickspark.staging import stage_table


def test_registered():
    names = list(E.queries())
    assert [n.split("_")[0] for n in sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
            ] == [f"op{k}" for k in range(1, 14)]
    assert "pipeline" in names and [n for n, _ in C.STAGES] == [
        "quality_rules", "quality_classifier", "simhash_near_dedup", "secret_scan", "packing"]


def test_stages_against_the_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in C.STAGES:
        out = stage_table(stage(spark, docs, sf))
        if name == "packing":
            break
        assert out.columns == DOCUMENT_COLUMNS
        before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
        if name == "quality_rules":
            judged = {i: quality_rules.judge(r.text) for i, r in before.items()}
            assert {i: r.text for i, r in after.items()} == {i: j["cleaned"] for i, j in judged.items() if j["kept"]}
        elif name == "quality_classifier":
            assert set(after) == {r.doc_id for r in quality_model.classify(docs, quality_model.fit(docs)).collect() if r.kept}
        elif name == "simhash_near_dedup":
            assert set(after) == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        else:
            assert {i: r.text for i, r in after.items()} == {i: secret_scan.redact(r.text) for i, r in before.items()}
            assert not any(secret_scan.scan(r.text)[1] for r in after.values())
        assert all(r.n_chars == len(r.text) for r in after.values())
        sizes.append(len(after))
        docs = out
    packed = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == set(after) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 200


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 100


def test_empty_documents(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_edge_documents(spark, edge, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == {1}
