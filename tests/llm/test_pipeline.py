import corpus_pipeline
from synthaudit.llm import queries, quality, simhash, substrings, decontam
from synthaudit.llm.common import read_table, scratch_table


def test_stages_and_effects(spark, sf):
    """Each stage, run by hand on its predecessor's rows, gives what run() gives."""
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    docs = read_table(spark, sf, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch_table(stage(spark, kept[-1], sf), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and 0 < len(ids[-1]) < len(ids[0])
    good = quality.score(docs, queries.quality_model(docs, read_table(spark, sf, "labels")))
    assert ids[1] == {r.doc_id for r in good.where("predicted = 1").collect()}
    first = simhash.near_duplicates(kept[1])
    assert ids[2] == {r.doc_id for r in first.where("doc_id = component_id").collect()}
    again = substrings.repeated_passages(kept[3]).count()
    assert again <= substrings.repeated_passages(kept[2]).count() * 0.1
    found = decontam.find_contamination(kept[3], read_table(spark, sf, "benchmark"))
    assert ids[4] == {r.doc_id for r in found.where("not contaminated").collect()}
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids[4]
    assert kept[4].where("n_chars <> length(text)").count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert {"op5_topk", "op6_decontamination", "op8_chat"} <= set(entry.oracle_sql())
