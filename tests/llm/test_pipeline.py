import os

import corpus_pipeline as cp
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, packing, simhash
from tests_llm_prose import prose


def tables(spark, tmp_path):
    bench = [(i, prose(700 + i, 40)) for i in range(3)]
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(40)]
    rows += [(50, "\n".join("%%% " * 8 for _ in range(5)), "en", "s", 0), (51, prose(1, 60), "en", "s", 0), (52, prose(60, 30) + " " + bench[0][1], "en", "s", 0), (53, None, None, None, None), (54, "", "en", "s", 0)]
    junk = [(100 + i, "\n".join(" ".join(w + "%%%" for w in x.split()) for x in prose(300 + i, 50).split("\n")), "en", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    labels = spark.createDataFrame([(r[0], int(r[0] < 50), 0) for r in rows[:40] + junk], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
        df.write.mode("overwrite").parquet(os.path.join(tmp_path, f"{name}.parquet"))
    return str(tmp_path)


def test_stages_one_by_one(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        path = str(tmp_path / f"out_{name}")
        out.write.parquet(path)
        seen[name] = spark.read.parquet(path)
        if name != cp.STAGES[-1][0]:
            assert seen[name].columns == columns
        docs = seen[name]
    ids = lambda name: {r["doc_id"] for r in seen[name].collect()}
    assert set(range(40)) <= ids("quality_classifier") and not any(i >= 100 for i in ids("quality_classifier"))
    assert ids("line_dedup") == ids("quality_classifier")
    copy = seen["line_dedup"].where("doc_id = 51").first()
    assert copy["n_chars"] == len(copy["text"]) < 60
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(seen["line_dedup"]).collect()}
    assert ids("simhash_near_dedup") == set(groups.values()) and set(range(40)) <= ids("simhash_near_dedup")
    dirty = {r["doc_id"] for r in decontaminate.contaminated(seen["simhash_near_dedup"], spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert 52 in dirty and ids("decontamination") == ids("simhash_near_dedup") - dirty
    tokens = packing.WordTokenizer(packing.resolve_vocabulary("word_bpe_49k.json"))
    want = sum(len(tokens.encode(r["text"] or "")) // 4 + 1 for r in seen["decontamination"].collect())
    assert sum(r["length"] for r in seen["best_fit_packing"].collect()) == want
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in cp.run(spark, d).collect()) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in seen["best_fit_packing"].collect())


def test_stages_on_odd_tables(spark, docs, tmp_path):
    d = tables(spark, tmp_path)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        assert out.count() <= docs.count() or name == "best_fit_packing"
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0


def test_names_and_registration():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
