import corpus_pipeline
from meshlake.llm import registry
from tests.llm.conftest import prose


def test_stages_keep_clean_documents_and_drop_the_others(spark, tmp_path):
    passage = " ".join(f"word{i} is here{'.' if i % 7 == 0 else ''}" for i in range(30)) + "."
    rows = [(i, prose(i, ("en", "de")[i % 2], 60 + i)) for i in range(150)]
    rows = [(i, t + (" vilekind" if i % 10 == 0 else "")) for i, t in rows]
    rows += [(200, rows[1][1]), (201, prose(800, "en", 50) + ". " + passage), (202, prose(801, "en", 50) + ". " + passage), (203, "12345"), (204, None)]
    spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = corpus_pipeline.keep(docs)
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, _ in rows if i < 150 and i % 10}
    assert set(left["language_id"]) == {i for i, _ in rows} - {203, 204}
    assert clean <= set(left["toxicity"]) and not any(i % 10 == 0 and i < 150 for i in left["toxicity"])
    assert 200 not in left["minhash_near_dedup"] and clean <= set(left["minhash_near_dedup"])
    assert "word15" in left["substring_dedup"][201] and "word15" not in left["substring_dedup"][202]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left["substring_dedup"])


def test_stages_take_nulls_empty_tables_and_awkward_columns(spark, tmp_path):
    rows = [(i if i else None, prose(i, ("en", "de")[i % 2], 60 + i), ("en", "de")[i % 2], 1, 0.5, None, 5) for i in range(60)]
    rows += [(5, rows[5][1], "de", 1, 0.5, None, 5), (7, prose(99, "en", 80), "en", 1, 0.5, None, 5), (8, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int, Score double, `match` string, n_chars int").repartition(2)
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1, 60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)))
        assert left.columns == docs.columns and left.schema["n_chars"].dataType.simpleString() == "int"
        ids = [r[0] for r in left.collect()]
        assert None in ids or name == "toxicity"
        assert name != "minhash_near_dedup" or (ids.count(5), ids.count(7), ids.count(8)) == (1, 2, 2)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("length > 0").count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_queries_are_registered():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in registry.QUERIES) == 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_passages_that_begin_within_a_sentence_go(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose(1, "en", 50) + " then " + passage + " here. " + prose(2, "en", 20)), (2, prose(3, "en", 50) + " but " + passage + " there. " + prose(4, "en", 20)), (3, passage)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    want = rows[1][1].replace(passage + " ", "")
    assert left == {1: (rows[0][1], len(rows[0][1])), 2: (want, len(want))}
