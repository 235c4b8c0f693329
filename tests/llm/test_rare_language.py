from foliate.llm import language_id


def test_every_label_has_a_model(spark):
    rows = [(i, f"the common words of text {i} and so on", "en") for i in range(600)]
    rows += [(600 + i, f"zvyk mluvit rzadko kdy {i}", x) for i, x in enumerate(["cs", "pl", "pl", "sk"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language_id.trained(docs, rows=20)[0] == ["cs", "en", "pl", "sk", "und"]
    sizes = {r.lang: r["count"] for r in language_id.sample(docs, rows=20).groupBy("lang").count().collect()}
    assert sizes == {"en": 20, "cs": 1, "pl": 2, "sk": 1}
    kept = sorted(r.doc_id for r in language_id.sample(docs, rows=20).filter("lang = 'en'").collect())
    want = docs.filter("lang = 'en'").selectExpr("doc_id", "xxhash64(doc_id, text) h").orderBy("h").limit(20)
    assert kept == sorted(r.doc_id for r in want.collect())
