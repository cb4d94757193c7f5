"""The toxicity stage where no labelled document is outside the held-out fold."""

import pytest

from sitemill.llm import labelled, toxicity


@pytest.mark.parametrize("case", ["empty", "of no document", "held out only"])
def test_unfitted_field_keeps_every_document(spark, case):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "one two", "three four five"] * 10)], "doc_id long, text string")
    held = docs.where(labelled.held_out()).select("doc_id").collect()
    rows = {"empty": [], "of no document": [(1000 + k, k % 2) for k in range(20)], "held out only": [(r[0], 1) for r in held]}[case]
    field = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert held and toxicity.keep_clean(docs, field).count() == 40
    assert toxicity.tag(docs, field).where("predicted = 1 OR spans <> ''").count() == 0
