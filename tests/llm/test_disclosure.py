"""op10's disclosing terms over whole documents, with the production parameters."""

from vecweave.llm import pii


def test_terms_of_whole_documents(spark, tmp_path):
    far = "today please call the number at hand " * 5
    rows = [(k, f"Dr Zarathustra Wu saw {far} +1 (202) 555-0143 again") for k in range(4)]
    rows += [(10 + k, f"{far} again saw number {k}") for k in range(200)] + [(999, "Zarathustra alone, and WU too"), (None, "wu without id"), (1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in pii.op10_personal_data(spark, str(tmp_path)).collect()}
    text = dict(rows)
    words = {k: [text[k][int(a) : int(b)] for n, a, b in (x.split(":") for x in v.split(",") if x) if n == "term"] for k, v in got.items()}
    assert words[0] == ["Dr", "Zarathustra", "Wu"] and words[999] == ["Zarathustra", "WU"] and words[None] == ["wu"]
    assert words[10] == [] and words[1000] == [] and len(got) == len(rows)
