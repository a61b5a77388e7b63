"""Token files round trip: the ids that come back are the tokenizer's, at the places where they stand in the corpus."""

from tokenizers import Tokenizer

from panelflow.llm import tokens
from panelflow.llm.queries import vocabulary


def test_ids_come_back_in_place(spark, tmp_path):
    texts = [None, "", "A short text.", "Über 7 Brücken 🙂 " * 40, "a b c " * 3000, "A short text."]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    path, at = f"file://{tmp_path}/blocks", vocabulary("word_bpe_49k.json")
    tokens.write_blocks(docs, path, at)
    encode, start = Tokenizer.from_file(at), 0
    got = {r.id: r for r in tokens.read_documents(spark, path).collect()}
    assert sorted(got) == [0, 10, 20, 30, 40, 50]
    for i, t in enumerate(texts):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[10 * i].start, got[10 * i].ids) == (start, ids)
        start += len(ids)
