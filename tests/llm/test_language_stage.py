"""The pipeline's language stage rejects for want of evidence."""

from lodestone.llm import language

EN = "the cat and the dog went to the house with their friends "
DE = "der hund und die katze gingen mit ihren freunden nach hause "
TEXTS = {1: EN, 2: DE, 3: "नमस्ते दुनिया यह एक परीक्षा है", 4: EN + "नमस्ते दुनिया", 5: "x", 6: None, 7: "12 34", 8: "the dog went नमस्ते दुनिया यह एक परीक्षा है नमस्ते दुनिया यह एक परीक्षा है"}


def test_texts_without_evidence_are_rejected(spark):
    model = language.fit([EN, DE], ["en", "de"])
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in language.determined(docs, model, 0.4).collect()) == [1, 2, 4]
    alone = language.fit([EN], ["en"])
    assert sorted(r["doc_id"] for r in language.determined(docs, alone, 0.4).collect()) == [1, 2, 4, 5]
