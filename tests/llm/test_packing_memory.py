"""What workers keep while pieces are placed."""

import public_tokenizers

from meshwork.llm import packing


def test_workers_drop_the_encoder_before_pieces_are_placed(spark, monkeypatch):
    names, in_arrow = [], packing.in_arrow
    monkeypatch.setattr(packing, "in_arrow", lambda df, name, run, schema: names.append(name) or in_arrow(df, name, run, schema))
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in found} == {1, 2} and len(set(names)) == 2
