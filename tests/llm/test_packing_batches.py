"""Batches of texts are encoded chunk by chunk."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_llm import fuzzed

from meshwork.llm.packing import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_batches_have_the_librarys_ids_in_all_scripts():
    texts = ["", " ", *fuzzed(23, 20_000), "(Ab) ab. AB éb ÉB İb ßa ab|cd 12 a\nb", ""]
    own = WordEncoder(WORDS)
    n, ids = own.encode_all(pa.array(texts), 1)
    library = own.model.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, own.kind).tolist() for x in ids.to_pylist()] == [[*x.ids, 1] for x in library]
    assert n.tolist() == [len(x.ids) + 1 for x in library]
    assert own.encode_all(pa.array(texts).slice(5, 40), 1)[1].to_pylist() == ids.to_pylist()[5:45]
    assert len(own.encode_all(pa.array([], pa.string()), 1)[1]) == 0


def test_a_batchs_word_is_encoded_once_though_more_differ_than_are_remembered(monkeypatch):
    asked, word = [], WordEncoder.word
    monkeypatch.setattr(WordEncoder, "word", lambda self, letters: asked.append(letters) or word(self, letters))
    own = WordEncoder(WORDS)
    own.words.half = 2000
    asked.clear()
    words = ["".join(chr(97 + i // 26**j % 26) for j in range(3)) for i in range(1000)]
    own.encode_all(pa.array([" ".join(words), "\n".join(f"({w.title()})." for w in words), " ".join(words)]), 1)
    assert len(asked) == len(words)
