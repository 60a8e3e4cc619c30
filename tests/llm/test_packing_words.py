from array import array

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_alone_are_not_parted(monkeypatch):
    """Words of ASCII letters alone go to the vocabulary as they are; ids stay the library's, also from both memories."""
    parted, stem = [], packing._stem
    monkeypatch.setattr(packing, "_stem", lambda chunk: parted.append(chunk) or stem(chunk))
    monkeypatch.setattr(packing, "_KNOWN", {})
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 3)
    long = "Longword" * 12
    texts = ["The word the WORD\nthe, (x) don't  Été été. naïve!", f"{long} {long.lower()} {long}, a1b2 ƻ ...", "", "The word, été " + long]
    tk = Tokenizer.from_file(PATH)
    for part in (texts[:2], texts[1:], texts, texts[::-1]):
        assert list(packing._word_ids(PATH, part)) == [array("I", tk.encode(t, add_special_tokens=False).ids).tobytes() for t in part]
    assert parted and not [p for p in parted if p.isascii() and p.isalpha()]
