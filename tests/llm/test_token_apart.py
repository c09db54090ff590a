"""Words that differ only in A-Z or in the sign after them are learned once, and every text keeps the library's ids."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tabwise.llm.token_files import WordEncoder, apart

PATH = public_tokenizers.path("word_bpe_49k.json")


def _encoder():
    with open(PATH, encoding="utf-8") as f:
        return WordEncoder(f.read())


def test_signs_and_capitals_make_no_new_words():
    encoder, learned = _encoder(), set()
    learn = encoder._learn_words
    encoder._learn_words = lambda new: learned.update(new) or learn(new)
    encoder.encode(["Words, words; WORDS. words' wordS!", None, "straße, Straße. straße"])
    assert learned - {b""} == {b"words", "straße".encode(), b",", b";", b".", b"'", b"!"}


def test_apart_cuts_after_letters_only():
    def cut(*texts):
        return apart(pa.array(texts, pa.large_string())).to_pylist()

    assert cut("the CAT'S, é. 3.5 ×. “a” ...b", "", ".x") == ["the cat 's , é . 3.5 ×. “a” ...b", "", " .x"]
    # a capital with such a mark has no composed form, its small letter has one
    assert cut("H̱, a.") == ["H̱, a."] and cut("T̈́") == ["T̈́"]
    assert cut("a") == ["a"] and cut("") == [""] and cut() == []


def test_texts_of_odd_characters_get_the_library_ids():
    encoder, whole, draw = _encoder(), Tokenizer.from_file(PATH), random.Random(5)
    signs = [*"aTHsSkK09.,'’\"-!<|>= \n\t\x1c\x85\xa0", "'s", "'RE", "'ll", "É", "é", "ß", "×", "÷", "ÿ", "Å", "K", "İ", "ı", "ǅ", "Σ", "σ", "“", "…",
             "²", "中", "😀", "­", "ﬁ", "abc", "The"]
    marks = ["̱", "̈", "̸", "̈́", "̊", "ͅ"]
    for chars in (signs, signs + marks):
        for _ in range(30):
            texts = ["".join(draw.choices(chars, k=draw.randrange(12))) for _ in range(40)]
            assert [x.tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
