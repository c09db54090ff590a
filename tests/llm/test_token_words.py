"""Distinct words are found by Arrow, looked up once and learned once."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tabwise.llm.common import Generations
from tabwise.llm.token_files import WordEncoder, _as_bytes


def test_values_learns_what_neither_generation_holds():
    asked = []

    def learn(keys):
        asked.append(set(keys))
        return {k: k * 2 for k in keys}

    cache = Generations(2)
    assert cache.values([1, 2, 3], learn) == [2, 4, 6]
    assert cache.values([3, 4], learn) == [6, 8] and cache.values([], learn) == []
    assert cache.values([4, 3], learn) == [8, 6]
    assert asked == [{1, 2, 3}, {4}] and set(cache.young) == {3, 4}


def test_bytes_of_sliced_strings():
    held = pa.array(["a", "", "é\n", "bc"], pa.large_string())
    assert _as_bytes(held) == [b"a", b"", "é\n".encode(), b"bc"] and _as_bytes(held[2:]) == ["é\n".encode(), b"bc"]
    assert _as_bytes(pa.array([], pa.large_string())) == []


def test_whole_texts_get_the_library_ids_and_words_are_learned_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = WordEncoder(f.read())
    learned = []
    learn = encoder._learn_words
    encoder._learn_words = lambda new: learned.extend(new) or learn(new)
    texts = ["  the cat\tthe  CAT\x0b\x0cit's\r\nthe ", None, "", " \n", "a\x1cb\x85c d e the", "İstanbul naïve ǅ ΣΣ", "\u0000 x",
             "the <|endoftext|> cat", "\U0001f600the", "the cat " * 500]
    whole = Tokenizer.from_file(path)
    for _ in range(2):
        got = encoder.encode(texts)
        assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder.encode([])] == [] and [len(x) for x in encoder.encode([None, ""])] == [0, 0]
    assert len(learned) == len(set(learned))
