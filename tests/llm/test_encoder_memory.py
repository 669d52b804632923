"""What the encoder of the packing stage holds in a Python worker."""

import random
import tracemalloc
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from brakta.llm.bpe import make_encoder
from brakta.llm.common import Memo

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdeghiklmnorstuéü", k=rng.randrange(9, 14))) + rng.choice(["", ",", "."]) for _ in range(n)]


def test_words_that_occur_once_are_not_held():
    encode = make_encoder(TOKENIZER)
    text = " ".join(words(20_000, 1))
    tracemalloc.start()
    encode(text[:1000])
    before = tracemalloc.get_traced_memory()[0]
    encode(text)
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 1 << 20


def test_ids_are_the_librarys_at_every_sight():
    encode, library = make_encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    text = " ".join(words(500, 2)) + " The <|x|> end. Straße İ 12 don't"
    own = array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
    assert [encode(text) for _ in range(3)] == [own] * 3


def test_a_memo_keeps_from_the_second_time_on():
    asked = []
    memo = Memo(lambda key: asked.append(key) or key * 2, limit=1 << 20, twice=True)
    assert [memo["a"] for _ in range(4)] == ["aa"] * 4 and asked == ["a", "a"]
    for key in map(str, range(20_000)):  # the generations turn
        assert memo[key] == memo[key] == memo[key] == key * 2
    assert memo["a"] == "aa" and len(memo) + len(memo.elder) < 20_000
