"""The encoder of op2 against the library on texts of awkward characters."""

import random

from public_tokenizers import path
from tokenizers import Tokenizer

from corpusloom.llm.token_output import encode_texts

CHARACTERS = "ab1öüßćǅɏɐʰⅫ²½ͅéжΣ語。 ,.!?'\"*&-_~|<>\n\t  —…😀\x00\x7f​᠎`^+="


def test_ids_are_those_of_the_library():
    rng, name = random.Random(3), path("byte_bpe_50k.json")
    texts = ["".join(rng.choices(CHARACTERS, k=rng.randrange(60))) for _ in range(4000)]
    texts += ["", " ", "  a", "a ", "***", " ***", "x ***", "ö*** ü&&&. ɏ!! ɐ!! é, 語。。 語,,", "<|endoftext|> a <|endoftext|>"]
    library = Tokenizer.from_file(name)
    for text, ids in zip(texts, encode_texts(texts, name), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
