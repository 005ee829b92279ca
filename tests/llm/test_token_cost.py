"""What encoding costs: each word goes to the model once, a block's symbols are coded in few steps."""

import numpy as np
import public_tokenizers

from brickyard.llm import token_codec, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


class _Counted:
    """A tokenizer that notes which words its model is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []
        self.model = self

    def tokenize(self, word):
        self.asked.append(word)
        return self.tokenizer.model.tokenize(word)

    def encode_batch_fast(self, texts, **how):
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_words_go_to_the_model_once():
    encoder = token_files.ChunkEncoder(PATH)
    plain, encoder.tokenizer = encoder.tokenizer, _Counted(encoder.tokenizer)
    texts = ["Grüne, foo. bar", "grüne! FOO", "(foo) foo, GRÜNE?", "  bar\tgrüne  ", None, "", " "]
    for text in texts:  # each in a call of its own
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == plain.encode(text or "", add_special_tokens=False).ids
    assert len(encoder.tokenizer.asked) == 3


def test_letters_with_forms_of_their_own():
    plain = token_files.ChunkEncoder(PATH).tokenizer
    texts = [f"{a}{chr(c)}{b}" for c in range(0x21, 0x370) for a, b in (("", ""), ("a", "B"), ("x", "."), ("-", "y "))]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.ChunkEncoder(PATH).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_block_takes_256_steps():
    lanes, steps = token_codec._shape(token_files.BLOCK_TOKENS)
    assert lanes * steps == token_files.BLOCK_TOKENS and steps <= 256
