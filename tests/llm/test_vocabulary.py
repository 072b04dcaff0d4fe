"""How texts are asked of the tokenizers library."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from incidence.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **how)


def test_words_are_asked_in_runs():
    bpe, ours = Tokenizer.from_file(PATH), packing.Vocabulary(PATH)
    ours.library = counted = Counted(ours.library)
    r = np.random.default_rng(1)
    texts = [" ".join("".join(r.choice([*"abcdefgé"], r.integers(1, 12))) for _ in range(400)) + "." for _ in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts)] == [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    words = {w for t in texts for w in ours._PARTS.findall(t)}
    assert len(words) > 5000 and counted.texts < len(words) / 100


def test_runs_that_do_not_come_apart_are_asked_alone(monkeypatch):
    ours = packing.Vocabulary(PATH)
    told = [np.frombuffer(x, "<u4").tolist() for x in ours.ids(["some words here", "and more of them"])]
    for point in ([ours.library.token_to_id("a")], [1, 2]):  # never right, or not one id
        other = packing.Vocabulary(PATH)
        other.point = point
        assert [np.frombuffer(x, "<u4").tolist() for x in other.ids(["some words here", "and more of them"])] == told
