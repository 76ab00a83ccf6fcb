"""What a worker keeps of one operator when it turns to another."""

import gc
import weakref

from newsgrid.llm import segments as S


def test_encoders_are_gone_at_once():
    encoder = S.kept(S.WordEncoder, S.vocabulary("word_bpe_49k.json"))
    list(encoder.encode(["some words, some more"]))
    left = weakref.ref(encoder)
    del encoder
    gc.disable()
    try:
        S.forget()
        assert left() is None and not S._KEPT
    finally:
        gc.enable()
