import pytest

from tidemark.llm import tokens

PATH = "/opt/tokenizers/byte_bpe_50k.json"


def kept(encoder):
    return len(encoder.parts) + len(encoder.words) + len(encoder.spaced)


def test_strings_go_with_the_task():
    with tokens.encoding(PATH) as encode:
        ids = encode("Some words of a text, and some more words.")
        assert kept(tokens.encoder(PATH)) > 0
    assert kept(tokens.encoder(PATH)) == 0
    with tokens.encoding(PATH) as encode:
        assert encode("Some words of a text, and some more words.") == ids


def test_strings_go_with_a_failed_task():
    with pytest.raises(RuntimeError), tokens.encoding(PATH) as encode:
        encode("Some words.")
        raise RuntimeError
    assert kept(tokens.encoder(PATH)) == 0
