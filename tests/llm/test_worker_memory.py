"""What a Python worker keeps or takes at once is bounded."""

from tokenizers import Tokenizer

from partloom.llm import packing
from partloom.llm.pretokens import symbol_table
from partloom.llm.queries import TOKENIZER


class Asked:
    """A splitter, and a tokenizer's batch encoder, that remember what they were asked."""

    def __init__(self, inner):
        self.inner, self.longest, self.pieces = inner, 0, []

    def pre_tokenize_str(self, text):
        self.longest = max(self.longest, len(text))
        return self.inner.pre_tokenize_str(text)

    def encode_batch(self, pieces, add_special_tokens):
        self.pieces += pieces
        return self.inner.encode_batch(pieces, add_special_tokens=add_special_tokens)


def test_code_points_are_asked_in_short_runs():
    splitter = Asked(Tokenizer.from_file(TOKENIZER).pre_tokenizer)
    symbol_table(splitter)
    assert splitter.longest < 1 << 17


def test_pieces_met_again_are_kept_when_others_are_dropped(monkeypatch):
    monkeypatch.setattr(packing, "MOST_PIECES", 20)
    encoder = packing.Encoder(TOKENIZER)
    library, encoder.tokenizer = encoder.tokenizer, Asked(encoder.tokenizer)
    for n in range(40):
        text = " the" + "".join(f" word{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + i)}" for i in range(5))
        own = library.encode(text, add_special_tokens=False).ids
        assert packing.np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == own
        assert len(encoder.known) <= 20 and len(encoder.older) <= 20
    assert encoder.tokenizer.pieces.count("Ġthe") + encoder.tokenizer.pieces.count(" the") == 1
