"""The encoder asks the automaton for the longest token at the places it stands at, not for all tokens everywhere; pieces don't depend on which white space is around them."""

import random

import pytest

bpe = pytest.importorskip("densigrid.llm.bpe")


def merged(spec: dict, rank: dict, piece: str) -> list[int]:
    """Byte-pair encoding as it is defined: the pair of least rank first, of equal ones the left."""
    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    letters = bpe.byte_letters()
    parts = [letters[b] for b in piece.encode()]
    parts[-1] += suffix
    while len(parts) > 1:
        least, i = min((rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if least == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [vocab[p] for p in parts]


def test_longest_tokens_where_the_encoder_stands():
    import json

    from densigrid.llm.queries import vocabulary_path

    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    made = bpe.Bpe(spec)
    rank = {tuple(p if isinstance(p, list) else p.split(" ")): i for i, p in reversed(list(enumerate(spec["model"]["merges"])))}

    class Words:
        """The automaton without the walk over all matches."""

        iter_long = made.words.iter_long

    made.words = Words
    rng = random.Random(5)
    pieces = ["a", "é", "中", "!" * 9, "theeringtionat"] + ["".join(rng.choices("etaoinshrdlußé", k=rng.randint(1, 24))) for _ in range(2000)]
    for p in pieces:
        assert list(memoryview(made.encode_piece(p)).cast("I")) == merged(spec, rank, p), p
    assert not made.blanks_matter
    for text in ("A  b\t\nc", "it's\x0b 12 don't", "ü   x　y"):
        blank = made.blank.sub(" ", text)
        assert made.encode(text).tobytes() == b"".join(made.encode_piece(p) for p in made.split.findall(blank.lower()))
