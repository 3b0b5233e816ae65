"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton gives the longest token that starts at a place of a piece, and a table the next shorter one that it begins with. The encoder takes the
longest one that goes with the token before it, and steps back where no token does; two tokens go together when merging would never have crossed the border between them, which
follows from the merge table alone and is kept in a pair table. Every place of a piece is given up at most once, so the work is
linear in its length. Decoding gathers the bytes of all tokens from one buffer by their offsets.

The vocabulary is a file in the format of the tokenizers library, with an end-of-word suffix; only that format's parts used by
it are supported (NFC, white space to a blank, lower case; split by pattern; byte-level letters; no decoder), others are refused.

Defined cases: null and empty texts have no tokens and decode to the empty text; special tokens in a text become their ids; repeated rows are encoded
alike; long texts are encoded whole; other columns are kept, and replaced only where they are named as a result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from densigrid.llm.common import extended

CACHE_PIECES = 120_000  # encoded pieces in each of the two generations that a worker remembers; of token pairs four times as many
SPACE = "\t-\r \x85\xa0  -     　"
END = "￿"  # stands for the end-of-word suffix within the automaton


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Pieces(dict):
    """Encoded pieces, each worked out when first asked for; a full generation becomes the old one, from which pieces still come back."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.work(piece)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Bpe:
    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or not model["end_of_word_suffix"]:
            raise ValueError("this vocabulary file has parts that are not supported")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.letters = byte_letters()
        mark = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) and t != suffix else t
        self.merged, self.parts, self.rank = {}, {}, {}
        for i, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            t = vocab["".join(pair if isinstance(pair, list) else pair.split(" "))]
            if (a, b) not in self.merged:
                self.merged[a, b] = (i, t)
            if t not in self.parts:
                self.parts[t], self.rank[t] = (a, b), i
        self.words = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.parts or len(mark(token)) == 1 or len(mark(token)) == 2 and mark(token).endswith(END):
                self.words.add_word(mark(token), (len(mark(token)), i))
        self.words.make_automaton()
        size = max([*vocab.values(), *(x["id"] for x in spec.get("added_tokens", []))]) + 1
        self.length, self.shorter = [0] * size, [-1] * size  # of each token its length, and the longest other token that it begins with
        known = dict((word, token) for word, (_, token) in self.words.items())
        for word, token in known.items():
            self.length[token] = len(word)
            self.shorter[token] = next((known[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in known), -1)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # No piece holds white space, nor depends on which it is, if the pattern names it only among what a class leaves out.
        self.blanks_matter = bool(re.search(r"\s|[\\.$^]", re.sub(r"\[\^[^\]]*\]|\\p\{[LN]\}", "", pattern)))
        pattern = pattern.replace("\\s", SPACE)
        self.split = regex.compile(pattern)
        simple = pattern.replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9")
        self.split_ascii = self.split if "\\p" in simple else re.compile(simple)
        self.blank = regex.compile(f"[{SPACE}]+")
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = {k: np.array([v], dtype="<u4").tobytes() for k, v in added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        names = [b""] * size
        for t, i in [*vocab.items(), *added.items()]:
            names[i] = t.encode()
        # Without a decoder tokens are joined by blanks: each entry begins with one, and the first is cut off.
        self.blob = np.frombuffer(b"".join(b" " + n for n in names), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(n) + 1 for n in names])]).astype(np.int64)
        self.fits: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_piece)

    def together(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between these two tokens: undo their merges from the latest on; at no time
        may the pieces that meet at the border have a merge that comes before the next one to be undone."""
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            a, b, found = left, right, True
            before = len(self.rank) + 1  # merges of this rank and later are undone already
            side = 0
            while True:
                m = self.merged.get((a, b))
                # A tie of ranks is decided by place: the left of two equal merges comes first.
                if m is not None and (m[0] < before or m[0] == before and side == 1):
                    found = False
                    break
                ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
                if ra < 0 and rb < 0:
                    break
                if ra > rb:
                    before, side, a = ra, 0, self.parts[a][1]
                else:
                    before, side, b = rb, 1, self.parts[b][0]
            if len(self.fits) >= 4 * CACHE_PIECES:
                self.fits.clear()
            self.fits[key] = found
        return found

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of text (a word), as little-endian 32-bit integers."""
        letters = self.letters
        word = "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")]) + END
        n, fits, length, shorter = len(word), self.fits, self.length, self.shorter
        longest = [-1] * n  # tokens at the places met
        for end, (size, token) in self.words.iter_long(word):
            longest[end - size + 1] = token
        dead = bytearray(n + 1)
        path: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    good = fits.get(last << 32 | token)
                    if good if good is not None else self.together(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at, last = at + length[token], token
                if at < n:
                    token = longest[at]
                    if token < 0:
                        end, (size, token) = next(self.words.iter_long(word, at), (-1, (0, -1)))
                        if end - size + 1 != at:
                            token = -1
                        longest[at] = token
            else:
                dead[at] = 1
                if not path:
                    raise ValueError("no token sequence")
                token = path.pop()
                at, last = at - length[token], path[-1] if path else -1
                token = shorter[token]
        return np.array(path, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), dtype="<u4")
        return np.frombuffer(b"".join(self.special.get(x) or self._plain(x) for x in self.cut.split(text) if x), dtype="<u4")

    def _plain(self, text: str) -> bytes:
        split = self.split_ascii
        if not text.isascii():
            split, text = self.split, unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma isn't told apart
        if self.blanks_matter:
            text = self.blank.sub(" ", text)
        return b"".join(map(self.pieces.__getitem__, split.findall(text.lower())))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        take = np.repeat(start - (ends - size), size)
        take += np.arange(len(take))
        return self.blob[take].tobytes()[1:]


_LOADED: dict[str, Bpe] = {}


def loaded(spec_text: str) -> Bpe:
    """The encoder of a vocabulary, made once in each worker."""
    key = hashlib.sha256(spec_text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(json.loads(spec_text))
    return _LOADED[key]


def tokens(docs: DataFrame, vocabulary_path: str, digests_only: bool = True, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, unless it is kept) with n_tokens, ids_sha256 and decoded_sha256, and, unless ``digests_only``, ids (array<int>) and decoded (string).

    The vocabulary (a few MB, a fixed file) is read by the driver and broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(texts: list) -> tuple:
        bpe = loaded(shared.value)
        out: tuple = ([], [], [], [], [])
        for t in texts:
            ids = bpe.encode(t if isinstance(t, str) else None)
            back = bpe.decode(ids)
            row = [len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()]
            for held, x in zip(out, row if digests_only else [*row, ids.astype(np.int32), back.decode()]):
                held.append(x)
        return out[: 3 if digests_only else 5]

    return extended(docs, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string"), work, () if keep_text else (text,))
