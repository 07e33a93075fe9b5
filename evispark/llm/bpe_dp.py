"""BPE encoding and decoding by per-prefix dynamic programming.

For a BPE vocabulary built by merges, every prefix of a piece has exactly one last token in its encoding: the one
that ends the prefix and is compatible with the last token of what stands before it. An automaton of the vocabulary
(Aho-Corasick, in place of a suffix automaton) lists the tokens that end at each position, a test of merge order decides
compatibility, and back-pointers from the end give the ids. No merge loop runs over the piece, so a piece of n symbols costs O(n * longest token).

Defined cases: null and empty texts have no ids; the special strings of the tokenizer's file are single ids wherever
they stand; texts of any length are encoded whole; rows that repeat are encoded alike, each for itself; a null doc_id is
carried through; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

#: Distinct white-space-delimited words, and pieces of words, whose encodings a worker remembers before it starts anew.
MEMO, PIECES = 300_000, 100_000
#: Tested pairs of tokens that a worker remembers.
BORDERS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class Vocabulary:
    """Tokens, ranks and splits of a BPE file with word ends, over an alphabet where a word's last symbol is one letter.

    A last byte and its end mark are written as one letter, END above the byte's own, so that merges act on plain strings.
    """

    END = 0x4000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in (model["vocab"] | self.special).items()}
        letters = byte_letters()
        self.inner = letters
        self.last = [chr(ord(x) + self.END) for x in letters]
        self.ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.ids[self._plain(token)] = i
        #: rank at which a pair merges (key: both ids in one number), and by id, what a token was merged from and when; symbols have rank -1
        self.merge: dict[int, int] = {}
        self.left, self.right, self.rank = ([-1] * (max(self.text) + 1) for _ in range(3))
        for r, pair in enumerate(model["merges"]):
            left, right = (self._plain(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            i, j, k = self.ids[left], self.ids[right], self.ids[left + right]
            self.merge[i << 32 | j] = r
            if self.rank[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, r
        self.suffixes = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.suffixes.add_word(t, (i, len(t)))
        #: after each symbol, the automaton's suffix links list the tokens that end there
        self.suffixes.make_automaton()
        #: borders already tested, and pieces already encoded
        self.tested: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def _plain(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            head = token[: -len(self.suffix)]
            return head[:-1] + chr(ord(head[-1]) + self.END)
        return token

    def compatible(self, border: int) -> bool:
        """Whether no merge crosses the border of two adjacent tokens before both are complete.

        Undo the later of the two tokens' last merges again and again. At each moment, the two symbols at the border
        would merge if their pair's rank comes before that of the merges already undone, leftmost first on ties.
        """
        left, right = border >> 32, border & 0xFFFFFFFF
        rank = self.rank
        #: ranks below which a crossing merge would have come first
        before = 1 << 60
        while True:
            if self.merge.get(left << 32 | right, before) < before:
                return False
            r, s = rank[left], rank[right]
            if r < 0 and s < 0:
                return True
            if r > s:  # the left token was completed last: a crossing merge of this rank would stand right of it
                before, left = r, self.right[left]
            else:  # of equal ranks, the left occurrence merges first; a crossing one stands left of the right token's
                before, right = s + 1, self.left[right]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        if (ids := self.known.get(piece)) is None:
            ids = self._encode(piece)
            if len(piece) < 100:
                if len(self.known) >= PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def _encode(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        symbols = "".join([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
        n = len(symbols)
        last, begins = [0] * (n + 1), [0] * (n + 1)
        tested, done = self.tested, 0
        for at, (t, size) in self.suffixes.iter(symbols):
            if at < done:  # this prefix has its last token; exactly one is right
                continue
            begin = at + 1 - size
            if begin:
                border = last[begin] << 32 | t
                fits = tested.get(border)
                if fits is None:
                    if len(tested) >= BORDERS:
                        tested.clear()
                    fits = tested[border] = self.compatible(border)
                if not fits:
                    continue
            done = at + 1
            last[done], begins[done] = t, begin
        out, end = [], n
        while end > 0:
            out.append(last[end])
            end = begins[end]
        out.reverse()
        return out


class Words(dict):
    """Ids as bytes and decoded text of words, remembered for short ones."""

    def __init__(self, ids, text: dict[int, str]):
        super().__init__()
        self.of, self.text = ids, text

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.of(word)
        known = (struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.text.__getitem__, ids)))
        if len(self) >= MEMO:
            self.clear()
        if len(word) < 100:
            self[word] = known
        return known


class Codec:
    """Ids and decoded text of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.vocabulary.special, key=len, reverse=True)))
        #: fixed values: the pre-token pattern and white space of the tokenizer's file
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.space = regex.compile(r"\p{White_Space}+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.memo = Words(self.word, self.vocabulary.text)

    def _plain_ids(self, text: str) -> list[int]:
        # lower case letter by letter: no form depends on its neighbours
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [i for piece in self.pieces.findall(text) for i in self.vocabulary.encode_piece(piece)]

    def word(self, word: str) -> list[int]:
        """Ids of a stretch without white space: no merge, normal form or special string crosses white space."""
        if "<|" not in word:
            return self._plain_ids(word)
        out, at = [], 0
        for m in self.special.finditer(word):
            out += self._plain_ids(word[at : m.start()])
            out.append(self.vocabulary.special[m[0]])
            at = m.end()
        return out + self._plain_ids(word[at:])

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit numbers, and the decoded text: tokens joined by one space."""
        words = (text or "").split() if not self.odd.search(text or "") else [w for w in self.space.split(text) if w]
        found = [*map(self.memo.__getitem__, words)]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each file and worker process; tasks that follow in the same process use it again."""
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str, texts: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ids as bytes and the decoded text if ``texts``, else their digests."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, " + ("ids binary, decoded string" if texts else "ids_sha256 string, decoded_sha256 string")

    def make():
        encode = codec(vocabulary).encode

        def work(cols: dict) -> dict:
            found = [encode(t) for t in cols["text"].to_pylist()]
            out = {"doc_id": cols["doc_id"], "n_tokens": [len(i) // 4 for i, _ in found]}
            if texts:
                return out | {"ids": [i for i, _ in found], "decoded": [d for _, d in found]}
            return out | {"ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in found], "decoded_sha256": [hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in found]}

        return work

    return arrow_map(docs.select("doc_id", "text"), schema, make)


def op3_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
