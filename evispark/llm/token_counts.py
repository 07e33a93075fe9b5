"""Token counts of whole texts by overlap resynchronisation.

A text is encoded in overlapping chunks, and every token is counted by the chunk that has it at its place: those that
begin before a splice by the chunk on its left, the others by the one on its right. Where a chunk begins or ends inside a
word, its own first or last tokens are not the text's; splices keep them out of the count. A splice lies at a boundary in
the overlap that is proven stable. White space is a candidate, for no normal form, pre-token, merge or special string of
the vocabulary crosses it; the proof is that the library, encoding the end of one chunk and the beginning of the next with
offsets, gives the same ids at the same places between the overlap's first and last white space. Where that fails, or
where there are no two candidates, the overlap is doubled, up to the whole chunk, and then the chunk.

A chunk's encoding is kept as its words, in the chunk's own borders, with their places and numbers of tokens; the library
encodes each different word once for as long as a worker remembers it. Every text goes this way; one that fits one
chunk has no splice.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are single tokens, the
library's default; a text without white space, however long, ends as one chunk; rows that repeat are counted each for
itself; a null doc_id is carried through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

#: Characters of a chunk and of the first overlap; stretches whose counts a worker remembers.
CHUNK, OVERLAP, MEMO = 4096, 64, 600_000
SPACE = regex.compile(r"\p{White_Space}")
WORD = regex.compile(r"\P{White_Space}+")
#: what str.split() takes for white space and the vocabulary does not
ODD = regex.compile("[\x1c-\x1f]")


class Counter:
    """Counts by the vocabulary's own library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}

    def tokens(self, words: list[list[str]]) -> list[int]:
        """Numbers of tokens of lists of words."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({w for some in words for w in some}.difference(self.memo))
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.memo.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(self.memo.__getitem__, some)) for some in words]

    def between(self, text: str, a: int, b: int, p: int, q: int) -> list[tuple[int, int]]:
        """Ids and places, within the whole text, of the tokens that text[a:b] has from p to q."""
        e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
        return [(i, s + a) for i, (s, _) in zip(e.ids, e.offsets, strict=True) if p <= s + a < q]

    def stable(self, text: str, begin: int, end: int, lap: int) -> int | None:
        """A boundary in text[begin:end], the overlap of a chunk and its successor, at which both may be cut."""
        spaces = [m.start() for m in SPACE.finditer(text, begin, end)]
        if len(spaces) < 2:
            return None
        p, q = spaces[0], spaces[-1]
        left = self.between(text, max(0, begin - lap), end, p, q)
        right = self.between(text, begin, min(len(text), end + lap), p, q)
        return p if left == right else None

    def chunks(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
        """(start, end, from, to) of each chunk: what it encodes, and the splices between which its tokens count."""
        out, start, low, size, n = [], 0, 0, chunk, len(text)
        while (end := start + size) < n:
            splice, lap, begin = None, overlap, end
            while splice is None and begin > low + 1:
                begin = max(low + 1, end - lap)
                splice = self.stable(text, begin, end, lap)
                lap *= 2
            if splice is None:  # no boundary in the whole chunk
                size *= 2
            else:
                out.append((start, end, low, splice))
                start, low, size = begin, splice, chunk
        return [*out, (start, n, low, n)]

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        words, of = [], []
        for i, text in enumerate(texts):
            for start, end, low, high in self.chunks(text, chunk, overlap):
                part = text[start:end]
                # all tokens of the chunk, without those that begin before its first splice or from its last one on
                words += [split(part), beginning_before(part, low - start), beginning_from(part, high - start)]
                of.append(i)
        out, n = [0] * len(texts), self.tokens(words)
        for k, i in enumerate(of):
            out[i] += n[3 * k] - n[3 * k + 1] - n[3 * k + 2]
        return out


def split(part: str) -> list[str]:
    return WORD.findall(part) if ODD.search(part) else part.split()


def beginning_before(part: str, place: int) -> list[str]:
    """The words of a chunk, as far as the chunk has them, that begin before a place."""
    if place <= 0:
        return []
    border = SPACE.search(part, place - 1)  # a word that begins before the place may end behind it
    return split(part[: border.start() if border else len(part)])


def beginning_from(part: str, place: int) -> list[str]:
    """The words of a chunk, as far as the chunk has them, that begin at a place or behind it."""
    if place >= len(part):
        return []
    if place > 0 and not SPACE.match(part[place - 1]):
        border = SPACE.search(part, place)  # the word around the place began before it
        place = border.start() if border else len(part)
    return split(part[place:])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each file and worker process."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        counts = counter(vocabulary).counts

        def work(cols: dict) -> dict:
            texts = [t or "" for t in cols["text"].to_pylist()]
            tokens = counts(texts, chunk, overlap)
            return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": tokens, "over_limit": [c > limit for c in tokens]}

        return work

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
