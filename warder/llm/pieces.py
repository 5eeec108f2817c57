"""SentencePiece BPE encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import documents

SPACE = "▁"
#: Encoded words kept by a worker; the table starts anew when it is full.
CACHE_WORDS = 300_000
CACHE_WORD_CHARS = 64
PAIRS = 1_000_000


class WordCache(dict):
    """Ids of words as int32 bytes, in two generations: a full one becomes the old one, from
    which words that come again are taken over."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("i", self.encode(word)).tobytes()
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class PieceEncoder:
    """Encodes a text exactly as the library does with a BPE model and byte fallback.

    The vocabulary gives merges by score: the adjacent pair whose joined piece has the
    best score merges first, leftmost among equals. A sequence of pieces is the encoding
    of a text iff every two neighbours stay as they are when their joined text is merged.
    """

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in pieces}
        self.text = {i: p for p, i in self.ids.items()}
        scores = {i: sp.get_score(i) for i in pieces}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Merge rank; single characters are there from the start.
        self.rank = {i: -1 if len(self.text[i]) == 1 else order[scores[i]] for i in pieces}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.eos = sp.eos_id()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.singles = {p: (i, 1) for p, i in self.ids.items() if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for piece, i in self.ids.items():  # single characters need no search
            if len(piece) > 1 and self.split(i):
                self.matches.add_word(piece, (len(piece) - 1, (i, len(piece))))
        self.matches.make_automaton()
        self.words = WordCache(self.encode_word)
        self.whole_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i; None if merging never makes it."""
        if i not in self.halves:
            parts = [self.ids.get(c) for c in self.text[i]]
            last = None
            while len(parts) > 1 and None not in parts:
                joins = [(self.rank[j], k, j) for k in range(len(parts) - 1) if (j := self.ids.get(self.text[parts[k]] + self.text[parts[k + 1]])) is not None]
                if not joins:
                    break
                _, k, j = min(joins)
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [j]
            self.halves[i] = last if len(parts) == 1 else None
        return self.halves[i]

    def stays(self, left: int, right: int) -> bool:
        """True if merging the joined text of two pieces gives these two again.

        The merges are undone from the latest on. Before each, the pieces at the border are
        those that lived then; had they a join due before either of them grew (on the left
        side at the same rank, the left growth comes first), it would have crossed the border.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self._stays(left, right)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _stays(self, left: int, right: int) -> bool:
        rank, text, never = self.rank, self.text, len(self.rank)
        left_grows = right_grows = never
        while True:
            join = self.ids.get(text[left] + text[right])
            if join is not None and rank[join] < left_grows and rank[join] <= right_grows:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left_grows, left = a, self.split(left)[1]
            else:
                right_grows, right = b, self.split(right)[0]

    def backtrack(self, text: str) -> list[int]:
        """Encode a text of known characters. Longest match first; a position from which no
        match fits is marked in a bit field and never tried again."""
        n = len(text)
        singles, stays = self.singles, self.stays
        found = [[singles[c]] for c in text]
        for end, (back, piece) in self.matches.iter(text):  # by rising length for each start
            found[end - back].append(piece)
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        tried: list[tuple[int, int]] = []  # place and candidate of each chosen piece
        pos, at, last = 0, len(found[0]) - 1 if n else -1, -1
        while pos < n:
            here = found[pos]
            while at >= 0:
                piece, size = here[at]
                end = pos + size
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or stays(last, piece)):
                    break
                at -= 1
            if at >= 0:
                out.append(piece)
                tried.append((pos, at))
                pos, last = end, piece
                at = len(found[pos]) - 1 if pos < n else -1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                out.pop()
                last = out[-1] if out else -1
                pos, at = tried.pop()
                at -= 1
        return out

    def encode_word(self, word: str) -> list[int]:
        """Characters outside the vocabulary become bytes and merge with nothing."""
        out: list[int] = []
        start = 0
        for k, c in enumerate(word):
            if c not in self.ids:
                out += self.backtrack(word[start:k])
                out += [self.bytes[b] for b in c.encode("utf-8")]
                start = k + 1
        return out + self.backtrack(word[start:])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without end id. No piece holds a space after another
        character, so runs that begin with spaces are encoded on their own."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        if not self.whole_words:
            return np.array(self.encode_word(marked), dtype=np.int32)
        parts = marked.split(SPACE)
        if "" in parts[1:]:  # runs of spaces: each belongs to what follows
            words, run = [], 0
            for part in parts[1:]:
                run += 1
                if part:
                    words.append(SPACE * run + part)
                    run = 0
            if run:
                words.append(SPACE * run)
        else:
            words = [SPACE + part for part in parts[1:]]
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


#: Characters of text that a task holds encoded at once.
SLICE_CHARS = 4_000_000


def slices(texts: list[str], most: int = SLICE_CHARS):
    """Ranges of rows with about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def piece_encode(df: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """Encode and decode every whole text: (key, ids array<int> with the end id, decoded).

    A null or empty text has the end id only and decodes to ''. Rows are independent:
    repeated rows and keys return as often as they come, an empty table returns none, and
    other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(model)
        end = np.array([enc.eos], dtype=np.int32)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = [np.concatenate([enc.encode(t), end]) for t in texts[a:b]]
                decoded = [enc.library.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(ids, pa.int32()), pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = piece_encode(documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
