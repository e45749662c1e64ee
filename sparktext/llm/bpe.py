"""BPE encoding by a queue of merge ranks over a linked symbol list, and decoding by its vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparktext.llm.common import identified, slices

# Words remembered per Python worker, with their ids or with the number of them; beyond that the memory
# is emptied and filled again. Of numbers, the last full memory is held beside the one being filled.
REMEMBERED = 400_000
COUNTED = 300_000
# Symbols up to which looking for the least rank anew is quicker than a queue.
SHORT = 24


def byte_symbols() -> list[str]:
    """One printable character per byte, as byte-level vocabularies write them."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges lowest rank first, leftmost first among equals.

    ``after`` and ``before`` link the symbols both ways. A queue entry names a pair by its left
    place; it is stale, and skipped, if either symbol has changed since.
    """
    n = len(symbols)
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(ranks[pair], i, *pair) for i in range(n - 1) if (pair := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (pair := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(queue, (ranks[pair], i, *pair))
        if (h := before[i]) >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
            heapq.heappush(queue, (ranks[pair], h, *pair))
    return [s for s in symbols if s]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left by ``merge_symbols``. The ranks of a short list are searched in place."""
    if len(symbols) > SHORT:
        return len(merge_symbols(symbols, ranks))
    never = len(ranks)
    rank = ranks.get
    left = [rank(pair, never) for pair in zip(symbols, symbols[1:])]  # noqa: B905
    while left and (least := min(left)) < never:
        i = left.index(least)
        joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
        del left[i]
        if i:
            left[i - 1] = rank((symbols[i - 1], joined), never)
        if i < len(left):
            left[i] = rank((joined, symbols[i + 1]), never)
    return len(symbols)


class _Counts(dict):
    """Number of ids of each word met, filled on demand.

    Words of the memory that was full last are taken over as they are met again, so frequent ones stay.
    """

    def __init__(self, count_word):
        super().__init__()
        self.count_word = count_word
        self.earlier: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = self.earlier.get(word)
        if n is None:
            n = self.count_word(word)
        if len(word) <= 64:
            if len(self) >= COUNTED:
                self.earlier = dict(self)
                self.clear()
            self[word] = n
        return n


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer's JSON file.

    Of the file the split pattern, the merges, the vocabulary and the added tokens are used; the
    normaliser is canonical composition, blanks and lower case.
    """

    # White space of the normaliser's pattern; str.split also parts at U+001C to U+001F.
    SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    ODD = regex.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.added.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        # Whether the pattern keeps a stretch of letters in one piece, as the usual ones do.
        self.letters_whole = self.pieces.findall("abßñ日ʰ") == ["abßñ日ʰ"]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = byte_symbols()
        self.words: dict[str, str] = {}
        self.counts = _Counts(self.count_word)
        self.sign_counts = _Counts(self.count_piece)

    def encode_word(self, word: str) -> list[int]:
        """Ids of a normalised stretch without blanks."""
        out = []
        for piece in self.pieces.findall(word):
            symbols = [self.bytes[b] for b in piece.encode()]
            symbols[-1] += self.end
            out += [self.ids[s] for s in merge_symbols(symbols, self.ranks)]
        return out

    def count_word(self, word: str) -> int:
        """Number of ids of a normalised stretch without blanks."""
        if not self.letters_whole:
            return sum(map(self.count_piece, self.pieces.findall(word)))
        if word.isalpha():
            return self.count_piece(word)
        # A piece of letters is counted as the word that it is by itself.
        return sum([self.counts[p] if p.isalpha() else self.sign_counts[p] for p in self.pieces.findall(word)])

    def count_piece(self, piece: str) -> int:
        # The symbol of an ASCII letter's byte is the letter.
        symbols = list(piece) if piece.isascii() and piece.isalpha() else [self.bytes[b] for b in piece.encode()]
        symbols[-1] += self.end
        return merged_count(symbols, self.ranks)

    def words_of(self, text: str) -> list[str]:
        # The lower case of each character by itself: no word-final form of sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w for w in self.SPACE.split(text) if w] if self.ODD.search(text) else text.split()

    def parts(self, text: str) -> list[str]:
        """Stretches of text and added tokens in turn."""
        return self.specials.split(text) if any(a in text for a in self.added) else [text]

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        parts = self.parts(text)
        return len(parts) // 2 + sum(sum(map(self.counts.__getitem__, self.words_of(part))) for part in parts[::2])

    def encode(self, text: str) -> str:
        """Ids of a text, in decimal, joined by one space."""
        parts = self.parts(text)
        known, out = self.words, []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(str(self.added[part]))
                continue
            for word in self.words_of(part):
                ids = known.get(word)
                if ids is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ids = " ".join(map(str, self.encode_word(word)))
                    if len(word) <= 64:
                        known[word] = ids
                if ids:
                    out.append(ids)
        return " ".join(out)

    def decode(self, ids: list[int]) -> str:
        """Strings of the ids; the vocabulary has no decoder, so one space stands between them."""
        return " ".join(self.strings[i] for i in ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        names = {str(i): s for i, s in known.strings.items()}
        for batch in slices(batches):
            ids = [known.encode(text) for text in batch.column("text").to_pylist()]
            lists = [x.split() for x in ids]
            decoded = [" ".join([names[i] for i in x]) for x in lists]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in lists], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in slices(batches):
            ids = [[int(i) for i in known.encode(text).split()] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else known.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts; a NULL or empty text has no ids.

    ``path`` names the vocabulary's JSON file, at the same place on every executor. Added tokens in a
    text are recognised before anything else. No shuffle; a row per row, repeated rows included.
    """
    return identified(docs, id_col, text_col).drop("text_hash").mapInArrow(_ids(path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); NULL ids give NULL, unknown ids raise."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path), "doc_id bigint, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, digests only."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return identified(docs, id_col, text_col).drop("text_hash").mapInArrow(_encoded(path), schema)
