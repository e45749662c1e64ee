"""Text likelihood summed over all subword segmentations, mixed with word counts of a corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.llm.common import identified, stored
from sparktext.llm.words import mixed, powers

WORD_MARK = "▁"
END_OF_WORD = "\n"  # never inside a word
END_OF_TEXT = ""  # the token after the last word, as no word is empty
# Words of one length that form a matrix, and the longest that do.
MATRIX_WORDS = 20_000
MATRIX_CHARS = 40
COUNTED_WORDS = 300_000  # distinct words a task gathers before it passes them on
# Bound of the broadcast table of frequent words.
FREQUENT_WORDS = 131_072
FREQUENT_BYTES = 16 << 20
PARTS = "doc_id bigint, text_hash bigint, held_out boolean, word string, n bigint, copies bigint, known bigint, base double, score double"


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII blanks."""
    return text.encode().lower().split()


@dataclass
class Pieces:
    """Log-probabilities of the pieces that begin a word and of those that go on, with the word's end.

    Both sets sum to one, so the sum over all words is at most one.
    """

    first: dict[str, float]
    later: dict[str, float]

    @staticmethod
    def weighted(first: dict[str, float], later: dict[str, float]) -> Pieces:
        def logs(weights):
            total = math.log(sum(weights.values()))
            return {p: math.log(w) - total for p, w in weights.items()}

        return Pieces(logs(first), logs(later))

    def longest(self) -> int:
        return max(map(len, (*self.first, *self.later)))


def read_pieces(path: str) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of a sentencepiece vocabulary's pieces by its scores, which order the pieces: the score
    -r stands for the weight 1 / (r + 2), as frequencies fall with the rank. Byte pieces rank last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later, lowest = {}, {}, 0.0
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or WORD_MARK in piece[1:] or score < -1e8:
            continue
        lowest = min(lowest, score)
        weight = 1 / (2 - score)
        if piece[0] == WORD_MARK:
            first[piece[1:]] = weight
        else:
            later[piece] = weight
    first.setdefault("", 1 / (2 - lowest))
    for byte in range(256):
        later[f"<0x{byte:02X}>"] = 1 / (2 - lowest)
    later[END_OF_WORD] = 0.5
    return first, later


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))


def _edges(word: str, pieces: Pieces, longest: int) -> tuple[list[tuple[int, str, float]], list[list[tuple[int, str, float]]]]:
    """Edges (end, piece, log-probability) that begin the word, and those from each place inside it."""
    n, first, later = len(word), pieces.first, pieces.later
    begin = [(0, "", first[""])]
    for j in range(1, min(n, longest) + 1):
        if (p := first.get(word[:j])) is not None:
            begin.append((j, word[:j], p))
    inside = []
    for i in range(n):
        own = [(j, s, p) for j in range(i + 1, min(n, i + longest) + 1) if (p := later.get(s := word[i:j])) is not None]
        if not own or own[0][0] != i + 1:  # the character is no piece: its bytes are
            own.append((i + 1, word[i], sum(later[f"<0x{b:02X}>"] for b in word[i].encode())))
        inside.append(own)
    return begin, inside


def _forward(word: str, begin, inside) -> list[float]:
    into: list[list[float]] = [[] for _ in range(len(word) + 1)]
    for j, _, p in begin:
        into[j].append(p)
    reached = []
    for i, edges in enumerate(inside):
        a = _log_sum(into[i])
        reached.append(a)
        for j, _, p in edges:
            into[j].append(a + p)
    reached.append(_log_sum(into[-1]))
    return reached


def word_log_probability(word: str, pieces: Pieces, longest: int) -> float:
    """Natural log of the word's probability, summed over its segmentations by forward recursion."""
    return _forward(word, *_edges(word, pieces, longest))[-1] + pieces.later[END_OF_WORD]


def _uses(word: str, pieces: Pieces, longest: int, first: Counter, later: Counter) -> None:
    """Add the expected use of each piece in the word, by forward and backward recursion."""
    begin, inside = _edges(word, pieces, longest)
    reached = _forward(word, begin, inside)
    total, n = reached[-1], len(word)
    left = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = _log_sum([p + left[j] for j, _, p in inside[i]])
        for j, piece, p in inside[i]:
            use = math.exp(reached[i] + p + left[j] - total)
            if use > 1e-6:
                if piece in pieces.later:
                    later[piece] += use
                else:
                    for b in piece.encode():
                        later[f"<0x{b:02X}>"] += use
    for j, piece, p in begin:
        first[piece] += math.exp(p + left[j] - total)
    later[END_OF_WORD] += 1


class Lattice:
    """The same recursions over many words at once: words of one length are the rows of a matrix.

    Pieces are found by the hash of a stretch of characters, from running sums over each row.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.longest = pieces, pieces.longest()
        self.up, self.down = powers(MATRIX_CHARS + 1)
        self.sides = []
        for side in (pieces.first, pieces.later):
            names = [p for p in side if p and p != END_OF_WORD and not p.startswith("<0x")]
            keys = np.array([self._hash_of(p) for p in names], np.uint64)
            order = np.argsort(keys)
            self.sides.append(([names[i] for i in order], keys[order], np.array([side[names[i]] for i in order])))
        self.spelled: dict[int, float] = {}

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        sums = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[: codes.shape[0], None], axis=0, out=sums[1:])
        return sums

    def _hash(self, sums: np.ndarray, i: int, j: int) -> np.ndarray:
        return mixed((sums[j] - sums[i]) * self.down[i] + np.uint64(j - i))

    def _hash_of(self, piece: str) -> np.uint64:
        return self._hash(self._sums(np.array([[ord(c)] for c in piece], np.uint64)), 0, len(piece))[0] if len(piece) <= MATRIX_CHARS else np.uint64(0)

    def _found(self, side: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, keys, logs = self.sides[side]
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return at, np.where(keys[at] == h, logs[at], -np.inf)

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of single characters spelled by bytes."""
        kinds, inverse = np.unique(codes, return_inverse=True)
        for c in kinds.tolist():
            if c not in self.spelled:
                self.spelled[c] = sum(self.pieces.later[f"<0x{b:02X}>"] for b in chr(c).encode())
        return np.array([self.spelled[c] for c in kinds.tolist()])[inverse]

    def _forward(self, words: list[str]):
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n).T.astype(np.uint64)
        sums = self._sums(codes)
        reached = np.full((n + 1, len(words)), -np.inf)
        reached[0] = self.pieces.first[""]
        begin, inside = [], []
        for j in range(1, min(n, self.longest) + 1):
            at, p = self._found(0, self._hash(sums, 0, j))
            if np.isfinite(p).any():
                begin.append((j, at, p))
                reached[j] = np.logaddexp(reached[j], p)
        spelled = []
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                at, p = self._found(1, self._hash(sums, i, j))
                if j == i + 1:
                    lost = np.flatnonzero(~np.isfinite(p))
                    if len(lost):
                        own = np.full(len(words), -np.inf)
                        own[lost] = self._bytes(codes[i][lost])
                        spelled.append((i, codes[i], own))
                        reached[j] = np.logaddexp(reached[j], reached[i] + own)
                if np.isfinite(p).any():
                    inside.append((i, j, at, p))
                    reached[j] = np.logaddexp(reached[j], reached[i] + p)
        return reached, begin, inside, spelled

    def _by_length(self, words: list[str]):
        """(places, words) of one length; words too long for a matrix one by one."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for k in range(0, len(places), MATRIX_WORDS):
                own = places[k : k + MATRIX_WORDS]
                yield own, [words[i] for i in own]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, as word_log_probability() gives it."""
        out = np.zeros(len(words))
        for places, own in self._by_length(words) if words else ():
            if len(own[0]) > MATRIX_CHARS:
                out[places] = [word_log_probability(w, self.pieces, self.longest) for w in own]
            else:
                out[places] = self._forward(own)[0][-1] + self.pieces.later[END_OF_WORD]
        return out

    def uses(self, words: list[str], first: Counter, later: Counter) -> None:
        """Add the expected use of each piece in the words."""
        counts = [np.zeros(len(names)) for names, _, _ in self.sides]
        for _, own in self._by_length(words) if words else ():
            n = len(own[0])
            if n > MATRIX_CHARS:
                for w in own:
                    _uses(w, self.pieces, self.longest, first, later)
                continue
            reached, begin, inside, spelled = self._forward(own)
            left = np.full((n + 1, len(own)), -np.inf)
            left[n] = 0.0
            by_start: list[list] = [[] for _ in range(n)]
            for i, j, at, p in inside:
                by_start[i].append((j, p))
            for i, _, p in spelled:
                by_start[i].append((i + 1, p))
            for i in range(n - 1, -1, -1):
                for j, p in by_start[i]:
                    left[i] = np.logaddexp(left[i], p + left[j])
            for i, j, at, p in inside:
                counts[1] += np.bincount(at, np.exp(reached[i] + p + left[j] - reached[n]), len(counts[1]))
            for i, codes, p in spelled:
                use = np.exp(reached[i] + p + left[i + 1] - reached[n])
                kinds, inverse = np.unique(codes, return_inverse=True)
                for c, u in zip(kinds.tolist(), np.bincount(inverse, use).tolist(), strict=True):
                    if u > 0:
                        for b in chr(c).encode():
                            later[f"<0x{b:02X}>"] += u
            for j, at, p in begin:
                counts[0] += np.bincount(at, np.exp(p + left[j] - reached[n]), len(counts[0]))
            first[""] += float(np.exp(self.pieces.first[""] + left[0] - reached[n]).sum())
            later[END_OF_WORD] += len(own)
        for total, count, (names, _, _) in zip((first, later), counts, self.sides, strict=True):
            for k in np.flatnonzero(count > 1e-9).tolist():
                total[names[k]] += float(count[k])


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def passed(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    trained, other = Counter(), set()
    for batch in batches:
        for text, out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            if out:
                other.update(words_of(text))
            else:
                trained.update(words_of(text))
                trained[END_OF_TEXT.encode()] += 1
            if len(trained) + len(other) > COUNTED_WORDS:
                yield passed(dict.fromkeys(other, 0) | trained)
                trained, other = Counter(), set()
    yield passed(dict.fromkeys(other, 0) | trained)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of (text, held_out): every word of the corpus and its count in rows not held out."""
    return docs.select("text", "held_out").mapInArrow(_counts, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def adapted(words: DataFrame, first: dict[str, float], later: dict[str, float], rounds: int = 2, prior: float = 100.0) -> Pieces:
    """Pieces weighted by their expected use in the distinct words of the corpus (c > 0), in ``rounds``
    rounds of expectation and maximisation that begin with the vocabulary's scores. The scores also
    count for ``prior`` words, so that no piece gets probability 0. What comes to the driver is one
    number per piece of the vocabulary."""
    pieces = Pieces.weighted(first, later)
    base = [{p: w * prior / sum(ws.values()) for p, w in ws.items()} for ws in (first, later)]
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            begun, went, lattice = Counter(), Counter(), Lattice(pieces)
            for batch in batches:
                lattice.uses(batch.column(0).to_pylist(), begun, went)
            kind = [True] * len(begun) + [False] * len(went)
            columns = [pa.array(kind, pa.bool_()), pa.array([*begun, *went], pa.string()), pa.array([*begun.values(), *went.values()], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["begins", "piece", "uses"])

        known = words.where((F.col("c") > 0) & (F.col("word") != END_OF_TEXT)).select("word")
        uses = known.mapInArrow(expected, "begins boolean, piece string, uses double").groupBy("begins", "piece").agg(F.sum("uses").alias("uses"))
        weights = [dict(base[0]), dict(base[1])]
        for begins, piece, n in uses.collect():  # at most one row per piece and kind
            side = weights[0 if begins else 1]
            side[piece] = side.get(piece, 0.0) + n
        pieces = Pieces.weighted(*weights)
    return pieces


@dataclass
class Corpus:
    """Counts of training tokens: all, distinct, seen once, seen twice, ends of text."""

    tokens: int
    distinct: int
    once: int
    twice: int
    ends: int

    @staticmethod
    def of(words: DataFrame) -> Corpus:
        count = [F.sum("c"), *[F.sum(F.when(x, 1).otherwise(0)) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]]
        row = words.agg(*count, F.sum(F.when(F.col("word") == END_OF_TEXT, F.col("c")))).first()
        return Corpus(*[int(x or 0) for x in row])

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def mixed(self, c, log_probability):
        """log10 of discounted relative counts plus the freed mass spread by the subword lattice."""
        if not self.tokens:  # nothing learned: half for the end, half for words
            return log_probability / math.log(10) + math.log10(0.5)
        free = math.log10(self.discount * self.distinct / self.tokens) + log_probability / math.log(10)
        with np.errstate(divide="ignore"):
            return np.logaddexp2(np.log2(np.maximum(c - self.discount, 0) / self.tokens), free / math.log10(2)) * math.log10(2)

    def end(self) -> tuple[int, float, float]:
        score = math.log10((self.ends - self.discount) / self.tokens) if self.tokens else math.log10(0.5)
        return int(self.ends > 0), float(self.base(self.ends)), score


def scored_words(words: DataFrame, pieces: Pieces, corpus: Corpus) -> DataFrame:
    """(word, c, base, score): log10 probabilities of every distinct word, each computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            log_p = lattice.log_probabilities(batch.column("word").to_pylist())
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            columns = [batch.column("word"), batch.column("c"), pa.array(corpus.base(c)), pa.array(corpus.mixed(c, log_p))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", "base", "score"])

    return words.where(F.col("word") != END_OF_TEXT).mapInArrow(run, "word string, c bigint, base double, score double")


def frequent(scored: DataFrame) -> dict[bytes, tuple[int, float, float]]:
    """The most frequent words with (known, base, score), bounded in number and bytes.

    The cut is taken from a histogram of counts with eight steps per doubling.
    """
    step = F.floor(8 * F.log2(F.greatest("c", F.lit(1)))).cast("int")
    seen = scored.where("c > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    cut, n, size = None, 0, 0
    for row in sorted(seen, key=lambda r: -r["step"]):
        n, size = n + row["n"], size + row["bytes"]
        if n > FREQUENT_WORDS or size > FREQUENT_BYTES:
            break
        cut = row["step"]
    if cut is None:
        return {}
    rows = scored.where((F.col("c") > 0) & (step >= cut)).select("word", "base", "score").toArrow().to_pydict()
    return {w.encode(): (1, b, s) for w, b, s in zip(rows["word"], rows["base"], rows["score"], strict=True)}


def repeated(log10_p: float, n: int, strength: float) -> float:
    """log10 of the rising factorial x (x + 1) ... (x + n - 1) with x = strength * p; p may underflow."""
    x = strength * 10.0**log10_p
    more = (math.lgamma(n + x) - math.lgamma(1 + x)) / math.log(10) if n > 1 else 0.0
    return math.log10(strength) + log10_p + more


def _partial(table, end, strength: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, once = table.value, math.log10(strength)
        for batch in batches:
            ids, hashes, outs = (batch.column(c) for c in ("doc_id", "text_hash", "held_out"))
            rows, words, counts, copies, knowns, bases, scores = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = words_of(text)
                known, base, score = end[0], end[1], repeated(end[2], 1, strength)
                score += (math.lgamma(strength) - math.lgamma(strength + len(tokens) + 1)) / math.log(10)
                for word, n in Counter(tokens).items():
                    found = known_words.get(word)
                    if found is None:
                        rows.append(row)
                        words.append(word.decode())
                        counts.append(n)
                        copies.append(0)
                        knowns.append(0)
                        bases.append(0.0)
                        scores.append(0.0)
                    else:
                        known += n
                        base += n * found[1]
                        score += once + found[2] if n == 1 else repeated(found[2], n, strength)
                rows.append(row)
                words.append(f"\t{row}")  # no word has a tab: meets nothing, and is no hot key
                counts.append(len(tokens) + 1)
                copies.append(1)
                knowns.append(known)
                bases.append(base)
                scores.append(score)
            at = pa.array(rows, pa.int64())
            columns = [ids.take(at), hashes.take(at), outs.take(at), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(copies, pa.int64()), pa.array(knowns, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "held_out", "word", "n", "copies", "known", "base", "score"])

    return run


def score_documents(docs: DataFrame, path: str, rounds: int = 2, strength: float = 1000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Words are drawn as if a text had preferences of its own around the corpus' word probabilities: the
    chance of word w after t tokens is (strength * p(w) + its count so far) / (strength + t), which
    multiplies to one factor per distinct word and does not depend on their order. p(w) mixes
    w's discounted count in the texts not held out with its subword probability: the sum, in log
    space, over all its segmentations into pieces of the vocabulary at ``path`` (on every executor),
    weighted by the vocabulary's scores as adapted to the distinct words of the corpus. Segmentations
    do not cross words, so the product is the sum over all segmentations of the text.

    Every distinct word is scored once. Texts look up the frequent words in a broadcast table of
    bounded size; their other words are joined. NULL text counts as empty: one token, the end.
    Repeated rows all get their result. With no training text all mass is the lattice's.
    """
    own = identified(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))
    words = stored(word_counts(own), "word-counts")
    corpus = Corpus.of(words)
    pieces = adapted(words, *read_pieces(path), rounds=rounds)
    scored = stored(scored_words(words, pieces, corpus), "word-scores")
    table = docs.sparkSession.sparkContext.broadcast(frequent(scored))
    parts = own.mapInArrow(_partial(table, corpus.end(), strength), PARTS)
    joined = parts.alias("p").join(scored.alias("w"), "word", "left")
    each = F.col("p.copies") == 0
    known = F.when(each, F.when(F.col("w.c") > 0, F.col("p.n")).otherwise(0)).otherwise(F.col("p.known"))
    # As repeated() does; a word outside the table is rare, or rare in the training texts.
    x = F.lit(strength) * F.pow(F.lit(10.0), F.col("w.score"))
    ones = F.sequence(F.lit(1).cast("bigint"), F.col("p.n") - 1)
    more = F.when(F.col("p.n") > 1, F.aggregate(ones, F.lit(0.0), lambda a, i: a + F.log10(x + i))).otherwise(0.0)
    drawn = math.log10(strength) + F.col("w.score") + more
    sums = joined.groupBy("doc_id", "text_hash", "held_out").agg(
        F.sum("p.copies").alias("copies"),
        F.sum(F.when(~each, F.col("p.n"))).alias("n_tokens"),
        F.sum(known).alias("n_known"),
        F.sum(F.when(each, F.col("p.n") * F.col("w.base")).otherwise(F.col("p.base"))).alias("base_score"),
        F.sum(F.when(each, drawn).otherwise(F.col("p.score"))).alias("score"),
    )
    one = [(F.col(c) / F.col("copies")).cast(t).alias(c) for c, t in (("n_tokens", "bigint"), ("n_known", "bigint"), ("base_score", "double"), ("score", "double"))]
    rows = sums.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "held_out", *one, F.lit(corpus.tokens).cast("bigint").alias("train_tokens"))
