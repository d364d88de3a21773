"""Token counts from counts of distinct pre-tokens, without the ids of any text.

A SentencePiece BPE model merges two neighbouring symbols only if what they make is a piece. So no merge crosses a place
between two characters that stand beside each other in no piece, and a text has as many tokens as the parts have
between such places: its pre-tokens. Here these are words with the spaces before them, without marks such as full stops
(those that no piece has after a letter), such marks with what follows them, single line breaks, and parts of longer runs, cut at every such place.

1. Every task counts its pre-tokens; the sums over all tasks are the table of distinct pre-tokens.
2. Each distinct pre-token is encoded once, for its number of pieces.
3. Each text's pre-token frequencies meet that table. The most frequent pre-tokens (``head`` rows at most) travel to
   the tasks, where frequencies are multiplied and summed in place; all other pre-tokens of a text leave as 128-bit digests
   with their frequency and meet their counts in a join. A key of that join is rarer than every pre-token of the head, so
   none is hot, however often a word occurs; and ``head`` changes only which way a pre-token takes, never a result.

Texts are read twice, and only pre-tokens outside of the head move. Null texts are empty, and empty texts have no tokens (the
library puts its leading space before other texts only). Rows that repeat an id, or have none, are rows like others. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import own_memory, stage

#: Rows of the head at most. A row holds at most LONGEST characters, so the head has a bounded size.
HEAD = 262_144
#: Characters of a pre-token that the head keeps as it is; longer ones are known by their digest.
LONGEST = 64
#: Length from which a word is cut at every place that no piece spans.
FINE = 64
#: Distinct pre-tokens that a task holds before it sends their counts.
HELD = 400_000

SPACE = "▁"


_RUNS = regex.compile(r" ++[^ ]*+")
_LETTER = regex.compile(r"[\p{L}\p{N}]")


def closing_marks(spans: set[tuple[str, str]]) -> dict[str, str]:
    """The characters of pieces that are neither letters nor digits, by the letters and digits that pieces have before them.

    A text may be cut before such a character where any other letter or digit comes before it.
    """
    marks = sorted({c for pair in spans for c in pair if c not in " \n" and not _LETTER.match(c)})
    groups: dict[str, str] = {}
    for c in marks:
        letters = "".join(sorted(before for before, after in spans if after == c and _LETTER.match(before)))
        groups[letters] = groups.get(letters, "") + c
    return groups


def pretoken_pattern(spans: set[tuple[str, str]]) -> str:
    """Words with the spaces before them, cut before marks where no piece goes on; single line breaks; spaces at the end."""
    groups = closing_marks(spans)
    every = "".join(map(regex.escape, "".join(groups.values())))
    kept = [rf"(?<!{f'(?![{letters}])' if letters else ''}[\p{{L}}\p{{N}}])[{regex.escape(marks)}]" for letters, marks in groups.items()]
    return rf" *+[^ \n](?:{'|'.join([rf'[^ \n{every}]++', *kept])})*+|\n| ++"


class PieceModel:
    """A SentencePiece BPE model with identity normalisation, as a counter of pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        pieces = [self.model.id_to_piece(i).replace(SPACE, " ") for i in ids]
        #: Pairs of characters that stand beside each other in some piece.
        self.spans = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        if any("\n" in pair or (pair[1] == " " and pair[0] != " ") for pair in self.spans):
            raise ValueError("pieces must not span line breaks, or a space after another character")
        self._words = regex.compile(pretoken_pattern(self.spans))
        self._fence = len(self.model.encode("\n"))
        for probe in ("a", " a", "  a  b ", "one\ntwo", "<s> x</s>", "Åﬁ　x​", "a\tb\r\n", SPACE + "a", "\x00"):
            if len(self.model.encode(probe)) != sum(self.pieces([w])[0] * n for w, n in Counter(self.pretokens(probe)).items()):
                raise ValueError("the model must be BPE with identity normalisation and a leading space")

    def chunks(self, text: str) -> list[str]:
        """A text that isn't empty, cut before each space after another character; less the space that starts each chunk.

        The library puts a space before the whole text. Chunks are quick to count, and only distinct ones are cut further.
        """
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [run[1:] for run in _RUNS.findall(" " + text)]

    def parts(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        words = self._words.findall(" " + chunk)
        if len(chunk) < FINE:
            return words
        return [part for word in words for part in ((word,) if len(word) < FINE else self._finely(word))]

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that isn't empty, in turn."""
        return [part for chunk in self.chunks(text) for part in self.parts(chunk)]

    def _finely(self, word: str) -> Iterator[str]:
        start, spans = 0, self.spans
        for at, pair in enumerate(zip(word, word[1:], strict=False), 1):
            if pair not in spans:
                yield word[start:at]
                start = at
        yield word[start:]

    def pieces(self, words: list[str]) -> list[int]:
        """The number of pieces of each pre-token: encoded after a line break, which takes the library's leading space."""
        return [len(ids) - self._fence for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]


@lru_cache(maxsize=1)
def _kept(path: str) -> PieceModel:
    return PieceModel(path)


def _model(path: str) -> PieceModel:
    own_memory(path, _kept.cache_clear)
    return _kept(path)


def digest(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode())


def distinct_pretokens(texts: DataFrame, path: str) -> DataFrame:
    """word, times: every pre-token of ``texts`` (one column) and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(model.chunks(text))
                if len(held) > HELD:
                    yield flushed(model, held)
        yield flushed(model, held)

    def flushed(model: PieceModel, held: Counter[str]) -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for chunk, k in held.items():
            for word in model.parts(chunk):
                words[word] += k
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "times"])

    return texts.mapInArrow(count, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """word, pieces, times for each row of ``words`` (word, times)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.pieces(batch.column(0).to_pylist()), pa.int32()), batch.column(1)], ["word", "pieces", "times"])

    return words.mapInArrow(encode, "word string, pieces int, times long")


def _digested(words: DataFrame) -> DataFrame:
    """h1, h2, pieces: the digests of ``words`` (word, pieces)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = np.frombuffer(b"".join(map(digest, batch.column(0).to_pylist())), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(1)], ["h1", "h2", "pieces"])

    return words.select("word", "pieces").mapInArrow(name, "h1 long, h2 long, pieces int")


def _rank_bucket() -> Column:
    """A coarse logarithm of how often a pre-token occurs: some thousands of values, whatever the corpus."""
    return F.floor(F.log2(F.col("times").cast("double")) * 32).cast("int")


def head_of(counted: DataFrame, head: int) -> tuple[dict[str | bytes, int], int]:
    """The most frequent pre-tokens with their pieces, ``head`` at most, and the first bucket of frequencies that is all in it."""
    sizes = sorted(((r["b"], r["n"]) for r in counted.groupBy(_rank_bucket().alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for bucket, n in sizes:
        if total + n > head:
            break
        least, total = bucket, total + n
    if not total:
        return {}, least
    # Long words leave the executors as digests, so that the head has a bounded size.
    short = F.length("word") <= LONGEST
    rows = counted.where(_rank_bucket() >= least)
    found = rows.where(short).select("word", "pieces").toArrow()
    known: dict[str | bytes, int] = dict(zip(found["word"].to_pylist(), found["pieces"].to_pylist(), strict=True))
    for r in _digested(rows.where(~short)).collect():
        known[np.array([r["h1"], r["h2"]], "<i8").tobytes()] = r["pieces"]
    return known, least


def _frequencies(docs: DataFrame, path: str, known: dict[str | bytes, int]) -> DataFrame:
    """row, doc_id, n_bytes, n_head (tokens of the head's pre-tokens), tail and times (digests and frequencies of the others)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = _model(path), shared.value
        memo: dict[str, int] = {}  # of chunks whose pre-tokens are all in the head
        for batch in batches:
            size, total, tails, times = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, rare = 0, Counter()
                for chunk, k in Counter(model.chunks(text)).items() if text else ():
                    each = memo.get(chunk)
                    if each is None:
                        each, missed = 0, False
                        for word in model.parts(chunk):
                            found = pieces.get(word) if len(word) <= LONGEST else pieces.get(digest(word))
                            if found is None:
                                rare[word] += k
                                missed = True
                            else:
                                each += found
                        if not missed and len(chunk) <= LONGEST:
                            memo[chunk] = each
                    n += each * k
                size.append(len(text.encode()) if text else 0)
                total.append(n)
                tails.append(b"".join(map(digest, rare)))
                times.append(np.array(list(rare.values()), "<i4").tobytes())
            if len(memo) > HELD:
                memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(tails, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "n_bytes", "n_head", "tail", "times"])

    named = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = named.mapInArrow(meet, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_head long, tail binary, times binary")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "frequencies")


def _tail_pairs(rows: DataFrame) -> DataFrame:
    """row, h1, h2, times: a row for each pre-token outside of the head that a text has."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, 2)
            times = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")
            row = np.repeat(batch.column(0).to_numpy(), [len(x) // 16 for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(times)], ["row", "h1", "h2", "times"])

    return rows.where(F.octet_length("tail") > 0).select("row", "tail", "times").mapInArrow(explode, "row long, h1 long, h2 long, times int")


def token_counts(docs: DataFrame, path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): a row for each row of ``docs``."""
    counted = stage(count_pieces(distinct_pretokens(docs.select(F.col("text").cast("string")), path), path), "pieces")
    known, least = head_of(counted, head)
    rows = _frequencies(docs, path, known)
    tail = _digested(counted.where(_rank_bucket() < least))
    sums = _tail_pairs(rows).join(tail, ["h1", "h2"]).groupBy("row").agg(F.sum(F.col("pieces").cast("long") * F.col("times")).alias("n_tail"))
    out = rows.select("row", "doc_id", "n_bytes", "n_head").join(sums, "row", "left")
    n = (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long")
    return out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
