"""Language-model scores by Brown classes.

The probability of a text is the product, over its words and a final end token, of a class-transition and a
word-emission probability: P(class of w | class of the word before) * P(w | class of w).

* The ``cluster_words`` most frequent training words are assigned to ``classes`` classes by exchange
  clustering: words move, one at a time, to the class that raises the likelihood of the training bigrams most.
* Then every other head word that occurs ``min_count`` times or more is put into the class that raises it most, by the
  classes of its neighbours in all training texts (sparse counts from a shuffle; each word is judged in its own row).
* All other words fall into classes by their shape (length and closing mark), and the end token has its own.
* The transitions are counted anew over all training texts with the classes of all these words.
* Transitions are interpolated with class frequencies by absolute discounting; emissions are smoothed by
  ``alpha``, which leaves room for one unseen word in each shape class.

What is gathered: a count for each distinct training word (one shuffle of partial counts), bigram counts over the
words that are exchanged and shape classes, neighbour counts of the words put in later, and class bigrams. Counts of the ``head_words`` most frequent words, of 64 bytes at
most, travel to the tasks (a fixed bound); other words meet their counts in a join, where no key is hot since
a word outside the head is rare by construction.

The base model is the smoothed unigram. Lower-casing changes A to Z only.
Null and empty texts hold only the end token. Rows without doc_id train (their remainder is unknown, so not
the held-out one) and are scored. Repeated rows are scored each. Without training rows the base score is
that of N = 0, V = 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import crc_mod5, own_memory, stage

LONGEST = 64
#: Shape classes: octets of a word (up to 1, 3, 5, 8, 12, 18, 27, more), twice: without and with a closing mark.
LENGTHS = (1, 3, 5, 8, 12, 18, 27)
MARKS = b".,;:!?"
SHAPES = 2 * (len(LENGTHS) + 1)


_BY_LENGTH = [2 * sum(n > x for x in LENGTHS) for n in range(LENGTHS[-1] + 2)]


def shape(word: bytes) -> int:
    return _BY_LENGTH[min(len(word), LENGTHS[-1] + 1)] + (word[-1] in MARKS)


def shape_column(word: Column) -> Column:
    """shape() for a binary column."""
    n = F.octet_length(word)
    k = sum((F.when(n > x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    last = F.substring(word, F.octet_length(word), F.lit(1))
    marked = last.isin([F.lit(bytes([m])) for m in MARKS])
    return (2 * k + F.when(marked, 1).otherwise(0)).cast("int")


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod5() == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary) and its count c in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(tokens(text))
                if len(counts) > 500_000:
                    yield batch_of()
                    counts.clear()
        if counts:
            yield batch_of()

    return training.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bigram_counts(training: DataFrame, clustered: list[bytes]) -> np.ndarray:
    """Counts of neighbouring symbols: clustered words, then shape classes, then the end token (also before the first word)."""
    index = {w: k for k, w in enumerate(clustered)}
    base, size = len(clustered), len(clustered) + SHAPES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        get = index.get
        for batch in batches:
            pending: list[int] = [size - 1]
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = tokens(text)
                found = list(map(get, words))
                for k in [k for k, x in enumerate(found) if x is None]:
                    found[k] = base + shape(words[k])
                pending += found
                pending.append(size - 1)
                if len(pending) > 500_000:
                    symbols = np.array(pending)
                    total += np.bincount(symbols[:-1] * size + symbols[1:], minlength=size * size)
                    pending = [size - 1]
            symbols = np.array(pending)
            if len(symbols) > 1:
                total += np.bincount(symbols[:-1] * size + symbols[1:], minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    rows = training.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size^2 rows
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def exchange_clusters(pairs: np.ndarray, words: int, classes: int, passes: int = 6) -> np.ndarray:
    """A class for each symbol: the first ``words`` symbols are exchanged among ``classes`` classes, the others keep one each.

    The likelihood of a class bigram model is the sum of n log n over class bigrams, less twice that over
    classes, up to a constant; each move is judged by it in closed form for all target classes at once.
    """
    size = len(pairs)
    classes = max(1, min(classes, words))
    label = np.array([k % classes for k in range(words)] + [classes + k for k in range(size - words)])
    total = classes + size - words
    member = np.zeros((size, total))
    member[np.arange(size), label] = 1
    out_of, in_to = pairs @ member, (pairs.T @ member)  # from a word to classes; from classes to a word
    grid = member.T @ pairs @ member

    def nlogn(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    for _ in range(passes):
        moved = 0
        for w in range(words):
            a = label[w]
            loop = pairs[w, w]
            o, i = out_of[w].copy(), in_to[w].copy()
            # Counts without w in any class; its own loop counts move with it.
            o[a] -= loop
            i[a] -= loop
            rest = grid.copy()
            rest[a, :] -= o
            rest[:, a] -= i
            rest[a, a] -= loop
            left, right = rest.sum(axis=1) + i, rest.sum(axis=0) + o  # what leads to w, or follows it, counts wherever w goes
            ow, iw = o.sum() + loop, i.sum() + loop
            row = nlogn(rest[:classes] + o[None, :]) - nlogn(rest[:classes])
            column = nlogn(rest[:, :classes] + i[:, None]) - nlogn(rest[:, :classes])
            k = np.arange(classes)
            corner = nlogn(rest[k, k] + o[k] + i[k] + loop) - nlogn(rest[k, k])
            gain = row.sum(axis=1) + column.sum(axis=0) - row[k, k] - column[k, k] + corner
            gain -= nlogn(left[:classes] + ow) - nlogn(left[:classes]) + nlogn(right[:classes] + iw) - nlogn(right[:classes])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            if b != a:
                moved += 1
                label[w] = b
                out_of[:, a] -= pairs[:, w]
                out_of[:, b] += pairs[:, w]
                in_to[:, a] -= pairs[w]
                in_to[:, b] += pairs[w]
                grid = rest
                o2, i2 = o, i
                grid[b, :] += o2
                grid[:, b] += i2
                grid[b, b] += loop
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Model:
    """What a task needs to score texts; of fixed size."""

    head: dict[bytes, int]
    counts: np.ndarray
    label: np.ndarray  # class of each head word
    transition: np.ndarray  # log10, classes x classes
    emission: np.ndarray  # log10 of each head word given its class
    n: int
    v: int
    shape_n: np.ndarray
    shape_v: np.ndarray
    alpha: float
    first_shape: int

    @property
    def end(self) -> int:
        return self.first_shape + SHAPES


def neighbour_counts(training: DataFrame, words: list[bytes], context: np.ndarray, first: int, upto: int, size: int) -> DataFrame:
    """w, seen (list of (place, n)): how often each word from number ``first`` up to ``upto`` follows a class (place is that class) or precedes
    one (place is ``size`` more). ``context`` is the class of the words before ``first``; all other words count as their shape's."""
    index = {w: k for k, w in enumerate(words[:upto])}
    kind_of = np.concatenate([context, [size - 1 - SHAPES + shape(w) for w in words[first:upto]], [size - 1]])  # the last is the end's
    shared = training.sparkSession.sparkContext.broadcast((index, kind_of.astype(np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("neighbours", lambda: None)
        index, kind_of = shared.value
        get, end, shapes = index.get, size - 1, size - 1 - SHAPES
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        fresh: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found = np.concatenate([keys, *fresh])
            times = np.concatenate([n, np.ones(len(found) - len(keys), np.int64)])
            order = np.argsort(found, kind="stable")
            found, times = found[order], times[order]
            starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
            return found[starts], (np.add.reduceat(times, starts) if len(starts) else times)

        def of(batch_keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(batch_keys // (2 * size)), pa.array((batch_keys % (2 * size)).astype(np.int32)), pa.array(times)], ["w", "place", "n"])

        for batch in batches:
            found: list[int] = [-1]
            odd: list[int] = []  # shapes of the words without a number
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = tokens(text)
                numbers = list(map(get, words, repeat(-2)))
                odd += [shapes + shape(w) for k, w in zip(numbers, words, strict=True) if k == -2]
                found += numbers
                found.append(-1)
            number = np.array(found, np.int64)
            kind = kind_of[np.maximum(number, -1)]
            kind[number == -2] = odd
            at = np.flatnonzero(number >= first)
            fresh.append(number[at] * (2 * size) + kind[at - 1])
            fresh.append(number[at] * (2 * size) + size + kind[at + 1])
            if sum(map(len, fresh)) > 1_000_000:
                keys, n = merged()
                fresh = []
                if len(keys) > 2_000_000:
                    yield of(keys, n)
                    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if fresh:
            keys, n = merged()
        if len(keys):
            yield of(keys, n)

    rows = training.select("text").mapInArrow(count, "w long, place int, n long")
    return rows.groupBy("w", "place").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list(F.struct("place", "n")).alias("seen"))  # at most 2 * size for a word


def best_classes(word: np.ndarray, place: np.ndarray, n: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word (rows of one word stand together) that raises the likelihood of the bigrams in ``grid`` most when the word joins it."""
    size = len(grid)

    def gained(base: np.ndarray, more: np.ndarray) -> np.ndarray:
        return (base + more) * np.log(np.maximum(base + more, 1e-300)) - np.where(base > 0, base * np.log(np.maximum(base, 1e-300)), 0.0)

    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    follows = place < size
    # The class bigrams that a neighbour's count would add to, for each class that the word could join.
    met = np.where(follows[:, None], grid[np.where(follows, place, 0), :classes], grid[:classes, np.where(follows, 0, place - size)].T)
    gain = np.add.reduceat(gained(met, n[:, None].astype(float)), starts)
    after, before = (np.add.reduceat(np.where(side, n, 0), starts).astype(float)[:, None] for side in (~follows, follows))
    rows, columns = grid.sum(axis=1)[None, :classes], grid.sum(axis=0)[None, :classes]
    gain -= np.where(after > 0, gained(rows, after), 0.0) + np.where(before > 0, gained(columns, before), 0.0)
    return gain.argmax(axis=1)


def place_words(neighbours: DataFrame, grid: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and the class that each is put in: at most one row for each head word."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                words, seen = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500)
                flat = seen.flatten()
                numbers = np.repeat(words.to_numpy(), np.diff(seen.offsets.to_numpy()))
                best = best_classes(numbers, flat.field("place").to_numpy(), flat.field("n").to_numpy(), grid, classes)
                yield pa.RecordBatch.from_arrays([words, pa.array(best.astype(np.int32))], ["w", "class"])

    found = neighbours.mapInArrow(choose, "w long, class int").toArrow()
    return found["w"].to_numpy(), found["class"].to_numpy()


def class_bigrams(training: DataFrame, words: list[bytes], label: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring classes, the end token's being the last (also before the first word): size x size."""
    shared = training.sparkSession.sparkContext.broadcast({w: k for w, k in zip(words, label.tolist(), strict=True) if k >= 0})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, end, shapes = shared.value.get, size - 1, size - 1 - SHAPES
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            kinds: list[int] = [end]
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = tokens(text)
                found = list(map(get, words))
                for k in [k for k, x in enumerate(found) if x is None]:
                    found[k] = shapes + shape(words[k])
                kinds += found
                kinds.append(end)
            pairs = np.array(kinds)
            total += np.bincount(pairs[:-1] * size + pairs[1:], minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    rows = training.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size^2 rows
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _head(counts: DataFrame, size: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words of LONGEST bytes at most, and their counts: at most ``size`` words, whole ties only.

    A histogram of counts gives the cut, so no task sorts or gathers the words of others.
    """
    short = counts.where(F.octet_length("word") <= LONGEST)
    kept, cut = 0, None
    for r in short.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(size).collect():  # distinct counts, each above the next
        if kept + r["words"] > size:
            break
        kept, cut = kept + r["words"], r["c"]
    if cut is None:
        return [], np.empty(0, np.int64)
    top = short.where(F.col("c") >= cut).toArrow()
    rows = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    return [w for _, w in rows], np.array([c for c, _ in rows], np.int64)


def train(training: DataFrame, counts: DataFrame, head_words: int, cluster_words: int, classes: int, alpha: float, discount: float, min_count: int = 3) -> Model:
    """``counts``: a stable table of word and c."""
    ended = training.count()
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words, count = _head(counts, head_words)
    exchanged = words[:cluster_words]
    pairs = bigram_counts(training, exchanged)
    found = exchange_clusters(pairs, len(exchanged), classes)
    first_shape = int(found[: len(exchanged)].max(initial=-1)) + 1
    size = first_shape + SHAPES + 1
    label = np.full(len(words), -1)
    label[: len(exchanged)] = found[: len(exchanged)]
    upto = int((count >= min_count).sum())  # words are in order of count
    if upto > len(exchanged) and first_shape:
        every = np.concatenate([label[: len(exchanged)], first_shape + np.arange(SHAPES + 1)])
        member = np.zeros((len(every), size))
        member[np.arange(len(every)), every] = 1
        neighbours = neighbour_counts(training, words, label[: len(exchanged)], len(exchanged), upto, size)
        which, put = place_words(neighbours, member.T @ pairs @ member, first_shape)
        label[which] = put
    grid = class_bigrams(training, words, label, size)
    unigram = (grid.sum(axis=0) + 0.5) / (grid.sum() + 0.5 * size)
    before = grid.sum(axis=1, keepdims=True)
    spare = np.where(before > 0, discount * (grid > 0).sum(axis=1, keepdims=True) / np.maximum(before, 1), 1.0)
    transition = np.log10(np.maximum(grid - discount, 0) / np.maximum(before, 1) + spare * unigram[None, :])
    shapes = np.array([shape(w) for w in words], np.int64)
    in_class = label >= 0
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.groupBy(shape_column(F.col("word")).alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row for each shape
        shape_n[r["s"]], shape_v[r["s"]] = r["n"], r["v"]
    np.subtract.at(shape_n, shapes[in_class], count[in_class])  # words with a class are none of their shape's
    np.subtract.at(shape_v, shapes[in_class], 1)
    class_n = np.zeros(size)
    np.add.at(class_n, label[in_class], count[in_class])
    emission = np.log10((count + alpha) / (shape_n + alpha * (shape_v + 1))[shapes]) if len(words) else np.empty(0)
    emission[in_class] = np.log10(count[in_class] / class_n[label[in_class]])
    of = np.where(in_class, label, first_shape + shapes) if len(words) else label
    return Model({w: k for k, w in enumerate(words)}, count, of, transition, emission, int(row["n"]) + ended, int(row["v"]) + (ended > 0), shape_n, shape_v, alpha, first_shape)


def _heads(rows: DataFrame, model: Model, ends: int) -> DataFrame:
    """What is known without a join: uid, doc_id, held_out, n_tokens, n_known, base and score so far, and the other words with their counts in the text."""
    broadcast = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        floor = np.log10(m.n + 0.5 * (m.v + 1))
        base_of = np.log10(m.counts + 0.5) - floor
        end_base = np.log10(ends + 0.5) - floor
        get = m.head.get
        uid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                uids, n_tokens, n_known, base, total, rare, times, sizes = [], [], [], [], [], [], [], []
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    words = tokens(text)
                    found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    known = found >= 0
                    hits = found[known]
                    kinds = np.empty(len(words) + 2, np.int64)
                    kinds[0] = kinds[-1] = m.end
                    kinds[1:-1][known] = m.label[hits]
                    others = [words[k] for k in np.flatnonzero(~known)]
                    kinds[1:-1][~known] = [m.first_shape + shape(w) for w in others]
                    uids.append(uid)
                    uid += 1
                    n_tokens.append(len(words) + 1)
                    n_known.append(len(hits) + (ends > 0))
                    base.append(base_of[hits].sum() + end_base)
                    total.append(m.transition[kinds[:-1], kinds[1:]].sum() + m.emission[hits].sum())
                    tally = Counter(others)
                    rare += tally
                    times += tally.values()
                    sizes.append(len(tally))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "tf"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), lists],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "total", "rare"],
                )

    return rows.mapInArrow(score, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, total double, rare array<struct<word:binary,tf:long>>")


def score_documents(docs: DataFrame, head_words: int = 1 << 18, cluster_words: int = 2048, classes: int = 96, alpha: float = 0.5, discount: float = 0.75, min_count: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    rows = _rows(docs)
    training = rows.where(~F.col("held_out"))
    counts = stage(word_counts(training), "words")
    model = train(training, counts, head_words, cluster_words, classes, alpha, discount, min_count)
    ends = model.n - int(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    heads = stage(_heads(rows, model, ends), "heads")
    rare = heads.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.tf")
    met = rare.join(counts, "word", "left").select("uid", "tf", F.coalesce("c", F.lit(0)).alias("c"), shape_column(F.col("word")).alias("s"))
    floor = float(np.log10(model.n + 0.5 * (model.v + 1)))
    room = F.array(*[F.lit(float(np.log10(n + alpha * (v + 1)))) for n, v in zip(model.shape_n, model.shape_v, strict=True)])
    tails = met.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - floor)).alias("base_tail"),
        F.sum(F.col("tf") * (F.log10(F.col("c") + alpha) - F.get(room, F.col("s")))).alias("tail"),
    )
    out = heads.drop("rare").join(tails, "uid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_tail", zero)).alias("base_score"), (F.col("total") + F.coalesce("tail", zero)).alias("score"),
    )


def perplexity(score: Column, n_tokens: Column) -> Column:
    """Perplexity for each token, from a log10 probability."""
    return F.pow(F.lit(10.0), -score / n_tokens)
