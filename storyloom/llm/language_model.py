"""Whole-document log-likelihoods under a gated recurrent language model trained on the corpus.

1. Counts: every token of the training rows is counted (partial counters in each partition, then
   a shuffle by word). Words from a count on, at most ``common_words``, are broadcast; the bound
   holds whatever the corpus. No other word is frequent, so later joins have no hot word.
2. Codes: the most frequent words are head words, in classes; other words fall into classes by
   their last two bytes. Within such a class a word has its smoothed relative frequency, so every
   token, seen or not, has a probability, and a text's probability is that of its tokens. All
   texts are written as codes once (two bytes a token), with what needs no network; from there on
   texts aren't read again.
3. Training: the corpus is dealt by hash to ``rounds``; in each, every partition trains on all of
   its documents from the current weights, and the weights are averaged by tokens (summed in
   Spark in two levels). One pass over all training rows, truncated backpropagation.
4. Scoring: one pass over all codes carries the state through each whole document. Words that
   aren't common are written as (row, word) and meet their counts by a join on the word.

Defined results: a null text is empty and has one token, the end. A null id counts as empty text
for the split. Repeated rows are scored each by itself (and counted each in training). With no
training rows every word is unseen. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import recurrent
from storyloom.llm.common import received, release, remainder, send, table, words_of
from storyloom.shared import materialize

#: The code of the end of a text, the first head word.
END = 0
ALPHA = 0.1
#: Distinct words that a counting partition holds before it hands them on.
COUNTER_WORDS = 300_000
#: Tokens that are trained on or scored side by side.
BLOCK_TOKENS = 3_000_000
CHUNK = 4096


def count_words(batches):
    from collections import Counter

    import pyarrow as pa

    counts: Counter = Counter()

    def out():
        n = pa.array(list(counts.values()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), n], ["word", "n"])

    for b in batches:
        for w in words_of(b.column("text")):
            counts.update(w)
            if len(counts) >= COUNTER_WORDS:
                yield out()
                counts.clear()
    if counts:
        yield out()
    counts.clear()
    release()


@dataclass
class Vocabulary:
    """What codes need: common words by falling count, classes of endings, and corpus totals.

    A word's index is its place among the common words, or their number plus the class of its
    ending; ``codes`` and ``logs`` (of count + 0.1) are by index.
    """

    shape: recurrent.Shape
    index: dict[bytes, int]
    endings: dict[bytes, int]
    codes: object
    counts: object
    n: int  # training tokens, ends included
    v: int  # distinct training tokens
    ends: int  # training texts
    class_n: list[int] = field(default_factory=list)
    class_v: list[int] = field(default_factory=list)

    @property
    def heads(self) -> int:
        return self.shape.heads * self.shape.width

    def indexer(self):
        """word -> index; the table of words becomes the one that knows words it doesn't hold."""
        common, endings, last = len(self.index), self.endings, self.shape.rest - 1

        class Index(dict):
            def __missing__(self, word):
                return common + endings.get(word[-2:], last)

        self.index = Index(self.index)
        return self.index.__getitem__


def vocabulary(counts: DataFrame, ends: int, common_words: int, heads: int, width: int, rest: int, hidden: int) -> Vocabulary:
    """counts: (word, n) over the training rows. Sums over all words; only common ones are collected."""
    import numpy as np

    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    # A histogram of 64 steps for each doubling tells the least count that few enough words have.
    step = F.floor(F.log2("n") * 64).cast("int")
    by_step = counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("k")).collect()
    held, least = 0, None
    for r in by_step:
        if held + r.m > common_words:
            break
        held, least = held + r.m, r.k
    common = counts.where(step >= least) if least is not None else counts.limit(0)
    found = common.toArrow().to_pydict()
    pairs = sorted(zip(found["word"], found["n"], strict=True), key=lambda p: (-p[1], p[0]))
    shape = recurrent.Shape(heads, width, rest, hidden)
    n_head = heads * width
    by_end: dict[bytes, int] = {}
    for w, n in pairs[n_head - 1 :]:
        by_end[w[-2:]] = by_end.get(w[-2:], 0) + n
    largest = sorted(by_end, key=lambda e: (-by_end[e], e))[: rest - 1]
    endings = {e: k for k, e in enumerate(largest)}
    codes = [k + 1 if k < n_head - 1 else n_head + endings.get(w[-2:], rest - 1) for k, (w, _) in enumerate(pairs)]
    return Vocabulary(
        shape, {w: k for k, (w, _) in enumerate(pairs)}, endings, np.array([*codes, *range(n_head, n_head + rest)], np.int16),
        np.array([n for _, n in pairs] + [0] * rest, np.int64), (total.n or 0) + ends, total.v + (ends > 0), ends,
    )


def class_totals(held):
    """Tokens and distinct words of each class of words that aren't head words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        vocab = received(held)
        n, v = np.zeros(vocab.shape.rest, np.int64), np.zeros(vocab.shape.rest, np.int64)
        index = vocab.indexer()
        for b in batches:
            at = vocab.codes[np.array([index(w) for w in b.column("word").to_pylist()], np.int64)].astype(np.int64) - vocab.heads
            keep = at >= 0
            n += np.bincount(at[keep], b.column("n").to_numpy()[keep], len(n)).astype(np.int64)
            v += np.bincount(at[keep], minlength=len(v))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    return run


def sums(values, docs):
    """Sum of values[indices] for each array of indices."""
    import numpy as np

    ends = np.cumsum([0, *map(len, docs)])
    total = np.concatenate(([0.0], np.cumsum(values[np.concatenate(docs)] if docs else [])))
    return total[ends[1:]] - total[ends[:-1]]


def with_end(codes, at):
    import numpy as np

    return np.append(codes[at], np.int16(END))


def encode_partition(held):
    """Per row: codes, tokens, and the parts of both scores that common words and classes give; words that
    aren't common with their numbers."""

    def run(batches):
        import math
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        vocab = received(held)
        index, common, logs = vocab.indexer(), len(vocab.index), np.log10(vocab.counts + ALPHA)
        logs[common:] = 0.0
        end = math.log10(vocab.ends + ALPHA)
        # What turns log10(c + 0.1) into a word's share of its class; head words are predicted whole.
        norm = np.zeros(vocab.shape.codes)
        norm[vocab.heads :] = np.log10(np.array(vocab.class_n) + ALPHA * (np.array(vocab.class_v) + 1))
        share = np.where(vocab.codes < vocab.heads, 0.0, logs - norm[vocab.codes])

        def out(batch, first, docs, rare):
            part = batch.slice(first, len(docs))
            offsets = np.cumsum([0, *map(len, rare)])
            # The lists of words, without a Python list of all of them as objects of their own.
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(chain.from_iterable(rare), pa.binary()))
            known = [len(at) - len(m) + (vocab.ends > 0) for at, m in zip(docs, rare, strict=True)]
            codes = pa.array([with_end(vocab.codes, d).tobytes() for d in docs], pa.binary())
            return pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", "held_out", "round")), pa.array([len(d) + 1 for d in docs], pa.int64()),
                 pa.array(known, pa.int64()), pa.array(sums(logs, docs) + end), pa.array(sums(share, docs)), codes, lists],
                [x.split()[0] for x in ENCODED.split(", ")],
            )

        for b in batches:
            first, docs, rare, size = 0, [], [], 0
            for i, w in enumerate(words_of(b.column("text"))):
                at = np.array(list(map(index, w)), np.int32)
                docs.append(at)
                rare.append([w[k] for k in np.flatnonzero(at >= common).tolist()])
                size += len(w) + 1
                if size >= BLOCK_TOKENS:
                    yield out(b, first, docs, rare)
                    first, docs, rare, size = i + 1, [], [], 0
            if docs:
                yield out(b, first, docs, rare)
        release()

    return run


ENCODED = "id long, held_out boolean, round int, n_tokens long, known long, base double, share double, codes binary, rare array<binary>"


def blocks_of(batches):
    """(batch, first row, codes of each text) for blocks of about BLOCK_TOKENS."""
    import numpy as np

    for b in batches:
        first, docs, size = 0, [], 0
        for i, raw in enumerate(b.column("codes")):
            docs.append(np.frombuffer(raw.as_py(), np.int16))
            size += len(docs[-1])
            if size >= BLOCK_TOKENS:
                yield b, first, docs
                first, docs, size = i + 1, [], 0
        if docs:
            yield b, first, docs


def gathered(batches):
    """Codes of texts in blocks of about BLOCK_TOKENS, across batches: many texts run side by side."""
    held, size = [], 0
    for _, _, docs in blocks_of(batches):
        held += docs
        size += sum(map(len, docs))
        if size >= BLOCK_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train_partition(held, rate: float):
    """Trains on all texts of the partition; yields the weights times the tokens seen, in chunks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shape, weights = received(held)
        trainer = recurrent.Trainer(weights, shape, rate)
        for docs in gathered(batches):
            trainer.learn(docs)
        if trainer.tokens:
            flat = recurrent.pack(trainer.w).astype(np.float64) * trainer.tokens
            parts = [flat[k : k + CHUNK] for k in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64())), pa.array([trainer.tokens] * len(parts), pa.int64())],
                ["chunk", "sums", "tokens"],
            )
        release()

    return run


def add_up(table):
    import numpy as np
    import pyarrow as pa

    sums = table.column("sums").combine_chunks()
    total = sums.flatten().to_numpy().reshape(len(sums), -1).sum(axis=0)
    tokens = int(np.sum(table.column("tokens").to_numpy()))
    return pa.table(
        [table.column("chunk")[:1], pa.array([total], pa.list_(pa.float64())), pa.array([tokens], pa.int64())], ["chunk", "sums", "tokens"]
    )


def train(rows: DataFrame, vocab: Vocabulary, rounds: int, rate: float) -> dict:
    """rows: (round, codes), dealt to rounds by hash."""
    import numpy as np

    by_code = np.zeros(vocab.shape.codes)
    head = vocab.counts[: min(vocab.heads - 1, len(vocab.index))]
    by_code[END], by_code[1 : 1 + len(head)], by_code[vocab.heads :] = vocab.ends, head, vocab.class_n
    weights = recurrent.initial(vocab.shape, by_code)
    schema = "chunk int, sums array<double>, tokens long"
    for k in range(rounds):
        held = send(rows.sparkSession, (vocab.shape, weights))
        part = rows.where(F.col("round") == k).select("codes").mapInArrow(train_partition(held, rate * 0.5**k), schema)
        # Two levels: no task adds up more than a part of the partitions' weights.
        some = part.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("chunk", "g")
        sums = some.applyInArrow(add_up, schema).groupBy("chunk").applyInArrow(add_up, schema).orderBy("chunk").collect()
        if sums:
            flat = np.concatenate([np.array(r.sums) / r.tokens for r in sums])
            weights = recurrent.unpack(flat, weights)
        held.destroy()
    return weights


def score_partition(held):
    """Per row of codes: what encode_partition gave, with the network's part of the score added."""

    def run(batches):
        import math

        import pyarrow as pa

        shape, weights = received(held)
        for b, first, docs in blocks_of(batches):
            part = b.slice(first, len(docs))
            ll = recurrent.log_likelihoods(weights, shape, docs) / math.log(10)
            kept = [part.column(c) for c in KEPT]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ll + part.column("share").to_numpy())], [*KEPT, "model"])
        release()

    return run


KEPT = ("row", "id", "held_out", "n_tokens", "known", "base")


def log_likelihoods(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, common_words: int = 200_000,
    heads: int = 24, width: int = 32, rest: int = 64, hidden: int = 16, rounds: int = 3, rate: float = 0.01,
) -> DataFrame:
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (remainder(F.col(id_col), folds) == held_out).alias("held_out"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(rounds)).cast("int").alias("round"), F.col(text_col).alias("text"),
    )
    training = rows.where(~F.col("held_out"))
    ends = training.count()
    counts = materialize(training.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    vocab = vocabulary(counts, ends, common_words, heads, width, rest, hidden)
    held = send(spark, vocab)
    totals = counts.mapInArrow(class_totals(held), "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    by_class = {r.k: r for r in totals.collect()}
    held.destroy()
    vocab.class_n = [by_class[k].n if k in by_class else 0 for k in range(rest)]
    vocab.class_v = [by_class[k].v if k in by_class else 0 for k in range(rest)]
    held = send(spark, vocab)
    encoded = materialize(rows.mapInArrow(encode_partition(held), ENCODED).withColumn("row", F.monotonically_increasing_id()), "codes")
    held.destroy()
    weights = train(encoded.where(~F.col("held_out")), vocab, rounds, rate)
    schema = "row long, id long, held_out boolean, n_tokens long, known long, base double, model double"
    scored = materialize(
        encoded.select(*KEPT, "share", "codes").mapInArrow(score_partition(send(spark, (vocab.shape, weights))), schema), "scored"
    )
    rare = (
        encoded.select("row", F.explode("rare").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row").agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))).alias("log_sum"),
            F.count("n").alias("seen"),
        )
    )
    log_sum, seen = F.coalesce("log_sum", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    norm = F.log10(F.lit(float(vocab.n)) + F.lit(ALPHA) * F.lit(float(vocab.v + 1)))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + log_sum - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + log_sum).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_likelihoods(table(spark, sf_dir, "documents"))
