"""Language identification by multilingual mixture inference.

A document is a mixture of languages: every word comes from one of them, and a word's
likelihood under a language is that of its character n-grams (hashed byte trigrams of the
lower-cased letters, the word's edges included). Expectation-maximisation estimates each
document's proportions; the set of languages is chosen by penalised likelihood over nested
sets, from the one best language up, and the largest share of the chosen set is predicted.

Learning counts n-grams per language over all documents that are not held out: each partition
sums its own table, and only its non-zero counts are shuffled. The table that is broadcast has
``buckets`` numbers per language, whatever the corpus.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is
every text if no language was learned. Texts whose language is null are not learned from. Ties
go to the language that sorts first. Repeated rows are predicted each by itself. Only the
named columns are read; language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import received, remainder, send, table

BUCKETS = 1 << 16
#: ASCII bytes that aren't lower-case letters become spaces; the text is lower-cased before.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HAS_LETTER = re.compile(r"[^\W\d_]")
#: Words that are worked on at once.
BLOCK_WORDS = 400_000


def has_letter(text: str) -> bool:
    # The pattern also finds numerals that aren't digits, such as fractions.
    return any(m[0].isalpha() for m in HAS_LETTER.finditer(text))


def letters(text: str) -> bytes:
    """The text's words of letters, lower-cased, a space before and after each."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def trigrams(raw: bytes):
    """Hashed bucket of each three bytes, and where each word's first one is."""
    import numpy as np

    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32), np.flatnonzero(b[:-2] == 32)


def count_trigrams(batches):
    """Per partition and language, the non-zero counts."""
    import numpy as np
    import pyarrow as pa

    sums: dict[str, object] = {}
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            texts.setdefault(lang, []).append(letters(text.as_py()))
        for lang, parts in texts.items():
            raw = b"".join(parts)
            if len(raw) < 3:
                continue
            n = np.bincount(trigrams(raw)[0], minlength=BUCKETS)
            sums[lang] = sums[lang] + n if lang in sums else n
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
            ["lang", "bucket", "n"],
        )


class Model:
    """Log probabilities of n-gram buckets per language, in the languages' sort order."""

    def __init__(self, counts: dict[str, dict[int, int]], smoothing: float = 0.5) -> None:
        import numpy as np

        self.languages = sorted(counts)
        self.table = np.zeros((len(counts), BUCKETS), np.float32)
        for row, lang in zip(self.table, self.languages, strict=True):
            n = np.full(BUCKETS, smoothing)
            n[list(counts[lang])] += list(counts[lang].values())
            row[:] = np.log(n / n.sum())

    def word_likelihoods(self, raw: bytes):
        """(words, languages): log likelihood of each word."""
        import numpy as np

        grams, starts = trigrams(raw)
        return np.stack([np.add.reduceat(row[grams], starts) for row in self.table], axis=1)


def mixture(log_p, first, doc, subset, shares, rounds: int, tolerance: float):
    """EM over the languages of each document's subset; log_p is per word, less its maximum.

    first: each document's first word; doc: each word's document. Returns shares and the log
    likelihood of each document (without the maxima).
    """
    import numpy as np

    p = np.exp(log_p)
    n = np.diff(np.append(first, len(doc)))[:, None]
    shares = shares * subset
    shares /= shares.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        q = p * shares[doc]
        total = q.sum(axis=1, keepdims=True)
        new = np.add.reduceat(q / np.maximum(total, 1e-30), first, axis=0) / n
        new = np.maximum(new, 1e-9) * subset
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - shares).max()
        shares = new
        if moved < tolerance:
            break
    total = np.log(np.maximum((p * shares[doc]).sum(axis=1), 1e-30))
    return shares, np.add.reduceat(total.astype(np.float64), first)


def choose(model: Model, texts: list[bytes], penalty: float, rounds: int = 12, tolerance: float = 1e-3):
    """(language, share) for each text of letters (none may be empty)."""
    import numpy as np

    # Texts overlap by a space: its trigrams with the next text's start are no word's own.
    lens = np.array([len(t) for t in texts])
    raw = b"".join(texts) + b" "
    ll = model.word_likelihoods(raw)
    # Each text starts with a space and ends with one; the closing space starts an empty word.
    starts = np.flatnonzero(np.frombuffer(raw, np.uint8)[:-2] == 32)
    offsets = np.cumsum(lens)
    closing = np.searchsorted(starts, offsets - 1)
    closing = closing[(closing < len(starts)) & (starts[np.minimum(closing, len(starts) - 1)] == (offsets - 1))]
    keep = np.ones(len(starts), bool)
    keep[closing] = False
    ll, starts = ll[keep], starts[keep]
    doc = np.searchsorted(offsets, starts, side="right")
    first = np.flatnonzero(np.concatenate(([True], np.diff(doc) > 0)))
    d, langs = len(texts), ll.shape[1]
    n = np.diff(np.append(first, len(doc)))
    top = ll.max(axis=1, keepdims=True)
    log_p = np.maximum(ll - top, -60).astype(np.float32)
    alone = np.add.reduceat(log_p.astype(np.float64), first, axis=0)
    best = alone.argmax(axis=1)
    cost = -alone[np.arange(d), best]
    pick, share = best.copy(), np.ones(d)
    if langs == 1:
        return [(model.languages[k], 1.0) for k in pick]
    everywhere = np.ones((d, langs), np.float32)
    shares, _ = mixture(log_p, first, doc, everywhere, everywhere / langs, rounds, tolerance)
    order = np.argsort(-shares, axis=1, kind="stable")
    active = np.arange(d)
    for k in range(2, langs + 1):
        subset = np.zeros((d, langs), np.float32)
        np.put_along_axis(subset, order[:, :k], 1, axis=1)
        words = np.isin(doc, active) if len(active) < d else slice(None)
        local_doc = np.searchsorted(active, doc[words])
        local_first = np.flatnonzero(np.concatenate(([True], np.diff(local_doc) > 0)))
        s, like = mixture(log_p[words], local_first, local_doc, subset[active], shares[active], rounds, tolerance)
        now = -like + penalty * (k - 1) * np.log(n[active] + 1.0)
        better = now < cost[active]
        at = active[better]
        cost[at] = now[better]
        pick[at] = s[better].argmax(axis=1)
        share[at] = s[better].max(axis=1)
        active = at
        if not len(active):
            break
    return [(model.languages[k], float(x)) for k, x in zip(pick, np.clip(share, 0.0, 1.0), strict=True)]


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows of docs whose text and language aren't null."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts: dict[str, dict[int, int]] = {}
    sums = (
        rows.mapInArrow(count_trigrams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    for r in sums.toLocalIterator():
        counts.setdefault(r.lang, {})[r.bucket] = r.n
    return Model(counts)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """(id_col, lang_pred, score) for every row of docs."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = send(docs.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        own = received(held)
        for b in batches:
            found: list[tuple[str, float]] = [("und", 0.0)] * b.num_rows
            at, block, size = [], [], 0

            def flush(at, block, found):
                if block:
                    for i, x in zip(at, choose(own, block, penalty), strict=True):
                        found[i] = x

            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                if not text or not own.languages or not has_letter(text):
                    continue
                raw = letters(text)
                at.append(i)
                block.append(raw)
                size += raw.count(b" ")
                if size >= BLOCK_WORDS:
                    flush(at, block, found)
                    at, block, size = [], [], 0
            flush(at, block, found)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["id", "lang_pred", "score"],
            )

    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = remainder(F.col("doc_id"), 4)
    found = predict(docs, learn(docs.where(fold != 2)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
