"""TF-IDF weights of whole texts, by chunks of rows and ranges of terms.

Rows are counted in chunks, each written to a file: its distinct terms, and for every row their places and counts.
A chunk's terms go to the tasks of their ranges once, whatever the number of its rows that hold them; a range adds up in how
many rows each term is and answers every chunk with an array as long as what it sent. So neither a term of a row nor
a term of the corpus is a row of a table, and what is shuffled grows with the input. Files are read and written through
pyarrow.fs; those that a failed task leaves are in no table, and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.shared import materialize, new_path


class Counted:
    """The chunks of rows (id, w), w being the words of a text.

    terms: words less the stop words and, with bigrams, pairs of neighbouring ones. A chunk is at most chunk_words words and
    chunk_bytes bytes, or one row; a range is some range_bytes of terms, those of all chunks together, its ends taken from
    a sample of each chunk's terms (one for each sample_bytes of them).
    """

    def __init__(
        self, rows: DataFrame, *, stop_words=(), bigrams: bool = True, chunk_words: int = 1_500_000, chunk_bytes: int = 1 << 26, range_bytes: int = 1 << 25, sample_bytes: int = 1 << 18
    ):
        spark = rows.sparkSession
        self.uri, self.id_type = new_path(spark, "chunks"), dict(rows.dtypes)["id"]
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(self.uri)
        fs.create_dir(root, recursive=True)
        count = _chunk_writer(self.uri, stop_words, bigrams, chunk_words, chunk_bytes, min(sample_bytes, range_bytes))
        counted = rows.select("id", "w").mapInArrow(count, "file string, n long, size long, sample array<string>")
        self.files = materialize(counted, "chunks")
        self.n, size, self.n_files = self.files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        cores = spark.sparkContext.defaultParallelism
        self.n_tasks = max(self.n_files, 4 * cores)
        ranges = max(size // range_bytes, min(4 * cores, size // (1 << 20))) + 1
        found = sorted(t for r in self.files.select("sample").collect() for t in r.sample)
        self.bounds = sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []

    def _by_range(self):
        """Each chunk's terms and in how many of its rows they are, cut by range."""
        n = min(self.n_files, 16 * self.files.sparkSession.sparkContext.defaultParallelism)
        held = self.files.select("file").repartition(max(1, n))
        dealt = held.mapInArrow(_dealer(self.uri, self.bounds), "part int, file string, terms string, df array<int>")
        return dealt.repartitionById(len(self.bounds) + 1, F.col("part")).groupBy("part")

    def terms(self, max_df: float) -> DataFrame:
        """(k, term): the numbers, in the terms' order, of those in at most max_df of the rows."""
        most = max_df * self.n

        def run(key, rows):
            import pyarrow as pa

            names, _, _, df = _added(rows)
            ok = df <= most
            k = (key[0].as_py() << 40) + _ranks(names)[ok]
            return pa.table({"k": pa.array(k), "term": names.filter(pa.array(ok))})

        return self._by_range().applyInArrow(run, "k long, term string")

    def weights(self, emit, schema: str, max_df: float, extra_stop_words=(), numbers: bool = False, by_rarity: bool = False) -> DataFrame:
        """What emit makes of a chunk: emit(ids, row, term, w, k, names), for each entry its row's and its term's place and its weight,
        in the order of rows and in them of terms, for the terms their numbers if asked for, and names(places), their texts.

        Terms in more than max_df of the rows are left out. Weights are sublinear frequency by smooth inverse document frequency, a
        row's made unit length; extra stop words then get the weight 0. Numbers are in the order of terms or, by_rarity, in that of the
        logarithm (in quarters, base 2) of the number of their rows first, and -1 for terms of one row.
        """
        answer = _answers(numbers, by_rarity)
        answers = self._by_range().applyInArrow(answer, "file string, part int, df array<int>" + (", k array<long>" if numbers else ""))
        weigh = _weigher(self.uri, self.n, max_df, extra_stop_words, emit)
        return answers.repartition(self.n_tasks, "file").groupBy("file").applyInArrow(weigh, schema)


def top(rows: Counted, n: int, max_df: float, extra_stop_words=(), digits: int = 9) -> DataFrame:
    """(id, term, w): the n heaviest terms of each row, of equal weights (to so many digits) the first in the terms' order."""

    def emit(ids, row, term, w, k, names):
        import numpy as np
        import pyarrow as pa

        order = np.where(w > 0, -np.floor(w * 10.0**digits + 0.5), np.inf)
        cuts, found = np.searchsorted(row, np.arange(len(ids) + 1)).tolist(), []
        for a, z in zip(cuts, cuts[1:], strict=False):
            o = order[a:z]
            near = np.flatnonzero(o <= np.partition(o, n - 1)[n - 1]) if z - a > n else np.arange(z - a)
            found.append(a + near[np.argsort(o[near], kind="stable")][:n])
        at = np.concatenate([np.zeros(0, np.int64), *found])
        at = at[w[at] > 0]
        return pa.table({"id": ids.take(pa.array(row[at])), "term": names(term[at]), "w": pa.array(w[at])})

    return rows.weights(emit, f"id {rows.id_type}, term string, w double", max_df, extra_stop_words)


def sparse(rows: Counted, max_df: float, extra_stop_words=()) -> DataFrame:
    """(id, term, w) of all terms."""

    def emit(ids, row, term, w, k, names):
        import pyarrow as pa

        ok = w > 0
        return pa.table({"id": ids.take(pa.array(row[ok])), "term": names(term[ok]), "w": pa.array(w[ok])})

    return rows.weights(emit, f"id {rows.id_type}, term string, w double", max_df, extra_stop_words)


def arrays(rows: Counted, max_df: float, extra_stop_words=()) -> DataFrame:
    """(id, weights: array of k, w) by the terms' numbers; rows that have no term at most in max_df of them are left out."""

    def emit(ids, row, term, w, k, names):
        import numpy as np
        import pyarrow as pa

        held, ok = np.unique(row), w > 0
        ends = np.searchsorted(row[ok], held, side="right")
        entries = pa.StructArray.from_arrays([pa.array(k[term[ok]]), pa.array(w[ok])], ["k", "w"])
        return pa.table({"id": ids.take(pa.array(held)), "weights": pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), entries)})

    return rows.weights(emit, f"id {rows.id_type}, weights array<struct<k: bigint, w: double>>", max_df, extra_stop_words, numbers=True)


def shared(rows: Counted, max_df: float, extra_stop_words=()) -> DataFrame:
    """(id, ks, ws, square) by numbers in the order of rarity, of the terms that are in more than one row; rows without such are left out."""

    def emit(ids, row, term, w, k, names):
        import numpy as np
        import pyarrow as pa

        ok = (w > 0) & (k[term] >= 0)
        row, ks, ws = row[ok], k[term[ok]], w[ok]
        order = np.lexsort((ks, row))
        held, n = np.unique(row, return_counts=True)
        ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        ks, ws = (pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (ks, ws))
        # In the order of terms, so that equal rows have equal sums.
        return pa.table({"id": ids.take(pa.array(held)), "ks": ks, "ws": ws, "square": pa.array(np.bincount(row, w[ok] ** 2, len(ids))[held])})

    return rows.weights(emit, f"id {rows.id_type}, ks array<bigint>, ws array<double>, square double", max_df, extra_stop_words, numbers=True, by_rarity=True)


def _chunk_writer(uri: str, stop_words, bigrams: bool, chunk_words: int, chunk_bytes: int, sample_bytes: int, chunk_rows: int = 1_000_000):
    """Writes rows (id, w) to files of chunks; returns each file with its number of rows, its terms' size and a sample of them."""

    def distinct(ordered):
        """The distinct ones of an array, which is put in order, and how often each is there."""
        import numpy as np

        ordered.sort()
        starts = np.flatnonzero(np.r_[len(ordered) > 0, ordered[1:] != ordered[:-1]][: len(ordered)])
        return ordered[starts], np.diff(starts, append=len(ordered)).astype(np.int32)

    def count(held):
        import random
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs as files

        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("w").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        if stop_words:
            stays = ~pc.is_in(words, value_set=pa.array(list(stop_words), pa.string())).to_numpy(zero_copy_only=False)[codes]
            row, codes = row[stays], codes[stays]
        # In the words' order; a pair is a word and the next one's place plus 1, a word alone has 0 there, so numbers are in the
        # order of the terms' texts: a space is less than whatever a word is made of.
        codes, words = _ranks(words)[codes], words.take(pc.sort_indices(words))
        wide = len(words) + 1
        entries = (row * wide + codes) * wide
        if bigrams:
            same = np.flatnonzero(row[1:] == row[:-1])
            entries = np.concatenate([entries, entries[same] + codes[same + 1] + 1])
            del same
        del row, codes, coded
        entries, counts = distinct(entries)
        row, entries = np.divmod(entries, wide * wide)
        row_ends = np.searchsorted(row, np.arange(rows.num_rows), side="right").astype(np.int32)
        del row
        terms, df = distinct(entries.copy())
        steps = np.diff(np.searchsorted(terms, entries), prepend=0).astype(np.int32)
        del entries
        first, second = np.divmod(terms, wide)
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(16 + size[first] + np.where(second > 0, 1 + size[second - 1], 0)) if len(terms) else np.zeros(0, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        sample = np.searchsorted(ends, np.arange(random.randrange(sample_bytes), total, sample_bytes), side="right")
        columns = {"ids": rows.column("id").combine_chunks(), "ends": row_ends, "steps": steps, "counts": counts,
                   "words": words, "first": first.astype(np.int32), "second": second.astype(np.int32), "df": df}
        table = pa.table({c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for c, v in columns.items()})
        fs, root = files.FileSystem.from_uri(uri)
        name = f"{uuid.uuid4().hex}.chunk"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return pa.RecordBatch.from_pylist(
            [{"file": name, "n": rows.num_rows, "size": total, "sample": _texts(words, first[sample], second[sample]).to_pylist()}],
            pa.schema([("file", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("sample", pa.list_(pa.string()))]),
        )

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        most = (chunk_words, chunk_bytes, chunk_rows)
        held, size = [], [0, 0, 0]

        def done():
            found = count(held)
            held.clear()
            pa.default_memory_pool().release_unused()
            return found

        for b in batches:
            lists = b.column("w")
            words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten()
            octets = np.r_[0, np.cumsum(pc.binary_length(flat).to_numpy())]
            ends = [np.r_[0, np.cumsum(words)]]
            ends += [octets[ends[0]], np.arange(b.num_rows + 1)]
            at = 0
            while at < b.num_rows:
                to = min(int(np.searchsorted(e, e[at] + m - s, side="right")) - 1 for e, m, s in zip(ends, most, size, strict=True))
                if to <= at and held:
                    yield done()
                    size = [0, 0, 0]
                    continue
                to = max(to, at + 1)
                held.append(b.slice(at, to - at))
                size, at = [s + int(e[to] - e[at]) for s, e in zip(size, ends, strict=True)], to
        if held:
            yield done()

    return run


def _ranks(names):
    """The place of each of an array of distinct texts in their order."""
    import numpy as np
    import pyarrow.compute as pc

    ranks = np.empty(len(names), np.int64)
    ranks[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    return ranks


def _texts(words, first, second):
    """Terms of words by their places, the second one's plus 1."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(first):
        return pa.array([], pa.string())
    one = words.take(pa.array(first))
    pairs = pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(second, 1) - 1)), " ")
    return pc.if_else(pa.array(second == 0), one, pairs)


def _chunk_reader(uri: str, columns):
    """Reads columns of a chunk's file; arrays of numbers as numpy's. Steps are those between the entries' terms' places, as
    they compress well."""

    def read(name):
        import pyarrow as pa
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(uri)
        order = ("ids", "ends", "steps", "counts", "words", "first", "second", "df")
        with fs.open_input_file(f"{root}/{name}") as f:
            rows = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[order.index(c) for c in columns])).read_all()
        flat = {c: rows.column(c).combine_chunks().flatten() for c in columns}
        return [v if c in ("ids", "words") else v.to_numpy() for c, v in flat.items()]

    return read


def _dealer(uri: str, bounds):
    """Rows (part, file, terms, df) of files: a chunk's terms, in their order, cut at the bounds; a text of lines, as these compress well."""
    read = _chunk_reader(uri, ("words", "first", "second", "df"))

    def run(batches):
        import bisect

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        class Names:
            def __init__(self, words, first, second):
                self.held = words, first, second

            def __len__(self):
                return len(self.held[1])

            def __getitem__(self, k):
                words, first, second = self.held
                text = words[int(first[k])].as_py()
                return f"{text} {words[int(second[k]) - 1].as_py()}" if second[k] else text

        for b in batches:
            for name in b.column("file").to_pylist():
                words, first, second, df = read(name)
                names, cuts = Names(words, first, second), [0]
                for t in bounds:
                    cuts.append(bisect.bisect_left(names, t, cuts[-1]))
                cuts = pa.array([*cuts, len(names)], pa.int32())
                texts, df = (pa.ListArray.from_arrays(cuts, v) for v in (_texts(words, first, second), pa.array(df)))
                n = len(bounds) + 1
                rows = [pa.array(np.arange(n, dtype=np.int32)), pa.array([name] * n), pc.binary_join(texts, "\n"), df]
                yield pa.RecordBatch.from_arrays(rows, ["part", "file", "terms", "df"]).filter(pa.array(np.diff(cuts.to_numpy()) > 0))

    return run


def _added(rows):
    """The distinct terms of a range, where each row's entries end, each entry's place among the terms, and in how many rows these are."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.split_pattern(rows.column("terms").combine_chunks(), "\n")
    coded = lists.flatten().dictionary_encode()
    codes, df = coded.indices.to_numpy(), rows.column("df").combine_chunks().flatten().to_numpy()
    return coded.dictionary, lists.offsets, codes, np.bincount(codes, df).astype(np.int64)


def _answers(numbers: bool, by_rarity: bool):
    """To each chunk of a range, for its terms in its order, in how many rows they are, and their numbers."""

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        names, ends, codes, df = _added(rows)
        found = {"file": rows.column("file"), "part": rows.column("part"), "df": pa.ListArray.from_arrays(ends, pa.array(df[codes].astype(np.int32)))}
        if numbers:
            k = (key[0].as_py() << 40) + _ranks(names)
            if by_rarity:
                k = np.where(df > 1, k + (np.floor(4 * np.log2(df)).astype(np.int64) << 56), -1)
            found["k"] = pa.ListArray.from_arrays(ends, pa.array(k[codes]))
        return pa.table(found)

    return run


def _weigher(uri: str, n: int, max_df: float, extra_stop_words, emit):
    """What emit makes of a chunk, from its answers; see Counted.weights."""
    read = _chunk_reader(uri, ("ids", "ends", "steps", "counts", "words", "first", "second"))

    def run(key, answers):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, ends, steps, counts, words, first, second = read(key[0].as_py())
        codes = np.cumsum(steps, dtype=np.int64)
        answers = answers.take(pc.sort_indices(answers.column("part")))
        get = lambda c: answers.column(c).combine_chunks().flatten().to_numpy()
        df = get("df")
        idf = np.where(df <= max_df * n, np.log((1 + n) / (1 + df)) + 1, 0)
        row = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        x = (1 + np.log(counts)) * idf[codes]
        ok = x > 0
        row, codes, x = row[ok], codes[ok], x[ok]
        w = x / np.sqrt(np.bincount(row, x * x, len(ids)))[row]
        for t in extra_stop_words:
            one, _, two = t.partition(" ")
            of_one, of_two = pc.index(words, one).as_py(), pc.index(words, two).as_py() + 1 if two else 0
            if of_one >= 0 and (of_two or not two):
                w[np.isin(codes, np.flatnonzero((first == of_one) & (second == of_two)))] = 0
        names = lambda k: _texts(words, first[k], second[k])
        return emit(ids, row, codes, w, get("k") if "k" in answers.column_names else None, names)

    return run
