"""Spelling variants: words one edit apart, found by two-dimensional range reporting, and the form each stands for."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shuffle_width, trim
from corvane.llm.tokens import batches
from corvane.llm.wavelet import WaveletMatrix

#: Latin-1 bytes: letters lower-cased (A-Z alone), all else a space. Characters beyond Latin-1 become "?", which is no letter.
_LETTERS = bytes((b + 32 if b < 91 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, as Latin-1 bytes: a byte is a code point."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def thinned(run: bytes, start: int, one_in: int) -> bytes:
    """The run without one code point where one_in divides the crc32 of what start stands for and the run; start: the crc32 so far."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): words of all texts of at least `shortest` code points and `least` occurrences.

    Every one_in-th run (by the crc32 of "<id>:<run>") loses a code point, the same one wherever it stands in a document.
    Null texts have no words; a null id is an empty one. Repeated rows count again. Counts are added up within batches, then
    by Spark, so a frequent word is a row a batch in the shuffle.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def run(parts):
        import pyarrow as pa

        total: Counter = Counter()

        def packed():
            got = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return got

        for batch in batches(parts):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(w for w in runs(text) if len(w) >= shortest).items():
                    w = thinned(w, start, one_in)
                    if len(w) >= shortest:
                        total[w] += n
            if len(total) > 200_000:
                yield packed()
        if total:
            yield packed()
        trim()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def halves(vocabulary: DataFrame, most: int = 100_000) -> DataFrame:
    """(side, length, bucket, block, is_query, is_point, word, n): the buckets in which words one edit apart meet.

    Of two words, the shorter (or as long) of `length` code points, the edit lies in the second half of it or in the first;
    the other half stands in both. So words are dealt by their first half (side 0) and by their last (side 1), each once as
    a word of that length and once as one that is a code point longer. Buckets of more than `most` words are cut into
    blocks of points, and every word of the bucket asks each block.
    """
    size = F.length("word")
    own, longer = [], []
    for out, length, skip in ((own, size, 0), (longer, size - 1, 1)):
        half = F.floor(length / 2).cast("int")
        out += [(0, length, F.substring("word", F.lit(1), half)), (1, length, F.substring("word", half + 1 + skip, size))]
    spots = [F.struct(F.lit(side).alias("side"), length.cast("int").alias("length"), key.alias("bucket"), F.lit(k == 0).alias("is_query")) for k, group in enumerate((own, longer)) for side, length, key in group]
    rows = vocabulary.select("word", "n", F.explode(F.array(*spots)).alias("x")).select("x.*", "word", "n")
    spark = rows.sparkSession
    large = rows.groupBy("side", "length", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = large.select("side", "length", "bucket", F.ceil(F.col("size") / most).cast("int").alias("blocks"))  # a row for each `most` words at most
    met = rows.join(F.broadcast(large), ["side", "length", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    blocks = F.when(F.col("is_query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(at))
    out = met.withColumn("_at", at).withColumn("block", F.explode(blocks)).withColumn("is_point", F.col("block") == F.col("_at")).drop("_at", "blocks")
    return out.repartition(shuffle_width(spark), "side", "length", "bucket", "block").sortWithinPartitions("side", "length", "block", "bucket")


class Ordered:
    """Words of one length in forward order, with the permutation to the order of their reversals as a wavelet matrix."""

    def __init__(self, codes: np.ndarray):
        # Code points as big-endian bytes, so that bytes compare as code points do.
        self.order = np.argsort(_keys(codes), kind="stable")
        self.codes = codes[self.order]
        self.forward = _keys(self.codes)
        back = _keys(self.codes[:, ::-1])
        places = np.argsort(back, kind="stable")
        self.backward = back[places]
        self.at_backward = places  # which word, in forward order, stands at each place of the backward order
        rank = np.empty(len(codes), np.int64)
        rank[places] = np.arange(len(codes))
        self.matrix = WaveletMatrix(rank)

    def interval(self, keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in sorted keys of words that begin with each row of part."""
        rows, width = len(part), keys.dtype.itemsize // 4 - part.shape[1]
        low = np.concatenate([part, np.zeros((rows, width), ">u4")], axis=1)
        high = np.concatenate([part, np.full((rows, width), 0xFFFFFFFF, ">u4")], axis=1)
        return np.searchsorted(keys, _keys(low), "left"), np.searchsorted(keys, _keys(high), "right")

    def near(self, asked: np.ndarray, side: int, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, word here, edit position) for each word of `asked` and each edit position on one side.

        Words as long as those here differ in the code point at the position; words one shorter lack it. The words here
        that begin as the asked one does before the position are an interval forward, those that end as it does behind
        the position an interval backward; words in both are reported. alone: all asked words of this length are among those here.
        """
        own, length = self.codes.shape[1], asked.shape[1]
        half = length // 2
        skip = 1 if own == length else 0
        spots = range(half, length if skip else length + 1) if side == 0 else range(half)
        found = []
        for i in spots:
            prefixes, ask_prefix = np.unique(_keys(asked[:, :i]), return_inverse=True) if i else (None, np.zeros(len(asked), np.int64))
            first, last = self._ends(self.forward, prefixes, i, ask_prefix)
            tail = asked[:, i + skip :][:, ::-1]
            suffixes, ask_suffix = np.unique(_keys(tail), return_inverse=True) if tail.shape[1] else (None, np.zeros(len(asked), np.int64))
            low, high = self._ends(self.backward, suffixes, tail.shape[1], ask_suffix)
            # Where the only word in an interval is the asked one itself, there is nothing to be reported.
            itself = 1 if skip and alone else 0
            some = np.flatnonzero((last - first > itself) & (high - low > itself))
            which, value = self.matrix.report(first[some], last[some], low[some], high[some])
            asked_by, word = some[which], self.at_backward[value]
            other = self.codes[word, i]
            if skip:
                real = other != asked[asked_by, i]
            elif i:  # a code point put in beside its like stands at several positions; the first counts
                real = other != asked[asked_by, i - 1]
            else:
                real = np.ones(len(word), bool)
            found.append((asked_by[real], word[real], np.full(int(real.sum()), i)))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def _ends(self, keys: np.ndarray, parts, width: int, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if parts is None:
            return np.zeros(len(ask), np.int64), np.full(len(ask), len(keys), np.int64)
        first, last = self.interval(keys, np.frombuffer(parts.tobytes(), ">u4").reshape(len(parts), width))
        return first[ask], last[ask]


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of code points as byte strings of one width, which sort as the rows do."""
    rows = np.ascontiguousarray(codes, ">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if rows.shape[1] else np.zeros(len(rows), "S1")


def _coded(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-be"), ">u4").reshape(len(texts), length)


def meetings(rows: DataFrame, chunk: int = 200_000):
    """(word, near, near_n) as Arrow batches for both words of each near pair found in the buckets of halves()."""

    def run(parts):
        import pyarrow as pa
        import pyarrow.compute as pc

        for side, length, frame in _chunks(parts, chunk):
            sizes = pc.utf8_length(frame["word"])
            asks = frame.filter(frame["is_query"])
            if not asks.num_rows:
                continue
            asked, alone = _coded(asks["word"].to_pylist(), length), pc.all(asks["is_point"]).as_py()
            for longer in (0, 1):
                points = frame.filter(pc.and_(frame["is_point"], pc.equal(sizes, length + longer)))
                if not points.num_rows:
                    continue
                index = Ordered(_coded(points["word"].to_pylist(), length + longer))
                for start in range(0, len(asked), 50_000):
                    who, word, _ = index.near(asked[start : start + 50_000], side, alone)
                    if not len(who):
                        continue
                    a, b = pa.array(who + start), pa.array(index.order[word])
                    left, right = asks.select(["word", "n"]).take(a), points.select(["word", "n"]).take(b)
                    yield from _best(left, right, both=bool(longer))
        trim()

    return rows.mapInArrow(run, "word string, n_near long, near_n long, near string")


def _best(left, right, both: bool) -> Iterator:
    """For each word of the pairs: how many words it is near to, and the one of largest n, the least of them.

    Words of one length ask each other, so each pair is there twice; a longer word doesn't ask, so it gets its part here.
    """
    import pyarrow as pa

    for a, b in ((left, right), (right, left)) if both else ((left, right),):
        table = pa.table({"word": a["word"], "near_n": b["n"], "near": b["word"]}).sort_by([("word", "ascending"), ("near_n", "descending"), ("near", "ascending")])
        got = table.group_by("word", use_threads=False).aggregate([("near", "count"), ("near_n", "first"), ("near", "first")])
        got = got.select(["word", "near_count", "near_n_first", "near_first"]).rename_columns(["word", "n_near", "near_n", "near"])
        yield from got.to_batches(max_chunksize=20_000)


def _chunks(parts, size: int):
    """(side, length, table) of whole buckets of one side and length, about `size` rows at a time, from sorted batches."""
    import pyarrow as pa

    held, rows, key = [], 0, None
    for batch in parts:
        if not batch.num_rows:
            continue
        sides, lengths, blocks, buckets = (batch.column(c).to_pylist() for c in ("side", "length", "block", "bucket"))
        start = 0
        for i, now in enumerate(zip(sides, lengths, blocks, buckets)):
            if now == key:
                continue
            # A chunk ends with its side, length or block, or between buckets once it is large.
            if key is not None and (now[:3] != key[:3] or rows + i - start >= size):
                held.append(batch.slice(start, i - start))
                yield key[0], key[1], pa.Table.from_batches(held)
                held, rows, start = [], 0, i
            key = now
        held.append(batch.slice(start))
        rows += batch.num_rows - start
    if rows:
        yield key[0], key[1], pa.Table.from_batches(held)


def variants(vocabulary: DataFrame, factor: int = 5, most: int = 100_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each (word, n), words being distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    of largest n (ties: the least in code-point order) if that n is at least `factor` times its own, else null. root follows
    the forms to the last; factor is 2 or more, so that forms lead to ever more frequent words. Empty vocabularies give no rows; words of any code points and lengths are fine.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    found = meetings(halves(vocabulary, most)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = vocabulary.join(found, "word", "left").withColumn("_n", -F.col("best.minus"))
    has = F.col("_n") >= F.col("n") * factor
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    links = rows.where("form is not null").select("word", "form")
    return rows.join(roots(links, int(63 / log2(factor))), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """(word, root) from links (word, form), by doubling. No chain is longer than `longest`: n grows by the factor with each link and stays below 2^63."""
    at = links.select("word", F.col("form").alias("root"))
    for _ in range(longest.bit_length()):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialize(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return at
