"""Language-model scores from Brown class bigrams.

1. Every text is split into words once: blocks of texts keep their tokens as
   numbers of a dictionary of their own, and all later steps work on numbers.
2. The dictionaries, dealt by hash of the word, give the vocabulary. Each word
   belongs to a bucket; a bucket tells each block the codes of the words it asked for.
3. Exchange clustering of all words, round by round until the likelihood of the
   class bigrams settles. The most frequent words (the core, a fixed number)
   move one by one on the driver against exact counts of each other. All other
   words move at once in Spark, each to the class its neighbours' present
   classes fit best. The likelihood is counted anew after every round; a round
   that lowers it is undone, and from then on half as many words, a quarter, an
   eighth move at a time, until a round gains next to nothing.
4. Class transitions over all training texts, smoothed with the class
   distribution and a Good-Turing share for unseen words, times the emission of
   the word from its class, give the score of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batches, crc32_mod, deflated, inflated, materialize, shared_dir, shuffle_width, summed
from corvane.llm.tokens import batches

SINGLE = 1 << 15  # marks codes of words seen once
#: Words of blocks, and occurrences outside the core, that one bucket of the vocabulary may hold on average.
BUCKET_WORDS, BUCKET_TOKENS = 1_000_000, 50_000_000


def split(texts):
    """(words in a row, how many each text has) of an Arrow array of texts: A-Z in lower case, parted by ASCII white space."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty word
    upto = np.r_[0, np.cumsum(filled)]
    ends = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return words.filter(pc.greater(pc.binary_length(words), 0)), np.diff(ends)


def word_hashes(words) -> np.ndarray:
    """Numbers that spread words (an Arrow array of strings): from both ends and the length; equal for equal words."""
    offsets, data = words.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    eights = np.ndarray((at[-1] + 1,), "<u8", (data.to_pybytes()[: at[-1]] if data else b"") + bytes(8), 0, (1,))
    size = np.diff(at)
    keep = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1))
    first = eights[at[:-1]] & keep
    last = np.where(size >= 8, eights[np.maximum(at[1:] - 8, 0)], first)
    h = (first ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = ((h ^ h >> np.uint64(29)) + last) * np.uint64(0x165667B19E3779F9)
    return h ^ h >> np.uint64(32)


BLOCK = "block long, docs array<long>, held array<boolean>, lengths array<int>, n_train long, codes binary, words array<binary>, counts binary"


def blocks_of(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Texts (doc_id, held_out, text) as blocks of about so many bytes: training texts first, each with an end (0), as
    numbers into the block's words, which stand by hash; counts: how often each stands in the training texts."""
    import pyarrow as pa
    from pyspark import TaskContext

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        docs = [d for part in parts for d in part[0]]
        held = np.concatenate([part[1] for part in parts])
        sizes = np.concatenate([part[3] for part in parts])
        coded = pa.concat_arrays([part[2] for part in parts]).dictionary_encode()
        words = coded.dictionary
        order = np.argsort(word_hashes(words), kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(1, len(words) + 1)
        codes = place[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int32)
        ends = np.cumsum(sizes)
        turn = np.argsort(held, kind="stable")
        texts = [np.r_[codes[ends[i] - sizes[i] : ends[i]], np.int32(0)] for i in turn.tolist()]
        flat = np.concatenate(texts)
        n_train = int((sizes + 1)[~held].sum())
        counts = np.bincount(flat[:n_train], minlength=len(words) + 1)[1:]
        columns = [[number], [[docs[i] for i in turn.tolist()]], [held[turn].tolist()], [(sizes[turn] + 1).tolist()], [n_train], [deflated(flat.astype("<i4"))]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
        names = words.take(pa.array(order)).cast(pa.binary())
        arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([deflated(counts.astype("<i8"))], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["block", "docs", "held", "lengths", "n_train", "codes", "words", "counts"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches(rows):
            text = batch.column("text")
            words, sizes = split(text)
            parts.append((batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), words, sizes))
            size += text.nbytes
            if size >= block_bytes:
                yield block(number, parts)
                number, parts, size = number + 1, [], 0
                pa.default_memory_pool().release_unused()
        if parts:
            yield block(number, parts)

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, BLOCK)


ASK = "bucket long, block long, numbers binary, times binary, counts binary, types long, tokens long, top array<struct<word:binary,number:int,c:bigint>>"


def vocabulary(blocks: DataFrame, buckets: int, most: int) -> DataFrame:
    """The words of all blocks, dealt by hash into buckets. One row for each block and bucket: numbers within the bucket of
    the block's words there (-1: in no training text), how often each stands in the block's training texts, and in all.
    One more row for each bucket (no block): types, tokens, and its `most` most frequent words."""
    import pyarrow as pa

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, block in enumerate(batch.column("block").to_pylist()):
                words, times = batch.column("words")[i].values, inflated(batch.column("counts")[i].as_py(), "<i8")
                if not len(words):
                    continue
                of = (word_hashes(words) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                edges = np.r_[starts, len(words)]
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words)
                parts = [deflated(t) for t in np.split(times, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int64)), pa.array([block] * len(starts), pa.int64()), lists, pa.array(parts, pa.binary())], ["bucket", "block", "words", "times"])

    def number(rows: pa.Table) -> pa.Table:
        lists = rows.column("words")
        sizes = [len(x) for c in lists.chunks for x in c]
        coded = pa.concat_arrays([c.flatten() for c in lists.chunks]).dictionary_encode()
        at = coded.indices.to_numpy()
        times = [inflated(x, "<i8") for x in rows.column("times").to_pylist()]
        c = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(c, at, np.concatenate(times))
        numbers = np.where(c > 0, np.cumsum(c > 0) - 1, -1)
        ends = np.cumsum(sizes)
        parts = [at[e - n : e] for e, n in zip(ends, sizes)]
        words = coded.dictionary
        top = sorted(((words[int(i)].as_py(), int(numbers[i]), int(c[i])) for i in (np.argpartition(-c, most)[:most] if len(c) > most else range(len(c))) if c[i] > 0), key=lambda t: (-t[2], t[0]))
        n, bucket = len(parts), rows.column("bucket")[0].as_py()
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int64()), "block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()),
            "numbers": pa.array([*(deflated(numbers[p].astype("<i4")) for p in parts), None], pa.binary()), "times": pa.array([*(deflated(t) for t in times), None], pa.binary()),
            "counts": pa.array([*(deflated(c[p].astype("<i8")) for p in parts), None], pa.binary()), "types": pa.array([None] * n + [int((c > 0).sum())], pa.int64()), "tokens": pa.array([None] * n + [int(c.sum())], pa.int64()),
            "top": pa.array([None] * n + [[{"word": w, "number": i, "c": k} for w, i, k in top]], pa.list_(pa.struct([("word", pa.binary()), ("number", pa.int32()), ("c", pa.int64())]))),
        })

    dealt = blocks.select("block", "words", "counts").mapInArrow(spread, "bucket long, block long, words array<binary>, times binary")
    return dealt.groupBy("bucket").applyInArrow(number, ASK)


@dataclass
class Model:
    """Class bigrams of a corpus. Classes are 0 to n_classes - 1, then the end of a text, then words not placed or not seen.

    A word's code is its place in the core, or core + class outside it.
    """

    n_classes: int
    core: list[tuple] = field(default_factory=list)  # (word, bucket, number), the most frequent first
    core_classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tokens: int = 0
    types: int = 0
    ends: int = 0
    counts: np.ndarray | None = None  # (size + 1) x (size + 1); the last row and column: words seen once
    likelihoods: list[float] = field(default_factory=list)
    asks: DataFrame | None = None  # vocabulary(), its rows of blocks
    answers: DataFrame | None = None  # (bucket, block, codes) of the words asked for, in their order

    @property
    def size(self) -> int:
        return self.n_classes + 2

    def class_of_code(self) -> np.ndarray:
        return np.r_[self.core_classes, np.arange(self.size)].astype(np.int64)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(table: np.ndarray) -> float:
    """What of the log-likelihood of class bigrams depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def core_pairs(blocks: DataFrame, core: list[bytes]) -> np.ndarray:
    """Counts of core word after core word, (core, core), over the training texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    f = len(core)
    known = pa.array(core, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(f * f, np.int64)
        for batch in batches:
            for n, codes, words in zip(batch.column("n_train").to_pylist(), batch.column("codes").to_pylist(), batch.column("words")):
                of = np.r_[f, pc.fill_null(pc.index_in(words.values, known), f).to_numpy(zero_copy_only=False)].astype(np.int32)
                k = of[inflated(codes, "<i4")[:n]]
                both = np.flatnonzero((k[:-1] < f) & (k[1:] < f))
                total += np.bincount(k[both].astype(np.int64) * f + k[both + 1], minlength=f * f)
        yield pa.RecordBatch.from_arrays([pa.array([deflated(total)], pa.binary())], ["pairs"])

    return summed(blocks.select("n_train", "codes", "words").mapInArrow(run, "pairs binary"), "pairs", f * f).reshape(f, f)


def exchange(classes: np.ndarray, pairs: np.ndarray, before: np.ndarray, after: np.ndarray, table: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass over the core words, the most frequent first: each goes to the class in which the likelihood is highest.

    pairs: core by core. before, after: counts of each core word by the classes of its neighbours outside the core.
    table: class by class. Returns classes, the table of them, and how many words moved; all counts are exact.
    """
    classes, table, moves = classes.copy(), table.astype(float), 0
    size, k = len(table), np.arange(n_classes)
    tokens = table.sum(0)
    for w in range(len(classes)):
        a, own = classes[w], float(pairs[w, w])
        left = before[w] + np.bincount(classes, pairs[:, w], size)
        right = after[w] + np.bincount(classes, pairs[w, :], size)
        left[a] -= own
        right[a] -= own
        n = left.sum() + own
        table[:, a] -= left
        table[a, :] -= right
        table[a, a] -= own
        tokens[a] -= n
        column, row, diagonal = table[:, :n_classes], table[:n_classes, :], table[k, k]
        gain = (_xlogx(column + left[:, None]) - _xlogx(column)).sum(0) + (_xlogx(row + right) - _xlogx(row)).sum(1)
        gain -= _xlogx(diagonal + left[k]) + _xlogx(diagonal + right[k]) - _xlogx(diagonal)
        gain += _xlogx(diagonal + left[k] + right[k] + own)
        gain -= 2 * (_xlogx(tokens[k] + n) - _xlogx(tokens[k]))
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
            b = a
        table[:, b] += left
        table[b, :] += right
        table[b, b] += own
        tokens[b] += n
        moves += b != a
        classes[w] = b
    return classes, table, moves


ANSWER = "bucket long, block long, codes binary"


def _answers(asks, codes: np.ndarray):
    """What a bucket tells each block that asks: the codes of its words, by number; the last code is that of words in no training text."""
    import pyarrow as pa

    said = []
    for numbers, counts in zip(asks.column("numbers").to_pylist(), asks.column("counts").to_pylist()):
        said.append(deflated((codes[inflated(numbers, "<i4")] | np.where(inflated(counts, "<i8") == 1, SINGLE, 0)).astype("<u2")))
    return pa.table({"bucket": asks.column("bucket"), "block": asks.column("block"), "codes": pa.array(said, pa.binary())})


def _of_bucket(core: list[tuple], bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the core words of a bucket, and their places in the core."""
    own = [(number, i) for i, (_, b, number) in enumerate(core) if b == bucket]
    return np.array([n for n, _ in own], np.int64), np.array([i for _, i in own], np.int64)


def _types(asks) -> int:
    return max((int(inflated(x, "<i4").max(initial=-1)) for x in asks.column("numbers").to_pylist()), default=-1) + 1


def _codes_of_words(answers, end: int) -> np.ndarray:
    """Codes by local number: the end of a text, then the block's words, which stand by hash as buckets do."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist()))
    return np.concatenate([np.array([end], "<u2"), *(inflated(c, "<u2") for _, c in rows)])


def _order(numbers: np.ndarray) -> np.ndarray:
    """Places in ascending order of number, ties as they stand; two passes over 16 bits each."""
    by = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")
    return by[np.argsort((numbers >> 16).astype(np.uint16)[by], kind="stable")] if len(numbers) and numbers.max() >> 16 else by


def neighbourhoods(blocks: DataFrame, model: Model) -> DataFrame:
    """Rows (bucket, block, near, stats) of the training texts under the present classes.

    With a bucket: the codes of the word before and the word after each occurrence of the block's words there that are
    outside the core, word by word. Without one: the block's class bigrams and the core's neighbours outside the core.
    """
    import pyarrow as pa

    f, size = len(model.core), model.size
    end = f + size - 2
    class_of = model.class_of_code().astype(np.int32)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        code_of = _codes_of_words(answers, end)
        local = inflated(block.column("codes")[0].as_py(), "<i4")[: block.column("n_train")[0].as_py()]
        code = code_of[local]
        single = np.flatnonzero(code >= SINGLE)
        code &= np.uint16(SINGLE - 1)
        before = np.r_[np.uint16(end), code[:-1]]
        after = np.r_[code[1:], np.uint16(end)]
        cls = class_of[code]
        n = size + 1
        counts = np.bincount(np.r_[class_of[end], cls[:-1]] * np.int32(n) + cls, minlength=n * n)
        counts += np.bincount(class_of[before[single]] * n + size, minlength=n * n)
        counts += np.bincount(size * n + class_of[after[single]], minlength=n * n)
        in_core = code < f
        at = np.flatnonzero(in_core & (before >= f))
        left = np.bincount(code[at].astype(np.int64) * size + before[at] - f, minlength=f * size)
        at = np.flatnonzero(in_core & (after >= f))
        right = np.bincount(code[at].astype(np.int64) * size + after[at] - f, minlength=f * size)
        rows = [(None, None, None, deflated(np.concatenate([counts, left, right]).astype("<i8")))]
        at = np.flatnonzero(~in_core & (local > 0))
        of = local[at]
        at = at[_order(of)]
        near = np.stack([before[at], after[at]], 1)
        sizes = [(b, len(inflated(c, "<u2"))) for b, c in sorted(zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist()))]
        upto = np.r_[0, np.cumsum(np.bincount(of, minlength=len(code_of)))]
        place = 1
        for bucket, words in sizes:
            a, b = upto[place], upto[place + words]
            if b > a:
                rows.append((bucket, block.column("block")[0].as_py(), deflated(near[a:b]), None))
            place += words
        return pa.table({x: pa.array(c, k) for x, c, k in zip(("bucket", "block", "near", "stats"), zip(*rows), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])})

    own = blocks.select("block", "n_train", "codes")
    return own.groupBy("block").cogroup(model.answers.groupBy("block")).applyInArrow(run, "bucket long, block long, near binary, stats binary")


def moved(near: DataFrame, model: Model, fit: np.ndarray, parts: int = 1, turn: int = 0) -> DataFrame:
    """Answers after words outside the core went to the class that fits their neighbours best: all, or one in `parts` of them, by hash and turn.

    fit: (2, codes, classes), what a word before and a word after of each code say for each class: by how much, to first
    order, the likelihood of the class bigrams grows with an occurrence of the word there, class totals included.
    """
    import pyarrow as pa

    core, n_classes, f = model.core, model.n_classes, len(model.core)
    fit = fit.astype(np.float32)
    asks = model.asks if parts == 1 else model.asks.join(model.answers.select("bucket", "block", F.col("codes").alias("present")), ["bucket", "block"])

    def run(near: pa.Table, asks: pa.Table) -> pa.Table:
        own, places = _of_bucket(core, asks.column("bucket")[0].as_py())
        scores = np.zeros((_types(asks), n_classes), np.float32)
        free = np.ones(len(scores), bool)
        free[own] = False
        where = {b: i for i, b in enumerate(asks.column("block").to_pylist())}
        for block, codes in zip(near.column("block").to_pylist(), near.column("near").to_pylist()):
            numbers, times = (inflated(asks.column(x)[where[block]].as_py(), k) for x, k in (("numbers", "<i4"), ("times", "<i8")))
            met = np.flatnonzero((numbers >= 0) & (times > 0))
            met = met[free[numbers[met]]]
            numbers, ends, codes = numbers[met], np.cumsum(times[met]), inflated(codes, "<u2").reshape(-1, 2)
            starts = ends - times[met]
            at = 0
            while at < len(numbers):  # about 16,000 occurrences a turn, so that what they say stays in the cache
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + 16_384)))
                said = fit[0].take(codes[starts[at] : ends[to - 1], 0], axis=0)
                said += fit[1].take(codes[starts[at] : ends[to - 1], 1], axis=0)
                scores[numbers[at:to]] += np.add.reduceat(said, starts[at:to] - starts[at], axis=0)
                at = to
        codes = np.r_[f + scores.argmax(1) if len(scores) else np.empty(0, np.int64), f + n_classes + 1].astype(np.int64)
        if parts > 1:
            bucket = asks.column("bucket")[0].as_py()
            stays = np.flatnonzero((np.arange(len(scores), dtype=np.uint64) * np.uint64(2_654_435_761) + np.uint64(40_503 * bucket) >> np.uint64(16)) % np.uint64(parts) != np.uint64(turn % parts))
            present = np.full(len(codes), f + n_classes + 1)
            for numbers, said in zip(asks.column("numbers").to_pylist(), asks.column("present").to_pylist()):
                numbers = inflated(numbers, "<i4")
                present[numbers[numbers >= 0]] = inflated(said, "<u2")[numbers >= 0] & (SINGLE - 1)
            codes[stays] = present[stays]
        codes[own] = places
        return _answers(asks, codes)

    placed = near.where("bucket is not null").select("bucket", "block", "near")
    return placed.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(run, ANSWER)


def _fit(table: np.ndarray, class_of: np.ndarray, n_classes: int) -> np.ndarray:
    tokens = table.sum(0)
    tie = np.log(table + 0.5) - np.log(np.outer(tokens, tokens) / max(tokens.sum(), 1) + 0.5)
    return np.stack([tie[:, :n_classes][class_of], tie[:n_classes, :].T[class_of]])


#: Least share of the words outside the core, as a fraction of one, that moves at once.
MOST_PARTS = 8


def train(blocks: DataFrame, n_classes: int, core_words: int, settled: float) -> Model:
    """Vocabulary and classes of the training texts of blocks; model.counts are the transitions of the classes kept.

    Every round kept gains more than `settled` of a likelihood that can't pass zero, and only a few are undone, so rounds end.
    model.likelihoods has those of the rounds kept, which never fall.
    """
    if not 0 < n_classes <= 250 or not 0 < core_words <= 4_096:
        raise ValueError("n_classes must be 1 to 250, core_words 1 to 4,096")
    model = Model(n_classes)
    words, tokens, model.ends = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    buckets = max(1, words // BUCKET_WORDS, tokens // BUCKET_TOKENS, min(shuffle_width(blocks.sparkSession), words // 20_000))
    asks = materialize(vocabulary(blocks, buckets, core_words), "asks")
    totals = asks.where("block is null")
    types = totals.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    model.tokens, model.types = tokens, types + (model.ends > 0)
    top = totals.select("bucket", F.explode("top").alias("t")).select("bucket", "t.*").orderBy(F.desc("c"), "word").limit(core_words).collect()  # core_words rows at most
    model.core = [(bytes(r["word"]), r["bucket"], r["number"]) for r in top]
    f, size = len(model.core), model.size
    model.asks = asks.where("block is not null").select("bucket", "block", "numbers", "times", "counts")
    core = model.core

    def start(asks):
        own, places = _of_bucket(core, asks.column("bucket")[0].as_py())
        codes = np.full(_types(asks) + 1, f + n_classes + 1)
        codes[own] = places
        return _answers(asks, codes)

    home = shared_dir(blocks.sparkSession)
    model.answers = materialize(model.asks.groupBy("bucket").applyInArrow(start, ANSWER), "answers", to=f"{home}-answers-0")
    model.core_classes = np.arange(f) % n_classes
    pairs = core_pairs(blocks, [w for w, _, _ in core]) if f else np.zeros((0, 0), np.int64)
    n = size + 1
    kept, parts, turn, slot = None, 1, 0, 0
    while True:
        # Only the answers of this round and the one before are needed, and no older neighbourhoods: their folders are written over.
        near = materialize(neighbourhoods(blocks, model), "near", to=f"{home}-near")
        if kept is None or kept.answers is not model.answers:
            stats = summed(near.where("bucket is null"), "stats", n * n + 2 * f * size)
            counts, left, right = np.split(stats, [n * n, n * n + f * size])
            counts = counts.reshape(n, n)
            now = likelihood(counts[:size, :size].astype(float))
            if turn:
                if kept is not None and now <= kept.likelihood:  # the round made it worse: fewer words at once, from where it stood
                    parts, model.core_classes, model.answers, slot = 2 * parts, kept.core_classes, kept.answers, kept.slot
                    if parts > MOST_PARTS:
                        break
                    continue
                gained = now - kept.likelihood if kept else np.inf
                kept = Kept(now, counts, left, right, model.core_classes, model.answers, slot)
                model.likelihoods.append(now)
                if gained <= settled * abs(now):
                    break
        else:
            counts, left, right = kept.counts, kept.left, kept.right
        table, left, right = counts[:size, :size].astype(float), left.reshape(f, size), right.reshape(f, size)
        moves = f + 1
        while moves:  # each move raises the likelihood, so the core comes to rest
            model.core_classes, table, moves = exchange(model.core_classes, pairs, left, right, table, n_classes)
        if types > f or not turn:
            slot = 1 - slot
            model.answers = materialize(moved(near, model, _fit(table, model.class_of_code(), n_classes), parts, turn), "answers", to=f"{home}-answers-{slot}")
        else:  # nothing but the core: its classes have come to rest
            model.answers = model.answers.select("*")
        turn += 1
    if kept is not None:
        model.counts, model.core_classes, model.answers = kept.counts, kept.core_classes, kept.answers
    return model


@dataclass
class Kept:
    """The classes of the best round so far, with what was counted under them."""

    likelihood: float
    counts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    core_classes: np.ndarray
    answers: DataFrame
    slot: int


def _with_counts(model: Model) -> DataFrame:
    return model.answers.join(model.asks.select("bucket", "block", "counts"), ["bucket", "block"])


def word_classes(blocks: DataFrame, model: Model) -> DataFrame:
    """(word, c, class) of every word of the training texts."""
    import pyarrow as pa

    class_of = model.class_of_code()

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        code = _codes_of_words(answers, 0)[1:]
        c = _counts(answers)
        at = np.flatnonzero(c > 0)
        words = block.column("words").chunk(0).flatten()
        return pa.table({"word": words.take(pa.array(at)), "c": pa.array(c[at]), "class": pa.array(class_of[code[at] & (SINGLE - 1)].astype(np.int32))})

    return blocks.select("block", "words").groupBy("block").cogroup(_with_counts(model).groupBy("block")).applyInArrow(run, "word binary, c long, class int").distinct()


def _counts(answers) -> np.ndarray:
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
    return np.concatenate([np.empty(0, np.int64), *(inflated(c, "<i8") for _, c in rows)])


def log_transitions(counts: np.ndarray, by_class: np.ndarray, unseen: int, weight: float = 50.0) -> np.ndarray:
    """log10 of the smoothed probability of each class after each; class `unseen` gets the share of words seen once.

    counts: the last row and column are those of words seen once, what stands before them and what follows.
    """
    size = len(counts) - 1
    tokens = by_class.sum()
    overall = by_class / tokens if tokens else np.ones(size) * (np.arange(size) != unseen) / max(size - 1, 1)
    new = (counts[:size, size].sum() + 0.5) / (tokens + 1)
    pairs, lone = counts[:size, :size].astype(float), counts[:size, size].astype(float)
    pairs[unseen] = counts[size, :size]  # what follows words seen once stands for what follows unseen ones
    rows = pairs.sum(1)
    lone[unseen] = new * rows[unseen]
    share = (lone + weight * new) / (rows + weight)
    out = (pairs + weight * overall) / (rows + weight)[:, None] * (1 - share)[:, None]
    out[:, unseen] = share
    with np.errstate(divide="ignore"):
        return np.log10(out)


def scores(blocks: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text of blocks."""
    import pyarrow as pa

    size = model.size
    class_of, end = model.class_of_code(), len(model.core) + size - 2
    counts = model.counts if model.counts is not None else np.zeros((size + 1, size + 1), np.int64)
    step = log_transitions(counts, counts[:size, :size].sum(0).astype(float), size - 1)
    tokens, ends = model.tokens, model.ends
    floor = np.log10(tokens + 0.1 * (model.types + 1))
    with np.errstate(divide="ignore"):
        class_log = np.log10(counts[:size, :size].sum(0))

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        cls_of = class_of[_codes_of_words(answers, end) & (SINGLE - 1)]
        c = np.r_[ends, _counts(answers)]
        known = c > 0
        emit = np.where(known, np.log10(np.maximum(c, 1)) - np.where(known, class_log[cls_of], 0), 0)
        local = inflated(block.column("codes")[0].as_py(), "<i4")
        cls = cls_of[local]
        lengths = block.column("lengths").chunk(0).flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        score = np.add.reduceat(emit[local] + step[np.r_[size - 2, cls[:-1]], cls], starts)
        base = np.add.reduceat((np.log10(c + 0.1) - floor)[local], starts)
        return pa.table({
            "doc_id": block.column("docs").chunk(0).flatten(), "held_out": block.column("held").chunk(0).flatten(), "n_tokens": pa.array(lengths.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat(known[local].astype(np.int64), starts)), "train_tokens": pa.array(np.full(len(lengths), tokens)),
            "base_score": pa.array(base), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(-score / lengths, 300.0)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    own = blocks.select("block", "docs", "held", "lengths", "codes")
    return own.groupBy("block").cogroup(_with_counts(model).groupBy("block")).applyInArrow(run, schema)


def blocks_and_model(docs: DataFrame, n_classes: int = 48, core_words: int = 1_024, settled: float = 3e-4, folds: int = 10, held_out_fold: int = 0, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_mod(id_col, folds) == held_out_fold).alias("held_out"), F.col(text_col).alias("text"))
    with arrow_batches(docs.sparkSession, 1_000):
        blocks = materialize(blocks_of(rows, block_bytes), "blocks")
    with arrow_batches(docs.sparkSession, 4):
        return blocks, train(blocks, n_classes, core_words, settled)


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs.

    The model learns from all texts outside the held-out fold (by crc32 of the id as text, null as the empty text).
    Null and empty texts are one end. Repeated rows count as often as they stand there. Of words that fit two classes
    alike the least class counts. Without training texts every word is unseen; without rows there are none. core_words
    bounds only which words move one by one; every word takes part in every round. Rounds end when the likelihood
    gains less than the share `settled`.
    """
    return scores(*blocks_and_model(docs, **options))
