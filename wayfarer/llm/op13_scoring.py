"""Scores of whole texts: a word model with one added to every count, and causal self-attention over subword ids.

Words are counted over all teaching texts. The commonest ones, of bounded number, reach every task; the others
are looked up by a join, with what a text needs of them summed before. Subword ids are counted over
the same texts, and the attention layer learns from every window of them, once each (``taught``). A text is the ids of its lower-cased words between two end ids, so letter case and white space
don't count; overlapping windows score each id once, the last end id included.

Defined cases: null and empty texts are the end token alone; a null doc_id is neither held out nor teaches; repeated rows
score alike and count each; without teaching texts every id is as likely as any other, and words too; ties of
frequency go by id; clashing extra columns are ignored; an empty table has no rows; a long text is read in runs.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from . import textbytes as tb
from .causal_attention import AttentionParams, CausalAttention, Learned, Scorer, classes_of, learn, log_shares
from .grouped import many
from .word_pieces import WordPieces

#: Bytes of texts whose words are looked up together.
RUN = 1 << 22
#: Bytes of a word that is looked up by its hash.
SHORT = 64
#: Words of a partition that a join may hold in a table of hashes; beyond, it sorts.
HELD = 1 << 20
VOCAB, IDS, END_ID = "byte_bpe_50k.tiktoken", 50_257, 50_256
#: Words that every task knows, and ids that a task scores together.
MOST_WORDS, TOGETHER = 1 << 18, 400_000
#: Windows that a task learns from in a round, those that are shuffled among each other, and rows of the embedding that travel together.
SHARD, BLOCK, PIECE = 1 << 17, 1 << 13, 1 << 8
#: Parts of one to which parameters are rounded before they are added up; some 2 ** 34 of them fit.
GRID = float(1 << 18)
_WORD = ~tb.SPACES
_STEP = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known", pa.float64()), ("ids", pa.binary()), ("word", pa.string()), ("n", pa.int64())])
_TYPES = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, ids binary, word string, n long"


def held_out(doc_id: Column) -> Column:
    """Rows that never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """Row and text of the words of a run of texts, lowered; a long text comes in several runs."""
    for at, to, raw, offsets in tb.slices(texts, RUN):
        parts = [(raw, offsets)] if to - at > 1 else [(raw[lo:hi], np.array([0, hi - lo])) for lo, hi in tb.runs(raw, tb.SPACES)]
        for data, where in parts:
            low = tb.lower_ascii(data)
            starts, ends, row = tb.word_spans(low, where, _WORD)
            yield row + at, tb.span_strings(low, starts, ends)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over the texts that teach; the row without a word is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.table({"word": words, "n": pa.repeat(1, len(words))}) for _, words in _words(batch.column(0))]
            each = pa.concat_tables([*found, pa.table({"word": pa.nulls(1, pa.string()), "n": pa.array([batch.num_rows], pa.int64())})])
            yield from each.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    teach = _plain(docs).where("doc_id IS NOT NULL AND NOT held_out").select("text")
    return teach.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class WordModel:
    """Counts of the commonest words, of the end token, of all teaching tokens and of the distinct ones."""

    words: pa.Array
    counts: np.ndarray
    end: int
    total: int
    distinct: int
    #: Words with at most this count are not among the commonest ones.
    rest: int

    @property
    def log_total(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))

    def looked_up(self, pieces: WordPieces) -> Known:
        """What tasks look up of the commonest words; a Python worker keeps it with the model."""
        if (known := self.__dict__.get("known")) is None:
            known = self.__dict__["known"] = Known(self, pieces)
        return known


def _hashes(words: pa.StringArray) -> np.ndarray:
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return tb.span_hashes(data, at[:-1] - at[0], at[1:] - at[0])


class Known:
    """Place, gain and ids of each of the commonest words. Words are found by hashes, and compared."""

    def __init__(self, m: WordModel, pieces: WordPieces) -> None:
        listed, self.words, self.logs = m.words.to_pylist(), m.words, np.log10(m.counts + 1.0)
        self.ids, self.sizes = pieces.cut(" ".join(listed), len(listed))
        self.begin = np.cumsum(self.sizes) - self.sizes
        short = np.flatnonzero(pc.binary_length(m.words).to_numpy() <= SHORT)
        hashes = _hashes(m.words.take(pa.array(short)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], short[order]
        #: Words that their hashes don't tell: long ones and those that share one.
        again = self.at[1:][self.hashes[1:] == self.hashes[:-1]]
        self.odd = {listed[i]: i for i in [*np.setdiff1d(np.arange(len(listed)), short).tolist(), *again.tolist()]}

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Place of each word among the commonest, or -1."""
        at = np.full(len(words), -1, np.int64)
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= SHORT)
        if len(short) and len(self.hashes):
            those = words.take(pa.array(short))
            h = _hashes(those)
            found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            like = np.flatnonzero(self.hashes[found] == h)
            place = self.at[found[like]]
            same = pc.equal(those.take(pa.array(like)), self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
            at[short[like[same]]] = place[same]
        if self.odd:
            rest = np.flatnonzero(at < 0)
            at[rest] = np.fromiter((self.odd.get(w, -1) for w in words.take(pa.array(rest)).to_pylist()), np.int64, len(rest))
        return at

    def ids_of(self, words: pa.StringArray, pieces: WordPieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``places``; ids, and where those of each word begin and how many it has."""
        at = self.places(words)
        hit, rest = at >= 0, np.flatnonzero(at < 0)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), words.take(pa.array(rest))), " ")[0].as_py()
        flat, size = pieces.cut(joined, len(rest))
        begin, sizes = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begin[rest], sizes[rest] = len(self.ids) + np.cumsum(size) - size, size
        begin[hit], sizes[hit] = self.begin[at[hit]], self.sizes[at[hit]]
        return at, np.concatenate([self.ids, flat]), begin, sizes


def word_model(counts: DataFrame, most: int = MOST_WORDS) -> WordModel:
    """Of stored ``word_counts``; ``most`` bounds the words that are sent to tasks."""
    size = F.floor(F.log2("c")).cast("int")
    sizes = counts.groupBy(size.alias("size"), F.col("word").isNull().alias("end")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).orderBy(F.desc("size")).collect()
    end = sum(r["n"] for r in sizes if r["end"])
    taken, rest = 0, 0
    for r in (r for r in sizes if not r["end"]):
        taken += r["v"]
        if taken > most:
            rest = (1 << (r["size"] + 1)) - 1
            break
    found = counts.where(F.col("word").isNotNull() & (F.col("c") > rest)).toArrow()
    words = found["word"].cast(pa.string()).combine_chunks()
    return WordModel(words, found["c"].to_numpy(), end, sum(r["n"] for r in sizes), sum(r["v"] for r in sizes), rest)


def steps(docs: DataFrame, model: WordModel, path: str) -> DataFrame:
    """Per text its ids and what the commonest words give; then, by text, the words that need a look."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pieces_of, uid = shared.value, WordPieces.of(path), TaskContext.get().partitionId() << 40
        common = m.looked_up(pieces_of)
        logs = common.logs
        for batch in batches:
            n = batch.num_rows
            n_tokens, n_known, known = np.ones(n, np.int64), np.full(n, int(m.end > 0)), np.full(n, np.log10(m.end + 1.0))
            rare, pieces, rows = [], [], []
            for row, words in _words(batch.column(1)):
                # Each distinct word of a run is looked up once, and cut into ids if it isn't among the commonest.
                coded = words.dictionary_encode()
                code, distinct = coded.indices.to_numpy(), coded.dictionary
                at, flat, begin, size = common.ids_of(distinct, pieces_of)
                hit = at >= 0
                gain = np.where(hit, logs[at], 0.0) if len(logs) else np.zeros(len(at))
                n_tokens += np.bincount(row, minlength=n)
                n_known += np.bincount(row, hit[code], n).astype(np.int64)
                known += np.bincount(row, gain[code], n)
                missed = np.flatnonzero(~hit[code])
                rare.append(pa.table({"uid": pa.array(row[missed] + uid), "word": words.take(pa.array(missed))}))
                each = size[code]
                end = np.cumsum(each)
                pieces.append(flat[np.arange(each.sum()) + np.repeat(begin[code] - end + each, each)])
                rows.append(np.bincount(row, each, n).astype(np.int64))
            # Runs follow the rows, so their ids do too.
            flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint16)
            where = np.zeros(n + 1, np.int32)
            where[1:] = 2 * np.cumsum(np.sum(rows, axis=0)) if rows else 0
            ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(where), pa.py_buffer(flat)])
            none = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(known), ids, none(pa.string(), n), none(pa.int64(), n)], schema=_STEP)
            if rare:
                for r in pa.concat_tables(rare).group_by(["uid", "word"]).aggregate([([], "count_all")]).to_batches():
                    k = r.num_rows
                    yield pa.RecordBatch.from_arrays([r.column("uid"), none(pa.int64(), k), none(pa.bool_(), k), none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.binary(), k), r.column("word"), r.column("count_all")], schema=_STEP)
            uid += n

    return _plain(docs).select("doc_id", "text", "held_out").mapInArrow(run, _TYPES)


def rare_words(found: DataFrame, counts: DataFrame, rest: int, distinct: int = 0) -> DataFrame:
    """``(uid, n_known, known)`` of what the words beyond the commonest ones give to a text."""
    # A text has one row a word and batch, and the commonest words aren't here; Spark splits what a word of many held-out texts fills.
    rare, parts = counts.where(F.col("c") <= rest), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each word has one row there, so partitions are even.
    rare = rare.hint("shuffle_hash") if distinct <= HELD * parts else rare
    rows = found.where("ids IS NULL").select("uid", "word", "n").join(rare, "word")
    return rows.groupBy("uid").agg(F.sum("n").alias("n_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("known"))


def _sequences(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts between end ids, end to end, and where each begins."""
    end = np.array([END_ID], np.uint16)
    parts = [np.concatenate([end, np.frombuffer(x.as_buffer(), np.uint16), end]) for x in ids]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32), offsets


def id_counts(teach: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """How often each id follows in ``teach(ids)``, and the number of windows that don't overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(IDS + 1, np.int64)
        for batch in batches:
            ids, offsets = _sequences(batch.column(0))
            out[:IDS] += np.bincount(ids, minlength=IDS)
            out[END_ID] -= len(offsets) - 1
            out[IDS] += int((-(-(np.diff(offsets) - 1) // window)).sum())
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(out[seen])], ["id", "n"])

    found = teach.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(IDS + 1, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out[:IDS], int(out[IDS])


def pair_counts(teach: DataFrame, classes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (class * IDS + id) of the ids that follow an id of a class at least so often, and how often; of ids that share
    their class with others. There are no more keys than classes times ids."""
    alone = np.bincount(classes)[classes] == 1
    shared = teach.sparkSession.sparkContext.broadcast((classes.astype(np.int16), alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_, alone = shared.value
        for table in many(batches, 500):
            ids, offsets = _sequences(table.column(0).combine_chunks())
            inside = ~alone[ids]
            inside[offsets[:-1]] = False
            at = np.flatnonzero(inside)
            key, n = np.unique(class_[ids[at - 1]].astype(np.int64) * IDS + ids[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = teach.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return found["key"].to_numpy(), found["n"].to_numpy()


def _blocks(batches: Iterable[pa.RecordBatch], p: AttentionParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of ``ids``, each id to follow in exactly one, in blocks of ``BLOCK`` and a last one: ids, of which the
    first ``size`` + 1 are real, and those sizes."""
    parts, held = [], 0
    for batch in batches:
        ids, offsets = _sequences(batch.column(0))
        count = -(-(np.diff(offsets) - 1) // p.window)
        row = np.repeat(np.arange(len(count)), count)
        start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * p.window
        size = np.minimum(p.window, offsets[row + 1] - 1 - start)
        ids, at = np.concatenate([ids, np.zeros(p.window, np.int32)]), 0
        while at < len(start):
            to = min(len(start), at + BLOCK - held)
            x = ids[start[at:to, None] + np.arange(p.window + 1)[None, :]]
            x *= np.arange(p.window + 1)[None, :] <= size[at:to, None]
            parts.append((x, size[at:to]))
            held, at = held + to - at, to
            if held == BLOCK:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, held = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _learned(start: Learned, state: Learned, reads: np.ndarray, windows: int) -> pa.RecordBatch:
    """What a task has learned from a shard: the parameters that all windows move, and the rows that were read, in pieces."""
    pieces, data = [-1], [np.concatenate([state.dense, state.squares]).astype(np.float32).tobytes()]
    for piece in range(-(-len(reads) // PIECE)):
        own = slice(piece * PIECE, (piece + 1) * PIECE)
        if reads[own].any():
            pieces.append(piece)
            data.append(np.column_stack([state.e[own], state.gathered[own] - start.gathered[own], reads[own].astype(np.float32)]).astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array([windows] * len(pieces), pa.int64()), pa.array(data, pa.binary())], ["piece", "n", "data"])


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of each piece over shards: rows weigh by how often a shard read them, other parameters by windows.

    What is added is rounded to a grid on which sums are exact, so the order in which it comes doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        windows: dict[int, int] = {}
        for batch in batches:
            for piece, n, data in zip(batch["piece"].to_pylist(), batch["n"].to_pylist(), batch["data"], strict=True):
                x = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
                if piece < 0:
                    x *= n
                else:
                    x = x.reshape(-1, width + 2)
                    x[:, :width] *= x[:, -1:]
                x = np.rint(x * GRID) / GRID
                total[piece] = total[piece] + x if piece in total else x
                windows[piece] = windows.get(piece, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(windows.values()), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "n", "data"])

    return run


def taught(teach: DataFrame, counts: np.ndarray, classes: np.ndarray, n: int, p: AttentionParams) -> tuple[CausalAttention, np.ndarray]:
    """The layer that all ``n`` windows of ``teach(doc_id, ids)`` have taught, and how often each row of its embedding was read.

    Texts fall into shards by a hash of what they hold, whatever files or tasks they come from, so a task gets about ``SHARD``
    windows, which it goes through in the hashes' order. The first shard is learned alone; then each round takes
    four times as many as the one before, side by side from the same start, and averages what their tasks have
    learned. Every window is in one shard of one round. Only tables of few windows are read several times.
    """
    order, seen = np.argsort(-counts, kind="stable"), int(np.count_nonzero(counts))
    rank = np.full(IDS, seen, np.int32)
    rank[order[:seen]] = np.arange(seen)
    shards, passes = -(-n // SHARD), max(1, min(40, -(-p.epochs * p.sample // n)))
    state, reads = Learned.start(p, seen + 1), np.zeros(seen + 1)
    hashed = teach.select(F.xxhash64("doc_id", "ids").alias("h"), "ids").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    first, size = 0, 1
    while first < shards:
        last = min(shards, first + size)
        shared = teach.sparkSession.sparkContext.broadcast((state, rank, classes.astype(np.int16)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            start, rank, classes = shared.value
            shard, state, windows = first + TaskContext.get().partitionId(), copy.deepcopy(start), 0

            def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                nonlocal windows
                kept = []
                for x, sizes in _blocks(batches, p):
                    block = rank[x], classes[x[:, 1:]], sizes
                    windows += len(sizes)
                    kept += [block] * (passes > 1)
                    yield block
                for _ in range(passes - 1):
                    yield from kept

            rates = lambda done: 1 - (first + (last - first) * min(1.0, done * shards / (n * passes))) / shards
            read = learn(state, blocks(), p, lambda done: max(0.01, rates(done)), [p.seed, shard])
            if windows:
                yield _learned(start, state, read, windows)

        mine = hashed.where(F.col("shard").between(first, last - 1)).repartitionById(last - first, F.col("shard") - first).sortWithinPartitions("h").select("ids")
        pieces = -(-(seen + 1) // PIECE) + 1
        each = mine.mapInArrow(run, "piece int, n long, data binary").repartitionById(min(pieces, 32), F.pmod(F.col("piece") + 1, F.lit(min(pieces, 32))))
        now = copy.deepcopy(state)
        for r in each.mapInArrow(_sums(p.width), "piece int, n long, data binary").collect():
            x = np.frombuffer(r["data"], np.float64)
            if r["piece"] < 0:
                now.dense, now.squares = (x / r["n"]).astype(np.float32).reshape(2, -1)
                now.steps += max(1, r["n"] * passes // ((last - first) * p.batch))
                continue
            x = x.reshape(-1, p.width + 2)
            own = np.flatnonzero(x[:, -1]) + r["piece"] * PIECE
            x = x[x[:, -1] > 0]
            now.e[own], reads[own] = x[:, :-2] / x[:, -1:], reads[own] + x[:, -1]
            now.gathered[own] += x[:, -2].astype(np.float32)
        shared.unpersist()
        state, first, size = now, last, size * 4
    # Ids that no window holds look like the average one.
    state.e[reads == 0] = np.average(state.e, axis=0, weights=reads)
    net = state.net(p)
    net.local = rank
    return net, reads


def fit(found: DataFrame, p: AttentionParams) -> Scorer:
    """The attention model of stored ``steps``."""
    teach = found.where("ids IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out")
    counts, n = id_counts(teach, p.window)
    classes = classes_of(counts, p.classes)
    net = taught(teach, counts, classes, n, p)[0] if n else CausalAttention.even(p, IDS)
    return Scorer(net, classes, *log_shares(counts, classes, p.classes, *pair_counts(teach, classes, p.least_pair), p.faith))


def score(docs: DataFrame, p: AttentionParams = AttentionParams(), path: str | None = None, most: int = MOST_WORDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs(doc_id, text, ...)``."""
    counts = tables.stored(word_counts(docs))
    words = word_model(counts, most)
    found = tables.stored(steps(docs, words, path or public_tokenizers.path(VOCAB)))
    shared = docs.sparkSession.sparkContext.broadcast(fit(found, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in many(batches, 200):
            said, ids = [], table["ids"].combine_chunks()
            sizes = np.cumsum(np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1])) // (2 * TOGETHER)
            for at, to in zip(edges := [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist()], [*edges[1:], len(ids)], strict=True):
                said.append(shared.value.totals(*_sequences(ids.slice(at, to - at))))
            cols = [table[c].combine_chunks() for c in ("uid", "doc_id", "held_out", "n_tokens", "n_known", "known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(said) / np.log(10))], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "known", "score"])

    texts = found.where("ids IS NOT NULL").select("uid", "doc_id", "held_out", "n_tokens", "n_known", "known", "ids")
    main = texts.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, score double")
    rare = rare_words(found, counts, words.rest, words.distinct).select("uid", F.col("n_known").alias("rare_n"), F.col("known").alias("rare_known"))
    out = main.join(rare, "uid", "left")
    base = F.col("known") + F.coalesce("rare_known", F.lit(0.0)) - F.col("n_tokens") * F.lit(words.log_total)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_n", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(tables.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_lm_scores": op13_lm_scores}
SQL: dict[str, str] = {}
