"""Stupid-backoff scores of documents by a bigram model of the whole corpus: count tables joined to exploded bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, stash, stashes, table
from .tokens import chunks, mix, split

#: Factor of a backoff, and the count from which a bigram is in its table. The model is made of the documents that it scores,
#: where every pair occurs once at least, in its own document; from two on, something else speaks for it.
BACKOFF, MIN_COUNT = 0.4, 2
#: Words and bigrams with at least this share of the corpus are frequent: at most a million words and a hundred thousand bigrams.
WORD_SHARE, PAIR_SHARE = 1e-6, 1e-5
#: Entries of counts that a task gathers before it adds them up.
GATHER = 1_000_000
#: Occurrences of bigrams that a task packs together, and bigrams for one partition of the count table; on larger executors
#: more of both make fewer and longer rows.
PACK, CELL = 1_000_000, 1_500_000
#: Hash of the mark before a text's first word.
_START = mix(np.array([0x5354415254], np.uint64))[0]
#: Numbers below are ranks of frequent words; no other word has one up to it.
_RANKS = np.uint64(1 << 21)


def _sequence(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) with the mark before every text that has words."""
    w = split(raw)
    first = np.flatnonzero(np.diff(w.doc, prepend=-1))
    return np.insert(w.doc, first, w.doc[first]), np.insert(w.hash, first, _START)


class Frequent:
    """The frequent words, numbered, and the frequent bigrams of such words, with their counts. Of bounded size."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.keys, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def number(self, h: np.ndarray) -> np.ndarray:
        """A frequent word's rank in hash order, or 63 bits of another word's hash, above all ranks."""
        other = h >> np.uint64(1)
        other = np.where(other <= _RANKS, other + _RANKS + np.uint64(1), other)
        if not len(self.words):
            return other
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at.astype(np.uint64), other)

    def bigrams(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first word, second word) of every bigram, words by number."""
        doc, h = _sequence(raw)
        k = self.number(h)
        same = doc[1:] == doc[:-1]
        return doc[1:][same], k[:-1][same], k[1:][same]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _tally(name: str, found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of all values that a task finds, added up in bounded memory."""
    keys, counts, size = [], [], 0

    def batch(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(k), pa.array(n)], names=[name, "n"])

    def add() -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    for values in found:
        k, n = np.unique(values, return_counts=True)
        keys, counts, size = [*keys, k], [*counts, n], size + len(k)
        if size > GATHER:
            k, n = add()
            keys, counts, size = [k], [n], len(k)
            if size > GATHER // 2:
                yield batch(k, n)
                keys, counts, size = [], [], 0
    if keys:
        k, n = add()
        yield batch(k, n)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    return (raw for batch in batches for _, raw in chunks(x.as_py() for x in batch.column(0)))


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tally("w", (_sequence(raw)[1] for raw in _texts(batches)))


#: Kinds of dealt rows: what documents add by themselves, pairs of frequent words, other pairs, counts of other words.
_OWN, _FREQUENT, _OTHER, _WORD = range(4)
_DEALT = ["cell", "kind", "pack", "n", "ids", "packed"]
_DEALT_SCHEMA = "cell int, kind int, pack long, n int, ids array<long>, packed binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, equally long, byte by byte of the same place, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n * columns, codec="zstd"), np.uint8)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in flat.reshape(columns, 8, n)]


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which np.cumsum undoes."""
    return np.diff(x, prepend=np.uint64(0))


def _dealt(cell: np.ndarray, doc: np.ndarray, ids: pa.Array, pack: int, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """One row for each cell: its pairs, sorted, and for each the place of its document among the cell's ids. The first column is the leading one of the order."""
    order = np.lexsort((columns[0], cell))
    cell, doc, columns = cell[order], doc[order], [x[order] for x in columns]
    low = int(doc.min()) if len(doc) else 0
    ends = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        place = np.zeros(int(doc[i:j].max()) - low + 1, np.int64)
        place[doc[i:j] - low] = 1
        own = np.flatnonzero(place)
        place[own] = np.arange(len(own))
        packed = _pack(_steps(columns[0][i:j]), *(x[i:j] for x in columns[1:]), place[doc[i:j] - low].view(np.uint64))
        yield int(cell[i]), kind, pack, j - i, ids.take(pa.array(own + low)), packed


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cells, kinds, packs, sizes, ids, packed = zip(*rows, strict=True)
    lists = _lists(pa.concat_arrays([pa.array([], pa.int64()), *ids]), list(map(len, ids)))
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(kinds, pa.int32()), pa.array(packs, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(packed, pa.binary())], names=_DEALT)


def _lists(values: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


class _Cell:
    """Rows of one partition of the count table: bigrams are counted, looked up and added up by document."""

    def __init__(self, counts: np.ndarray, min_count: int, unseen: float) -> None:
        self.counts, self.min_count, self.unseen = counts, min_count, unseen
        self.held: dict[int, list[list[np.ndarray]]] = {k: [] for k in range(4)}
        self.ids: list[pa.Array] = []
        self.packs: list[int] = []
        self.n_ids = 0

    def add(self, kind: int, pack: int, n: int, ids: pa.Array, packed: bytes) -> None:
        columns = _unpack(packed, n, 3 if kind == _OTHER else 2)
        if kind != _OWN:
            columns[0] = np.cumsum(columns[0], dtype=np.uint64)
        if kind == _WORD:
            self.held[kind].append(columns)
            return
        columns.append(np.arange(n) + self.n_ids if kind == _OWN else columns.pop().astype(np.int64) + self.n_ids)
        self.held[kind].append(columns)
        self.ids.append(ids)
        self.packs.append(pack)
        self.n_ids += len(ids)

    def _columns(self, kind: int, n: int) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.held[kind], strict=True)] if self.held[kind] else [np.empty(0, np.uint64)] * n

    @staticmethod
    def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, place of the first of each key in it, size) of equal keys."""
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(order)])
        return order, first, np.diff(first, append=len(order))

    def results(self) -> Iterator[pa.RecordBatch]:
        """(word, ids, size, v): what the documents of a pack add, under a negative number of the pack; and what documents add
        beside the logarithm of the count of a word that another cell knows, under that word."""
        size, v, touched = np.zeros(self.n_ids, np.int64), np.zeros(self.n_ids), np.zeros(self.n_ids, bool)
        own, done, doc = self._columns(_OWN, 3)
        size[doc.astype(np.int64)] = own.view(np.int64)
        v[doc.astype(np.int64)] = done.view(np.float64)
        touched[doc.astype(np.int64)] = True

        def add(doc: np.ndarray, value: np.ndarray) -> None:
            nonlocal v
            v += np.bincount(doc, value, self.n_ids)
            touched[doc] = True

        # documents have scored pairs before a frequent word as unseen; only seen ones are to be mended
        code, doc = self._columns(_FREQUENT, 2)
        order, first, n = self._groups(code)
        code = code[order[first]]
        a, b = (code // _RANKS).astype(np.int64), (code % _RANKS).astype(np.int64)
        seen = n >= self.min_count
        value = np.log(n) - np.log(self.counts[a]) - np.log(self.counts[b]) - self.unseen
        add(doc[order[np.repeat(seen, n)]].astype(np.int64), np.repeat(value[seen], n[seen]))
        word, times = self._columns(_WORD, 2)
        word, at = np.unique(word, return_inverse=True)
        times = np.bincount(at, times.view(np.int64), len(word))
        a, b, doc = self._columns(_OTHER, 3)
        doc = doc.astype(np.int64)
        order, first, n = self._groups(mix(a * np.uint64(3) + mix(b)))
        a, b, seen = a[order[first]], b[order[first]], n >= self.min_count

        def count(asked: np.ndarray) -> np.ndarray:
            """Counts of words; 0 for words of other cells."""
            k = np.minimum(np.searchsorted(word, asked), max(len(word) - 1, 0))
            rare = np.where(word[k] == asked, times[k], 0) if len(word) else np.zeros(len(asked))
            return np.where(asked < _RANKS, self.counts[np.where(asked < _RANKS, asked, np.uint64(0)).astype(np.int64)], rare)

        of_b = count(b)
        far = ~seen & (of_b == 0)
        unseen = self.unseen + np.log(np.where(of_b > 0, of_b, 1))
        value = np.where(seen, np.log(n) - np.log(np.where(seen, count(a), 1)), unseen) - np.where(b < _RANKS, unseen, 0)
        here = ~far & (seen | (b >= _RANKS))
        add(doc[order[np.repeat(here, n)]], np.repeat(value[here], n[here]))
        names = ["word", "ids", "size", "v"]
        ids = pa.concat_arrays([pa.array([], pa.int64()), *self.ids])
        kept = np.flatnonzero(touched)
        sizes = np.diff(np.searchsorted(kept, np.cumsum([0, *map(len, self.ids)])))
        lists = [_lists(x, sizes[sizes > 0]) for x in (ids.take(pa.array(kept)), pa.array(size[kept]), pa.array(v[kept]))]
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.array(self.packs, np.int64)[sizes > 0]), *lists], names=names)
        entries = doc[order[np.repeat(far, n)]]
        asked, size = np.repeat(b[far], n[far]), np.zeros(len(entries), np.int64)
        order, first, n = self._groups(asked)
        lists = [_lists(x, n) for x in (ids.take(pa.array(entries[order])), pa.array(size), pa.array(np.full(len(entries), self.unseen)))]
        yield pa.RecordBatch.from_arrays([_signed(asked[order[first]]), *lists], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task by document, in bounded memory, from lists of documents and what they add; ``more`` goes to each of a list."""
    names, held = ["doc_id", "size", "v"], None
    for batch in batches:
        ids, size, v = (batch.column(k) for k in range(3))
        more = np.repeat(batch.column(3).to_numpy(), pc.list_value_length(ids).to_numpy())
        rows = pa.table([ids.flatten(), size.flatten(), pa.array(v.flatten().to_numpy() + more)], names=names)
        rows = rows if held is None else pa.concat_tables([held, rows])
        held = rows.group_by("doc_id").aggregate([("size", "sum"), ("v", "sum")]).select(["doc_id", "size_sum", "v_sum"]).rename_columns(names)
        if len(held) > GATHER:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def score(docs: DataFrame, min_count: int = MIN_COUNT, cell: int = CELL, pack: int = PACK) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document of ``docs(doc_id, text)`` under the corpus itself.

    A word after another scores c(pair) / c(first) if the pair's count is min_count or more, else BACKOFF * c(word) / N;
    a text's first word follows a mark. log_score is the sum of logarithms. Counts are of all rows. Unigrams are counted in
    a table by hash. The table of pairs has one partition for about ``cell`` bigrams of the corpus. Bigrams are exploded and
    dealt by hash to these partitions, those of about ``pack`` occurrences of whole documents for one partition as one
    compressed row; each partition counts its pairs, joins them to the counts of words and adds up documents, and a grouped
    aggregate adds up the partitions. Pairs before a frequent word are scored as unseen where they stand, so only seen ones
    send something back. Pairs with a rarer word go where that word's count goes; only unseen pairs of two rare
    words are joined to the table of words by a shuffle of their own.
    Frequent words and pairs (of a given share or more, so of bounded number) are counted first and broadcast: their rows are
    summed where they stand, so a partition holds no pair of a larger share. Words are those between ASCII white space, A-Z
    as a-z; told apart by 63-bit hashes.
    Rows with the same doc_id are one document, so are rows without; texts without words have n_words and log_score 0 and a
    null mean; an empty table gives no rows; columns of other names are ignored.
    """
    spark, mark = docs.sparkSession, stashes()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counts = stash(docs.select("text").mapInArrow(_unigrams, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    start = int(np.array(_START).view(np.int64))
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("w") != start, F.col("n"))), F.lit(0))).first()[0]
    often = counts.where((F.col("n") >= WORD_SHARE * total) | (F.col("w") == start)).toPandas()
    frequent = Frequent(often["w"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64))
    words = spark.sparkContext.broadcast((frequent.words, frequent.counts))
    # a frequent pair is made of words that are as frequent
    parts_of_pairs = np.flatnonzero(frequent.counts >= PAIR_SHARE * total).astype(np.uint64)
    small = spark.sparkContext.broadcast((frequent.words[parts_of_pairs.astype(np.int64)], parts_of_pairs))

    def pairs_of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers = small.value
        known = Frequent(hashes, numbers)

        def keys(raw: list[bytes]) -> np.ndarray:
            _, a, b = known.bigrams(raw)
            both = (a < _RANKS) & (b < _RANKS)
            return numbers[a[both].astype(np.int64)] * _RANKS + numbers[b[both].astype(np.int64)]

        return _tally("key", (keys(raw) for raw in _texts(batches)))

    hot = docs.select("text").mapInArrow(pairs_of_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = hot.where((F.col("n") >= PAIR_SHARE * total) & (F.col("n") >= min_count)).toPandas()
    hot_keys = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    pairs = spark.sparkContext.broadcast((hot_keys[order], hot["n"].to_numpy(np.int64)[order]))
    cells = max(1, -(-total // cell))
    unseen = float(np.log(BACKOFF) - np.log(max(total, 1)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (keys, n) = Frequent(*words.value), pairs.value
        gain = np.log(n) - np.log(known.counts[(keys // _RANKS).astype(np.int64)]) if len(keys) else np.empty(0)

        def rows(ids: pa.Array, own: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            first, size, done = own[0][0], *(np.concatenate([x[k] for x in own]) for k in (1, 2))
            doc, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            sign = mix(np.array([size.sum() * 31 + len(size)], np.uint64) + (mix(a[:1])[0] ^ b[0] if len(a) else np.uint64(first)))[0]
            pack = int(sign >> np.uint64(2))
            yield _batch([(int(sign % np.uint64(cells)), _OWN, pack, len(size), ids.slice(first, len(size)), _pack(size.astype(np.int64), done))])
            both = (a < _RANKS) & (b < _RANKS)
            code, rest = a[both] * _RANKS + b[both], ~both
            at = lambda x: (x % np.uint64(cells)).astype(np.int64)
            rare = np.where(a[rest] >= _RANKS, a[rest], b[rest])
            dealt = [*_dealt(at(mix(code)), doc[both], ids, pack, _FREQUENT, code), *_dealt(at(rare), doc[rest], ids, pack, _OTHER, a[rest], b[rest])]
            if dealt:
                yield _batch(dealt)

        for batch in batches:
            ids, own, held, size_held = batch.column(0), [], [], 0
            for at, raw in chunks(x.as_py() for x in batch.column(1)):
                doc, a, b = known.bigrams(raw)
                size, done = np.bincount(doc, minlength=len(raw)), np.zeros(len(raw))
                if len(keys):
                    key = np.where((a < _RANKS) & (b < _RANKS), a * _RANKS + b, np.uint64(1 << 63))
                    k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[k] == key
                    done = np.bincount(doc[hit], gain[k[hit]], len(raw))
                    doc, a, b = doc[~hit], a[~hit], b[~hit]
                often = b < _RANKS
                done += np.bincount(doc[often], np.log(known.counts[b[often].astype(np.int64)]) + unseen, len(raw))
                own.append((at, size, done))
                held.append((doc + at, a, b))
                size_held += len(doc)
                if size_held > pack:
                    yield from rows(ids, own, held)
                    own, held, size_held = [], [], 0
            if own:
                yield from rows(ids, own, held)

    def deal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(*words.value)
        for batch in batches:
            word = known.number(batch.column(0).to_numpy().view(np.uint64))
            n, own = batch.column(1).to_numpy()[word >= _RANKS], word[word >= _RANKS]
            place = (own % np.uint64(cells)).astype(np.int64)
            order = np.lexsort((own, place))
            place, own, n = place[order], own[order], n[order]
            ends = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)).tolist()
            none = pa.array([], pa.int64())
            if len(own):
                yield _batch([(int(place[i]), _WORD, 0, j - i, none, _pack(_steps(own[i:j]), n[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Cell(words.value[1], min_count, unseen)
        for batch in batches:
            kinds, packs, sizes = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for k, (kind, pack, n) in enumerate(zip(kinds, packs, sizes, strict=True)):
                own.add(kind, pack, n, batch.column(4)[k].values, batch.column(5)[k].as_py())
        if own.n_ids:
            yield from own.results()

    rows = docs.mapInArrow(explode, _DEALT_SCHEMA).unionByName(counts.mapInArrow(deal_words, _DEALT_SCHEMA))
    found = rows.repartitionById(cells, F.col("cell")).mapInArrow(look_up, "word long, ids array<long>, size array<long>, v array<double>")
    number, often = F.shiftrightunsigned("w", 1), F.broadcast(spark.createDataFrame(pd.DataFrame({"w": frequent.words.view(np.int64)}), "w long"))
    other = counts.join(often, "w", "left_anti").select(F.when(number <= int(_RANKS), number + int(_RANKS) + 1).otherwise(number).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    # packs, whose numbers are no words, need no count; their documents meet in one task
    out = found.join(other, "word", "left").select("ids", "size", "v", F.coalesce(F.log("n"), F.lit(0.0)).alias("more")).mapInArrow(_add_up, "doc_id long, size long, v double")
    out = out.groupBy("doc_id").agg(F.sum("size").alias("n_words"), F.sum("v").alias("log_score"))
    out = stash(out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))))
    clear(spark, mark, out)
    return out


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
