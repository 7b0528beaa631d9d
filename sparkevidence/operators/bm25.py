"""BM25 ranking of a corpus for many questions at once, by a block-max inverted index.

**Index.** Tasks cut their documents into buckets of ``BUCKET_DOCS`` and invert each bucket where it
lies, so building moves no postings and stores nothing else: a row holds the postings of one word in one
bucket. Files hold runs of ``RUN_BUCKETS`` buckets, each sorted by
word inside the task, so that a search reads the row groups of the asked words only and a task holds no
more than one run, however large its part of the corpus. A word that occurs in a third of all documents is spread over all
buckets like any other.

**Search.** The weights of the question words come from a join with the word counts. Buckets are dealt
to groups. The postings of asked words are picked out and packed, compressed and a bucket to a row, where they
are read, and go to their group; so do the questions, packed too. There are only as many groups as keep all
cores busy, since each takes a copy of all questions; postings move once. A task keeps its packed buckets and reads its
questions, ``GROUP_WEIGHTS`` words at a time, and for these opens its buckets one by one: the best gains of blocks of
``BLOCK_DOCS`` documents times weights
bound the score of every block for every question, blocks below the k-th score found so far are
skipped, and the postings of the others are added up. k rows for each question leave a task. Questions
never pass through the driver, and the number of jobs does not grow with them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import tokenize
from .scale import BROADCAST_ROWS, at_most, cut_lineage, spread
from .topk import HIT_SCHEMA, RunningTopK, rank_hits, six_places

BUCKET_DOCS = 1024
BLOCK_DOCS = 64
GROUP_BUCKETS = 256
#: Question words that a task holds at once, and those of one pack.
GROUP_WEIGHTS = 1 << 20
PACK_WEIGHTS = 1 << 18
#: Rows of postings that are packed together.
PACK_ROWS = 1 << 18
#: Tasks of a search for each core: more would only copy the questions more often.
TASKS_PER_CORE = 2
#: Buckets whose postings are sorted by word together when an index is built.
RUN_BUCKETS = 16
#: Questions whose scores of one bucket are held at once: 4 MB.
CHUNK_QUERIES = 512
#: Asked words up to which their list is given to the scan, which then skips row groups without them.
PUSHED_TERMS = 1_000
ROW_GROUP_BYTES = 4 << 20
RUN_ROWS = 4096
#: A word with at least this part (one in so many) of a bucket's documents as postings, over all questions, can be frequent there.
FREQUENT = 8
#: It is, if so many products of matrices take no longer than the sum of one posting.
PRODUCTS = 1536
#: Where blocks are bounded and more than this part stays open, the next few buckets are not bounded.
OPEN, UNBOUNDED = 0.75, 7
#: Scores are compared after rounding to six places.
MARGIN = 1e-6

POSTINGS = "bucket long, term string, docs array<int>, tf array<int>"
PACKED = "kind int, bucket long, packed binary"
BUCKETS = "bucket long, ids array<long>, lengths array<int>"

Tokens = Callable[[str], Column]


@dataclass(frozen=True)
class Totals:
    n_docs: int
    avg_length: float
    mean_idf: float
    n_buckets: int


@dataclass(frozen=True)
class Index:
    """``postings`` by bucket and word, ``buckets`` with ids and lengths of their documents, ``words``.

    The columns ``blocks`` and ``tops`` of older indexes are empty: the best gains of blocks are taken where a
    bucket is opened, from the gains of its postings. So building needs no mean length, and no second pass.
    """

    postings: DataFrame
    buckets: DataFrame
    words: DataFrame
    totals: Totals
    k1: float = DEFAULTS.bm25_k1
    b: float = DEFAULTS.bm25_b


def tokenized(
    docs: DataFrame, tokens: Tokens = tokenize, id_col: str = "doc_id", text_col: str = "content"
) -> DataFrame:
    """(doc_id, terms) of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("terms"))


def raw_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def open_index(
    postings: DataFrame, buckets: DataFrame, words: DataFrame, settings: Settings = DEFAULTS
) -> Index:
    """An index over stored tables, with its totals."""
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    row = buckets.agg(
        F.count("*").alias("n"), F.sum(F.size("ids")).alias("docs"), F.sum(length).alias("length")
    ).first()
    n_docs = row["docs"] or 0
    mean = words.agg(F.avg(raw_idf(F.col("df"), F.lit(n_docs)))).first()[0]
    totals = Totals(n_docs, (row["length"] or 0) / max(n_docs, 1), mean or 0.0, row["n"])
    return Index(postings, buckets, words, totals, settings.bm25_k1, settings.bm25_b)


def build_index(
    docs: DataFrame,
    tokens: Tokens = tokenize,
    id_col: str = "doc_id",
    text_col: str = "content",
    settings: Settings = DEFAULTS,
) -> Index:
    """Tokenize a corpus once and write the index out for all later searches."""
    rows = tokenized(spread(docs), tokens, id_col, text_col).mapInArrow(_inverted(), f"{POSTINGS}, ids array<long>")
    # rows are half as long as those of older indexes: as many to a row group, so that as few are read for a word
    rows = cut_lineage(rows, {"parquet.block.size": str(ROW_GROUP_BYTES // 2)})
    buckets = rows.where("term is null").select("bucket", "ids", F.col("tf").alias("lengths"))
    empty = {"blocks": F.lit(None).cast("array<int>"), "tops": F.lit(None).cast("array<double>")}
    postings = rows.where("term is not null").drop("ids").withColumns(empty)
    words = cut_lineage(postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")))
    return open_index(postings, buckets, words, settings)


def _inverted():
    """Documents into buckets: one row with ids and lengths, and one for each word."""
    kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64())]
    names = ["bucket", "term", "docs", "tf", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        in_run = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET_DOCS):
                for columns in _bucket(batch.slice(start, BUCKET_DOCS)):
                    columns.insert(0, pa.array(np.full(len(columns[0]), bucket)))
                    held.append(pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names))
                bucket, in_run = bucket + 1, in_run + 1
                if in_run == RUN_BUCKETS:
                    yield from _by_word(held)
                    held, in_run = [], 0
        yield from _by_word(held)

    return run


def _by_word(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some buckets by word and bucket, heads first, in small batches."""
    if held:
        run = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        coded = run.column("term").chunk(0).dictionary_encode()
        rank = pc.rank(coded.dictionary, tiebreaker="first").take(coded.indices).fill_null(0)
        # rows come by bucket, which a stable sort keeps
        order = np.argsort(rank.to_numpy(), kind="stable")
        del coded, rank
        whole = run.to_batches()[0]
        for start in range(0, len(order), RUN_ROWS):
            yield whole.take(pa.array(order[start : start + RUN_ROWS]))


def _listed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _bucket(part: pa.RecordBatch) -> Iterator[list[pa.Array]]:
    """Columns after the bucket number: first the documents, then the postings by word."""
    ids, lists = part.column(0), part.column(1)
    n = len(ids)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    one = np.array([0, n])
    yield [
        pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), _listed(lengths, one),
        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.cast(pa.int64())),
    ]
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return
    rows = np.repeat(np.arange(n), lengths)
    cell, tf = np.unique(words.indices.to_numpy() * np.int64(n) + rows, return_counts=True)
    word, doc = cell // n, cell % n
    at = np.searchsorted(word, np.arange(len(words.dictionary) + 1))
    yield [
        words.dictionary, _listed(doc, at), _listed(tf, at), pa.nulls(len(words.dictionary), pa.list_(pa.int64())),
    ]


def query_terms(queries: DataFrame, tokens: Tokens = tokenize) -> DataFrame:
    """(query_id, term, qtf) with the count of the word in the question."""
    return (
        queries.where(F.trim("query") != "")
        .select("query_id", F.explode(tokens("query")).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def index_stats(index: Index) -> DataFrame:
    """One row: documents, distinct words, mean document length, mean raw word weight."""
    n_docs = F.lit(index.totals.n_docs).cast("long")
    return index.words.agg(
        F.max(n_docs).alias("n_docs"),
        F.count("*").alias("n_terms"),
        F.max("df").alias("max_df"),
        F.max(F.lit(index.totals.avg_length)).alias("avg_length"),
        F.avg(raw_idf(F.col("df"), n_docs)).alias("mean_idf"),
    )


def _weights(terms: DataFrame, words: DataFrame, totals: Totals, s: Settings) -> DataFrame:
    """(query_id, term, weight) of the asked words that the corpus has."""
    idf = raw_idf(F.col("df"), F.lit(totals.n_docs))
    floor = F.lit(totals.mean_idf * s.bm25_epsilon)
    weight = F.when(idf < 0, floor).otherwise(idf) * F.col("qtf")
    return terms.join(words, "term").select(
        F.col("query_id").cast("long").alias("query_id"), "term", weight.alias("weight")
    ).where("weight <> 0")


def search(
    queries: DataFrame, index: Index, k: int, settings: Settings = DEFAULTS, tokens: Tokens = tokenize
) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k documents with a positive score.

    The ranking is small against the corpus and is written out once, so that whatever is built on
    it does not score the corpus again.
    """
    if (settings.bm25_k1, settings.bm25_b) != (index.k1, index.b):
        raise ValueError("the index was built for other k1 and b")
    return cut_lineage(rank_hits(scored(query_terms(queries, tokens), index, k, settings), k))


def _any_of(column: str, values: list[str]) -> Column:
    """A list condition as one expression, which is handed over and planned at once."""
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"{column} in ({', '.join(quoted)})") if quoted else F.lit(False)


def scored(terms: DataFrame, index: Index, k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, doc_id, score): k rows or less for each question and group of buckets."""
    postings, words = index.postings, index.words
    asked = terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
    if len(asked) <= PUSHED_TERMS:
        listed = _any_of("term", [r["term"] for r in asked])
        postings, words = postings.where(listed), words.where(listed)
    weights = cut_lineage(_weights(terms, words, index.totals, settings))
    if len(asked) > PUSHED_TERMS:
        hashed = weights.select(F.xxhash64("term").alias("hash")).distinct()
        if at_most(hashed, BROADCAST_ROWS):  # else all postings go; those of other words are not opened
            postings = postings.withColumn("hash", F.xxhash64("term")).join(F.broadcast(hashed), "hash", "left_semi")
    n = index.totals.n_buckets
    tasks = TASKS_PER_CORE * weights.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n // GROUP_BUCKETS), min(n, tasks), 1)

    grouped = _dealt(index.buckets, groups)
    words_of = F.sort_array(F.collect_list(F.struct("term", "weight")))
    asking = weights.groupBy("query_id").agg(words_of.alias("w")).select(
        F.lit(0).alias("kind"), "query_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"),
    )
    questions = asking.mapInArrow(_question_packer(), PACKED).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "*"
    )
    wanted = grouped(postings.select("bucket", "term", "docs", "tf").mapInArrow(_posting_packer(), PACKED))
    heads = grouped(index.buckets.select(F.lit(1).alias("kind"), "bucket", "lengths", "ids"))
    rows = wanted.unionByName(questions).unionByName(heads, allowMissingColumns=True)
    # null lists are slow to hand over to Python: the time of each grows with its batch
    lists = [x.name for x in rows.schema.fields if x.dataType.typeName() == "array"]
    rows = rows.withColumns({x: F.coalesce(x, F.array().cast(rows.schema[x].dataType)) for x in lists})
    dealt = rows.repartitionById(groups, "grp").sortWithinPartitions("grp", F.desc("kind"))
    return dealt.select("grp", "kind", "bucket", "packed", "lengths", "ids").mapInArrow(_scorer(k, index), HIT_SCHEMA)


def _dealt(buckets: DataFrame, groups: int) -> Callable[[DataFrame], DataFrame]:
    """Adds the group to rows with a bucket: buckets get consecutive numbers, so no group has two more than another."""
    task = F.shiftright("bucket", 32).alias("task")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = buckets.groupBy(task).agg(F.count("*").alias("n"))  # a row for each task that built the index
    starts = F.broadcast(counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    number = F.col("start") + F.col("bucket").bitwiseAND(0xFFFFFFFF)
    group = F.pmod(number, F.lit(groups)).cast("int").alias("grp")
    return lambda rows: rows.withColumn("task", task).join(starts, "task").select("*", group).drop("task", "start")


def _sealed(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed message, whole numbers in the smallest type that holds them."""
    lists = []
    for c in columns:
        if c.dtype.kind in "iu" and len(c) and c.min() >= 0:
            c = c.astype(np.min_scalar_type(c.max()))
        lists.append(_listed(c, np.array([0, len(c)])))
    batch = pa.RecordBatch.from_arrays(lists, names=[str(i) for i in range(len(lists))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unsealed(message: pa.Scalar) -> list[np.ndarray]:
    batch = pa.ipc.open_stream(message.as_buffer()).read_next_batch()
    return [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns]


def _letters(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words without nulls, and how many each has."""
    _, at, data = terms.buffers()
    at = np.frombuffer(at, np.int32)[terms.offset : terms.offset + len(terms) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _spelled(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = _ends(sizes).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(letters.tobytes())])


def _posting_packer():
    """Rows of postings into one row for each bucket among some ``PACK_ROWS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield _posting_packs(held)
                held, n = [], 0
        if n:
            yield _posting_packs(held)

    return run


def _posting_packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    whole = table.take(pa.array(order)).combine_chunks().to_batches()[0]
    bucket = whole.column("bucket").to_numpy()
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    packed = []
    for start, end in zip(starts, np.r_[starts[1:], len(bucket)]):
        part = whole.slice(start, end - start)
        docs, sizes = _lists(part.column("docs"))
        packed.append(_sealed(*_letters(part.column("term")), sizes, docs, _lists(part.column("tf"))[0]))
    return _packs(2, bucket[starts], packed)


def _packs(kind: int, bucket: np.ndarray, packed: list[bytes]) -> pa.RecordBatch:
    kinds = pa.array(np.full(len(packed), kind, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [kinds, pa.array(bucket, pa.int64()), pa.array(packed, pa.binary())], names=["kind", "bucket", "packed"]
    )


def _opened(message: pa.Scalar) -> pa.RecordBatch:
    """The rows of postings of one pack."""
    letters, widths, sizes, docs, tf = _unsealed(message)
    at, n = _ends(sizes), len(sizes)
    return _rows(2, _spelled(letters, widths), _listed(docs, at), _listed(tf, at), _listed(docs[:0], np.zeros(n + 1)))


def _rows(kind: int, term: pa.Array, docs: pa.Array, tf: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    short, long = pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(term), kind)), term, docs.cast(short), tf.cast(short), ids.cast(long)],
        names=["kind", "term", "docs", "tf", "ids"],
    )


def _question_packer():
    """Questions into packs of some ``PACK_WEIGHTS`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            share = _ends(sizes)[1:] // PACK_WEIGHTS
            starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]) if len(share) else []
            for start, end in zip(starts, np.r_[starts[1:], len(share)]):
                part = batch.slice(start, end - start)
                yield _packs(0, np.array([-1]), [_question_pack(part)])

    return run


def _question_pack(part: pa.RecordBatch) -> bytes:
    """Ids and sizes of questions, the numbers of their words, and these words with their weights."""
    weights, sizes = _lists(part.column("weights"))
    terms = part.column("terms").flatten()
    words = _sorted_words(terms)
    of, weight = np.unique(weights, return_inverse=True)
    both = _numbers(terms, words).astype(np.int64) * max(len(of), 1) + weight
    pairs, number = np.unique(both, return_inverse=True)
    # a null id has no questions to meet later
    ids = part.column("query_id").fill_null(-(2**63)).to_numpy()
    named = words.take(pa.array(pairs // max(len(of), 1)))
    return _sealed(ids, sizes, number, *_letters(named), of[pairs % max(len(of), 1)])


def _asked(message: pa.Scalar) -> pa.RecordBatch:
    """(query_id, term, weight) of a pack of questions."""
    ids, sizes, number, letters, widths, weight = _unsealed(message)
    terms = _spelled(letters, widths).take(pa.array(number))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids.astype(np.int64), sizes)), terms, pa.array(weight[number])],
        names=["query_id", "term", "weight"],
    )


def _sorted_words(terms: pa.Array) -> pa.Array:
    words = terms.unique()
    return words.take(pc.sort_indices(words))


def _numbers(terms: pa.Array, words: pa.Array) -> np.ndarray:
    """The place of each term among ``words``, or -1."""
    return pc.index_in(terms, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)


class _Questions:
    """Weights of one part of the questions, by question; words by number."""

    def __init__(self, query_id: np.ndarray, terms: pa.Array, weight: np.ndarray):
        self.ids, self.query = np.unique(query_id, return_inverse=True)
        self.words = _sorted_words(terms)
        word = _numbers(terms, self.words)
        order = np.lexsort((word, self.query))
        self.query, self.weight, self.word = self.query[order], weight[order], word[order]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _scorer(k: int, index: Index):
    k1, b, avg_length = index.k1, index.b, index.totals.avg_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group: packs of postings, the documents of its buckets, then packs of questions."""
        at, n = None, 0
        heads: dict[int, pa.RecordBatch] = {}
        packs: dict[int, list[pa.Scalar]] = defaultdict(list)
        asked: list[pa.RecordBatch] = []

        def answered() -> pa.RecordBatch:
            best = _Best(asked, k)
            asked.clear()
            for bucket in sorted(packs):
                rows = [heads[bucket], *map(_opened, packs[bucket])]
                best.add(_Bucket(rows, best.questions, k1, b, avg_length))
            pa.default_memory_pool().release_unused()
            return best.rows()

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("grp", "kind", "bucket")]
            for i, (grp, kind, bucket) in enumerate(zip(*columns)):
                if grp != at:
                    if asked:
                        yield answered()
                    at, n = grp, 0
                    heads.clear(), packs.clear()
                if kind == 2:
                    packs[bucket].append(batch.column("packed")[i])
                elif kind == 1:
                    lengths, ids = (batch.column(x).slice(i, 1) for x in ("lengths", "ids"))
                    heads[bucket] = _rows(1, pa.nulls(1, pa.string()), lengths, lengths, ids)
                else:
                    asked.append(_asked(batch.column("packed")[i]))
                    n += asked[-1].num_rows
                    if n + PACK_WEIGHTS > GROUP_WEIGHTS:  # another pack could be too much
                        yield answered()
                        n = 0
        if asked:
            yield answered()

    return run


class _Bucket:
    """Postings of the asked words in one bucket, with the gains of documents and blocks."""

    def __init__(self, rows: list[pa.RecordBatch], questions: _Questions, k1: float, b: float, avg_length: float):
        table = pa.Table.from_batches(rows).combine_chunks()
        kind = table.column("kind").to_numpy()
        head, rest = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 2))
        self.ids = head.column("ids")[0].values.to_numpy(zero_copy_only=False)
        lengths = head.column("docs")[0].values.to_numpy(zero_copy_only=False)
        self.n_blocks = -(-len(self.ids) // BLOCK_DOCS)
        #: Row of each word of the questions, or -1.
        self.row = np.full(len(questions.words), -1, dtype=np.int64)
        numbers = _numbers(rest.column("term").combine_chunks(), questions.words)
        rest, numbers = rest.filter(pa.array(numbers >= 0)), numbers[numbers >= 0]
        self.row[numbers] = np.arange(len(numbers))
        self.tops = np.zeros((len(numbers), self.n_blocks))
        if not len(numbers):
            return
        self.docs, self.size = _lists(rest.column("docs").combine_chunks())
        tf, _ = _lists(rest.column("tf").combine_chunks())
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        norm = k1 * (1 - b + b * lengths / avg_length) if len(lengths) else lengths
        self.gain = tf * (k1 + 1) / (tf + norm[self.docs])
        row, block = np.repeat(np.arange(len(numbers)), self.size), self.docs // BLOCK_DOCS
        opens = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
        self.tops[row[opens], block[opens]] = np.maximum.reduceat(self.gain, opens)


def _postings_of(row: np.ndarray, bucket: _Bucket) -> tuple[np.ndarray, np.ndarray]:
    """Places of the postings of some rows one after the other, and how many each has."""
    size = bucket.size[row]
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(bucket.first[row] - before, size), size


def _dense(query, row, weight, n_queries: int, bucket: _Bucket) -> np.ndarray:
    """Scores by words that many documents of the bucket have, as one product of matrices."""
    words, column = np.unique(row, return_inverse=True)
    gains = np.zeros((len(words), len(bucket.ids)))
    at, size = _postings_of(words, bucket)
    gains[np.repeat(np.arange(len(words)), size), bucket.docs[at]] = bucket.gain[at]
    asked = np.zeros((n_queries, len(words)))
    asked[query, column] = weight
    return asked @ gains


class _Best:
    """The running results of the questions of one part."""

    def __init__(self, asked: list[pa.RecordBatch], k: int):
        columns = [pa.Table.from_batches(asked).column(x) for x in ("query_id", "term", "weight")] if asked else None
        self.questions = (
            _Questions(columns[0].to_numpy(), pa.concat_arrays(columns[1].chunks), columns[2].to_numpy())
            if asked
            else _Questions(np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0))
        )
        self.k = k
        self.chunks = [
            RunningTopK(k, positive_only=True) for _ in range(0, len(self.questions.ids), CHUNK_QUERIES)
        ]
        self.unbounded = [0] * len(self.chunks)

    def add(self, bucket: _Bucket) -> None:
        q = self.questions
        row = bucket.row[q.word]
        for number in range(len(self.chunks)):
            start = number * CHUNK_QUERIES
            ids = q.ids[start : start + CHUNK_QUERIES]
            low, high = np.searchsorted(q.query, (start, start + len(ids)))
            mine = np.flatnonzero(row[low:high] >= 0) + low
            if len(mine):
                self._add(number, ids, q.query[mine] - start, row[mine], q.weight[mine], bucket)

    def _add(self, number, ids, query, row, weight, bucket: _Bucket) -> None:
        best, n = self.chunks[number], len(bucket.ids)
        floor = best.floors(ids)
        open_blocks = None
        if self.unbounded[number]:
            self.unbounded[number] -= 1
        else:
            bound = np.zeros((len(ids), bucket.n_blocks))
            heads = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            most = np.maximum(weight, 0)[:, None] * bucket.tops[row]
            bound[query[heads]] = np.add.reduceat(most, heads, axis=0)
            open_blocks = (bound >= np.maximum(floor - MARGIN, 0)[:, None]) & (bound > 0)
            if np.isfinite(floor).any() and open_blocks.mean() > OPEN:
                self.unbounded[number] = UNBOUNDED
            going = open_blocks.any(axis=1)
            keep = going[query]
            query, row, weight = (np.cumsum(going) - 1)[query[keep]], row[keep], weight[keep]
            if not len(query):
                return
            open_blocks, ids, floor = open_blocks[going], ids[going], floor[going]
            if open_blocks.mean() > OPEN:
                open_blocks = None
        over_all = np.bincount(row, minlength=len(bucket.size)) * bucket.size
        frequent = over_all[row] >= max(n / FREQUENT, n * len(ids) / PRODUCTS)
        total = _dense(query[frequent], row[frequent], weight[frequent], len(ids), bucket)
        query, row, weight = query[~frequent], row[~frequent], weight[~frequent]
        at, size = _postings_of(row, bucket)
        cell, gain = np.repeat(query * n, size) + bucket.docs[at], bucket.gain[at] * np.repeat(weight, size)
        if open_blocks is not None:
            of, doc = np.divmod(cell, n)
            live = open_blocks[of, doc // BLOCK_DOCS]
            cell, gain = cell[live], gain[live]
            total[~np.repeat(open_blocks, BLOCK_DOCS, axis=1)[:, :n]] = 0
        total += np.bincount(cell, gain, minlength=total.size).reshape(total.shape)
        best.add(ids, bucket.ids, total, floor)

    def rows(self) -> pa.RecordBatch:
        found = [np.concatenate([getattr(c, x) for c in self.chunks] or [np.empty(0)]) for x in ("query", "doc", "score")]
        return pa.RecordBatch.from_arrays(
            [pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(found[2])],
            names=["query_id", "doc_id", "score"],
        )
