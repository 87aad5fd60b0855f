"""Ranked lexical search with a length-stratified index.

The index is a table of blocks, each over a bounded number of documents. In a
block, documents of one length normaliser m form a stratum, and the postings of
a term are kept by stratum and within it by term frequency: a *cell* (term,
stratum, tf) lists its documents. All documents of a cell have the same impact,
which is computed once per cell.

A search takes the queries in blocks of bounded size. For each query the best
impact that a term has in a stratum bounds what any of the stratum's documents
can score. Strata are visited in falling order of bounds, and only for the
queries whose k-th best score so far the bound can still reach; a task carries
these thresholds from block to block. The k best of the tasks are ranked
together. The result is exact.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm.common import staged

#: Terms: ASCII letters (A-Z lower-cased) and digits, and all beyond ASCII.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(
    c if c in _KEPT else (c + 32 if 65 <= c <= 90 else 32) for c in range(256)
)
#: b and k1 of the score, in hundredths and thousandths.
SLOPE, SATURATION, SCALE = 25, 1200, 10**9

BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 10_000
#: Readers decode thousands of rows of a file at once, so files hold few blocks.
FILE_BLOCKS = 6
QUERY_BYTES, QUERY_ROWS = 1 << 20, 500
TOUCHES = 1 << 20

_FIELDS = [
    ("ids", pa.int64()), ("m", pa.int64()), ("first_doc", pa.int32()), ("terms", pa.string()),
    ("term_docs", pa.int32()), ("cell_term", pa.int32()), ("cell_stratum", pa.int32()),
    ("cell_tf", pa.int32()), ("cell_first", pa.int32()), ("docs", pa.int32()),
]
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}
BLOCK = ", ".join(f"{n} array<{_SQL[t]}>" for n, t in _FIELDS)


class LexicalIndex(NamedTuple):
    """``blocks`` (one row per block), documents with terms, all their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else (text or b"")
    return raw.translate(TABLE).split()


def normaliser(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - SLOPE + (SLOPE * n * n_docs) // n_terms


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Block:
    """Documents of one block while it is built."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, text: bytes, words: list[bytes]) -> None:
        self.ids.append(doc)
        self.words.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
        self.size += len(text)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in self.words])
        m = np.array([normaliser(int(n), n_docs, n_terms) for n in lengths], np.int64)
        none = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, none, m))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        strata, first_doc = np.unique(m[order], return_index=True)
        stratum = np.repeat(np.arange(len(strata)), np.diff(np.append(first_doc, len(order))))
        keys, tf = np.unique(
            np.concatenate(self.words) * len(order) + np.repeat(place, lengths), return_counts=True)
        term, doc = keys // len(order), keys % len(order)
        by_tf = np.lexsort((doc, tf, stratum[doc], term))
        term, doc, tf = term[by_tf], doc[by_tf], tf[by_tf]
        cell = np.stack([term, stratum[doc], tf])
        opens = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0)))
        columns = {
            "ids": pa.array([self.ids[i] for i in order], pa.int64()), "m": strata,
            "first_doc": first_doc,
            "terms": pa.array([w.decode("utf-8", "replace") for w in self.vocabulary], pa.string()),
            "term_docs": np.bincount(term, minlength=len(self.vocabulary)),
            "cell_term": term[opens], "cell_stratum": stratum[doc[opens]], "cell_tf": tf[opens],
            "cell_first": opens, "docs": doc,
        }
        lists = []
        for name, kind in _FIELDS:
            values = columns[name]
            values = values if isinstance(values, pa.Array) else pa.array(values).cast(kind)
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.RecordBatch.from_arrays(lists, names=[n for n, _ in _FIELDS])


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
    block_docs: int = BLOCK_DOCS,
) -> LexicalIndex:
    """The index of all rows with at least one term, as files below the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms_of(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array(sizes, pa.int64())})

    counted = rows.select("text").mapInArrow(count, "n long").where("n > 0")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, raw in zip(batch.column("key").to_pylist(), texts):
                words = terms_of(raw)
                if words:
                    block.add(doc, raw, words)
                    if block.size >= block_bytes or len(block.ids) >= block_docs:
                        yield block.row(n_docs, n_terms)
                        block = _Block()
        if block.ids:
            yield block.row(n_docs, n_terms)

    blocks = staged(rows.mapInArrow(build, BLOCK), maxRecordsPerFile=FILE_BLOCKS)
    return LexicalIndex(blocks, n_docs, n_terms)


class Queries(NamedTuple):
    """Query i holds ``terms[offset[i]:offset[i + 1]]`` with weights (w x repeats)."""

    vocabulary: dict[str, int]
    offset: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _queries(index: LexicalIndex, texts: list[str | None]) -> Queries:
    """Term weights of a block of queries, by the document counts of the index."""
    bags = [Counter(w.decode("utf-8", "replace") for w in terms_of(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for bag in bags for w in bag))}
    spark = index.blocks.sparkSession
    words = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    pairs = F.explode(F.arrays_zip("terms", "term_docs")).alias("at")
    df = {
        r["term"]: r["df"] for r in index.blocks.select(pairs).select(
            F.col("at.terms").alias("term"), F.col("at.term_docs").cast("long").alias("n"),
        ).join(F.broadcast(words), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()
    }  # at most the words of a block of queries
    flat = [(vocabulary[w], n * term_weight(index.n_docs, df.get(w, 0))) for bag in bags for w, n in bag.items()]
    pairs = np.array(flat, np.int64).reshape(-1, 2)
    offset = np.cumsum([0, *[len(bag) for bag in bags]])
    return Queries(vocabulary, offset, pairs[:, 0], pairs[:, 1])


class _Best:
    """The k best documents of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.threshold = np.ones(n, np.int64)  # a score below is of no use
        self.rows = np.zeros((4, 0), np.int64)  # query, score, id, id is null

    def add(self, query, score, doc, none) -> None:
        rows = np.concatenate([self.rows, np.stack([query, score, doc, none])], axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        opens = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        rank = np.arange(rows.shape[1]) - np.repeat(opens, np.diff(np.append(opens, rows.shape[1])))
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.threshold[last[0]] = last[1]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


def _search_block(block: dict, queries: Queries, best: _Best) -> None:
    wanted = np.array([queries.vocabulary.get(t, -1) for t in block["terms"]], np.int64)
    term = wanted[block["cell_term"]]
    keep = np.flatnonzero(term >= 0)
    if not len(keep):
        return
    m, n_strata = block["m"], len(block["m"])
    first = block["cell_first"].astype(np.int64)
    size = np.diff(np.append(first, len(block["docs"])))
    keep = keep[np.argsort(block["cell_stratum"][keep], kind="stable")]
    term, stratum, tf = term[keep], block["cell_stratum"][keep], block["cell_tf"][keep].astype(np.int64)
    first, size = first[keep], size[keep]
    impact = (SCALE * tf) // (1000 * tf + SATURATION // 100 * m[stratum])
    cells = np.searchsorted(stratum, np.arange(n_strata + 1))
    n = len(queries.offset) - 1
    filled = np.flatnonzero(np.diff(queries.offset))
    bounds = np.zeros((n_strata, n), np.int64)
    for s in range(n_strata):
        a, b = cells[s], cells[s + 1]
        top = np.zeros(len(queries.vocabulary), np.int64)
        top[term[a:b]] = impact[a:b]  # cells of a term come in rising order of tf
        bounds[s, filled] = np.add.reduceat(queries.weights * top[queries.terms], queries.offset[filled])
    # Queries by term.
    by_term = np.argsort(queries.terms, kind="stable")
    owner = np.repeat(np.arange(n), np.diff(queries.offset))[by_term]
    weight, term_first = queries.weights[by_term], np.searchsorted(
        queries.terms[by_term], np.arange(len(queries.vocabulary) + 1))
    first_doc = np.append(block["first_doc"], len(block["ids"]))
    for s in np.argsort(-bounds.max(axis=1), kind="stable"):
        who = bounds[s] >= best.threshold
        if not who.any():
            continue
        a, b = cells[s], cells[s + 1]
        low, n_docs = int(first_doc[s]), int(first_doc[s + 1] - first_doc[s])
        chosen = np.flatnonzero(who)
        row = np.cumsum(who) - 1
        exact = bounds[s].max() < 1 << 53  # sums of doubles are exact below
        scores = np.zeros(len(chosen) * n_docs, np.int64)
        # (cell, query) pairs of the stratum, then their postings, a bounded number at a time.
        counts = term_first[term[a:b] + 1] - term_first[term[a:b]]
        at = _ranges(term_first[term[a:b]], counts)
        cell = np.repeat(np.arange(a, b), counts)
        useful = who[owner[at]]
        at, cell = at[useful], cell[useful]
        gain = weight[at] * impact[cell]
        touched = np.cumsum(size[cell])
        begin = 0
        while begin < len(cell):
            done = touched[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(touched, done + TOUCHES, "right")))
            some = cell[begin:end]
            doc = block["docs"][_ranges(first[some], size[some])] - low
            spot = np.repeat(row[owner[at[begin:end]]] * n_docs, size[some]) + doc
            gains = np.repeat(gain[begin:end], size[some])
            if exact:
                scores += np.bincount(spot, gains, len(scores)).astype(np.int64)
            else:
                np.add.at(scores, spot, gains)
            begin = end
        scores = scores.reshape(len(chosen), n_docs)
        i, d = np.nonzero(scores >= best.threshold[chosen, None])
        if len(i):
            best.add(chosen[i], scores[i, d], block["ids"][low + d], block["none"][low + d])


def _unpack(batch: pa.RecordBatch, i: int) -> dict:
    block = {}
    for name, _ in _FIELDS:
        lists = batch.column(name)
        values = lists.values.slice(lists.offsets[i].as_py(), lists.offsets[i + 1].as_py() - lists.offsets[i].as_py())
        if name == "terms":
            block[name] = values.to_pylist()
        elif name == "ids":
            block["none"] = values.is_null().to_numpy(False).astype(np.int64)
            block[name] = values.fill_null(0).to_numpy(False)
        else:
            block[name] = values.to_numpy(False)
    return block


def _search(index: LexicalIndex, queries: Queries, k: int) -> DataFrame:
    """``(query, score, doc, none)``: the k best of each task."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries)
    kinds = [("query", "long"), ("score", "long"), ("doc", "long"), ("none", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = _Best(len(queries.offset) - 1, k)
        for batch in batches:
            for i in range(len(batch)):
                _search_block(_unpack(batch, i), queries, best)
        if best.rows.shape[1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in best.rows], names=[n for n, _ in kinds])

    return index.blocks.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds))


def search(
    index: LexicalIndex, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 20,
    query_bytes: int = QUERY_BYTES, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item.

    Only scores above 0 count; equal scores go by rising id, null ids last.
    Items equal in id and text are one; null is an id like any other. An item
    without terms, or whose terms no document has, gives no rows; so does an
    empty index. Repeated documents are ranked each for itself. The queries are
    taken in blocks of about ``query_rows`` and ``query_bytes``, by a hash.
    """
    asked = items.select(
        F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n // query_rows), -(-size // query_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    kind = asked.schema["item_id"].dataType.simpleString()
    spark = asked.sparkSession
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(n_blocks if index.n_docs else 0):
        rows = asked.where(block == b).collect()
        found = staged(_search(index, _queries(index, [r["text"] for r in rows]), k))
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {kind}")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "none", "doc")
        out = out.unionByName(
            found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(
                F.broadcast(names), "query").select(
                "item_id", "rank", F.when(F.col("none") == 0, F.col("doc")).alias("doc_id"), "score"))
    return out


def ranked_search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", k: int = 20,
) -> DataFrame:
    """Index all of ``docs``, search all of ``items``: ``(item_id, rank, doc_id, score)``.

    Texts of any length are read whole; null texts have no terms. Keys are
    integers. Columns are read by name, others may have any name. See ``search``.
    """
    quote = ["`" + c.replace("`", "``") + "`" for c in (key, text, item_id, item_text)]
    return search(build_index(docs, *quote[:2]), items, *quote[2:], k=k)
