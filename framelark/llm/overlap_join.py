"""Near-duplicate documents by a T-occurrence search on word shingles.

Two documents link when their shingle sets A, B have 100|A n B| >= 80|A u B|;
that is, when they share T = ceil(4(|A| + |B|) / 9) shingles. The work:

1. Documents of equal sets become one node (a 128-bit signature of the set).
2. Inverted lists hold each node under its rarest shingles only: a node of n
   shingles under n - ceil(4n/5) + 1, for two linked nodes must share one of
   those in any common order. The order puts shingles last that are frequent
   in a sample of documents; the sample changes the order, never the result.
3. The prefixes of linked nodes share not one shingle but ``shared_prefix`` of
   them, so pairs that meet in fewer lists are no candidates, and rows of nodes
   with fewer rows than a partner of any size in the list asks for are dropped.
   The nodes are first compared with the best of some heads of their lists:
   large groups of near copies grow together by numbers of pairs linear in their
   size, until the pairs across components are few beside the lists or a draw
   leaves most of them. Then all pairs across components are compared that may
   meet often enough from their first list on, the shortest lists first.
4. Pairs are compared in blocks, one query node against some candidates, by
   DivideSkip: of the query's lists over the candidates the longest are set
   aside, the short ones are merged with a heap, and candidates with enough
   occurrences there are looked up in the long ones by binary search.
5. Components of the links by alternating stars; a document's component is
   the smallest id in it.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm.common import numbered, packed, staged, unpacked
from framelark.llm.text import mix64, slices, windows, word_hashes, word_spans

LENGTH = 5
SAMPLED = 16  # one document of so many tells which shingles are frequent
FREQUENT = 3  # seen in so many sampled documents
MOST_FREQUENT = 500_000  # bounds what is broadcast: 16 bytes each
HEADS = 4  # nodes of a list that one draw offers to all others
BEST = 2  # of the heads offered to a node, those it is compared with
LINEAR = 8  # pairs across components, per row of the lists, that end the draws
FEWER = 0.75  # a draw that leaves more of those pairs is the last
BLOCK = 256  # candidates of one query compared in one group
LONG_LISTS = 0.0085  # the published weight of the split into short and long lists
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice ``(shingles, document)``: distinct, ordered by document and value."""
    for _, _, data, bounds in slices(texts):
        data = LOWER[data]
        starts, ends, first = word_spans(data, bounds)
        hashes = word_hashes(data, starts, ends)
        value, _, doc = windows(hashes, first, length)
        count = np.diff(first)
        values, docs = [value], [doc]
        for n in range(1, length):  # shorter texts are one shingle
            short = np.flatnonzero(count == n)
            whole = np.zeros(len(short), np.uint64)
            for j in range(n):
                whole = mix64(whole + hashes[first[short] + j] + np.uint64(n))
            values.append(whole)
            docs.append(short)
        value, doc = np.concatenate(values), np.concatenate(docs)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        yield value[new], doc[new], len(bounds) - 1


def signatures(value: np.ndarray, doc: np.ndarray, n_docs: int, seed: int):
    """Two 64-bit sums over each document's set, and its size."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix64(value + mix64(np.array([salt], np.uint64))), out=total[1:])
        out.append(mix64(total[first + count] - total[first]).view(np.int64))
    return count, first, *out


def frequent_shingles(docs: DataFrame, text: str, key: Column, most: int = MOST_FREQUENT):
    """Sorted frequent shingles and their counts in the sampled documents."""
    sample = docs.where(F.pmod(F.xxhash64(key), F.lit(SAMPLED)) == 0).select(F.col(text))

    def emit(batches):
        for batch in batches:
            for value, _, _ in shingle_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["h"])

    counted = staged(sample.mapInArrow(emit, "h long").groupBy("h").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT))
    # The lowest count that keeps the table within its bound.
    steps = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().collect()
    total, least = 0, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            least = row["step"] + 1
            break
    rows = counted.where(F.floor(F.log2("n") * 8) >= least).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, doc_id: str, text: str, frequent, seed: int) -> DataFrame:
    """One row per document: ``key, doc_id, n, node, check, prefix``."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def emit(batches):
        hot, counts = known.value
        for batch in batches:
            parts = []
            for value, doc, n_docs in shingle_sets(batch.column(2)):
                n, first, node, check = signatures(value, doc, n_docs, seed)
                rank = np.zeros(len(value), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                    rank = np.where(hot[at] == value, counts[at], 0)
                order = np.lexsort((value, rank, doc))
                place = np.arange(len(value)) - first[doc]
                size = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                chosen = value[order][place < size[doc]].view(np.int64)
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(chosen))
                parts.append([pa.array(n), pa.array(node), pa.array(check), prefix])
            if parts:
                columns = [pa.concat_arrays(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *columns],
                    names=["key", "doc_id", "n", "node", "check", "prefix"])

    return docs.select(row_digest(doc_id, text).alias("key"), F.col(doc_id), F.col(text)).mapInArrow(
        emit, f"key string, doc_id {kind}, n long, node long, check long, prefix array<long>")


def row_digest(doc_id: str, text: str) -> Column:
    """Equal for rows of equal id and text."""
    return F.md5(F.concat_ws(
        ":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")),
        F.coalesce(F.col(text), F.lit("")),
    ).cast("binary"))


def needed(n: int, m) -> np.ndarray:
    """Shingles that sets of n and m must share to link."""
    return (4 * (n + m) + 8) // 9


def shared_prefix(n: Column, m: Column) -> Column:
    """How many prefix shingles linked sets of n and m share at least.

    A set of n lacks at most n - T of the other's shingles in all, and so of its
    prefix; up to that many of its own may stand before a shared one.
    """
    t = F.floor((4 * (n + m) + 8) / 9)
    return F.least(*[t - F.floor((4 * x + 4) / 5) + 1 for x in (n, m)])


def divide_skip(query: np.ndarray, candidates: list[np.ndarray]) -> list[int]:
    """Numbers of the candidates that share enough shingles with the query."""
    k = len(candidates)
    sizes = np.array([len(c) for c in candidates])
    need = needed(len(query), sizes)
    # Inverted lists of the query's shingles over the candidates.
    value = np.concatenate(candidates)
    owner = np.repeat(np.arange(k), sizes)
    row = np.minimum(np.searchsorted(query, value), len(query) - 1)
    hit = query[row] == value
    entries = np.sort(row[hit] * k + owner[hit])  # list by list, candidates ascending
    lists = entries // k
    bounds = np.searchsorted(lists, np.arange(len(query) + 1))
    length = np.diff(bounds)
    threshold = int(need.min())
    by_length = np.argsort(length, kind="stable")
    n_long = min(int(threshold / (LONG_LISTS * math.log(max(2, int(length.max()))) + 1)),
                 threshold - 1, len(query))
    short, long = by_length[:len(query) - n_long], by_length[len(query) - n_long:]
    owners = (entries % k).tolist()
    merged = heapq.merge(*[owners[bounds[i]:bounds[i + 1]] for i in short if length[i]])
    found, at, seen = [], -1, 0
    counts = []
    for c in merged:
        if c != at:
            if seen:
                counts.append((at, seen))
            at, seen = c, 0
        seen += 1
    if seen:
        counts.append((at, seen))
    base = long * k
    for c, seen in counts:
        if seen < need[c] - n_long:
            continue
        probe = np.searchsorted(entries, base + c)
        inside = probe < len(entries)
        seen += int((entries[probe[inside]] == (base + c)[inside]).sum())
        if seen >= need[c]:
            found.append(c)
    return found


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets overlap enough.

    Compressed texts travel to the blocks, not sets, which are a multiple in size.
    """
    pairs = staged(pairs)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocks = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    members = blocks.select("a", "block", F.col("b").alias("node")).unionByName(
        blocks.select("a", "block", F.col("a").alias("node")).distinct())
    wanted = members.join(nodes.select("node", "key"), "node")
    texts = packed(docs, text, row_digest(doc_id, text))

    def search(key, rows):
        a = key[0].as_py()
        number = rows.column("node").to_numpy()
        _, first = np.unique(number, return_index=True)  # rows that repeat count once
        sets, numbers = [], number[first]
        for raw in unpacked(rows.column("packed").combine_chunks().take(pa.array(first))):
            sets += [value for value, _, _ in shingle_sets(pa.array([raw], pa.binary()))]
        query = int(np.flatnonzero(numbers == a)[0])
        others = [i for i in range(len(numbers)) if i != query]
        found = divide_skip(sets[query], [sets[i] for i in others])
        b = numbers[[others[i] for i in found]].astype(np.int64)
        return pa.table({"a": pa.array(np.full(len(b), a, np.int64)), "b": pa.array(b)})

    return staged(texts.join(wanted, "key").select("a", "block", "node", "packed").groupBy(
        "a", "block").applyInArrow(search, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``links (a, b)``: the smallest of each component.

    Large star and small star in turn until nothing changes; each is one
    aggregation and one join, whatever the degree of a node.
    """
    edges = staged(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct())
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = staged(large.distinct())
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = staged(large.join(root, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct())
        now = _digest(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal edge tables: their number and two sums of hashes."""
    each = [F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38, 0)")) for i in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *each).first())


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)`` once more links join components; only roots are searched."""
    at = lambda side: links.join(roots.withColumnRenamed("node", side), side, "left").select(
        "a", "b", F.coalesce("root", side).alias(f"root_{side}"))
    ends = at("a").join(at("b"), ["a", "b"])
    over = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    over = over.select(F.col("node").alias("root"), F.col("root").alias("_over"))
    moved = roots.join(over, "root", "left").select("node", F.coalesce("_over", "root").alias("root"))
    new = over.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(
        F.col("root").alias("node"), F.col("_over").alias("root"))
    return moved.unionByName(new)


def _close(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _head_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Each node with at most ``BEST`` heads of its lists, those it meets most often.

    First the heads are the nodes with most rows in the lists: in a group of near
    copies those nearest to what it was copied from. Later they are drawn. A number
    of pairs linear in the nodes; which of them, changes no result.
    """
    rank = ([F.desc("rows")] if turn == 0 else []) + [F.xxhash64("node", F.lit(turn)), F.col("node")]
    heads = lists.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy(*rank))).where(
        F.col("place") <= HEADS).select(
        "h", F.col("node").alias("m"), F.col("n").alias("n_m"), F.col("root").alias("root_m"))
    met = lists.join(heads, "h").where("root <> root_m").where(
        _close(F.col("n"), F.col("n_m"))).groupBy("node", "m", "n", "n_m").count()
    # Heads differ from list to list, so only a share of the meetings is seen.
    seen = met.where(2 * F.col("count") >= shared_prefix(F.col("n"), F.col("n_m")))
    best = Window.partitionBy("node").orderBy(F.desc("count"), "m")
    return seen.withColumn("place", F.row_number().over(best)).where(F.col("place") <= BEST).select(
        F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with their nodes' components, without rows that can link nothing more.

    ``rows`` counts a node's rows. Two nodes that link meet ``shared_prefix`` times,
    so a row stays only beside a size for which both it and some node of that size
    in its list have as many (``least``: the fewest of such a size); and a list only
    if it still has two components. ``length`` is that of the list.
    """
    known = lists.select("h", "node", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    count = lists.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    placed = staged(known.join(count, "node").select("h", "node", "n", "rows", "root"))
    sizes = staged(placed.groupBy("h", "n").agg(
        F.max("rows").alias("most"), F.min("root").alias("x"), F.max("root").alias("y")))
    other = sizes.select("h", F.col("n").alias("m"), F.col("most").alias("most_m"),
                         F.col("x").alias("x_m"), F.col("y").alias("y_m"))
    least = F.when(_close(F.col("n"), F.col("m")), shared_prefix(F.col("n"), F.col("m")))
    wanted = sizes.join(other, "h").where(F.least("x", "x_m") < F.greatest("y", "y_m")).where(
        F.least("most", "most_m") >= least).groupBy("h", "n").agg(F.min(least).alias("least"))
    able = staged(placed.join(wanted, ["h", "n"]).where("rows >= least"))
    mixed = able.groupBy("h").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("length"),
    ).where("x <> y").select("h", "length")
    return staged(able.join(mixed, "h"))


def _crossing(lists: DataFrame) -> int:
    """Pairs of a list that are in different components, over all lists."""
    held = lists.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(
        F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return held.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("x")).first()["x"] or 0


def _first_meetings(lists: DataFrame) -> DataFrame:
    """``(node, m)`` once per list in which two nodes of different components may
    meet for the first time, in one order of all lists that puts short ones first.

    Linked nodes meet ``shared_prefix`` times, so both have as many rows from their
    first meeting on. A node's last rows, after which too few follow for a partner
    of any size, are not joined; most of them are those of the longest lists.
    """
    own = Window.partitionBy("node")
    left = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("length", "h")) + 1
    kept = staged(lists.select(
        "h", "node", "n", "root", left.alias("left"), F.min("least").over(own).alias("least"),
    ).where(F.col("left") >= F.col("least")).drop("least"))
    other = kept.select("h", F.col("root").alias("root_b")).distinct()
    return kept.join(other, "h").where("root < root_b").join(kept.select(
        "h", F.col("root").alias("root_b"), F.col("node").alias("m"), F.col("n").alias("n_m"),
        F.col("left").alias("left_m"),
    ), ["h", "root_b"]).where(_close(F.col("n"), F.col("n_m"))).where(
        F.least("left", "left_m") >= shared_prefix(F.col("n"), F.col("n_m"))).select("node", "m")


def _cross_pairs(lists: DataFrame) -> DataFrame:
    """All pairs across components that can meet in as many lists as linked ones must."""
    return _first_meetings(lists).select(
        F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, doc_id, n_shingles, component_id, first_key)``, one row per document.

    ``key`` is ``row_digest``; ``first_key`` that of the document whose id is
    ``component_id`` (of several such rows, the smallest digest). Texts without
    words, null among them, have no shingles and link with nothing. Rows of one
    id are judged by their own texts. A null id links, but a component has the
    smallest id that is not null, or null. An empty table gives an empty one.
    """
    id_key = F.col(doc_id).cast("string")
    frequent = frequent_shingles(docs, text, id_key)
    seed = 0
    while True:
        signed = prefixes(docs, doc_id, text, frequent, seed)
        by_set = signed.groupBy("node", "check", "n").agg(F.first("prefix").alias("prefix"))
        rows = staged(signed.drop("prefix"))
        nodes = staged(rows.where("n > 0").groupBy("node", "check", "n").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"),
        ).select("node", "n", "first.doc_id", "first.key"))
        sizes = nodes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("m")).first()
        if sizes["n"] == sizes["m"]:
            break
        seed += 1  # two sets of one signature: sign all anew

    along = Window.partitionBy("h").orderBy("node")
    lists = staged(by_set.select(F.explode("prefix").alias("h"), "node", "n").withColumn(
        "other", F.coalesce(F.lag("node").over(along), F.lead("node").over(along))
    ).where("other is not null").select("h", "node", "n", F.col("node").alias("root")))
    roots = lists.select("node", "root").limit(0)
    lists = _with_roots(lists, roots)
    bound, crossing, turn = LINEAR * lists.count(), _crossing(lists), 0
    while crossing:  # large groups: some heads of each list against its nodes
        links = linked(_head_pairs(lists, turn), nodes, docs, doc_id, text)
        turn += 1
        if links.isEmpty():
            break
        roots = staged(joined_components(roots, links))
        lists = _with_roots(lists, roots)
        before, crossing = crossing, _crossing(lists)
        if crossing <= bound or crossing > FEWER * before:
            break
    more = linked(_cross_pairs(lists), nodes, docs, doc_id, text)  # all that is left
    if not more.isEmpty():
        roots = staged(joined_components(roots, more))

    grouped = nodes.select("node", "doc_id", "key").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min(
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    final = staged(grouped.select("node", "root").join(named, "root").select(
        "node", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key")))
    alone = F.col("n") == 0
    return rows.drop("check").join(final, "node", "left").select(
        "key", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("key")).otherwise(F.col("first_key")).alias("first_key"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component; of equal rows one stays."""
    rows, at = numbered(docs)
    stay = near_duplicates(rows, at[doc_id], at[text]).where("key = first_key").select(
        F.col("key").alias("_key")).distinct()
    return rows.withColumn("_key", row_digest(at[doc_id], at[text])).join(
        staged(stay), "_key").dropDuplicates(["_key"]).select(*at.values()).toDF(*docs.columns)
