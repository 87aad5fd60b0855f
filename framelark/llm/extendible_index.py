"""Exact dedup by an extendible-hash index on shared files.

Tasks read the rows once. Equal texts that meet in one task become one entry
(pre-aggregation), so a text that a third of all rows share is written once
per task and buffer, not once per row. The directory is a table of leading hash
bits: starting from one bucket it doubles for as long as a bucket holds more
bytes than ``bucket_bytes``, and only overfull buckets split. A bucket of a
single hash cannot split; it gets overflow pages that are merged in a second
step. Buckets in key order are dealt to owner tasks of about equal bytes. An
owner goes through its entries sorted by hash: texts of one hash form a chain,
and an entry joins the link whose bytes equal its own, so no result rests on a
hash. The buckets stay as files of the shared folder.
"""

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import quoted, staged

WHITE = b" \t\n\x0b\x0c\r"
BUCKET_BYTES = 32 << 20
BUFFER_BYTES = 32 << 20
ENTRY_BYTES = 64
#: Directories end at a million slots, which bounds what is broadcast.
MOST_BITS = 20
SPARE_BITS = 4

ENTRY = "entry long, h long, body binary, n long, best_points long, best_key long, best_row long"


class ExactIndex(NamedTuple):
    """``rows`` (key columns, points, row, entry), ``directory`` (slot, bucket,
    depth, pages, owner), ``buckets`` (entries with their chain's head and totals)."""

    rows: DataFrame
    directory: DataFrame
    buckets: DataFrame


def hash64(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _better(a: tuple, b: tuple) -> bool:
    """More code points, then the smaller key (null last), then the earlier row."""
    (p, k, r), (q, m, s) = a, b
    return (-p, k is None, k or 0, r) < (-q, m is None, m or 0, s)


def _parts(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _entries(
    docs: DataFrame, key: str, text: str, carry: Sequence[str], hashed: Callable[[bytes], int],
    buffer_bytes: int,
) -> DataFrame:
    """One row per row of ``docs``; the first of each text of a buffer carries the entry."""
    carried = docs.select(*carry)
    kinds = [(f"c{i}", f.dataType.simpleString()) for i, f in enumerate(carried.schema)]
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
        *[F.col(c).alias(n) for c, (n, _) in zip(quoted(carried), kinds)],
    )
    names = ["key", "points", "row", *[n for n, _ in kinds]]
    schema = ", ".join(["key long", "points long", "row long", *[f"{n} {k}" for n, k in kinds], ENTRY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        done = 0
        held: list[pa.RecordBatch] = []
        owner: list[int] = []          # entry of each held row
        seen: dict[bytes, int] = {}
        first: list[int] = []          # held row that opens an entry
        count: list[int] = []
        best: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            plain = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            total = len(owner)
            bodies, hashes = [None] * total, [None] * total
            counts, tops = [None] * total, [(None, None, None)] * total
            for body, e in seen.items():
                at = first[e]
                bodies[at], hashes[at] = body, _signed(hashed(body))
                counts[at], tops[at] = count[e], best[e]
            entry = base + done + np.array(first, np.int64)[np.array(owner, np.int64)]
            more = [
                pa.array(entry), pa.array(hashes, pa.int64()), pa.array(bodies, pa.binary()),
                pa.array(counts, pa.int64()),
                *[pa.array([t[i] for t in tops], pa.int64()) for i in range(3)],
            ]
            return pa.RecordBatch.from_arrays(
                [*plain.columns, *more],
                names=[*names, "entry", "h", "body", "n", "best_points", "best_key", "best_row"])

        for batch in (part for whole in batches for part in _parts(whole, buffer_bytes)):
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
            row = base + done + len(owner) + np.arange(len(batch))
            held.append(pa.RecordBatch.from_arrays(
                [batch.column("key"), points, pa.array(row), *batch.columns[2:]], names=names))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for t, one in zip(texts, zip(points.to_pylist(), batch.column("key").to_pylist(), row.tolist())):
                body = (t or b"").translate(None, WHITE)
                e = seen.get(body)
                if e is None:
                    e = seen[body] = len(first)
                    first.append(len(owner))
                    count.append(0)
                    best.append(one)
                    size += len(body) + ENTRY_BYTES
                elif _better(one, best[e]):
                    best[e] = one
                count[e] += 1
                owner.append(e)
            if size >= buffer_bytes:
                yield flush()
                done += len(owner)
                held, owner, seen, first, count, best, size = [], [], {}, [], [], [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def split_directory(weights: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int) -> np.ndarray:
    """Local depth of the bucket that each slot belongs to.

    ``weights`` are bytes by leading hash bits (a power of two slots), ``low``
    and ``high`` the smallest and largest hash in a slot (undefined if empty).
    """
    bits = len(weights).bit_length() - 1
    depth = np.zeros(len(weights), np.int64)
    still = np.ones(1, bool)
    for d in range(bits):
        full = still & (weights.reshape(1 << d, -1).sum(1) > limit)
        # All of one hash: splitting cannot help.
        full &= low.reshape(1 << d, -1).min(1) < high.reshape(1 << d, -1).max(1)
        if not full.any():
            break
        depth[np.repeat(full, len(weights) >> d)] = d + 1
        still = np.repeat(full, 2)
    return depth


def _directory(entries: DataFrame, limit: int) -> tuple[DataFrame, int, int, bool]:
    """The directory's used slots, its bits, the number of owners, whether pages exist."""
    weight = F.octet_length("body") + ENTRY_BYTES
    total = entries.agg(F.sum(weight)).first()[0] or 0
    bits = min(MOST_BITS, max(1, int(total // limit).bit_length() + SPARE_BITS))
    cells = entries.groupBy(_slot(bits).alias("slot")).agg(
        F.sum(weight).alias("weight"), F.min("h").alias("low"), F.max("h").alias("high"),
    ).toPandas()  # one row per slot, 2**MOST_BITS at most
    weights = np.zeros(1 << bits, np.int64)
    low = np.full(1 << bits, np.iinfo(np.int64).max)
    high = np.full(1 << bits, np.iinfo(np.int64).min)
    at = cells["slot"].to_numpy(np.int64)
    weights[at], low[at], high[at] = cells["weight"], cells["low"], cells["high"]
    depth = split_directory(weights, low, high, limit)
    slots = np.arange(1 << bits)
    bucket = np.cumsum(slots % (1 << (bits - depth)) == 0) - 1
    load = np.bincount(bucket, weights).astype(np.int64)
    pages = np.maximum(1, -(-load // limit))
    owner = (np.cumsum(load) - load) // limit
    used = slots[at]
    rows = list(zip(*[
        x.tolist() for x in (used, bucket[used], depth[used], pages[bucket[used]], owner[bucket[used]])
    ]))
    table = entries.sparkSession.createDataFrame(
        rows, "slot long, bucket long, depth long, pages long, owner long")
    owners = int((owner + pages - 1).max()) + 1 if len(rows) else 1
    return table, bits, owners, bool((pages > 1).any())


def _slot(bits: int):
    return F.shiftrightunsigned("h", 64 - bits)


MERGED = (
    "entry long, head long, bucket long, page long, h long, link int, body binary, n long, "
    "best_points long, best_key long, best_row long, sha string"
)
_NAMES = [part.split()[0] for part in MERGED.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_ARROW = pa.schema([(n, _TYPES[k]) for n, k in (part.split() for part in MERGED.split(", "))])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the runs of one (bucket, page, hash); input sorted by these."""
    out: list[tuple] = []
    size = 0
    run, chain, members = None, [], []

    def close():
        for entry, at in members:
            link = chain[at]
            head = link["head"]
            out.append((
                entry, head, *run[:2], run[2], at, link["body"] if entry == head else None,
                link["n"], *link["best"], link["sha"],
            ))

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (
            "bucket", "page", "h", "entry", "body", "n", "best_points", "best_key", "best_row")]
        for bucket, page, h, entry, body, n, *best in zip(*columns):
            if run != (bucket, page, h):
                close()
                run, chain, members = (bucket, page, h), [], []
                if size >= BUFFER_BYTES // 4:
                    yield emit()
                    out, size = [], 0
            for at, link in enumerate(chain):
                if link["body"] == body:
                    link["n"] += n
                    if _better(tuple(best), link["best"]):
                        link["best"] = tuple(best)
                    break
            else:
                at = len(chain)
                chain.append({"body": body, "head": entry, "n": n, "best": tuple(best),
                              "sha": hashlib.sha256(body).hexdigest()})
                size += len(body)
            members.append((entry, at))
            size += ENTRY_BYTES
    close()
    if out:
        yield emit()


def _owned(dealt: DataFrame, owners: int) -> DataFrame:
    """Entries at their owner tasks, in key order, merged."""
    return dealt.repartitionById(owners, F.col("owner").cast("int")).sortWithinPartitions(
        "bucket", "page", "h", "entry"
    ).select(
        "bucket", "page", "h", "entry", "body", "n", "best_points", "best_key", "best_row"
    ).mapInArrow(_merge, MERGED)


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
    bucket_bytes: int = BUCKET_BYTES, buffer_bytes: int = BUFFER_BYTES,
    hashed: Callable[[bytes], int] = hash64,
) -> ExactIndex:
    """The index over all rows of ``docs``, as files below the shared folder."""
    rows = staged(_entries(docs, key, text, carry, hashed, buffer_bytes))
    entries = rows.where("body is not null").select(
        "entry", "h", "body", "n", "best_points", "best_key", "best_row")
    slots, bits, owners, paged = _directory(entries, bucket_bytes)
    place = entries.withColumn("slot", _slot(bits)).join(F.broadcast(slots), "slot")
    page = F.pmod("entry", "pages")
    merged = staged(_owned(
        place.withColumn("page", page).withColumn("owner", F.col("owner") + F.col("page")), owners))
    if paged:  # the pages of a bucket each have their own heads: merge those
        homes = F.broadcast(slots.where("pages > 1").select("bucket", "owner").distinct())
        heads = merged.where("body is not null").join(homes, "bucket").withColumn(
            "page", F.lit(0).cast("long"))
        over = staged(_owned(heads, owners)).select(
            F.col("entry").alias("head"),
            *[F.col(c).alias(f"_{c}") for c in ("n", "best_points", "best_key", "best_row")],
            F.col("head").alias("_head"),
        )
        totals = ["n", "best_points", "best_key", "best_row"]
        found = F.col("_head").isNotNull()
        merged = merged.join(over, "head", "left").select(
            "entry", F.coalesce("_head", "head").alias("head"), "bucket", "page", "h", "link",
            F.when(F.coalesce("_head", "head") == F.col("entry"), F.col("body")).alias("body"),
            *[F.when(found, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in totals], "sha",
        )
    return ExactIndex(rows, slots, merged)


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
    bucket_bytes: int = BUCKET_BYTES, buffer_bytes: int = BUFFER_BYTES,
    hashed: Callable[[bytes], int] = hash64,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and the ``carry`` columns that are not named like these.

    Texts are equal if their bytes are after ASCII white space is deleted. Of
    equal texts the row of the most code points stays, then of the smallest
    integer key. A null text is empty and equals every empty or blank one; a
    null key comes after all others, and ``keep_id`` is null if only such rows
    are in the group. Of rows equal in all of this one stays. Texts of any
    length are compared whole; an empty table gives an empty one. Columns of
    ``docs`` are read by name, so others may have any name.
    """
    fixed = {key.lower(), "keep_id", "group_size", "kept", "text_sha256"}
    carry = [c for c in carry if c.lower() not in fixed]
    quote = ["`" + c.replace("`", "``") + "`" for c in carry]
    name = "`" + key.replace("`", "``") + "`"
    body = "`" + text.replace("`", "``") + "`"
    index = build_index(docs, name, body, quote, bucket_bytes, buffer_bytes, hashed)
    found = index.buckets.select("entry", "n", "best_key", "best_row", "sha")
    carried = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return index.rows.select(
        "key", "row", "entry", *[f"c{i}" for i in range(len(carry))]
    ).join(found, "entry").select(
        F.col("key").alias(key), F.col("best_key").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"),
        F.col("sha").alias("text_sha256"), *carried,
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    renamed = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])
    at = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    rows = exact_duplicates(
        renamed.withColumn("_key", F.col(at[key])), "_key", at[text], carry=renamed.columns)
    return rows.where("kept").select(
        *[F.col(at[c]).alias(c) for c in docs.columns])
