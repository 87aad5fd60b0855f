"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole: its fields joined by a separator. The
byte lengths of its tokens, summed up, map every token to a byte span of the
document (byte-level vocabularies cut between bytes, so bytes rather than
characters make the map exact). The sections of a document, its fields and the
lines of its text, are spans as well; both lists are sorted, so joining them is
a binary search. A token across a border is allocated by a stated rule.
"""

import base64
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelark.llm.common import quoted, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the published vocabulary cuts text before pairs are merged (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "most", "share")
#: White space as the pattern sees it; long runs are cut out by hand, as the
#: pattern's look-ahead backtracks over them.
LONG_GAP = re.compile(
    r"[\t-\r \x85\xa0  -     　]{4096,}"
)
SCHEMA = (
    "field string, section long, start_byte long, end_byte long, n_tokens double,"
    " n_crossing long, doc_tokens long"
)
_encoders: dict[int, tuple] = {}


def encoder(ranks: bytes):
    """``(encode, byte length of each token)``, one per worker and vocabulary."""
    found = _encoders.get(hash(ranks))
    if found is None:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        own = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}
        )
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        found = _encoders[hash(ranks)] = (own, lengths)
    return found


def encode(own, text: str) -> np.ndarray:
    """Tokens of a whole text, however long its runs of white space."""
    parts, at = [], 0
    for gap in LONG_GAP.finditer(text):
        # The last blank before a word belongs to what follows.
        stop = gap.end() - (gap.end() < len(text))
        parts.append(own.encode_ordinary(text[at:gap.start()]))
        parts.append(own._encode_single_piece(text[gap.start():stop]))
        at = stop
    parts.append(own.encode_ordinary(text[at:]))
    return np.array([t for p in parts for t in p] if len(parts) > 1 else parts[0], np.int64)


def attribute(
    token_ends: np.ndarray, section_starts: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, crossing tokens)`` allocated to each section.

    Tokens and sections tile the same bytes from 0; empty sections are allowed.
    ``start``: a token counts where its first byte lies. ``most``: where most of
    its bytes lie, the earlier section if equal. ``share``: by bytes in each.
    """
    counts = np.zeros(len(section_starts))
    crossing = np.zeros(len(section_starts), np.int64)
    if len(token_ends) == 0:
        return counts, crossing
    token_starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_starts, token_starts, "right") - 1
    last = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    inner = first == last
    counts += np.bincount(first[inner], minlength=len(counts))
    borders = np.append(section_starts[1:], token_ends[-1])
    for t in np.flatnonzero(~inner):
        sections = np.arange(first[t], last[t] + 1)
        held = np.minimum(borders[sections], token_ends[t]) - np.maximum(
            section_starts[sections], token_starts[t])
        if rule == "share":
            counts[sections] += held / held.sum()
            crossing[sections[held > 0]] += 1
        else:
            owner = sections[0 if rule == "start" else int(np.argmax(held))]
            counts[owner] += 1
            crossing[owner] += 1
    return counts, crossing


def token_counts(
    docs: DataFrame, fields: Sequence[str] = ("lang", "source", "text"),
    keep: Sequence[str] = ("doc_id",), rule: str = "most", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per document and section: ``keep`` columns, ``field``, ``section``
    (line of the last field, else 0), its byte span in the joined document,
    ``n_tokens`` allocated by ``rule``, ``n_crossing`` of them across a border and
    ``doc_tokens`` of the whole.

    Fields are joined by a line feed, which ends the section before it; the last
    field is cut into lines. A null field is empty. A document of no bytes has
    sections of no tokens. The counts of a document sum to its tokens.
    ``keep`` columns named like an output column are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # a fixed file
    names = [n.split()[0] for n in SCHEMA.split(",")]
    kept = without(docs.select(*keep), *names)
    n_keep = len(kept.columns)
    rows = docs.select(*quoted(kept), *[docs[f].cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    kinds = [(f.name, f.dataType.simpleString()) for f in kept.schema]
    schema = ", ".join([f"`{n}` {k}" for n, k in kinds] + [SCHEMA])

    def count(batches):
        own, lengths = encoder(ranks.value)
        for batch in batches:
            columns = [batch.column(n_keep + i) for i in range(len(fields))]
            for at in range(0, batch.num_rows, 256):
                texts = [c.slice(at, 256).to_pylist() for c in columns]
                owner, out = [], [[] for _ in names]
                for d, values in enumerate(zip(*texts)):
                    lines = [(f, 0, v or "") for f, v in zip(fields[:-1], values)]
                    lines += [(fields[-1], i, x)
                              for i, x in enumerate((values[-1] or "").split("\n"))]
                    sizes = np.array([len(x[2].encode()) + 1 for x in lines])
                    sizes[-1] -= 1
                    ends = np.cumsum(sizes)
                    tokens = encode(own, "\n".join(x[2] for x in lines))
                    n, across = attribute(np.cumsum(lengths[tokens]), ends - sizes, rule)
                    owner += [at + d] * len(lines)
                    for to, more in zip(out, (
                        [x[0] for x in lines], [x[1] for x in lines], (ends - sizes).tolist(),
                        ends.tolist(), n.tolist(), across.tolist(), [len(tokens)] * len(lines),
                    )):
                        to.extend(more)
                keys = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays(
                    keys + [pa.array(v, t) for v, t in zip(out, (
                        pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(),
                        pa.int64(), pa.int64()))],
                    names=[n for n, _ in kinds] + names)

    return rows.mapInArrow(count, schema)
