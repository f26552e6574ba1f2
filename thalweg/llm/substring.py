"""Removal of repeated word passages, anchored on fixed blocks.

A window is `window` consecutive words of a document; any window holds a whole block of half as many words that begins
at a multiple of the block's length.  (1) These non-overlapping reference blocks are indexed by hash, every rolling
block probes the index, and blocks that stand at two places or more are hits.  (2) Windows around hits are extended to
exact repeats: a 128-bit digest of all of their words is compared, and the earliest place of each window survives.
(3) Words covered by a surviving window's later repeats go.

Hashes are dealt to parts of a bounded number of words.  A map task deals a slice of text to FAN parts at most; where
there are more, tasks that take the parts' rows merge and deal them again, each part to FAN finer ones, until the parts
are as small as they should be.  So a slice costs the same however many parts there are, and rows stay long.

What moves between machines is packed by map tasks into sorted byte planes, a few bytes for a block, and each task sends
a block or window once, however often it stands in its documents; so a passage that fills a third of the corpus brings
as many entries to a reducer as there are map blocks.  Exact copies of whole documents are recognised first, and only
the earliest one takes part in (2).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions

WINDOW = 20
#: Bits of a block's hash that are compared: a hit only makes windows candidates, so a chance collision costs, but changes nothing.
HASH_BITS = 52
#: Bytes of text that a worker takes at a time, words of the corpus for each packed part, words that a worker keeps hashes of.
SLICE_BYTES, PART_WORDS, CACHE = 4_000_000, 2_000_000, 250_000
#: Parts that a slice or a part is dealt to at most, and packed hashes that are dealt again together.
FAN, DEAL_HASHES = 512, 4_000_000
ALL = -1  # as a start: the whole document is a copy

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def _rolling(words: np.ndarray, k: int, factor: np.uint64) -> np.ndarray:
    """The hash of the k words from each position on, for all positions where k words are left."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * factor + words[i : i + n]
    return out


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, so that planes of zeros all but vanish in a compressed shuffle."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(data, dtype=np.uint8, offset=1)
    out = np.zeros((len(planes) // width, 8), dtype=np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view(np.uint64).ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _signed(ids: np.ndarray) -> np.ndarray:
    """Ids of either sign as unsigned numbers that stay small where the ids are, and back by _ids."""
    return ((ids << 1) ^ (ids >> 63)).view(np.uint64)


def _ids(zigzag: np.ndarray) -> np.ndarray:
    return ((zigzag >> np.uint64(1)) ^ (np.uint64(0) - (zigzag & np.uint64(1)))).view(np.int64)


def _part(hashes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Which of the parts a hash belongs to; rises with the hash."""
    return ((hashes >> np.uint64(bits - 31)) * np.uint64(parts)) >> np.uint64(31)


def _levels(parts: int) -> list[int]:
    """Numbers of parts, each a multiple of the one before by FAN at most; the last is `parts` or more."""
    out = [min(parts, FAN)]
    while out[-1] < parts:
        out.append(out[-1] * min(FAN, -(-parts // out[-1])))
    return out


def _cuts(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of each part in a sorted array of them, of those that occur only."""
    if not len(parts):
        return []
    edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
    return [(int(parts[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _slices(batches):
    """Batches cut to about SLICE_BYTES of text each, a row at least, with text as binary."""
    for batch in batches:
        text = pc.cast(batch.column(1), pa.binary()).fill_null(b"")
        batch = pa.RecordBatch.from_arrays([batch.column(0), text, *batch.columns[2:]], names=batch.schema.names)
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _word_hashes(texts, cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes end to end, and the number of words of each text."""
    arrays = [np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)) for words in map(bytes.split, texts)]
    return (np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)), np.array([len(a) for a in arrays], dtype=np.int64)


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of texts laid end to end: its text, its place there, and the words left from it on."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - starts[text]
    return text, at, sizes[text] - at


def _first_and_later(first: np.ndarray, second: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows: the first of each digest, and those at other places than it."""
    if not len(first):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    lead = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    of = np.maximum.accumulate(np.where(lead, np.arange(len(first)), 0))
    return lead, (doc != doc[of]) | (place != place[of])


def _documents(batches):
    """(doc_id, n_words, digest of the word sequence)"""
    for part in _slices(batches):
        words = [t.split() for t in part.column(1).to_pylist()]
        digests = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_words", "digest"])


def _index_blocks(batches, block: int, parts: int):
    """For each slice and part: the hashes of rolling blocks, which of them stand more than once, and the reference blocks."""
    cache = _Hashes()
    for piece in _slices(batches):
        ids = piece.column(0).to_numpy(zero_copy_only=False)
        words, sizes = _word_hashes(piece.column(1).to_pylist(), cache)
        text, at, left = _layout(sizes)
        hashes = _mix(_rolling(words, block, _K1)) >> np.uint64(64 - HASH_BITS)
        whole = np.flatnonzero(left[: len(hashes)] >= block)
        if not len(whole):
            continue
        rolling, counts = np.unique(hashes[whole], return_counts=True)
        anchors = whole[at[whole] % block == 0]
        anchors = anchors[np.argsort(hashes[anchors], kind="stable")]
        yield _deal_blocks(rolling, counts > 1, hashes[anchors], _signed(ids[text[anchors]]), at[anchors] // block, parts)


_BLOCKS = ["part", "rolling", "repeated", "refs", "docs", "blocks"]


def _deal_blocks(rolling: np.ndarray, repeated: np.ndarray, refs: np.ndarray, docs: np.ndarray, blocks: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part that occurs; rolling and refs (with docs and blocks) are sorted."""
    rows, none = [], (0, 0, 0)
    of_refs = {p: (p, c, d) for p, c, d in _cuts(_part(refs, HASH_BITS, parts))}
    for p, a, b in _cuts(_part(rolling, HASH_BITS, parts)):
        _, c, d = of_refs.get(p, none)
        rows.append((p, _pack_sorted(rolling[a:b]), np.packbits(repeated[a:b]).tobytes(), _pack_sorted(refs[c:d]), pack(docs[c:d]), pack(blocks[c:d])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 5], strict=True)], names=_BLOCKS)


def _gather_blocks(columns: dict[str, list]) -> tuple[np.ndarray, ...]:
    """Rolling hashes, which of them stand more than once in their row, reference hashes, docs and blocks of packed rows."""
    rolling = [_unpack_sorted(x) for x in columns["rolling"]]
    repeated = np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(r)) for m, r in zip(columns["repeated"], rolling, strict=True)])
    return np.concatenate(rolling), repeated, np.concatenate([_unpack_sorted(x) for x in columns["refs"]]), *(np.concatenate([unpack(x) for x in columns[n]]) for n in ("docs", "blocks"))


def _match_blocks(table: pa.Table) -> pa.Table:
    """Reference blocks of a part that stand at two places or more: (doc_id, block)."""
    hashes, repeated, refs, docs, blocks = _gather_blocks({n: table.column(n).to_pylist() for n in _BLOCKS})
    order = np.argsort(hashes)
    hashes, total = hashes[order], np.concatenate(([0], np.cumsum(1 + repeated[order].astype(np.int64))))
    found = total[np.searchsorted(hashes, refs, side="right")] - total[np.searchsorted(hashes, refs, side="left")] > 1
    docs, blocks = docs[found], blocks[found]
    return pa.table({"doc_id": pa.array(_ids(docs), pa.int64()), "block": pa.array(blocks.astype(np.int32), pa.int32())})


def _candidate_windows(batches, window: int, block: int, parts: int):
    """Windows whose first reference block is a hit, each once for a slice, by part; those known to repeat come as (docs, starts) alone."""
    cache = _Hashes()
    for piece in _slices(batches):
        ids = piece.column(0).to_numpy(zero_copy_only=False)
        words, sizes = _word_hashes(piece.column(1).to_pylist(), cache)
        text, at, left = _layout(sizes)
        offset = np.cumsum((sizes + block - 1) // block + 1) - ((sizes + block - 1) // block + 1)
        hit = np.zeros(int(((sizes + block - 1) // block + 1).sum()) + 2, dtype=bool)
        for i, blocks in enumerate(piece.column(2).to_pylist()):
            own = np.array(blocks, dtype=np.int64)
            own = own[own <= (sizes[i] - 1) // block]
            hit[offset[i] + own] = True
        start = np.flatnonzero((left >= window) & hit[offset[text] + (at + block - 1) // block])
        if not len(start):
            continue
        first, second = _rolling(words, window, _K1)[start], _rolling(_mix(words ^ _K3), window, _K2)[start]
        first, second = _mix(first), _mix(second)
        doc, place = ids[text[start]], at[start]
        order = np.lexsort((place, doc, second, first))
        first, second, doc, place = first[order], second[order], doc[order], place[order]
        lead, again = _first_and_later(first, second, doc, place)
        rows = []
        if again.any():
            rows += _deal_later(doc[again], place[again], parts)
        rows += _deal_windows(first[lead], second[lead], doc[lead], place[lead], parts)
        yield _window_rows(rows)


def _deal_windows(first: np.ndarray, second: np.ndarray, doc: np.ndarray, place: np.ndarray, parts: int) -> list[tuple]:
    """A row for each part that occurs; windows are sorted by digest."""
    return [(p, _pack_sorted(first[a:b]), pack(second[a:b]), pack(_signed(doc[a:b])), pack(place[a:b])) for p, a, b in _cuts(_part(first, 64, parts))]


def _deal_later(doc: np.ndarray, place: np.ndarray, parts: int) -> list[tuple]:
    """Windows known to repeat, a row for each part of their documents' hashes that occurs."""
    of = _part(_mix(doc.view(np.uint64)), 64, parts)
    order = np.lexsort((place, doc, of))
    doc, place = doc[order], place[order]
    return [(p, None, None, pack(_signed(doc[a:b])), pack(place[a:b])) for p, a, b in _cuts(of[order])]


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["part", "first", "second", "docs", "starts"])


def _gather_windows(columns: dict[str, list]) -> tuple[np.ndarray, ...]:
    """Digests, docs and places of the packed rows that have digests, sorted by them, and docs and places of the others."""
    own = [x is not None for x in columns["first"]]
    take = lambda n, keep, read=unpack: np.concatenate([read(x) for x, k in zip(columns[n], own, strict=True) if k == keep] or [np.zeros(0, dtype=np.uint64)])
    first, second, doc, place = take("first", True, _unpack_sorted), take("second", True), _ids(take("docs", True)), take("starts", True)
    order = np.lexsort((place, doc, second, first))
    return first[order], second[order], doc[order], place[order], _ids(take("docs", False)), take("starts", False)


def _dealt_again(batches, deal):
    """Rows sorted by part, those of a part merged as long as they are few enough, and dealt to finer parts by deal(columns)."""
    held, size, part = {}, 0, None
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for k, p in enumerate(columns["part"]):
            if held and (p != part or size >= DEAL_HASHES):
                yield deal(held)
                held, size = {}, 0
            part = p
            for n, values in columns.items():
                held.setdefault(n, []).append(values[k])
            size += sum(len(v[k] or b"") for n, v in columns.items() if n not in ("part", "salt")) // 8
    if held:
        yield deal(held)


def _deal_blocks_again(columns: dict[str, list], parts: int) -> pa.RecordBatch:
    hashes, repeated, refs, docs, blocks = _gather_blocks(columns)
    order = np.argsort(hashes)
    hashes, often = hashes[order], 1 + repeated[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    own = np.argsort(refs, kind="stable")
    return _deal_blocks(hashes[starts], np.add.reduceat(often, starts) > 1, refs[own], docs[own], blocks[own], parts)


def _deal_windows_again(columns: dict[str, list], parts: int) -> pa.RecordBatch:
    first, second, doc, place, later_doc, later_place = _gather_windows(columns)
    lead, again = _first_and_later(first, second, doc, place)
    rows = _deal_windows(first[lead], second[lead], doc[lead], place[lead], parts)
    return _window_rows(rows + _deal_later(np.concatenate((doc[again], later_doc)), np.concatenate((place[again], later_place)), parts))


def _deal_later_again(columns: dict[str, list], parts: int) -> pa.RecordBatch:
    doc, place = (np.concatenate([unpack(x) for x in columns[n]]) for n in ("docs", "starts"))
    rows = _deal_later(_ids(doc), place, parts)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (3, pa.binary()), (4, pa.binary()))], names=["part", "docs", "starts"])


def _to_parts(packed: DataFrame, levels: list[int], deal) -> DataFrame:
    """Packed rows of the first level's parts, dealt again to those of the last; the rows of a part are spread over tasks by a salt."""
    n, schema = partitions(packed.sparkSession), packed.schema
    for coarse, fine in zip(levels[:-1], levels[1:], strict=True):
        salted = packed.withColumn("salt", F.pmod(F.xxhash64(*packed.columns[1:]), F.lit(max(1, n // coarse))))
        dealt = salted.repartition(n, "part", "salt").sortWithinPartitions("part")
        packed = dealt.mapInArrow(lambda b, fine=fine: _dealt_again(b, lambda c: deal(c, fine)), schema)
    return packed


def _later_windows(table: pa.Table, parts: int) -> pa.Table:
    """Windows that stand earlier as well, packed by a hash of their documents: (part, docs, starts)."""
    first, second, doc, place, later_doc, later_place = _gather_windows({n: table.column(n).to_pylist() for n in table.column_names})
    again = _first_and_later(first, second, doc, place)[1]
    rows = _deal_later(np.concatenate((doc[again], later_doc)), np.concatenate((place[again], later_place)), parts)
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, n, t in ((0, "part", pa.int64()), (3, "docs", pa.binary()), (4, "starts", pa.binary()))})


def _of_documents(table: pa.Table) -> pa.Table:
    """(doc_id, starts): all later windows of each document of a part."""
    doc, place = (np.concatenate([unpack(x) for x in table.column(n).to_pylist()]) for n in ("docs", "starts"))
    doc = _ids(doc)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order].astype(np.int32)
    cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    starts = pa.ListArray.from_arrays(pa.array(np.concatenate((cuts, [len(doc)])), pa.int32()), pa.array(place, pa.int32()))
    return pa.table({"doc_id": pa.array(doc[cuts], pa.int64()), "starts": starts.cast(pa.list_(pa.int32()))})


def _remove(batches, window: int, with_text: bool):
    for piece in _slices(batches):
        n_words, n_removed, digests, kept_texts = [], [], [], []
        starts = piece.column(2).to_pylist()
        for text, begin in zip(piece.column(1).to_pylist(), starts, strict=True):
            words = text.split()
            n, gone = len(words), 0
            if begin and ALL in begin:
                gone, words = n, []
            elif begin:
                edge = np.zeros(n + 1, dtype=np.int64)
                begin = np.array(begin, dtype=np.int64)
                begin = begin[begin + window <= n]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                covered = np.cumsum(edge)[:n] > 0
                gone, words = int(covered.sum()), [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            kept = b" ".join(words)
            n_words.append(n)
            n_removed.append(gone)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept if with_text else None)
        columns = [piece.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove each word that a window covers whose word sequence also starts earlier.

    Words are [^\\x20\\x09-\\x0D]+, unchanged.  Earlier: in a document with a smaller doc_id, or in the same document
    before.  All windows are judged on the input.  Returns a row for each row: doc_id, n_words, n_removed, kept_sha256
    (kept words joined by one space); with with_text also kept_text.

    Null and empty texts have no words.  A row without doc_id has no order: nothing is removed from it or on account of
    it.  Rows that share a doc_id count as one document, whose windows at equal places are the same window.  Columns
    other than the two named are ignored.  Empty in, empty out.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    known = checkpoint(named.mapInArrow(_documents, "doc_id long, n_words long, digest binary"))
    total = known.agg(F.sum("n_words")).first()[0] or 0
    levels = _levels(max(2 * partitions(spark), int(total // PART_WORDS)))
    coarse, parts = levels[0], levels[-1]

    # Of documents with the same words, only the earliest one takes part from here on.
    long = known.filter(F.col("n_words") >= window)
    earliest = checkpoint(long.groupBy("digest", "n_words").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    copies = long.select("doc_id").distinct().join(earliest, "doc_id", "left_anti")

    packed = named.mapInArrow(lambda b: _index_blocks(b, block, coarse), "part long, rolling binary, repeated binary, refs binary, docs binary, blocks binary")
    hits = _to_parts(packed, levels, _deal_blocks_again).groupBy("part").applyInArrow(_match_blocks, "doc_id long, block int")
    of_doc = hits.join(earliest, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("block").alias("blocks"))  # a document's blocks at most

    # Both joins with the texts deal them out by doc_id in the same way, so the second reuses the first one's exchange.
    windows = named.join(of_doc, "doc_id").select("doc_id", "text", "blocks").mapInArrow(lambda b: _candidate_windows(b, window, block, coarse), "part long, first binary, second binary, docs binary, starts binary")
    # A part's later windows go to at most FAN coarse parts of documents' hashes, and from there to finer ones.
    later = _to_parts(windows, levels, _deal_windows_again).groupBy("part").applyInArrow(lambda t: _later_windows(t, coarse), "part long, docs binary, starts binary")
    later = _to_parts(later, levels, _deal_later_again)
    removed = later.groupBy("part").applyInArrow(_of_documents, "doc_id long, starts array<int>").union(copies.select("doc_id", F.array(F.lit(ALL)).alias("starts")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    judged = named.join(removed, "doc_id", "left").select("doc_id", "text", "starts")
    unnamed = rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    finish = lambda df: df.mapInArrow(lambda b: _remove(b, window, with_text), schema)
    return finish(judged).union(finish(unnamed))
