"""Byte-level BPE by merge replay over a corpus.

The corpus of a replay is a worker's block of texts; a worker remembers the pieces of earlier blocks, within bounds.  No
shuffle makes pieces distinct across workers: a frequent piece is replayed once for a worker, not once for the corpus.

The distinct pieces of many texts are laid end to end as one sequence of byte tokens.  An inverted index leads from the
rank of a token pair to the positions where it stands; a heap hands out the ranks that occur, lowest first, and each is
merged at all of its positions at once, touching only the two neighbours.  Every piece thus sees its own merges in rank
order, which is what encoding it alone would do, while a merge costs once for the corpus and not once for each piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = 1 << 30  # the rank of a pair that doesn't merge
#: Characters of text whose new pieces are replayed together, and encoded pieces that a worker keeps and their bytes: all bound memory.
REPLAY_CHARS, KEPT_PIECES, KEPT_BYTES = 8_000_000, 600_000, 32_000_000
#: Longer pieces have merges of their own: in a replay, merges that wait for one another within a piece are passed over again and again.
LONG_PIECE = 1_000


class Replay:
    """A byte-level vocabulary given as ranks, and its merge table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        joined = [(ranks[t[:k]] * self.size + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        joined.sort()
        self.pairs = np.array([k for k, _ in joined], dtype=np.int64)
        self.into = np.array([i for _, i in joined], dtype=np.int64)
        self.merges: dict[int, int] = {}
        # Tokens after whose creation a pair with a lower rank can appear: their merges go one at a time within a piece.
        self.returning = {ranks[p] for t, i in ranks.items() for k in range(1, len(t)) for p in (t[:k], t[k:]) if p in ranks and ranks[p] > i}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.into[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The token ids of each piece."""
        if any(len(p) > LONG_PIECE for p in pieces):
            short = iter(self.encode([p for p in pieces if len(p) <= LONG_PIECE]))
            return [next(short) if len(p) <= LONG_PIECE else self.encode_long(p) for p in pieces]
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        token = self.byte_ids[data]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        after = np.arange(1, n + 1)  # n: no position
        before = np.arange(-1, n - 1)
        rank = np.full(n + 1, NONE, dtype=np.int64)  # of the pair that begins here; NONE as well at positions merged away
        same = piece[1:] == piece[:-1]
        rank[: n - 1][same] = self.pair_ranks(token[:-1][same], token[1:][same])
        last = np.zeros(n, dtype=bool)
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter positions into the index by the rank of their pairs."""
            at = at[rank[at] < NONE]
            if not len(at):
                return
            r = rank[at]
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cuts = np.flatnonzero(np.diff(r)) + 1
                parts, firsts = np.split(at, cuts), r[np.concatenate(([0], cuts))].tolist()
            else:
                parts, firsts = [at], r.tolist()
            for part, k in zip(parts, firsts, strict=True):
                if k not in index:
                    heapq.heappush(heap, k)
                index[k].append(part)

        note(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[rank[at] == r]
            if len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                if r in self.returning:
                    first = np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))
                    later, at = at[~first], at[first]
                else:
                    at, later = self._apart(at, after), at[:0]
            else:
                later = at[:0]
            if not len(at):
                continue
            gone = after[at]
            token[at] = r
            alive[gone] = False
            rank[gone] = NONE
            last[at] = last[gone]
            after[at] = after[gone]
            follow = at[~last[at]]
            before[after[follow]] = follow
            rank[at] = NONE
            rank[follow] = self.pair_ranks(token[follow], token[after[follow]])
            lead = at[before[at] >= 0]
            lead = lead[piece[before[lead]] == piece[lead]]
            prior = before[lead]
            rank[prior] = self.pair_ranks(token[prior], token[lead])
            note(np.concatenate((follow, prior)))
            if len(later):
                note(later)
        ends = np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))
        return np.split(token[alive], ends[:-1])

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The token ids of one piece, by a heap of its pairs: n log n steps, whatever the piece."""
        if not self.merges:
            self.merges = dict(zip(self.pairs.tolist(), self.into.tolist(), strict=True))
        first = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        n, size, merges = len(first), self.size, self.merges
        token, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [*self.pair_ranks(first[:-1], first[1:]).tolist(), NONE]  # of the pair that begins here
        heap = [r * n + i for i, r in enumerate(rank) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:
                continue
            gone = after[i]
            token[i], after[i], rank[gone] = r, after[gone], NONE
            ends = [(before[i], i)] if before[i] >= 0 else []
            rank[i] = NONE
            if after[i] < n:
                before[after[i]] = i
                ends.append((i, after[i]))
            for a, b in ends:
                rank[a] = merges.get(token[a] * size + token[b], NONE)
                if rank[a] < NONE:
                    heapq.heappush(heap, rank[a] * n + a)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return np.array(out, dtype=np.int64)

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Positions without those that overlap the one before: from left to right, every other one of a chain."""
        chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
        if not chained.any():
            return at
        starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        return at[(np.arange(len(at)) - starts) % 2 == 0]


@lru_cache(maxsize=4)
def load(path: str) -> Replay:
    with open(path, "rb") as f:
        return Replay({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes texts in blocks, remembering a bounded number of encoded pieces."""

    def __init__(self, replay: Replay, pattern: str):
        self.replay, self.split = replay, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.said: list[str] = []
        self.counts: list[int] = []
        self.decoded: list[bytes] = []
        self.held = 0

    def encode_block(self, texts: list[str]) -> list[list[int]]:
        """For each text the places of its pieces, after encoding those that are new."""
        if len(self.place) > KEPT_PIECES or self.held > KEPT_BYTES:
            self.forget()
        place, known = self.place, len(self.place)
        found = []
        for text in texts:
            pieces = self.split(text)
            for p in pieces:
                if p not in place:
                    place[p] = len(place)
            found.append(np.fromiter(map(place.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
        new = list(place)[known:]
        bytes_of = self.replay.bytes_of
        for ids in self.replay.encode([p.encode("utf-8", "replace") for p in new]):
            ids = ids.tolist()
            self.ids.append(ids)
            self.counts.append(len(ids))
            self.said.append(" ".join(map(str, ids)))
            self.decoded.append(b"".join(map(bytes_of.__getitem__, ids)))
            self.held += len(self.decoded[-1])
        return found

    def tokens(self, places) -> list[int]:
        return [i for p in places for i in self.ids[p]]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns a row for each row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of
    the decoded bytes); with with_ids also ids (array<int>), with with_decoded also decoded (string).  Null and empty texts have no tokens.
    No string is special; very long words are encoded like any, in n log n steps.  Columns other than the two named are ignored; repeated rows give repeated rows.

    ranks_path is read by the driver; its content (under 1 MB for 50,000 tokens) goes to the executors with the plan.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary's size, whatever the corpus'
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = rows.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if with_decoded:
        schema = schema.add("decoded", "string")

    def run(batches):
        encoder = Encoder(_cached(content.value), pattern)
        for batch in batches:
            for part in _blocks(batch):
                yield _encode_batch(encoder, part, with_ids, with_decoded)

    return rows.mapInArrow(run, schema)


_REPLAYS: dict[str, Replay] = {}


def _cached(content: bytes) -> Replay:
    """One merge table for each vocabulary and Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _REPLAYS:
        _REPLAYS.clear()
        _REPLAYS[key] = Replay({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())})
    return _REPLAYS[key]


def _blocks(batch: pa.RecordBatch):
    """Slices of a batch with about REPLAY_CHARS bytes of text, a row at least."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    block = np.cumsum(sizes) // REPLAY_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _encode_batch(encoder: Encoder, batch: pa.RecordBatch, with_ids: bool = False, with_decoded: bool = False) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    found = encoder.encode_block(texts)
    counts, said, decoded = np.array(encoder.counts, dtype=np.int64), encoder.said, encoder.decoded
    n, ids_sha, decoded_sha, ids, back = [], [], [], [], []
    for places in found:
        n.append(int(counts[places].sum()) if len(places) else 0)
        places = places.tolist()
        ids_sha.append(hashlib.sha256(" ".join(map(said.__getitem__, places)).encode()).hexdigest())
        raw = b"".join(map(decoded.__getitem__, places))
        decoded_sha.append(hashlib.sha256(raw).hexdigest())
        if with_ids:
            ids.append(encoder.tokens(places))
        if with_decoded:
            back.append(raw.decode("utf-8", "replace"))
    columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        columns.append(pa.array(ids, pa.list_(pa.int32())))
        names.append("ids")
    if with_decoded:
        columns.append(pa.array(back, pa.string()))
        names.append("decoded")
    return pa.RecordBatch.from_arrays(columns, names)
