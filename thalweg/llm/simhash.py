"""SimHash near-duplicates, found through deletion variants of a few segments.

A fingerprint is cut into so few segments that of two fingerprints within the distance one segment differs by a bit at
most.  Each segment is indexed as it is and with each of its bits deleted; an equality join on these variants finds
the candidates, which are verified by their full distance.  Only distinct fingerprints are indexed: thousands of
copies count as one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions
from .components import connected_components

BITS = 64
SEED = 42
#: A bucket with more distinct fingerprints than this is not paired off; its members meet in finer buckets instead.
LARGE_BUCKET = 64


def fingerprint(text: str | None, ngram: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word n-grams; see fingerprints()."""
    words = _words(text)
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(ngram, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return _majority(hashes.reshape(-1, 1))[0]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D separate


def _majority(hashes: np.ndarray) -> list[int]:
    """For each column the bits that are set in over half of the rows, as a signed long."""
    ones = np.zeros(hashes.shape[1] * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 16):
        rows = np.ascontiguousarray(hashes[at : at + 255 * 16]).view(np.uint8)
        bits = np.unpackbits(rows.reshape(-1, hashes.shape[1] * 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """(doc_id, fp) for each row: the 64-bit SimHash as a signed long.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; a shingle is ngram words joined by a space, each
    repeat counting again; a shorter text is one shingle; a text without words (null, empty) has fingerprint zero.
    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(x.as_py(), ngram) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, fp: str = "fp", distance: int = 2, large: int = LARGE_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints, with the same components as all pairs within the distance (1 to 3).

    Buckets of up to `large` fingerprints give every verified pair.  In a larger bucket fingerprints meet again in
    sub-buckets whose members all agree but for the wildcards; each member is linked there to the smallest one.  A
    sub-bucket holds at most 2 ** wildcards fingerprints, so the rows grow with a bucket's size, never with its square.
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    slots = 2  # of two segments one differs by a bit at most
    width = BITS // slots
    fps = distinct.select(F.col(fp).alias("fp"))
    segment = [F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1)) for s in range(slots)]
    # slot s * 100 + 99: the segment itself; s * 100 + i: the segment without its bit i, and that bit.
    variants = []
    for s in range(slots):
        variants.append(F.struct(F.lit(s * 100 + 99).alias("slot"), segment[s].alias("value"), F.lit(0).alias("bit")))
        for i in range(width):
            cleared = segment[s].bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))
            variants.append(F.struct(F.lit(s * 100 + i).alias("slot"), cleared.alias("value"), F.shiftrightunsigned("fp", s * width + i).bitwiseAND(F.lit(1)).cast("int").alias("bit")))
    index = fps.select("fp", F.inline(F.array(*variants)))
    # A wildcard bucket only pairs fingerprints that differ in its bit; those that don't meet in the plain segment.
    counted = index.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"))
    counted = counted.filter((F.col("n") > 1) & ((F.col("slot") % 100 == 99) | (F.col("ones").between(1, F.col("n") - 1))))
    live = checkpoint(index.join(counted, ["slot", "value"]).select("slot", "value", "bit", "fp", "n"))

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    small = live.filter(F.col("n") <= large)
    left, right = small.select("slot", "value", F.col("bit").alias("x"), F.col("fp").alias("a")), small.select("slot", "value", F.col("bit").alias("y"), F.col("fp").alias("b"))
    plain = (F.col("slot") % 100 == 99) & (F.col("a") < F.col("b"))
    pairs = left.join(right, ["slot", "value"]).filter((plain | ((F.col("x") == 0) & (F.col("y") == 1))) & near).select("a", "b")
    return pairs.union(_refined(live.filter(F.col("n") > large), slots, width, distance)).filter(near).distinct()


def _refined(live: DataFrame, slots: int, width: int, distance: int) -> DataFrame:
    """Links inside large buckets, through the rest of the fingerprint with so many wildcards as the distance leaves."""
    found = None
    for s in range(slots):
        rest = [b for b in range(BITS) if not s * width <= b < (s + 1) * width]
        for plain, left in ((True, distance), (False, distance - 1)):
            here = live.filter((F.col("slot") == s * 100 + 99) if plain else (F.col("slot").between(s * 100, s * 100 + width - 1)))
            masks = _masks(rest, left)
            wild = F.when(F.lit(plain), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot") % 100 + s * width))
            keys = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(F.bitwise_not(m)).bitwiseAND(F.bitwise_not(wild)).alias("key")))
            rows = here.select("slot", "fp", F.inline(keys))
            groups = rows.groupBy("slot", "mask", "key").agg(F.collect_set("fp").alias("members"), F.min("fp").alias("a")).filter(F.size("members") > 1)  # at most 2 ** (left + 1) members
            links = groups.select("a", F.explode("members").alias("b")).filter("a <> b")
            found = links if found is None else found.union(links)
    return found


def _masks(bits: list[int], n: int) -> list[int]:
    """Signed masks with n of the bits set; no bit set for n = 0."""
    out = [0]
    for _ in range(n):
        out = sorted({m | 1 << b for m in out for b in bits if not m >> b & 1})
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, distance: int = 2) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id, group_size (rows with that component_id).

    Documents link when their fingerprints differ in at most `distance` bits; component_id is the smallest doc_id that
    can be reached over links, the document itself included.  Texts without words share fingerprint zero and link like
    any others.  A null doc_id counts in no component's smallest id; where no member has an id, component_id is null.
    Repeated rows give repeated rows.  Columns other than the two named are ignored.  Empty in, empty out.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, ngram))
    return _components(rows, distance)


def drop_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, distance: int = 2) -> DataFrame:
    """One row of each component of simhash_components, the one with the smallest doc_id, with all its columns.

    Rows that share an id share its fate; a row without id stays.
    """
    found = simhash_components(docs, id_col, text_col, ngram, distance)
    return _without(docs, id_col, found.filter(F.col("doc_id") != F.col("component_id")))


def _without(docs: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    ids = dropped.select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(ids, docs[id_col] == ids["_dropped"], "left_anti")


def _spread(small: DataFrame, key: str) -> DataFrame:
    """Rows of a few bytes that are about to become many, over all partitions; their size alone would put them in a few."""
    return small.repartition(partitions(small.sparkSession), key)


def _components(rows: DataFrame, distance: int) -> DataFrame:
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = checkpoint(_spread(distinct, "fp"))
    roots = connected_components(links(distinct, "fp", distance))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    joined = checkpoint(joined)
    of_root = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("group_size"))
    classes = joined.select("fp", "root").join(of_root, "root").select("fp", "component_id", "group_size")
    # A hot fingerprint's rows are split by the adaptive skew join; the other side has one row for each fingerprint.
    return rows.join(classes, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "group_size")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- similarity of 0.8: wide fingerprints

#: Longs of a wide fingerprint; each holds two segments.
LONGS = 12
#: Differing bits of a wide fingerprint that count as a similarity of 0.8 of the sets of five-word shingles; see README.
WIDE_DISTANCE = 86
#: The share of bits in which pairs of a similarity from 0.80 to 0.85 differ, as measured, and the least probability that such a pair meets in a segment.
DIFFERING, MEETING = 0.094, 0.99
#: Segments are so many bits longer than the logarithm of the number of fingerprints: chance meetings stay few at any size.
SPARE_BITS = 4
#: In buckets of up to NEIGHBOURS + 1 members all pairs are compared by a window; of larger ones see near_copies.
NEIGHBOURS = 4
#: Larger buckets are compared in blocks of about so many members, each two blocks in one go.
BLOCK = 2048
#: Distinct words that a worker keeps hashes of.
CACHE = 200_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: What sets the columns of a fingerprint apart.
_OFFSETS = np.arange(LONGS, dtype=np.uint64) * _FACTOR


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def wide_fingerprint(text: str | None, cache: _Hashes) -> list[int]:
    """LONGS signed 64-bit SimHashes of a text's two-word shingles, each of the shingles' hashes mixed anew."""
    words = _words(text)
    if not words:
        return [0] * LONGS
    hashes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) > 1:
        hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * _FACTOR + hashes[1:]
    x = hashes[:, None] + _OFFSETS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31)))


def segment_width(fingerprints: int) -> int:
    """Bits of a segment for so many fingerprints."""
    return min(32, max(16, math.ceil(math.log2(max(fingerprints, 2))) + SPARE_BITS))


def segments(width: int) -> int:
    """How many segments of this width a pair that differs in a share of DIFFERING of its bits needs, to meet in one with a probability of MEETING."""
    within = (1 - DIFFERING) ** width + width * DIFFERING * (1 - DIFFERING) ** (width - 1)
    return min(2 * LONGS, math.ceil(math.log(1 - MEETING) / math.log(1 - within)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of all documents, linked at a similarity of 0.8 or more, and of a bit less where fingerprints are near.

    Fingerprints link most of them; then _exact_links adds each pair of different components whose sets of five-word
    shingles have a similarity of 0.8 or more, so none of these is lost.

    Segments of the fingerprints are indexed as they are and with each bit deleted; the longer they are, in a larger
    table, the more of them there are, so a pair meets with the same probability at any size; see README for what is
    found.  All documents that share a bucket are compared, unless they are linked already:

    (1) Each fingerprint is compared with the smallest one of the buckets of plain segments, the one that it meets most
    often.  That joins most of a large group of near copies.
    (2) In all buckets, those of different components so far are compared: each two in small buckets, in larger ones
    each with two of other components.
    (3) In larger buckets that still hold several components, each two of different ones, in blocks, without a row for
    each pair.

    Documents with equal fingerprints count as one.  Texts without words are equal.  Rows without an id are left out.
    Rows that share an id count as one document.
    """
    names = [f"f{k}" for k in range(LONGS)]

    def run(batches):
        cache = _Hashes()
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            fps = np.array([wide_fingerprint(x, cache) for x in texts], dtype=np.int64).reshape(-1, LONGS)
            sets = [shingles(x, cache) for x in texts]
            of_set = [pa.array([_digest(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(fps[:, k]) for k in range(LONGS)], *of_set], names=["doc_id", *names, "digest", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    texts = rows
    rows = checkpoint(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in [*names, "digest", "size"])))
    units = checkpoint(_spread(rows.groupBy(*names).agg(F.min("doc_id").alias("u")), "u"))
    width = segment_width(units.count())
    slots = _segments(names, width, segments(width))

    first = connected_components(_verified(_leaders(units, slots), units, names))
    # c: the component so far, null where it is the document alone.
    units = checkpoint(units.join(first, units["u"] == first["node"], "left").select("u", *names, F.col("root").alias("c")))
    met = checkpoint(_meetings(units, slots, width))
    pairs = met.select(F.col("u").alias("a"), "c", F.explode("others").alias("o")).select("a", F.col("o.u").alias("b"), F.col("c").alias("ca"), F.col("o.c").alias("cb"))
    links = checkpoint(_verified(pairs.distinct(), units, names).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    roots = connected_components(links)
    more = checkpoint(_unlinked(met, units, names, roots))
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    # Documents of equal fingerprints hang on the smallest of them; its component's smallest one is the root.
    own = units.select(*names, F.coalesce("c", "u").alias("c"))
    linked = own.join(roots, own["c"] == roots["node"], "left").select(*names, F.coalesce("root", "c").alias("component_id"))
    found = checkpoint(rows.join(linked, names).select("doc_id", "component_id", "digest", "size"))
    roots = connected_components(_exact_links(texts, found))
    joined = found.join(roots, found["component_id"] == roots["node"], "left")
    return joined.select("doc_id", F.coalesce("root", "component_id").alias("component_id"))


# -- the exact way for the rest

#: Words of a shingle whose sets are compared, and the bits of a shingle's hash that are kept.
SHINGLE, HASH_BITS = 5, 48
#: Longs of the bitmaps by which pairs of sets are told apart before they are compared.
BITMAP = 16
#: Ids of so many texts at most are broadcast, so that other texts need not be moved; the texts of more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, cache: _Hashes) -> np.ndarray:
    """The sorted set of a text's five-word shingles, as hashes of 48 bits; a shorter text is one shingle, one without words has none."""
    words = _words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - SHINGLE + 1)
    x = np.full(n, min(len(words), SHINGLE), dtype=np.uint64)
    for k in range(min(len(words), SHINGLE)):
        x = (x ^ (x >> np.uint64(29))) * _FACTOR + hashes[k : k + n]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x ^ (x >> np.uint64(27))) >> np.uint64(64 - HASH_BITS))


def _digest(of: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(of.tobytes(), SEED)).astype(np.int64))


def _need(n):
    """Of a set of n shingles so many at least are in any set of a similarity of 0.8 or more, which has so many at least."""
    return (4 * n + 4) // 5


def _level(n):
    return max(1, n // 10)


def _prefix(n: int) -> int:
    """So many of the smallest of a set's n shingles hold the _level(n) smallest of those that it shares with any such other."""
    return n - _need(n) + _level(n)


def _dealt(texts: DataFrame, whole: bool = True) -> DataFrame:
    """(part, w, n, packed): n shingles of w sets that fall to a part, which is a partition of its own.

    Hashes go to the parts packed, six bytes each, in a row for each part and batch, not in one for each shingle.  If not
    whole, only the _prefix() smallest hashes of a set are dealt.
    """
    parts = partitions(texts.sparkSession)

    def pack(batches):
        cache = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = {_digest(x): x for x in (shingles(t.as_py(), cache) for t in batch.column(0).slice(at, 512)) if len(x)}
                if not whole:
                    sets = {k: x[: _prefix(len(x))] for k, x in sets.items()}
                if not sets:
                    continue
                token = np.concatenate(list(sets.values()))
                owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets.values()])
                part = (token % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                token, owner = token[order], owner[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                digests, out = np.array(list(sets), dtype=np.int64), []
                for k in range(parts):
                    s, e = cuts[k], cuts[k + 1]
                    if s < e:
                        who, place = np.unique(owner[s:e], return_inverse=True)
                        out.append((k, len(who), e - s, digests[who].tobytes() + place.astype(np.uint16).tobytes() + (token[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (token[s:e] >> np.uint64(32)).astype(np.uint16).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["part", "w", "n", "packed"])

    dealt = texts.select("text").mapInArrow(pack, "part int, w long, n long, packed binary")
    return dealt.repartitionById(parts, "part")  # by a hash of the part several would meet in one task's memory


def _shared_shingles(texts: DataFrame, whole: bool = True) -> DataFrame:
    """(digest, df, token): of each distinct set the shingles that other sets have as well, and how many sets do; whole: see _dealt."""

    def count(batches):
        owners, tokens = [], []
        for batch in batches:
            for w, n, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = packed.as_buffer()
                owners.append(np.frombuffer(raw, np.int64, w)[np.frombuffer(raw, np.uint16, n, 8 * w)])
                low, high = np.frombuffer(raw, np.uint32, n, 8 * w + 2 * n), np.frombuffer(raw, np.uint16, n, 8 * w + 6 * n)
                tokens.append(low | high.astype(np.uint64) << np.uint64(32))
        if not owners:
            return
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        del owners, tokens
        # Most hashes are of one set only: they go before anything else is made of them.
        order = np.argsort(token)
        token = token[order]
        owner = owner[order]
        several = np.zeros(len(token), dtype=bool)
        several[1:] = token[1:] == token[:-1]
        several[:-1] |= several[1:]
        owner, token = owner[several], token[several]
        del order, several
        order = np.lexsort((owner, token))
        owner, token = owner[order], token[order]
        new = np.ones(len(token), dtype=bool)  # copies of a set have been packed in several places
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        owner, token = owner[new], token[new]
        _, place, n = np.unique(token, return_inverse=True, return_counts=True)
        for at in range(0, len(token), 100_000):
            here = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(owner[here]), pa.array(n[place[here]]), pa.array(token[here].astype(np.int64))], ["digest", "df", "token"])

    return _dealt(texts, whole).mapInArrow(count, "digest long, df long, token long").filter("df > 1")


def _promising(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets(digest, size, ...) that may have one of a similarity of 0.8 or more, judged by a part of their shingles.

    Two such sets have the smallest of their common shingles in the prefixes of both, as many as the _level of the smaller
    one; so a set that shares fewer of its prefix with other prefixes has no partner.
    """
    n = _shared_shingles(texts, whole=False).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.floor((4 * F.col("size") + 4) / 5) / 10))
    return sets.join(n, "digest").filter(F.col("n") >= least).drop("n")


def _exact_links(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): components of found(doc_id, component_id, digest, size) that have sets of a similarity of 0.8 or more, as many as join them.

    Of a set's n shingles at least ceil(0.8 n) are in any such other; so two of them share one of their n - ceil(0.8 n) + 1
    rarest. Sets with so many shingles of their own have no partner: few are left. Sets that share one of the rarest are
    compared, first with the ends of each bucket, then, if not linked by that, all of different components whose bitmaps
    of shingles allow it, once for the first of the rarest shingles that they share.

    All shingles are counted only for the sets that _promising leaves.
    """
    # Equal sets are one, of any of their components; the others are linked to it.
    sets = checkpoint(found.filter("size > 0").groupBy("digest", "size").agg(F.min("component_id").alias("c"), F.min("doc_id").alias("d")))
    links = found.join(sets.select("digest", "c"), "digest").filter("component_id <> c").select(F.col("component_id").alias("a"), F.col("c").alias("b")).distinct()
    need = F.floor((4 * F.col("size") + 4) / 5)
    sets = checkpoint(_promising(texts, sets))
    ids = sets.select(F.col("d").alias("doc_id")).distinct()
    left = texts.join(F.broadcast(ids) if sets.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    held = _shared_shingles(left).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("of"))
    held = checkpoint(held.join(sets, "digest").filter(F.size("of") >= need).select("digest", "c", "size", (F.size("of") - need + 1).cast("int").alias("first"), "of").withColumns(_bitmap(F.col("of.token"))))
    tokens = held.select("digest", F.col("of.token").alias("of"))
    index = checkpoint(held.select("digest", "c", "size", F.explode(F.slice("of", F.lit(1), F.col("first"))["token"]).alias("token")))

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("9 * least(x_size, y_size) >= 4 * (x_size + y_size)").distinct()
        for k in "xy":
            pairs = pairs.join(tokens.select(F.col("digest").alias(k), F.col("of").alias(f"{k}_of")), k)
        both = F.size(F.array_intersect("x_of", "y_of"))
        return pairs.filter(9 * both >= 4 * (F.col("x_size") + F.col("y_size"))).select("a", "b").distinct()

    bucket = Window.partitionBy("token")
    me = F.struct("c", "digest", "size")
    ends = index.select("*", F.array(F.min(me).over(bucket), F.max(me).over(bucket)).alias("ends"))
    ends = ends.select("digest", "c", "size", F.explode("ends").alias("o")).filter("c <> o.c")
    links = links.union(alike(ends.select(F.col("digest").alias("x"), F.col("o.digest").alias("y"), F.col("size").alias("x_size"), F.col("o.size").alias("y_size"), F.col("c").alias("a"), F.col("o.c").alias("b"))))
    links = checkpoint(links)
    roots = connected_components(links)
    rest = index.join(roots, index["c"] == roots["node"], "left").select("digest", "size", "token", F.coalesce("root", "c").alias("c"))
    rest = rest.select("*", (F.min("c").over(bucket) != F.max("c").over(bucket)).alias("several")).filter("several").drop("several")
    rest = checkpoint(rest)
    return links.union(alike(_candidates(rest, held)))


def _candidates(rest: DataFrame, held: DataFrame) -> DataFrame:
    """(x, y, x_size, y_size, a, b): pairs of sets of rest(digest, size, token, c), of components a < b, that share a token and that bitmaps allow.

    The conditions are the join's own: a pair takes a row only if its bitmaps allow a similarity of 0.8, and only at the
    first of the rarest shingles that both have.
    """
    marks = [f"m{k}" for k in range(BITMAP)]
    rest = rest.join(held.select("digest", F.size("of").alias("n"), F.slice("of", F.lit(1), F.col("first"))["token"].alias("rarest"), *marks), "digest")
    sides = [rest.select(F.col("token").alias(f"{k}_token"), F.col("digest").alias(k), F.col("c").alias(c), *[F.col(x).alias(f"{k}_{x}") for x in ("size", "n", "rarest", *marks)]) for k, c in (("x", "a"), ("y", "b"))]

    def enough(p: str, q: str) -> Column:
        lacking = sum((F.bit_count(F.col(f"{p}_{m}").bitwiseAND(F.bitwise_not(f"{q}_{m}"))) for m in marks), F.lit(0))
        return 9 * (F.col(f"{p}_n") - lacking) >= 4 * (F.col("x_size") + F.col("y_size"))

    first = F.array_intersect("x_rarest", "y_rarest")[0] == F.col("x_token")
    met = sides[0].join(sides[1], (F.col("x_token") == F.col("y_token")) & (F.col("a") < F.col("b")) & enough("x", "y") & enough("y", "x") & first)
    return met.select("x", "y", "x_size", "y_size", "a", "b")


def _bitmap(of: Column) -> dict[str, Column]:
    """m0, m1, ...: BITMAP longs with a bit for each hash of a list. Each bit that another bitmap lacks is of a hash that its list lacks."""

    def part(k: int) -> Column:
        here = F.filter(of, lambda t: F.shiftright(t, 6) % BITMAP == k)
        return F.aggregate(here, F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (t % 64).cast("int"))))

    return {f"m{k}": part(k) for k in range(BITMAP)}


def _segments(names: list[str], width: int, n: int) -> Column:
    """(slot, v): the first n segments, the low bits of half-longs."""
    halves = [(2 * k + h, F.shiftrightunsigned(name, 32 * h)) for k, name in enumerate(names) for h in (0, 1)]
    return F.array(*[F.struct(F.lit(s).alias("slot"), v.bitwiseAND(F.lit((1 << width) - 1)).alias("v")) for s, v in halves[:n]])


def _leaders(units: DataFrame, slots: Column) -> DataFrame:
    """(a, b): each fingerprint and the smallest one of its plain buckets, the one that leads most of them."""
    each = units.select("u", F.inline(slots))
    led = each.select("u", F.min("u").over(Window.partitionBy("slot", "v")).alias("b")).filter("b < u")
    often = led.groupBy("u", "b").agg(F.count(F.lit(1)).alias("n"))
    return often.groupBy(F.col("u").alias("a")).agg(F.min(F.struct(-F.col("n"), "b"))["b"].alias("b"))


def _verified(pairs: DataFrame, units: DataFrame, names: list[str]) -> DataFrame:
    """The pairs (a, b, ...) whose fingerprints are within WIDE_DISTANCE."""
    sides = [units.select(F.col("u").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in names]) for x in "ab"]
    apart = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names), F.lit(0))
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(apart <= WIDE_DISTANCE).select(*pairs.columns)


def _meetings(units: DataFrame, slots: Column, width: int) -> DataFrame:
    """(u, c, others, key, bit): whom u, of component c, is compared with in a bucket, as (c, u); key is null in small buckets, where these are all."""
    each = units.select("u", "c", F.inline(slots)).select("u", "c", "slot", "v", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("i"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("i", F.lit(0)))
    wild = F.col("i") >= 0
    value = F.when(wild, F.col("v").bitwiseAND(F.bitwise_not(one))).otherwise(F.col("v"))
    key = F.call_function("shiftleft", (F.col("slot") * 64 + F.col("i") + 1).cast("long"), F.lit(32)).bitwiseOR(value)
    index = each.select(key.alias("key"), "u", "c", (wild & (F.col("v").bitwiseAND(one) != 0)).alias("bit"))
    index = index.repartition("key")  # before the window's own columns are added
    # With a deleted bit, only fingerprints that differ in it are new; in plain segments all that meet.
    order = Window.partitionBy("key").orderBy("u")
    bucket = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct(F.coalesce("c", "u").alias("c"), "u")
    ends = {f"{n}{b}": f(F.when(F.col("bit") == F.lit(b == 1), me)).over(bucket) for b in (0, 1) for n, f in (("low", F.min), ("high", F.max))}
    before = {f"before{k}": F.lag(F.struct(me.alias("it"), "bit"), k).over(order) for k in range(1, NEIGHBOURS + 1)}
    met = index.select("key", "bit", me.alias("me"), (F.count(F.lit(1)).over(bucket) <= NEIGHBOURS + 1).alias("few"), *[v.alias(k) for k, v in (ends | before).items()])
    plain = F.call_function("shiftright", F.col("key"), F.lit(32)) % 64 == 0
    near = [F.when(plain | (F.col(f"{b}.bit") != F.col("bit")), F.col(f"{b}.it")) for b in before]
    far = [F.when(plain | F.col("bit"), F.col(f"{n}0")).otherwise(F.col(f"{n}1")) for n in ("low", "high")]
    others = F.when(F.col("few"), F.array(*near)).otherwise(F.array(*far))
    others = F.array_distinct(F.filter(F.array_compact(others), lambda o: o["c"] != F.col("me.c")))
    met = met.select("me.u", "me.c", others.alias("others"), F.when(~F.col("few"), F.col("key")).alias("key"), F.col("bit").cast("long").alias("bit"))
    return met.filter(F.size("others") > 0)


def _unlinked(met: DataFrame, units: DataFrame, names: list[str], roots: DataFrame) -> DataFrame:
    """Links (a, b) of components in large buckets that are different ones; at most one less than a bucket's components from each two blocks."""
    # Joins take a row for each document, not for each of its buckets, of which it has a bounded number.
    large = met.filter(F.col("key").isNotNull()).groupBy("u", F.col("c").alias("was")).agg(F.collect_list(F.struct("key", "bit")).alias("at"))
    rows = large.join(roots, large["was"] == roots["node"], "left").select("u", F.coalesce("root", "was").alias("c"), F.inline("at")).repartition("key")
    # A row is needed if its bucket has a member that it may link to in another component; with a deleted bit, one that differs in the bit.
    bucket = Window.partitionBy("key")
    sides = {"": F.lit(True), "0": F.col("bit") == 0, "1": F.col("bit") == 1}
    ends = {f"{n}{x}": f(F.when(on, F.col("c"))).over(bucket) for x, on in sides.items() for n, f in (("low", F.min), ("high", F.max))}
    rows = rows.withColumns(ends | {"n": F.ceil(F.count(F.lit(1)).over(bucket) / BLOCK)})
    other = {x: (F.col(f"low{x}") != F.col("c")) | (F.col(f"high{x}") != F.col("c")) for x in sides}
    plain = F.call_function("shiftright", F.col("key"), F.lit(32)) % 64 == 0
    needed = F.when(plain, other[""]).when(F.col("bit") == 0, other["1"]).otherwise(other["0"])
    rows = rows.filter(needed).withColumn("own", F.pmod(F.xxhash64("u"), F.col("n")))
    rows = rows.groupBy("u", "c").agg(F.collect_list(F.struct("key", "bit", "n", "own")).alias("at"))
    rows = rows.join(units.drop("c"), "u").select("c", *names, F.inline("at"))
    # Most buckets are one block; the rows of others go to each two blocks that have them.
    several = rows.filter("n > 1").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.filter("n = 1").withColumn("with", F.lit(0).cast("long")).unionByName(several)
    rows = rows.select("key", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "bit", "c", *names)
    group = ["key", "x", "y"]

    def run(batches):
        held = np.empty((0, 6 + LONGS), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            cuts = [0, *(np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1).tolist()]
            links = [x for s, e in zip(cuts[:-1], cuts[1:], strict=True) for x in _joining(held[s:e])]
            held = held[cuts[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        if len(held):
            links = _joining(held)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _joining(rows: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of two blocks of a bucket; rows are (key, block, block, own block, bit, component, fingerprint)."""
    key, x, y = rows[0, :3].tolist()
    own, bit, fps = rows[:, 3], rows[:, 4], rows[:, 6:].view(np.uint64)
    names, c = np.unique(rows[:, 5], return_inverse=True)
    if len(names) < 2:
        return []
    root, out = list(range(len(names))), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for at in range(0, len(rows), 256):
        # Each pair once: a slice with what follows it and with itself.
        here = slice(at, at + 256)
        apart = sum(np.bitwise_count(fps[here, k, None] ^ fps[None, at:, k]).astype(np.int16) for k in range(fps.shape[1]))
        near = (apart <= WIDE_DISTANCE) & (c[here, None] != c[None, at:])
        if (key >> 32) % 64:
            near &= bit[here, None] != bit[None, at:]
        if x != y:
            near &= own[here, None] != own[None, at:]
        i, j = np.nonzero(near)
        _, first = np.unique(c[i + at] * len(names) + c[j + at], return_index=True)
        for k in first.tolist():
            a, b = top(int(c[i[k] + at])), top(int(c[j[k] + at]))
            if a != b:
                root[a] = b
                out.append((int(names[c[i[k] + at]]), int(names[c[j[k] + at]])))
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near_copies, the one with the smallest doc_id, with all its columns.

    Rows that share an id share its fate; a row without id stays.
    """
    return _without(docs, id_col, near_copies(docs, id_col, text_col).filter(F.col("doc_id") != F.col("component_id")))
