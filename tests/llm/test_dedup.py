import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import thalweg.llm.components
from thalweg.llm import exact_dedup, simhash, substring
from thalweg.llm.components import connected_components

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(m[:3] for m in members)
        keep = next(m[3] for m in members if m[:3] == best)
        out += [(m[3], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def exact(df, **options):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(df, **options).collect()), key=str)


def test_exact_groups(spark):
    rows = [(5, "a b"), (3, "ab"), (1, "ab"), (9, " a\tb \n"), (2, None), (4, ""), (7, " \x0b"), (8, "a\u00a0b"), (6, "A b"), (None, "ab"), (10, "x" * 50_000), (11, "x" * 50_000 + " ")]
    assert exact(docs(spark, rows)) == expected_exact(rows)


def test_exact_with_hot_texts(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot text", "hot  text", "hot text "]) if i % 3 == 0 else f"text {rng.randrange(300)}") for i in range(3000)]
    df = docs(spark, rows).repartition(7)
    assert exact_dedup._hot(df.selectExpr("doc_id", "text as _text"), 4, 2000, 1)
    assert exact(df) == expected_exact(rows)
    kept = exact_dedup.exact_dedup(df).filter("kept").collect()
    assert len(kept) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_keeps_one_of_repeated_rows_and_all_columns(spark):
    rows = [(1, "a", "x", 1), (1, "a", "x", 1), (2, "a ", "y", 2), (3, None, None, 3), (None, "b", None, 4)]
    df = docs(spark, rows, "doc_id long, text string, keep_id string, _norm int")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(2, "a ", "y", 2), (3, None, None, 3), (None, "b", None, 4)], key=str)
    assert exact_dedup.exact_dedup(df).count() == 5


def test_empty_tables(spark):
    df = docs(spark, [])
    assert exact_dedup.exact_dedup(df).count() == 0 and simhash.simhash_components(df).count() == 0 and substring.remove_repeats(df).count() == 0


# -- SimHash


def plain_fingerprint(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "One two", "ÄÖ one\u00a0two three", *(" ".join(rng.choice("the of And ÉT x".split()) for _ in range(rng.randrange(1, 900))) for _ in range(20))]
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert spark.sql("select xxhash64('one two three') as h").first()["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def union_find(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                root[find(a)] = find(b)
    out = defaultdict(set)
    for v in values:
        out[find(v)].add(v)
    return {frozenset(s) for s in out.values() if len(s) > 1}


@pytest.mark.parametrize(("distance", "large"), [(2, 64), (2, 3), (1, 2), (3, 4)])
def test_links_give_the_components_of_all_pairs(spark, distance, large):
    rng = np.random.default_rng(distance * 100 + large)
    values = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(25):
            v = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(b)
            values.add(v)
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values | {0, 1, 2**63})
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = connected_components(simhash.links(df, distance=distance, large=large)).collect()
    got = defaultdict(set)
    for r in roots:
        got[r["root"]].add(r["node"])
    assert {frozenset(s) for s in got.values()} == union_find(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    graphs = [[(int(x), int(y)) for x, y in rng.integers(-(2**40), 2**40, n)[rng.integers(0, n, (m, 2))]] for n, m in ((200, 90), (200, 250), (30, 400))]
    graphs.append([(9, k) for k in range(9)] + [(k, 40 - k) for k in range(9, 20)])
    for links in graphs:
        near = {*links, *((b, a) for a, b in links)}
        expected = {i: min(c) for c in union_find(sorted({x for pair in links for x in pair}), lambda a, b: (a, b) in near) for i in c if len(c) > 1}
        for most in (1_000_000, 0):
            monkeypatch.setattr(thalweg.llm.components, "ONE_TASK", most)
            df = spark.createDataFrame([*links, (5, 5), (None, 1)], "a long, b long")
            rows = connected_components(df).collect()
            assert {r["node"]: r["root"] for r in rows} == expected and len(rows) == len(expected)


def test_few_links_take_few_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert connected_components(links).filter("root = 0").count() == 301
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few links")]
    assert 0 < sum(len(j.stageIds) for j in jobs) <= 20


def test_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(2000))
    rows = [(5, base), (3, base.replace("word77 ", "other ")), (4, base.upper()), (9, "something else entirely " * 3), (2, ""), (8, None), (None, base)]
    got = {r["doc_id"]: (r["component_id"], r["fingerprint"]) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert got[5][0] == got[3][0] == got[4][0] == got[None][0] == 3 and got[9][0] == 9 and got[8][0] == got[2][0] == 2
    assert got[5][1] == format(plain_fingerprint(base), "016x") and got[2][1] == "0" * 16
    for drop in (simhash.drop_linked, simhash.drop_near_copies):
        assert {r["doc_id"] for r in drop(docs(spark, rows)).collect()} == {3, 9, 2, None}


def jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_edited_copies_are_found_and_others_kept(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    write = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, source = [], {}
    for g in range(60):
        base = write(rng.randrange(150, 500))
        rows.append((1000 + g * 10, " ".join(base)))
        for k in range(1, 3):
            copy = list(base)
            for _ in range(max(1, len(base) // 150)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((1000 + g * 10 + k, " ".join(copy)))
            source[1000 + g * 10 + k] = 1000 + g * 10
    alone = [(i, " ".join(write(300))) for i in range(200)]
    texts = dict(rows)
    assert min(jaccard(texts[c], texts[b]) for c, b in source.items()) > 0.85
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows + alone)).collect()}
    assert kept >= {i for i, _ in alone} and kept >= set(source.values())
    assert len(kept & set(source)) <= 0.03 * len(source)


def test_copies_at_the_threshold_are_found_at_any_width(spark, monkeypatch):
    """Pairs of a similarity from 0.80 to 0.85; segments as narrow as in a small table and as wide as in the largest."""
    rng = random.Random(11)
    rows, pairs = [], []
    for g in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        while jaccard(" ".join(base), " ".join(copy)) > 0.85:
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
            pairs.append((2 * g, 2 * g + 1))
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    assert len(pairs) > 100
    for width in (16, 32):
        monkeypatch.setattr(simhash, "segment_width", lambda n, width=width: width)
        kept = {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
        assert kept >= {a for a, _ in pairs} and len(kept & {b for _, b in pairs}) <= 0.1 * len(pairs)


def test_segments_grow_with_their_width():
    for width in range(16, 33):
        within = (1 - simhash.DIFFERING) ** width + width * simhash.DIFFERING * (1 - simhash.DIFFERING) ** (width - 1)
        assert 1 - (1 - within) ** simhash.segments(width) >= simhash.MEETING
    assert simhash.segment_width(2) == 16 and simhash.segment_width(10**6) == 24 and simhash.segment_width(10**12) == 32


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(7, " ".join(base))]
    for k in range(400):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(400)] = f"e{k}"
        rows.append((100 + k, " ".join(copy)))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
    assert 7 in kept and len(kept) <= 5
    assert simhash.drop_near_copies(docs(spark, [])).count() == 0


# -- repeated passages


def expected_repeats(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = {}
    for d, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (d, p):
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def repeats(df, window):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df, window=window).collect()}


@pytest.mark.parametrize(("window", "alphabet"), [(2, 3), (3, 2), (5, 2), (20, 40)])
def test_repeats_against_brute_force(spark, monkeypatch, window, alphabet):
    monkeypatch.setattr(substring, "SLICE_BYTES", 600)
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in range(60):
        words = [f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(0, 60))] if window < 20 or d % 2 else [f"u{rng.random()}" for _ in range(30)]
        if rng.random() < 0.4:
            a = rng.randrange(40)
            words[rng.randrange(len(words) + 1) : 0] = passage[a : a + rng.randrange(15, 31)]
        rows.append((1000 - 7 * d, " \n".join(words)))
    rows += [(3, rows[10][1]), (5, rows[10][1].replace("\n", "\t")), (-4, rows[20][1]), (7, None), (8, ""), (9, "same " * 300)]
    assert repeats(docs(spark, rows).repartition(5), window) == expected_repeats(rows, window)


def test_repeats_of_rows_without_or_with_shared_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    got = substring.remove_repeats(docs(spark, [(None, text), (None, text), (1, text), (1, text), (2, text)]), with_text=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"], r["kept_text"] == text) for r in got) == [(False, 1, 0, True)] * 2 + [(False, 2, 30, False)] + [(True, 0, 0, True)] * 2


def test_packing():
    rng = np.random.default_rng(0)
    for v in (np.zeros(0, np.uint64), np.array([0, 5, 2**63], np.uint64), rng.integers(0, 2**40, 99, dtype=np.uint64)):
        assert (substring.unpack(substring.pack(v)) == v).all()
        assert (substring._unpack_sorted(substring._pack_sorted(np.sort(v))) == np.sort(v)).all()
    ids = np.array([0, -1, 5, -(2**62), 2**62])
    assert (substring._ids(substring._signed(ids)) == ids).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_near_copies_that_share_a_large_bucket_with_others(spark, monkeypatch, block):
    """Only the first segment is shared by all; the document of the smallest id is near to none of the others."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, units, flips = random.Random(5), [], sum(1 << b for b in (0, 5, 9))
    for k in range(41):
        longs = [rng.getrandbits(64) for _ in range(simhash.LONGS)]
        longs[0] = longs[0] >> 16 << 16 | 0xABCD
        units.append((k, longs))
        if k:
            units.append((100 + k, [longs[0] ^ flips << 32, *[x ^ flips ^ flips << 32 for x in longs[1:]]]))
    names = [f"f{k}" for k in range(simhash.LONGS)]
    rows = [(u, *[x - (1 << 64) if x >> 63 else x for x in longs]) for u, longs in units]
    df = spark.createDataFrame(rows, "u long, " + ", ".join(f"{n} long" for n in names))
    df = df.withColumn("c", F.lit(None).cast("long"))
    met = simhash._meetings(df, simhash._segments(names, 16, 2 * simhash.LONGS), 16).cache()
    none = connected_components(df.select(F.col("u").alias("a"), F.col("u").alias("b")))
    got = {tuple(r) for r in simhash._unlinked(met, df, names, none).collect()}
    assert {tuple(sorted(r)) for r in got} == {(k, 100 + k) for k in range(1, 41)}


@pytest.mark.parametrize("fan", [2, 3])
def test_repeats_do_not_depend_on_the_parts(spark, monkeypatch, fan):
    """Parts dealt in several rounds, which take the same rows as one."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(80)]
    expected = {tuple(r) for r in substring.remove_repeats(docs(spark, rows), window=4).collect()}
    monkeypatch.setattr(substring, "FAN", fan)
    monkeypatch.setattr(substring, "PART_WORDS", 60)
    levels = substring._levels(27)
    assert levels[0] <= fan and levels[-1] >= 27 and all(b % a == 0 and b // a <= fan for a, b in zip(levels, levels[1:]))
    assert {tuple(r) for r in substring.remove_repeats(docs(spark, rows), window=4).collect()} == expected


def test_dealing_takes_no_longer_with_more_parts():
    hashes = np.sort(np.random.default_rng(1).integers(0, 2**substring.HASH_BITS, 300_000).astype(np.uint64))
    assert substring._levels(100_000)[0] == substring.FAN == 512
    cuts = substring._cuts(substring._part(hashes, substring.HASH_BITS, substring._levels(100_000)[0]))
    assert len(cuts) <= 512 and cuts[0][1] == 0 and cuts[-1][2] == len(hashes)


def test_no_near_copy_is_lost(spark, monkeypatch):
    """Where fingerprints link nothing, all pairs of a similarity of 0.8 or more are still linked, and no others; against brute force."""
    monkeypatch.setattr(simhash, "WIDE_DISTANCE", -1)
    rng, rows = random.Random(12), [(9000, "five words are one shingle"), (9001, "FIVE words  are one shingle"), (9002, "too short"), (9003, "too short"), (9004, ""), (9005, None)]
    passage = [f"p{i}" for i in range(40)]
    for g in range(40):
        base = passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200))]
        for k in range(4):
            rows.append((g * 10 + k, " ".join(base)))
            for _ in range(rng.randrange(1, max(2, len(base) // 15))):
                base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
    sets = {i: {tuple(w[j : j + 5]) for w in [(t or "").lower().split()] for j in range(max(1, len(w) - 4))} for i, t in rows}
    root, links = {i: i for i in sets}, 0
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links += sets[i] != sets[j]
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert links > 30 and len(set(root.values())) > 45
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, rows)).collect()} == root


def test_few_shingles_are_dealt_and_no_set_with_a_partner_is_passed_over(spark):
    """Each part of the dealt shingles is a task's only one; sets that have a partner by brute force stay, most others go."""
    rng, texts = random.Random(13), []
    for g in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 5, 6, 9, 14, 60, 300]))]
        texts.append(" ".join(base))
        if g % 2:
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                base[rng.choice([0, rng.randrange(len(base))])] = f"e{rng.randrange(10**6)}"
            texts += [" ".join(base), " ".join(base + [f"x{g}"]), " ".join(base)]
    sets = {s.tobytes(): s for s in (simhash.shingles(t, simhash._Hashes()) for t in texts)}.values()
    partner = {simhash._digest(a) for a in sets for b in sets if a is not b and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    df = docs(spark, list(enumerate(texts)))
    frame = spark.createDataFrame([(simhash._digest(s), len(s)) for s in sets], "digest long, size long")
    left = {r["digest"] for r in simhash._promising(df, frame).collect()}
    assert len(partner) > 20 and partner <= left and len(left) <= len(partner) + 25
    dealt = simhash._dealt(df, whole=False).withColumn("at", F.spark_partition_id()).collect()
    assert sum(r["n"] for r in dealt) <= 0.33 * simhash._dealt(df).agg(F.sum("n")).first()[0]
    assert all(len({r["part"] for r in dealt if r["at"] == at}) == 1 for at in {r["at"] for r in dealt})


def test_pairs_that_share_rare_shingles_take_a_row_once_and_only_if_they_may_be_alike(spark):
    rng = np.random.default_rng(8)
    hot, sets = list(range(1, 13)), {}
    for d in range(60):  # they share twelve of the rarest shingles, and nothing else
        sets[d] = hot + sorted(rng.integers(100, 2**47, 90).tolist())
    sets[60] = sets[7][:-6] + [50, 51]
    sets[61] = sets[60][:-1]
    rows = [(d, 1000 + d, len(of), len(of) - (4 * len(of) + 4) // 5 + 1, [(2, t) for t in of]) for d, of in sets.items()]
    held = spark.createDataFrame(rows, "digest long, c long, size long, first int, of array<struct<df: long, token: long>>")
    held = held.withColumns(simhash._bitmap(F.col("of.token")))
    rest = held.select("digest", "size", "c", F.explode(F.slice("of", F.lit(1), F.col("first"))["token"]).alias("token"))
    got = sorted((r["x"], r["y"], r["a"], r["b"]) for r in simhash._candidates(rest, held).collect())
    assert got == [(7, 60, 1007, 1060), (7, 61, 1007, 1061), (60, 61, 1060, 1061)]
