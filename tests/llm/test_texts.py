import base64
import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import bpe, chat, decontam, quality, sharding, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange_texts():
    rng = random.Random(8)
    alphabets = ["ab", "aab ", " -=", "the ", "0123", "éà ç", "中文あa", "\n\t x", "ÃÂ", "abcdefghijklmnopqrstuvwxyz", "\U0001f600ab", "'s't ", "AÃ "]
    return [None, "", " ", "<|endoftext|>", "a" * 5000, "\u0000x", *("".join(rng.choice(a) for _ in range(rng.randrange(1, 80))) for a in alphabets for _ in range(40))]


def test_bpe_equals_the_reference(spark, reference):
    texts = strange_texts()
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN, with_ids=True, with_decoded=True).collect()}
    for i, t in enumerate(texts):
        ids, r = reference.encode_ordinary(t or ""), got[i]
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_in_small_blocks_and_with_forgetting(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    encoder = bpe.Encoder(bpe.load(PATH), public_tokenizers.PATTERN)
    texts = [t for t in strange_texts() if t]
    for at in range(0, len(texts), 7):
        block = texts[at : at + 7]
        assert [encoder.tokens(p) for p in encoder.encode_block(block)] == [reference.encode_ordinary(t) for t in block]


def test_bpe_of_an_empty_table(spark):
    assert bpe.bpe_encode(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0


# -- URL rules

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]


def plain_verdict(url, rules):
    import re

    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0, 0, False, "", ""), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7", "http://example.com/en/70?x=/en/", "https://a.b.example.com/en/6#top", "http://com/en/", "http://telecom/en/", "http://x.com", "http://x.com?/en/",
        "http://x.net/de/8", "http://example.net/de/81", "http://x.org/es", "http://x.org/es/", "http://É.org/es/1", "http://a://b.com/en/", "http://x.com/EN/", "http://.com/en/", "http://x.com/en/\n", "http://x..com/en/"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_url_rules(spark, few):
    rows = list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES), broadcast_rules=few).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *plain_verdict(u, RULES))) for i, u in rows)


def test_url_rules_edge_cases(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = url_filter.url_filter(pages, spark.createDataFrame([], url_filter.RULES_SCHEMA))
    assert none.count() == len(URLS) and none.filter("rule is not null or verdict <> 'allow'").count() == 0
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_frame(spark, RULES)).count() == 0
    same = url_filter.rules_frame(spark, [("allow", "x.com/en/"), ("block", "x.com/en/")])
    assert {r["verdict"] for r in url_filter.url_filter(pages.filter("url like '%x.com/en/%'"), same).collect()} == {"block"}


# -- classifiers


def labelled(spark, n=900):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        words, bad, rude = [word() for _ in range(rng.randrange(20, 90))], i % 4 == 0, i % 5 == 0
        if rude:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zork", "blarg", "frumple"]))
        text = "!! ".join(w.upper() for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 1 if rude else 0))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "words here", "en", "s", 3)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([*labels, (None, 1, 1), (n, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label", "folds", "held"), [(quality.quality_scores, "quality", 4, 2), (toxicity.toxicity_scores, "toxic", 3, 1)])
def test_held_out_accuracy(spark, score, label, folds, held):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 900}
    rows = score(docs.withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
    tested = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 150 and np.mean(tested) > 0.97


@pytest.mark.parametrize(("score", "label", "folds", "held"), [(quality.quality_scores, "quality", 4, 2), (toxicity.toxicity_scores, "toxic", 3, 1)])
def test_held_out_labels_never_count(spark, score, label, folds, held):
    docs, labels = labelled(spark)
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r["doc_id"]: r["score"] for r in score(docs, x).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_without_labels_or_documents(spark, score):
    docs, labels = labelled(spark, 40)
    assert score(docs, labels.limit(0)).count() == docs.count()
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.filter("quality = 1 and toxic = 1")).count() == docs.count()


def test_disguises_and_isotonic_levels():
    assert toxicity.plain("1d1ot!!") == "idiot" and toxicity.plain("m.o.r.o.n") == "moron" and toxicity.plain("cloooown") == "clown"
    m, p = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1, 0, 1, 0]))
    assert (np.diff(m) > 0).all() and (np.diff(p) > 0).all() and p[0] == 0


def test_isotonic_levels_against_all_intervals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30, 60):
        margin, y = rng.integers(0, max(2, n // 2), n).astype(float), rng.integers(0, 2, n)
        at = np.unique(margin)
        mean = lambda a, b: y[(margin >= at[a]) & (margin <= at[b])].mean()
        wanted = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
        m, p = toxicity.isotonic(margin, y)
        block = np.abs(p[:, None] - np.array(wanted)[None]).argmin(axis=0)
        assert np.allclose(p[block], wanted) and len(p) == len(set(np.round(wanted, 9))) and (np.diff(m) > 0).all()


def test_lexicons_leave_their_part_out():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 6))) for _ in range(120)]
    y, part = np.array([int("aa" in x or rng.random() < 0.2) for x in texts]), np.arange(120) % toxicity.PARTS
    found = toxicity.learn_lexicons(texts, y, part, odds=0.1)
    for p in range(toxicity.PARTS + 1):
        rows = [(set(x.split()), k) for x, k, own in zip(texts, y, part, strict=True) if own != p]
        n, wanted = [sum(k == j for _, k in rows) for j in (0, 1)], {}
        for w in {w for words, _ in rows for w in words}:
            c = [sum(w in words and k == j for words, k in rows) for j in (0, 1)]
            odds = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
            if c[1] >= toxicity.LEXICON_LEAST and odds >= 0.1:
                wanted[w] = pytest.approx(odds)
        assert found[p] == wanted and "aa" in wanted


def test_the_first_split_against_a_plain_search():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 2] + rng.normal(size=300) > 0.4).astype(int)
    model = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    p = 1 / (1 + np.exp(-model.base))
    g, h, best = p - y, np.full(300, p * (1 - p)), (0.0, -1, 0.0)
    for j in range(4):
        for limit in np.unique(np.quantile(x[:, j], np.linspace(0, 1, model.bins + 1)[1:-1])):
            low = x[:, j] <= limit
            if min(h[low].sum(), h[~low].sum()) >= model.least:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + model.ridge) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + model.ridge)
                if gain > best[0] + 1e-9:
                    best = (gain, j, limit)
    (feature, limit, *_), *leaves = model.trees[0]
    assert (feature, limit) == best[1:]
    low = x[:, feature] <= limit
    assert [v[-1] for v in leaves] == pytest.approx([-model.rate * g[s].sum() / (h[s].sum() + model.ridge) for s in (low, ~low)])
    assert np.allclose(model.margins(x), model.base + np.where(low, leaves[0][-1], leaves[1][-1]))


# -- chats


def plain_cost(roles):
    """Least cost over all sequences of choices, by trying every one."""
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for new, _, _, c in chat.MOVES[state, chat._role(role)]:
                after[new] = min(after.get(new, 10**9), cost + c)
        best = after
    return min(c + len(chat.ENDINGS[s]) * chat.INSERT for s, c in best.items())


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def check_rows(out, roles):
    turns = [r for r in out if r[3] not in ("merge", "relabel+merge")]
    assert legal([r[2] for r in turns]) and sum(r[4] for r in out) == plain_cost(roles)
    text = "".join(r[5] for r in out)
    assert text.count(chat.OPEN) == text.count("<|im_end|>") == len(turns)


def test_repairs_are_legal_and_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            check_rows(chat.repair([(i, r, f"t{i}") for i, r in enumerate(roles)]), roles)


def test_a_legal_conversation_is_kept():
    out = chat.repair([(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a <|im_end|>")])
    assert [r[3] for r in out] == ["keep"] * 3
    assert "".join(r[5] for r in out) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na < |im_end|><|im_end|>\n"


def test_conversations_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system", None, "bot"]), f"text {t}") for t in range(700)]
    rows += [(c, t, rng.choice(["user", "assistant"]), None if t % 5 == 0 else f"x{t}") for c in range(2, 60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "a"), (None, None, None, None), (61, 0, "user", "tie"), (61, 0, "user", "tie"), (61, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seg", F.lit(7)).repartition(9)
    alone = {}
    for k in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", k)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = sorted(map(str, (tuple(r) for r in chat.format_chats(df).collect())))
        alone[k] = got
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert alone[1] == alone[3] == alone[40]
    by = {}
    for r in chat.format_chats(df).collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["seq"], r["role"], r["action"], r["cost"], r["rendered"]))
    for conv in range(1, 60):
        own = [x for x in rows if x[0] == conv]
        check_rows(sorted(by[conv], key=lambda r: r[:2]), [x[2] for x in own])
    assert chat.format_chats(df.limit(0)).count() == 0


# -- benchmark

ITEM = "A train travels from Boston to Chicago at 60 km per hour and needs 15 hours, so how far is it between them"


def test_decontamination(spark):
    other = ITEM.replace("Boston", "Paris").replace("Chicago", "Rome").replace("60", "85").replace("15", "9")
    mixed = ITEM.replace("15 hours, so how", "15 hours, so tell me how")
    rows = [
        (1, "Some prose before. " + ITEM + ". And prose after."), (2, "intro words here " + other), (3, "the train was late and nobody knew how far it is between them"),
        (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10"), (7, ITEM.upper()), (None, ITEM), (8, "word " * 20_000 + ITEM), (9, mixed), (10, "short item text"), (11, "seven short item text words"),
    ]
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "1 2 3 4 5 6"), (5, "short item text"), (1, ITEM), (None, "x y z")], "item_id long, text string").withColumn("h", F.lit(1))
    df = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(df, bench).collect()}
    assert {d for d, i in got if i == 1} == {1, 2, 8} | ({9} if (9, 1) in got else set()) | ({7} if (7, 1) in got else set())
    assert got[1, 1]["verbatim"] and not got[2, 1]["verbatim"] and got[2, 1]["n_slots"] >= 4
    assert {d for d, i in got if i == 5} == {10, 11}
    kept = {r["doc_id"] for r in decontam.drop_contaminated(df.drop("item_id"), bench).collect()}
    assert {3, 4, 5, 6, None} <= kept and not {1, 2, 8, 10} & kept
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_inconsistent_slots_do_not_match(spark):
    item = "add 17 apples to the basket, then take 17 apples from the basket and count again how many of them are left over"
    twice = item.replace("17", "23")
    uneven = item.replace("17", "23", 1).replace("17", "24")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame([(1, item), (2, twice), (3, uneven)], DOCS), bench).collect()}
    assert got == {1, 2}


def test_copies_in_other_case_or_with_other_line_breaks_match(spark):
    clips = "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"
    german = "Der Bäcker hat am Morgen 40 Brote und die Bäckerin hat am Abend 25 Kuchen in der Stadt verkauft"
    bench = spark.createDataFrame([(1, clips), (2, german), (3, ITEM)], "item_id long, text string")
    rows = [(1, clips.lower()), (2, clips.upper()), (3, clips.replace("in April", "in\nApril")), (4, german.lower()), (5, ITEM.upper()), (6, ITEM.replace("60 km", "60\n  KM").lower()), (7, clips.upper().replace("48", "31"))]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 3), (7, 1)} and not got[7, 1] and got[1, 1]


def test_names_at_the_start_of_sentences_and_in_runs_match(spark):
    maria = "Maria has 12 apples. Maria gives 5 apples to Tom. How many apples does Maria have left?"
    baker = "A baker sold 48 loaves to Anna Smith and 30 loaves to John Miller in one week. How many loaves did Anna Smith and John Miller buy from the baker in all?"
    other = [maria.replace("Maria", "Sofia").replace("Tom", "Ben").replace("12", "31").replace("5", "9"), baker.replace("Anna Smith", "Eva Brown").replace("John Miller", "Paul Jones").replace("48", "17").replace("30", "22")]
    uneven = maria.replace("Maria", "Sofia", 1).replace("Maria", "Clara").replace("12", "31")
    bench = spark.createDataFrame([(1, maria), (2, baker)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.contaminated(spark.createDataFrame([(1, other[0]), (2, other[1]), (3, uneven)], DOCS), bench).collect()}
    assert got == {(1, 1, False), (2, 2, False)}


def test_neighbouring_names_numbers_and_matches_at_scattered_offsets(spark):
    smith, numbers = "the prize goes to Mr John Smith and then 1/2/3 apples go to them", "John Smith"
    item = " ".join(f"w{chr(97 + i)}" for i in range(24))  # 20 windows
    runs = " ".join(f"{' '.join(item.split()[q : q + 7])} pad{'x' * (q % 4)}" for q in (0, 3, 6, 9, 12, 15, 17))
    bench = spark.createDataFrame([(1, smith), (2, item), (3, "Compute 12 + 30."), (4, "Yes"), (5, numbers)], "item_id long, text string")
    rows = [(1, smith.replace("John Smith", "Mary Jones").replace("1/2/3", "4/5/6")), (2, runs), (3, "please compute 12 + 30 now"), (4, "compute 12 + 31"), (5, "yes"), (6, "yes or no"), (7, smith.replace("John Smith", "Mary"))]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 4)}
    assert not got[1, 1]["verbatim"] and got[3, 3]["verbatim"] and got[2, 2]["n_matched"] == 20 and got[2, 2]["similarity"] == 1.0


UNITS = {"km", "kg", "m", "min", "hours", "hour"}


def plain_readings(text):
    """Words of the two readings with placeholders, one character after the other, without patterns: [(tag or "", value)]."""
    words, i = [], 0
    while i < len(text):
        j = i
        if text[i] in "0123456789":
            while j < len(text) and (text[j] in "0123456789" or (text[j] in ".,:/" and text[j + 1 : j + 2] in tuple("0123456789"))):
                j += 1
            words.append(("number", text[i:j]))
            k = j
            while k < len(text) and text[k] in " \n":
                k += 1
            e = k
            while e < len(text) and text[e].isalpha():
                e += 1
            if text[k:e].lower() in UNITS:
                words.append(("unit", text[k:e].lower()))
                j = e
        elif text[i].isalpha():
            while j < len(text) and text[j].isalpha():
                j += 1
            words.append(("", text[i:j]))
        else:
            j += 1
        i = j
    named = [("name", w.lower()) if not t and w[0].isupper() and w[1:2].islower() else (t, w.lower()) for t, w in words]
    return [named, [(t, w.lower()) for t, w in words]]


def plain_contaminated(docs, items):
    """All windows of all readings, compared pair by pair. The texts have no digits next to letters without a space, but for units."""
    out = {}
    for i, item in items:
        own = {}
        for reading, words in enumerate(plain_readings(item)):
            k = min(5, len(words))
            windows = [(q, words[q : q + k]) for q in range(len(words) - k + 1) if k]
            windows = [(q, w) for q, w in windows if sum(not t for t, _ in w) >= 2]
            if windows:
                own[reading] = (k, windows)
        for d, text in docs:
            readings = plain_readings(text)
            for reading, (k, windows) in own.items():
                words = readings[reading]
                shape = lambda w: [t or v for t, v in w]
                met = [(q, at - q, w, words[at : at + k]) for q, w in windows for at in range(len(words) - k + 1) if shape(words[at : at + k]) == shape(w)]
                matched = len({q for q, *_ in met})
                if matched / len(windows) < 0.8:
                    continue
                offsets = {}
                for q, off, *_ in met:
                    offsets.setdefault(off, set()).add(q)
                best = min(offsets, key=lambda o: (-len(offsets[o]), o))
                slots = {(a, f) for _, off, asked, found in met if off == best for a, f in zip(asked, found, strict=True) if a[0]}
                if len({a for a, _ in slots}) == len(slots):
                    out.setdefault((d, i), (reading, len(windows), matched, len(slots), all(a == f for a, f in slots)))
    return {key: v[1:] for key, v in out.items()}


def test_decontamination_against_a_plain_version(spark):
    rng = random.Random(7)
    vocabulary = ["the", "cat", "sat", "on", "mat", "and", "é", "John", "Smith", "MARY", "Anna", "A", "12", "3.5", "1/2/3", "7 km", "8kg", "9  Min", "2 hours,", "mat.", "Then", "1,", "2."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(6, 14))) for i in range(12)]
    docs = []
    for i in range(150):
        words = rng.choice(items)[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        docs.append((i, text(3) + " " + " ".join(words) + " " + text(3)))
    got = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = plain_contaminated(docs, items)
    assert len(expected) > 30
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["n_slots"], r["verbatim"]) for r in got} == expected


# -- shards


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i % 300 if i % 50 else None, None if i % 17 == 0 else f"text {i} " * (i % 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).repartition(4)
    got = sharding.shard_documents(df, str(tmp_path / "s"), arrivals=3, shard_rows=100, target_bytes=60_000)
    assert got.count() == 4000
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 60_000)
    assert store.version() >= 3 and sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    first = store.manifest(1)
    assert len(store.manifest()) < len(first) * 3 and {s["file"] for s in store.manifest()} != {s["file"] for s in first}
    per = {r["shard"]: (r["n"], r["shard_rows"]) for r in got.groupBy("shard", "shard_rows").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n == m for n, m in per.values()) and len(per) == len([s for s in store.manifest()])


def test_a_taken_version_is_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.manifest() == []
    assert store.append(spark.createDataFrame([(1, "a")], DOCS), 10) == 1
    before = store.manifest()
    with pytest.raises(FileExistsError):
        store.commit([], 0)
    assert store.version() == 1 and store.manifest() == before and store.compact() == 1


def test_sharding_an_empty_table(spark, tmp_path):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), str(tmp_path / "s")).count() == 0


def test_old_versions_stay_readable_until_they_are_vacuumed(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 60_000)
    rows = [(i, f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    store.append(df.filter("doc_id < 200"), 20)
    first = store.read(1)
    store.append(df.filter("doc_id >= 200"), 20)
    assert store.compact() == 3 and len(store.manifest()) < len(store.manifest(2))
    assert first.count() == 200 and store.read(1).count() == 200 and store.read(2).count() == store.read().count() == 400
    orphan = tmp_path / "s" / "data" / "lost" / "part-0.parquet"
    orphan.parent.mkdir()
    orphan.write_bytes(b"x")
    gone = store.vacuum(keep=2)
    assert store.versions() == [2, 3] and orphan.exists() and gone == []  # version 2 has the files of version 1
    assert store.read(2).count() == 400
    with pytest.raises(ValueError, match="not kept"):
        store.read(1)
    gone = store.vacuum(keep=1, grace=0)
    assert "data/lost/part-0.parquet" in gone and not orphan.exists() and store.read().count() == 400 and store.versions() == [3]
    assert len(gone) > 20 and store.vacuum(keep=1, grace=0) == []


def test_a_compaction_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), 60_000)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], DOCS)
    store.append(df, 10)
    before = store.manifest()
    with monkeypatch.context() as m:
        m.setattr(sharding.ShardStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.compact()
    assert store.version() == 1 and store.manifest() == before and store.read().count() == 100
    assert store.compact() == 2 and store.read().count() == 100


def test_writers_that_come_second_start_again(spark, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, str(tmp_path / "s"), 60_000) for _ in range(2))
    one = lambda i: spark.createDataFrame([(i, "x")], DOCS)
    for i in range(3):
        store.append(one(i), 10)
    merge = sharding.ShardStore._merge

    def late(self, run):
        other.append(one(9), 10)
        return merge(self, run)

    monkeypatch.setattr(sharding.ShardStore, "_merge", late)
    assert store.compact() == 5 and sorted(r["doc_id"] for r in store.read().collect()) == [0, 1, 2, 9]

    def taken(self, run):
        monkeypatch.setattr(sharding.ShardStore, "_merge", merge)
        other.compact()
        return merge(self, run)

    other.append(one(10), 10)
    monkeypatch.setattr(sharding.ShardStore, "_merge", taken)
    assert store.compact() == other.version() and sorted(r["doc_id"] for r in store.read().collect()) == [0, 1, 2, 9, 10]


def test_tiers():
    store = sharding.ShardStore.__new__(sharding.ShardStore)
    store.target, store.fanout = 64_000, 4
    assert [store.tier(n) for n in (70_000, 32_001, 32_000, 16_000, 15_000, 1_000, 0)] == [0, 0, 1, 1, 2, 3, 8]


# -- very long words


@pytest.mark.parametrize("word", ["and", "nd", "a", "ab", "the", "é", "=", "aB3"])
def test_very_long_words(reference, word):
    replay = bpe.load(PATH)
    for n in (400, 3_000):
        text = word * n
        encoder = bpe.Encoder(replay, public_tokenizers.PATTERN)
        assert encoder.tokens(encoder.encode_block([text])[0].tolist()) == reference.encode_ordinary(text)


def test_a_word_of_a_megabyte_takes_seconds():
    begun = time.time()
    replay = bpe.load(PATH)
    ids = replay.encode([b"and" * 300_000])[0]
    assert b"".join(replay.bytes_of[i] for i in ids.tolist()) == b"and" * 300_000 and time.time() - begun < 10


# -- classifiers against plain versions


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(64, 6, replace=False)), rng.normal(size=6)) for _ in range(60)]
    y = np.array([int(v.sum() > 0) for _, v in rows])
    model = quality.Ftrl(bits=6, epochs=2)
    weights, bias = model.fit(rows, y, seed=5)
    z, n, order = {}, {}, np.random.default_rng(5)
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= model.l1 else -(z[k] - np.sign(z[k]) * model.l1) / ((model.beta + n[k] ** 0.5) / model.alpha + model.l2)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            x = dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True))
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-(bias + sum(w[k] * x[k] for k in x))))
            for k, v in x.items():
                g = (p - y[r]) * v
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / model.alpha
                z[k], n[k] = z.get(k, 0.0) + g - sigma * w[k], n.get(k, 0.0) + g * g
    assert np.allclose(weights, [weight(k) if k in z else 0.0 for k in range(64)], atol=1e-6)


def test_the_quality_stage_keeps_columns_whatever_their_names(spark):
    rows = [(i, "a fine text about rivers and hills" if i % 2 else "buy now!!! $$$ 0000", f"own {i}", i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, `Held_Out` long, predicted string").withColumn("Score2", F.lit(1))
    df = df.withColumnRenamed("Score2", "_score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out = quality.drop_low_quality(df, labels)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    scored = quality.quality_scores(df.withColumnRenamed("score", "Score"), labels)
    assert scored.columns == ["doc_id", "text", "_score", "held_out", "score", "predicted"] and scored.count() == 60


def test_the_training_sample_is_bounded(spark):
    from thalweg.llm.labelled import labelled_sample

    df = spark.createDataFrame([(i % 50, f"{i:03d} " + "word " * (5_000 if i == 7 else 10)) for i in range(500)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    texts, y = labelled_sample(df, labels, "quality", 4, 2, 1_000)
    assert 30 < len(texts) <= 50 and len(y) == len(texts)  # one text for each id, the smallest
    few, _ = labelled_sample(df, labels, "quality", 4, 2, 1_000, train_bytes=600)
    assert 0 < len(few) and sum(map(len, few)) <= 600 and set(few) <= set(texts)


def test_training_texts_stay_on_the_executors(spark, monkeypatch):
    from thalweg.llm.labelled import labelled_sample

    docs, labels = labelled(spark, 60)
    texts, y = labelled_sample(docs, labels, "quality", quality.FOLDS, quality.HELD_OUT, quality.TRAIN_ROWS)
    expected = quality.Ftrl().fit([quality.features(t, quality._Tokens()) for t in texts], y)
    frame, taken = type(docs), []
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: taken.append(self.columns) or f(self))
    weights, bias = quality.fit_quality(docs, labels)
    assert taken and not any("text" in columns for columns in taken)
    assert np.array_equal(weights, expected[0]) and bias == expected[1] and np.any(weights)
