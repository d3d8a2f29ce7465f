"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
import xxhash

from foliometry.llm import chat, decontaminate, jaccard, langid, packing, pii, quality, sharding, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part string, grp string, shard double, bucket int, word string, other string"
WORDS = "the of and to in that is was for it with as his on be at by".split()


def rows_of(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, "en", None, None, 1, "x", None, 0.5, 3, "y", "z") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, one word, copies, near copies, a long text, repeated rows, a null id."""
    rng = random.Random(5)
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(120))
    near = base.replace(base.split()[60], "changed")
    long = " ".join(rng.choice(WORDS) for _ in range(9_000)) + base
    texts = [None, "", "one", "  \n\t ", base, base, near, "One", long, "é" * 400, base[:300], "pre " + base[100:260] + " post", base, "tail", None, "é" * 399 + "x"]
    ids = [*range(len(texts) - 3), 12, None, 14]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


def brute_removed(rows, length):
    big = 1 << 63
    rows = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    first = defaultdict(lambda: big + 1)
    for i, t in rows:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first[t[p : p + length]], i)
    out = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[None if i == big else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [3, 16_384])
def test_suffix_dedup(spark, odd, none, monkeypatch, hot):
    for name in ("CHUNK_BYTES", "ANCHOR_BUCKET", "SUFFIX_BUCKET"):
        monkeypatch.setattr(suffix_dedup, name, 20_000)
    monkeypatch.setattr(suffix_dedup, "HOT_RECORDS", hot)
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(odd).collect())
    assert got == brute_removed([(r.doc_id, r.text) for r in odd.collect()], 50)
    assert suffix_dedup.deduplicate(none).collect() == []


def test_suffix_dedup_random(spark, monkeypatch):
    for name in ("CHUNK_BYTES", "ANCHOR_BUCKET", "SUFFIX_BUCKET"):
        monkeypatch.setattr(suffix_dedup, name, 3_000)
    rng = random.Random(11)
    passages = ["".join(rng.choice("abc \0") for _ in range(rng.randint(40, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.6 else "ab" * rng.randrange(40) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(docs).collect())
    assert got == brute_removed(list(enumerate(texts)), 50)


def test_pii(spark, odd, none):
    texts = ["mail a.b@c.org, 10.0.0.1", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", "call +1 (212) 555-0100.", None, "", "nothing here"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for _, r in sorted(got.items())] == [(1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0,) * 4, (0,) * 4, (0,) * 4]
    assert got[0].spans.startswith("email:5:14,ip:16:24") and got[3].spans == ""
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(odd).count() == odd.count() and pii.find(none).collect() == []
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    found = {r.doc_id: r.text for r in clean.collect()}
    assert found[0] == "mail [EMAIL], [IP]" and found[3] is None and found[5] == "nothing here"


def test_em_weighs_labelers():
    counts = {("phone", "yyy-yy"): 80, ("phone", "yy--yy"): 60, ("phone", "n--nn-"): 70, ("phone", "n---n-"): 40, ("phone", "yn--y-"): 5}
    model = pii.train(counts)
    assert model.score("phone", "yyy-yy") > 0.9 > 0.2 > model.score("phone", "n--nn-")
    assert model.accuracy["phone"][0] > 0.9 and model.score("card", "yyyyyy") == 0.0


def test_decontamination(spark, odd, none):
    a = "Alpha beta gamma delta epsilon zeta eta theta iota kappa, lambda mu nu xi omicron pi."
    parts = a.split(", ")
    bench = spark.createDataFrame([(1, a, 1), (2, "too short", 2), (3, None, 3), (None, "", 4)], "item_id long, text string, seeds int")
    texts = [f"x {a.lower()} y", f"{parts[1]} and then {parts[0]}", "alpha beta gamma delta epsilon only", None, "clean text of other words in it", f"x {a.lower()} y"]
    docs = spark.createDataFrame(rows_of(texts, [0, 1, 2, 3, 4, 0]), SCHEMA)
    got = collected(decontaminate.contaminated(docs, bench))
    assert sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in got) == [(0, 1, 1, 1.0), (1, 1, 2, 1.0)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.contaminated(none, bench).collect() == [] and decontaminate.contaminated(docs, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert decontaminate.clean(odd, bench).count() == odd.count()


def test_warc(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>\r\n\r\nWARC/1.0\r\n", "é" * 50, "<p>a</p>", "<p>a</p>", "<p>a</p>"]
    ids = [5, 1, 2, 3, -4, 9, 5, None]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i} \n", h, "k") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, digest string")
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    expected = Counter()
    smallest = {}
    for i, h in zip(ids, html, strict=True):
        smallest[h or ""] = min(smallest.get(h or "", math.inf), math.inf if i is None else i)
    for i, h in zip(ids, html, strict=True):
        raw = (h or "").encode()
        first = smallest[h or ""]
        digest = warc.b32encode(hashlib.sha1(raw).digest()).decode()
        expected[i, len(raw), digest, *(("response", None) if i == first else ("revisit", first)), 3] += 1
    assert got == expected
    assert warc.round_trip(pages.where("false")).collect() == []
    path = warc.shared_path(spark, "test")
    warc.write_archives(pages, path)
    whole = warc.assemble(warc.read_archives(spark, path)).select("response.*", "request", "metadata").collect()
    bodies = [r.body for r in whole if r.type == "response"]
    assert sorted(bodies) == sorted(x.encode() for x in [*["<p>a</p>"] * 2, "", html[3], html[4]])
    assert all(r.request.body.startswith(b"GET ") and r.metadata.body.startswith(b"payloadLength") for r in whole)


def test_packing(spark, odd, none):
    own = packing.tokens(*packing.public_vocabulary())
    pieces = collected(packing.pack(odd, length=64))
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append([*own.plain(r.text or ""), 1])
    sequences = defaultdict(list)
    for p in pieces:
        assert crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    for doc_id, expected in texts.items():
        mine = [p for p in pieces if p["doc_id"] == doc_id]
        assert sum(p["length"] for p in mine) == sum(map(len, expected))
        if len(expected) == 1:
            mine.sort(key=lambda p: p["start"])
            assert memoryview(b"".join(p["ids"] for p in mine)).cast("I").tolist() == expected[0]
    assert packing.pack(none).collect() == []


def test_packing_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", 4_000)
    rng = random.Random(2)
    docs = spark.createDataFrame(rows_of([" ".join(rng.choice(WORDS) for _ in range(rng.randrange(200))) for _ in range(80)]), SCHEMA)
    pieces = collected(packing.pack(docs, length=128))
    size = Counter()
    for p in pieces:
        size[p["sequence_id"]] += p["length"]
    assert Counter(p["doc_id"] for p in pieces).keys() == set(range(80))
    assert sum(n < 128 for n in size.values()) <= len({s >> 40 for s in size})


def python_quality(text, trusted, every, buckets):
    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
        return [(x - (1 << 64) * (x >> 63)) % buckets for x in h + pairs]

    good, raw = (Counter(g for t in ts for g in grams(t)) for ts in (trusted, every))
    ratio = lambda b: math.log((good[b] + 1) / (good.total() + buckets)) - math.log((raw[b] + 1) / (raw.total() + buckets))
    mine = grams(text)
    return sum(map(ratio, mine)) / max(1, len(mine))


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0, "q"), (8, 1, 1, "q"), (6, 0, 0, "q"), (None, 1, None, "q"), (11, 1, None, "q")], "doc_id long, quality int, toxic int, text string")
    rows = odd.collect()
    trusted = [r.text or "" for r in rows if r.doc_id in (4, 11)]
    every = [r.text or "" for r in rows]
    got = collected(quality.assess(odd, labels, threshold=0.0))
    assert len(got) == len(rows)
    expected = []
    for row in rows:
        text = row.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        score = python_quality(text, trusted, every, quality.BUCKETS)
        symbols = sum(c in "#*$%&|<>" for c in text)
        expected.append((row.doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and score >= 0, round(score, 8)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter((*(r[n] for n in names), round(r["score"], 8)) for r in got) == Counter(expected)
    assert quality.assess(none, labels).collect() == []
    assert {r["score"] for r in collected(quality.assess(odd, labels.where("false")))} == {0.0}


def test_language_id(spark, none):
    vocabulary = {"en": WORDS, "de": "der die das und nicht mit ein ist auf für".split(), "fr": "le la les et des un une est dans pour".split()}
    rng = random.Random(9)
    rows = []
    for i in range(240):
        lang = rng.choice(list(vocabulary))
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) for _ in range(60)), lang, "src"))
    rows += [(900, None, "en", None), (901, " 12 ?!", "de", None), (902, "", None, None), (None, "the of and to in that is was for it with", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].held_out == (crc32(str(i).encode()) % 4 == 2) for i in range(240))
    held = [(got[i].lang_pred, rows[i][2]) for i in range(240) if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 0
    assert langid.identify(none).collect() == [] and langid.fit(none).content == {}


def brute_components(rows, words, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}
    find = lambda i: i if up[i] == i else find(up[i])
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize(("words", "num", "part"), [(3, 90, 1 << 21), (5, 80, 150)])
def test_jaccard(spark, odd, none, monkeypatch, words, num, part):
    monkeypatch.setattr(jaccard, "PART_SHINGLES", part)  # a small one cuts blocks into parts
    rng = random.Random(4)
    texts = []
    base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60)]
    for _ in range(14):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    docs = odd.unionByName(spark.createDataFrame(rows_of(texts, range(100, 114)), SCHEMA))
    got = Counter(tuple(r) for r in jaccard.linked_components(docs, words, num).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], words, num, 100)
    if words == 5:
        kept = jaccard.one_of_each(docs, words, num)
        roots = {c for i, _, c in got if c is not None}
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(roots)
        assert jaccard.linked_components(none, words, num).collect() == []


def test_chat(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), (None, None)]
    rows = [(1, k, *turns[k], "x") for k in range(2)] + [(2, k + 5, *turns[k], "x") for k in range(3)] + [(3, k, *turns[k], "x") for k in range(4)]
    rows += [(4, k, *turns[k], "x") for k in range(4)] + [(5, 0, "user", "", "x"), (6, 0, "user", None, "x"), (None, 0, "user", "z", "x"), (None, None, "user", "y", "x")]
    rows += [(7, k, "user", str(k % 7), "x") for k in range(600)] + [(8, k, "user", str(k % 7), "x") for k in range(599)]
    logs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = collected(chat.maximal_conversations(logs))
    assert sorted((r["conv_id"] or -1, r["segment"], r["n_turns"], r["n_copies"]) for r in got) == [(-1, 0, 2, 1), (3, 0, 4, 2), (5, 0, 1, 1), (6, 0, 1, 1), (7, 0, 600, 1), (7, 1, 600, 1), (7, 2, 600, 1)]
    shown = {(r["conv_id"], r["segment"]): r["rendered"] for r in got}
    assert shown[3, 0].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert shown[None, 0].startswith("<|im_start|>user\ny") and sum(v.count("<|im_start|>") for (c, _), v in shown.items() if c == 7) == 600
    assert chat.maximal_conversations(logs.where("false")).collect() == []


def test_sharding(spark, odd, none):
    got = collected(sharding.shard_documents(odd, 3))
    source = odd.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in source)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    home = defaultdict(set)
    for r in got:
        home[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values()) and {r["law"] for r in got} == {"bytes"}
    assert sharding.shard_documents(none).collect() == []


def test_sharding_is_even(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame(rows_of(["x" * rng.randrange(1, 4_000) for _ in range(3_000)]), SCHEMA)
    sizes = Counter()
    for r in sharding.shard_documents(docs).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.01 * max(sizes.values())


def test_sharding_places_groups_as_plain_best_fit_does(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["y" * rng.randrange(200) for _ in range(400)] + ["copy"] * 150 + [None, "", ""]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    groups = Counter(t or "" for t in texts)
    totals = sorted(((len(t) + 1) * n for t, n in groups.items()), reverse=True)
    capacity = sharding.fewest_bytes(list(Counter(totals).items()), 5).capacity
    bins, expected = [], Counter()
    for size in totals:
        fits = [(r, i) for i, r in enumerate(bins) if r >= size]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(max(capacity, size))
        bins[at] -= size
        expected[size, at] += 1
    for part_rows, most_runs in ((1 << 20, 1 << 18), (3, 0)):  # one part and a broadcast, and many parts and a shuffle
        monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
        monkeypatch.setattr(sharding, "BROADCAST_RUNS", most_runs)
        got = sharding.shard_documents(docs, 5).collect()
        shards = {(r.text_crc32, r.size, r.shard) for r in got}
        members = Counter((r.text_crc32, r.size) for r in got)
        assert Counter((size * members[crc, size], shard) for crc, size, shard in shards) == expected
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
