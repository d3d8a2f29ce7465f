"""Operators do the whole job: long texts, all tiles, real outputs."""

import gzip
import hashlib
import random
from base64 import b32encode

from foliometry.llm import decontaminate, langid, suffix_dedup, warc


def prose(lang, n, seed):
    """About ``n`` characters of an invented language of five hundred words."""
    made = random.Random(lang)
    words = ["".join(made.choice("aeiourstlnmdgcp") for _ in range(made.randint(2, 9))) for _ in range(500)]
    rng = random.Random(seed)
    out, size = [], 0
    while size < n:
        out.append(words[min(int(rng.expovariate(1 / 90)), 499)])
        size += len(out[-1]) + 1
    return " ".join(out)[:n]


def encoders():
    return langid.Model({lang: prose(lang, 20_000, "dictionary").encode() for lang in ("en", "fr", "de")}).encoders()


def test_a_long_text_of_one_language_is_accepted():
    langs, _, rejected = langid.classify([prose("en", n, 1) for n in (2_000, 200_000, 3_000_000)], encoders())
    assert langs == ["en"] * 3 and rejected == [False] * 3


def test_every_part_of_a_text_counts_alike():
    pairs = [("fr", 100_000, "en", 300_000), ("de", 40_000, "en", 200_000), ("fr", 5_000, "en", 40_000), ("en", 40_000, "fr", 5_000), ("en", 30_000, "de", 90_000)]
    langs, _, rejected = langid.classify([f"{prose(a, m, 1)} {prose(b, n, 2)}" for a, m, b, n in pairs], encoders())
    assert langs == ["en", "en", "en", "en", "de"] and not any(rejected)


def test_dictionaries_are_learned_from_any_place_of_a_text(spark):
    docs = spark.createDataFrame([(i, f"{'head ' * 2_000}{'body ' * 2_000}{'tail ' * 2_000}", "en") for i in range(40)], "doc_id long, text string, lang string")
    content = langid.fit(docs).content["en"]
    assert all(word in content for word in (b"head", b"body", b"tail")) and len(content) <= langid.DICT_BYTES
    short = spark.createDataFrame([(1, "short text", "en")], "doc_id long, text string, lang string")
    assert langid.fit(short).content == {"en": b"short text"}


def test_the_free_rest_of_a_match_is_tiled():
    p = list(range(15))
    text = [*range(5, 11), *range(90, 95), *range(6)]
    assert sorted(decontaminate.tiles(p, text)) == [(0, 11, 5), (5, 0, 6)]
    # in a longer item, fragments of six to nine words that share some
    long = list(range(30))
    text = [*range(9), 91, *range(4, 13), 92, *range(8, 17), 93, *range(17, 23)]
    assert sum(k for _, _, k in decontaminate.tiles(long, text)) == 9 + 8 + 6  # 0 to 8, 9 to 16, 17 to 22
    assert no_match_is_left(p, [*range(5, 11), *range(6)]) and no_match_is_left(long, text)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(60))] for _ in range(2))
        assert no_match_is_left(a, b)


def no_match_is_left(pattern, text):
    """Whether no five unmarked successive tokens are common to both."""
    a, b = list(pattern), list(text)
    for i, j, k in decontaminate.tiles(pattern, text):
        a[i : i + k], b[j : j + k] = [None] * k, [None] * k
    fives = [{tuple(x[i : i + 5]) for i in range(len(x) - 4) if None not in x[i : i + 5]} for x in (a, b)]
    return not fives[0] & fives[1]


def test_overlapping_fragments_contaminate(spark):
    p = [f"w{i}" for i in range(15)]
    docs = spark.createDataFrame([(1, " ".join([*p[5:11], "and", "so", *p[:6]]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(p))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_tiles, r.covered) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 7, 2, 11)]
    assert decontaminate.clean(docs, bench).count() == 0


def test_suffix_dedup_gives_texts_and_spans(spark):
    a, b, odd = "first passage " * 5, "zweite Stelle mit Umlauten äöü " * 3, "é" * 60
    texts = [a + odd, "new_" + a + "words", None, b, "x" + b + "y" + a, "", odd[:30] + "tail"]
    docs = spark.createDataFrame([*enumerate(texts), (None, b)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(docs).collect()}
    for i, text in [*enumerate(texts), (None, b)]:
        raw = (text or "").encode()
        for s in reversed(got[i].spans):
            raw = raw[: s.start] + raw[s.start + s.length :]
        assert bytes(got[i].kept) == raw
    assert bytes(got[1].kept) == b"new_words" and [tuple(s) for s in got[1].spans] == [(4, len(a))]
    assert bytes(got[4].kept) == b"xy" and len(got[4].spans) == 2 and got[0].spans == [] and bytes(got[None].kept) == b""
    assert bytes(got[6].kept) == b"tail"


def test_warc_query_assembles_bodies(spark, monkeypatch):
    html = ["<p>a</p>", "é" * 50, "", "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    seen, assemble = [], warc.assemble
    monkeypatch.setattr(warc, "assemble", lambda records: seen.append(assemble(records)) or seen[-1])
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert sorted(r.response.body for r in seen[0].where("response.type = 'response'").collect()) == sorted(h.encode() for h in set(html))
    digest = lambda text: b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert [(got[i].payload_bytes, got[i].payload_digest) for i in range(4)] == [(len(h.encode()), digest(h)) for h in html]
    other = seen[0].withColumn("response", seen[0]["response"].withField("body", warc.F.lit("other")))
    assert {(r.payload_bytes, r.payload_digest) for r in other.select(*warc.columns_of(other)).where("record_type = 'response'").collect()} == {(5, digest("other"))}


def foreign(kind, block, *headers, length=None):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *headers, f"content-length:{len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>\xff\xfe caf\xe9 WARC/1.0 within</p>"
    records = [
        foreign("warcinfo", b"software: other\r\n"),
        foreign("response", page, "WARC-Record-ID: <urn:1>", "WARC-Target-URI: http://a/", "Content-Type: application/http"),
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:2>\r\n\r\nno length\r\n\r\n",
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Record-ID: <urn:3>", "WARC-Concurrent-To: <urn:1>"),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Record-ID: <urn:4>", "WARC-Refers-To: <urn:1>"),
        foreign("response", b"10 IN A 1.2.3.4", "WARC-Record-ID: <urn:5>", "Content-Type: text/dns"),
        foreign("metadata", b"cut", "WARC-Record-ID: <urn:6>", length=999),
    ]
    whole = b"".join(records)
    for name, data in (("members", b"".join(map(gzip.compress, records))), ("one", gzip.compress(whole)), ("torn", gzip.compress(whole)[:-20]), ("empty", b"")):
        found = list(warc.parse(data))
        assert [r["warc-type"] for r in found][:6] == ["warcinfo", "response", "broken", "request", "revisit", "response"][: len(found)], name
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    assert [r["warc-type"] for r in warc.parse(whole)][-1] == "broken"
    rows = warc.read_archives(spark, str(tmp_path / "members.warc.gz")).collect()
    by = {r.record_id: r for r in rows if r.record_id}
    body = page.partition(b"\r\n\r\n")[2]
    assert bytes(by["<urn:1>"].body) == body and by["<urn:1>"].payload_bytes == len(body)
    assert by["<urn:1>"].computed_digest == b32encode(hashlib.sha1(body).digest()).decode()
    assert by["<urn:4>"].payload_bytes is None and bytes(by["<urn:5>"].body) == b"10 IN A 1.2.3.4"
    captures = {r.capture_id: r for r in warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()}
    assert captures["<urn:1>"].request.record_id == "<urn:3>" and captures["<urn:4>"].metadata is None


def test_a_large_record_is_read_in_pieces():
    block = bytes(range(256)) * 20_000
    data = gzip.compress(foreign("response", block)) + gzip.compress(foreign("request", b"x"))
    assert [r["block"] for r in warc.parse(data)] == [block, b"x"]
