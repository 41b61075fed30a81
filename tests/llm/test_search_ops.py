"""WARC, URL filter, decontamination, packing, chat: round trips and brute force."""

import hashlib
import io
import json
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kerbline.llm import chat, contamination, packing, url_filter, warc


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/\n4", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", "line\r\n\r\nWARC/1.1\r\n" * 200)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string").repartition(2)
    got = {int(r["id"]): r for r in warc.round_trip(df).collect()}
    assert set(got) == {p[0] for p in pages}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i]["type"] == ("revisit" if i in (1, 2) else "response") and got[i]["refers_to"] == ("3" if i in (1, 2) else None)
        assert bytes(got[i]["payload"]) == (b"" if i in (1, 2) else raw)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_ids(spark):
    x, y, huge = "x" * 1500, "y" * 1500, "z" * 20_000_000
    pages = [(1, x), (1, y), (2, x), (3, y), (3, y), (4, huge), (None, x), (None, None)]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").repartition(2)
    got = sorted((r["id"], r["payload_digest"], r["type"], r["refers_to"]) for r in warc.round_trip(df, payloads=False).collect())
    of = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [("1", of(x), "revisit", "2"), ("1", of(y), "revisit", "3"), ("2", of(x), "response", None), ("3", of(y), "response", None), ("3", of(y), "response", None)]
    want += [("4", of(huge), "response", None), ("None", of(x), "response", None), ("None", of(None), "response", None)]
    assert [str(g) for g in got] == [str(w) for w in sorted(want)]


def test_encoder_matches_tokenizers():
    import random

    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng, bits = random.Random(1), ["a", "The", " ", "  ", "\n", "\t", "é", "ß", "12", "!!", "'s", "'LL", "\u00a0", "\u3000", "日本", "\U0001f600", "\x00", "\r\n", "_", "$$$"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), text


def test_warc_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", "p" * (i * 7)) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    made = warc.write_archives(df, f"file://{tmp_path}/whole")
    warc.normalise(made, f"file://{tmp_path}/whole", f"file://{tmp_path}/single")
    name = made.first()["name"]
    whole, single = (tmp_path / "whole" / name).read_bytes(), (tmp_path / "single" / name).read_bytes()
    unzip = zlib.decompressobj(31)
    plain = unzip.decompress(whole)
    assert unzip.eof and not unzip.unused_data  # one member
    index = [json.loads(x) for x in (tmp_path / "single" / (name + ".idx")).read_text().splitlines()]
    assert len(index) == 50 and b"".join(zlib.decompress(single[x["offset"] : x["offset"] + x["length"]], 31) for x in index) == plain
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(whole[:-20])))
    with pytest.raises(ValueError):
        list(warc.parse_records(iter([plain[:-30]])))


def test_urls_match_plain_rules(spark):
    urls = ["http://A.Example.com/en/7x?q", "http://example.com/en/8", "https://com/en/", "http://notexample.com/en/7", "http://x.example.net/de/8", "http://x.example.net/de/9#f", "http://y.org/es/", "http://y.org/esx", None, "no scheme", "://", "http://h?x://y/en/", "http://casino.example.com/win/jackpot", "http://library.example.com/guide/index.html", "ftp://com.evil/en/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    for r in url_filter.judge(df, labelled).collect():
        u = urls[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [x for x in url_filter.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1] + best[2])
        assert r["verdict"] == (best[0] if best else "block" if r["score"] >= 0.5 else "allow")
    got = {r["page_id"]: r["score"] for r in url_filter.judge(df, labelled).collect()}
    assert got[12] > 0.5 > got[13]
    assert url_filter.judge(df.limit(0), labelled).count() == 0
    with pytest.raises(ValueError):
        url_filter.fit(labelled.limit(0))


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_matches_brute_force(spark):
    a = " ".join(f"w{i}" for i in range(14))
    items = [(1, a), (2, "Short one, here."), (3, None), (4, ""), (5, "é ß"), (6, "the " * 12), (7, a)]
    texts = ["pre " + a.upper() + " post", "w0 w1 w2 w3 w4 w5 w6 w7 w8 x w10", "a SHORT-one  here? short one here", "the " * 15, None, "", "...", "é\x00ß", " ".join(f"w{i}" for i in range(2, 12)), "short one", "x " * 3000 + a]
    docs = spark.createDataFrame([(i, t, "l", 0) for i, t in enumerate(texts)] + [(None, a, "l", 0)], "doc_id long, text string, term string, pos int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, hits = contamination.decontaminate(docs, bench)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in enumerate(texts):
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            for win in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for at in range(len(w) - len(win) + 1):
                    if tuple(w[at : at + len(win)]) == win:
                        hit.update(range(at, at + len(win)))
                        found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["item_ids"]), got[i]["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit)), i
    assert got[None]["n_hit"] == 0
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert contamination.decontaminate(d, b)[0].where("contaminated").count() == 0


def test_repeated_rows_are_contaminated(spark):
    a = " ".join(f"w{i}" for i in range(14))
    texts = [(1, "x " + a + " y")] * 3 + [(2, "one two three. one two three")] * 2 + [(3, "lone")] * 2 + [(4, "none")] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, a), (2, "one two three"), (3, "lone")], "item_id long, text string")
    rows, hits = contamination.decontaminate(docs, bench)
    got = sorted((r["doc_id"], r["n_hit"], r["n_items"]) for r in rows.collect())
    assert got == [(1, 14, 1)] * 3 + [(2, 6, 1)] * 2 + [(3, 1, 1)] * 2 + [(4, 0, 0)] * 2
    assert hits.count() == hits.distinct().count() == 5 + 2 + 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 9 + "beta gamma"), (4, "alpha beta")], "doc_id long, text string")
    wanted = spark.createDataFrame([("k", ["alpha", "beta", "gamma"])], "key string, terms array<string>")
    index = contamination.build_index(docs)
    assert sorted(r["doc"] for r in contamination.near(index, wanted, 5).collect()) == [1, 2]
    assert [r["at"] for r in contamination.phrases(index, spark.createDataFrame([("p", ["beta", "alpha"])], "key string, terms array<string>")).collect()] == [1]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_equals_tokenizers(tokenizer):
    encode = packing.Encoder(tokenizer)
    odd = ["a  b\n c", "  x\n\n y  ", "'s don't I'LL \n", "a\xa0\xa0  b", "<|endoftext|> hi<|endoftext|>", "é\t\tü \r\n z ", " ", "\n", "日本 語  !!  ?", "a\x1c \x1cb", "x" * 3000, "\u2028 a\x00b"]
    for t in odd:
        assert encode(t) == b"".join(int(i).to_bytes(4, "little") for i in encode.tokenizer.encode(t, add_special_tokens=False).ids), t


def test_packing_is_whole(spark, tokenizer):
    texts = ["hello world " * n for n in (1, 3, 40, 600, 1100)] + ["", None, "hello world "] * 5
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, length string").repartition(3)
    pieces = packing.tokenise(docs, tokenizer)
    out = packing.pack(pieces).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["id"]].append(r)
    encode = packing.Encoder(tokenizer)
    for i, t in enumerate(texts):
        ids = (encode(t) if t else b"") + (2).to_bytes(4, "little")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids and [r["length"] for r in own[1:]] == [1024] * (len(own) - 1)
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own)
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(seqs) == -(-sum(r["length"] for r in out) // 1024)
    assert packing.pack(packing.tokenise(docs.limit(0), tokenizer)).count() == 0


def test_local_search_empties_bins():
    start = Counter({(6, 3): 2, (5, 3): 2, (4,): 1})  # 38 of size 10: swaps reach four bins
    done = packing.local_search(start, 10)
    flat = lambda bins: Counter(x for p, c in bins.items() for _ in range(c) for x in p)
    assert flat(done) == flat(start) and all(sum(p) <= 10 for p in done)
    assert sum(sum(p) ** 2 * c for p, c in done.items()) >= sum(sum(p) ** 2 * c for p, c in start.items()) and sum(done.values()) <= sum(start.values())
    counts = {n: 3 for n in range(1, 101)}
    packed = packing.local_search(packing.best_fit(counts, 100), 100)
    assert flat(packed) == Counter(counts) and sum(packed.values()) <= -(-sum(n * 3 for n in counts) // 100) + 1
    ranks = defaultdict(list)
    for n, lo, hi, _, _ in packing.places(packed):
        ranks[n].append((lo, hi))
    assert all([x for a, b in sorted(v) for x in range(a, b)] == [0, 1, 2] for v in ranks.values())


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "long answer"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "short"), (3, 0, "user", "alone"), (3, 1, "assistant", None), (4, 0, None, None), (None, 0, "user", "x"), (5, None, "user", "x"), (1, 1, "assistant", "long answer")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_pairs(chat.pair_up(chat.conversations(turns))).collect()}
    one = got[1]
    assert one["rejected_id"] == 2 and one["n_prompt_turns"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert [one["chosen_completion"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["long answer<|end|>", "yes<|end|>"]
    assert [one["rejected_completion"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["short<|end|>"]
    assert set(got) == {1, 2, 3, 4} and got[2]["rejected_id"] is None and got[3]["rejected_completion"] == "" and got[4]["prompt"] == ""
    copies = turns.where("conv_id = 2").crossJoin(spark.range(10, 40).withColumnRenamed("id", "k")).select(F.col("k").alias("conv_id"), "turn", "role", "text")
    linked = chat.pair_up(chat.conversations(copies)).where("rejected_id IS NOT NULL").select("pair_id", "rejected_id").collect()
    assert sorted(tuple(r) for r in linked) == [(k, k + 1) for k in range(10, 39)]
    assert chat.format_pairs(chat.pair_up(chat.conversations(turns.limit(0)))).count() == 0
