"""The corpus operators against plain versions and on awkward tables."""

import base64
import hashlib
import math
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from kerbline.llm import decontaminate, exact_dedup, language_id, line_dedup, mixing, queries, repeats, simhash, token_output, url_filter, warc
from kerbline.llm.common import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rid long, row string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeats, and columns with names that operators use."""
    long = " ".join(random.Random(1).choice(["alpha", "Beta", "gamma,", "delta"]) + str(i % 977) for i in range(30000))
    rows = [
        (1, "one two three four five six", "en", "a", 3, 9, 9, "x"), (2, "one two three four five six", "en", "a", 3, 9, 9, "x"), (2, "one two three four five six", "en", "a", 3, 9, 9, "x"),
        (3, None, None, None, None, None, None, None), (None, "one two three four five six", None, "b", 1, 1, 1, "y"), (None, None, "fr", "b", 1, 1, 1, "y"), (4, "", "fr", "b", 0, 0, 0, ""),
        (5, long, "en", None, 1, 1, 1, "z"), (6, long + " end", "en", "c", 1, 1, 1, "z"), (7, "123 !!\n\n  \n", "de", "c", 1, 1, 1, "z"), (8, "é ü 漢字　x", "de", "c", 1, 1, 1, "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_simhash(spark, sf, plain):
    assert got(queries.op3_simhash(spark, sf)) == sorted(brute.simhash(plain), key=repr)


def test_decontamination(spark, sf, plain):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op7_decontaminate(spark, sf)) == sorted(brute.contamination(plain, items), key=repr)


def test_decontamination_in_parts(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = decontaminate.contamination(docs, bench, keep_text=False)
    parts = decontaminate.contamination(docs, bench, keep_text=False, broadcast_windows=200)
    assert got(whole) == got(parts)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "Zip the CODE now"), (2, "zip code"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the code"), (2, "the code"), (None, "zip"), (4, None), (5, "!!")], "item_id long, text string")
    r = {x["row"]["doc_id"]: x for x in decontaminate.contamination(docs, bench, keep_text=False).collect()}
    assert r[1]["items"] == ["1", "2"] and [(s["first"], s["end"]) for s in r[1]["spans"]] == [(1, 3)]
    assert r[2]["items"] == [] and r[3]["n_words"] == 0


def test_repeats(spark, sf, plain):
    assert got(queries.op8_remove_repeats(spark, sf)) == sorted(brute.repeats(plain), key=repr)


@pytest.mark.parametrize("set_bytes", [repeats.SET_BYTES, 300])
def test_repeats_of_small_strings(spark, set_bytes):
    r = random.Random(3)
    parts = ["".join(r.choice("abé") for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 7)))) for i in range(120)] + [(7, None), (0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.remove_repeats(df, length=24, keep_text=False, set_bytes=set_bytes)
    have = got(found.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)))
    assert have == sorted(brute.repeats(rows, 24), key=repr)


def test_tokens(spark, sf, plain):
    assert got(queries.op6_token_output(spark, sf)) == sorted(brute.tokens(plain, queries.tokenizer_path()), key=repr)


def test_token_pieces():
    e = token_output.PieceEncoder(queries.tokenizer_path())
    r = random.Random(5)
    alphabet = list(" \n\t''.,!-abzAZ019éß×÷—½漢\xa0\r\x0bst<|>") + ["'s", "'ll", " the", "\n\n", "<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    assert [x.tolist() for x in e.encode_many(texts)] == e._ids(texts)


def test_token_pieces_are_told_apart_by_their_bytes(monkeypatch):
    e = token_output.PieceEncoder(queries.tokenizer_path())
    blocks = ["ab" * 2048, "cd" * 2048]
    texts = ["".join(blocks), "".join(blocks[::-1]), "x" * 9000, "".join(blocks), ""]
    assert [x.tolist() for x in e.encode_many(texts)] == e._ids(texts)
    # a text that is cut, and pieces that are forgotten
    monkeypatch.setattr(token_output, "BATCH_BYTES", 300)
    monkeypatch.setattr(token_output, "KEPT_PIECES", 50)
    r = random.Random(6)
    alphabet = list(" \n\t''.,!-abzAZ019éß×÷—½漢\rst<|>") + ["'s", "'ll", " the", "\n\n", "  ", "<|endoftext|>"]
    for _ in range(40):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(200, 4000)))
        assert [x.tolist() for x in e.encode_many([text])] == e._ids([text])


def test_token_rows_can_be_found(spark, docs):
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, queries.tokenizer_path())
    assert token_output.read_tokens(spark, path).where("doc_id = 17").count() == 1


def test_token_files_are_skipped(spark):
    """A filter on an id reads one row group (1,000 rows) of one file, of 6,000 rows in four; so does one on an id that lies within but isn't there."""
    path = fresh_path(spark, "tokens")
    docs = spark.range(6000).select((F.col("id") * 3).alias("doc_id"), F.lit("some text").alias("text"))
    token_output.write_tokens(docs, path, queries.tokenizer_path())
    for doc_id, rows in ((3000, 1), (3001, 0)):
        found = token_output.read_tokens(spark, path).where(F.col("doc_id") == doc_id)
        assert len(found.collect()) == rows
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
        assert read <= 1000 * rows, read


@pytest.mark.parametrize("route", [exact_dedup.wide_hash, F.xxhash64, lambda b: F.octet_length(b) % 3])
def test_exact_groups(docs, plain, route):
    rows = plain + [(1000, plain[5][1]), (1001, plain[5][1]), (1002, None), (1003, "")]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    want = [(d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    assert got(exact_dedup.exact_groups(df, block_bytes=64, route=route)) == sorted(want, key=repr)


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = pages.limit(3).withColumn("page_id", F.col("page_id") + 10_000).withColumn("url", F.lit(None).cast("string"))
    rows = pages.unionByName(extra).unionByName(spark.createDataFrame([(20_000, "http://x/\r\ny", None), (None, "http://z", "")], pages.schema))
    path = fresh_path(spark, "warc")
    warc.write_archive(rows, path)
    back = {r["page_id"]: r for r in warc.read_pages(spark, path).collect()}
    for r in rows.collect():
        b = back[r["page_id"]]
        assert bytes(b["payload"]) == (r["html"] or "").encode()
        head, _, body = bytes(b["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        if b"WARC-Type: response" in head:
            assert body[:-4] == bytes(b["payload"]) and f"Content-Length: {len(b['payload'])}".encode() in head
    records = {r["page_id"]: r for r in warc.read_records(spark, path).collect()}
    assert all(r["verified"] for r in records.values())
    first = rows.first()
    digest = base64.b32encode(hashlib.sha1(first["html"].encode()).digest()).decode()
    assert records[first["page_id"]]["payload_digest"] == digest
    assert records[0]["record_type"] == "revisit" and records[0]["refers_to"] == 10_000
    assert records[None]["record_type"] == "revisit" and records[None]["refers_to"] == 20_000
    assert spark.read.parquet(f"{path}/payloads").count() == len({r["html"] or "" for r in rows.collect()})


def test_mix_meets_its_targets(spark, sf):
    plan = [r.asDict() for r in queries.op2_mix_sources(spark, sf).collect()]
    sources = sorted({r["source"] for r in plan})
    total = sum(r["size"] for r in plan)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    size = {s: sum(r["size"] for r in plan if r["source"] == s) for s in sources}
    capped = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in sources:
        want = 3 * size[s] if s in capped else weight[s] * level
        mine = [r for r in plan if r["source"] == s]
        assert mine[0]["source_size"] == size[s] and math.isclose(mine[0]["target"], want, rel_tol=1e-9)
        assert abs(sum(r["taken"] for r in mine) - want) <= max(r["size"] for r in mine) / 2 + 1
        assert all(r["taken"] in (r["size"] * k for k in range(4)) for r in mine)
        assert len({r["copies"] for r in mine if r["size"]}) <= 2
    assert got(queries.op2_mix_sources(spark, sf)) == got(queries.op2_mix_sources(spark, sf))


def test_mix_equals_the_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    have = got(queries.op2_mix_sources(spark, sf).select("doc_id", "source", "size", "copies"))
    assert have == sorted(brute.mix(docs, labels), key=repr)


def test_mix_takes_what_the_plan_takes(spark):
    rows = [(None, "w " * 290, "s"), (None, "v " * 300, "t"), (7, "a b c", "t"), (7, "d e f g", "s"), (1, "p q", "s"), (1, "p q", "s"), (1, "p q", "s"), (2, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs).collect()
    for source in "st":
        want = sum(r["taken"] for r in plan if r["source"] == source)
        assert sum(len(r["text"].split()) for r in mixing.mix(docs).where(F.col("source") == source).collect()) == want
    # equal rows of which the plan takes some once more
    docs = spark.createDataFrame([(1, "p q", "s")] * 25 + [(2, "x " * 11, "t")], "doc_id long, text string, source string")
    copies = {s: sum(r["copies"] for r in mixing.plan_mix(docs).collect() if r["source"] == s) for s in "st"}
    assert {s: mixing.mix(docs).where(F.col("source") == s).count() for s in "st"} == copies and copies["s"] not in (25, 50, 75)


def test_rows_with_nulls_in_other_places_differ(spark):
    rows = [(1, "a b c d e f", None), (1, None, "a b c d e f"), (2, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len(got(simhash.one_of_each_group(docs))) == 3


def test_languages_equal_the_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {d for d, _, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    want = dict(zip([d for d, _, _ in docs], brute.language([(t, x) for d, t, x in docs if d not in held], [t for _, t, _ in docs])))
    for r in queries.op9_language_id(spark, sf).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and math.isclose(r["score"], want[r["doc_id"]][1], abs_tol=1e-9)
        assert r["held_out"] == (r["doc_id"] in held)


def test_languages_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    r = queries.op9_language_id(spark, d).join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and 0 <= r[1] and r[2] <= 1


def test_golay_keys_meet():
    import numpy as np

    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 800, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 800, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in r.choice(64, r.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    keys = []
    for x in (a, b):
        mine = [set() for _ in x]
        for i, k in zip(*(v.tolist() for v in simhash.fuzzy_keys(x.view(np.int64)))):
            mine[i].add(k)
        keys.append(mine)
    assert all(x & y for x, y in zip(*keys))


def test_large_key_sets_are_split(spark):
    base = 0x0123456789ABCDEF
    rows = [(base ^ (1 << i),) for i in range(60)] + [(base ^ (0xFF << 50),)]
    prints = spark.createDataFrame(rows, "fp long")
    whole = got(simhash.fingerprint_components(prints))
    assert whole == got(simhash.fingerprint_components(prints, part=5))
    assert len({c for _, c in whole}) == 1 and len(whole) == 60


def test_url_rules(spark):
    urls = ["http://A.example.org/es/x", "https://example.org/en/12?x", "http://b.org/q", "http://x.com/fr/1", "http://com/de/", "http://notcom.net/de/", "nothing", None, "ftp://org", "http://x.org?/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = {x["page_id"]: x for x in url_filter.judge_urls(pages, labels).collect()}
    assert [r[i]["rule"] for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None]
    assert (r[0]["host"], r[0]["path"], r[0]["verdict"]) == ("a.example.org", "/es/x", "block") and (r[7]["host"], r[7]["path"]) == ("", "")
    assert r[9]["path"] == ""


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    r = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert all(x["verdict"] == ("block" if "/bad/" in x["path"] else "allow") for x in r)
    assert {x["template"] for x in r} <= {"/bad/*", "/good/*", "/*/*"}


def test_line_dedup_small(spark):
    rows = [(i, "s", f"menu\nonly {i}\n\nmenu") for i in range(4)] + [(9, None, "menu"), (10, "t", "menu\nx")]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    r = {x["row"]["doc_id"]: x for x in line_dedup.drop_boilerplate(df, ratio=0.5).collect()}
    assert r[0]["kept_text"] == "only 0\n" and r[0]["n_dropped"] == 2 and r[9]["kept_text"] == "menu" and r[10]["kept_text"] == "menu\nx"
    for hot in (0.0, 0.5, 1.0):
        joined = line_dedup.drop_boilerplate(df, ratio=0.5, broadcast_lines=0, hot=hot)
        assert {x["row"]["doc_id"]: x["kept_text"] for x in joined.collect()} == {k: v["kept_text"] for k, v in r.items()}


def test_lines_of_pages(spark):
    html = "<p>Menu</p>\nText <b>bold</b><!-- no\nline --><SCRIPT>a<b</SCRIPT><br>end"
    assert spark.range(1).select(line_dedup.html_text(F.lit(html))).first()[0] == "\nMenu\n\nText \nbold\n\nend"


def operators(df, spark):
    bench = spark.createDataFrame([(1, "three four five six"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    yield exact_dedup.exact_groups(df)
    yield simhash.near_duplicates(df, keep_text=True)
    yield simhash.one_of_each_group(df)
    yield decontaminate.contamination(df, bench)
    yield repeats.remove_repeats(df)
    yield language_id.identify(df, language_id.fit(df))
    yield line_dedup.drop_boilerplate(df, "source")
    yield mixing.plan_mix(df, labels)
    yield mixing.mix(df, labels)
    yield url_filter.judge_urls(df.withColumns({"page_id": F.col("doc_id"), "url": F.col("text")}), labels)
    path = fresh_path(spark, "odd")
    warc.write_archive(df, f"{path}/w", "doc_id", "lang", "text")
    yield warc.read_records(spark, f"{path}/w")
    yield warc.read_pages(spark, f"{path}/w")
    token_output.write_tokens(df, f"{path}/t", queries.tokenizer_path())
    yield token_output.document_index(spark, f"{path}/t")


def test_awkward_rows(odd, spark):
    n = odd.count()
    groups, near, kept, found, cleaned, langs, lines, plan, mixed, urls, records, pages, index = [x.collect() for x in operators(odd, spark)]
    for rows in (groups, near, found, cleaned, langs, lines, plan, urls, records, pages, index):
        assert len(rows) == n
    by = {(r["doc_id"], r["text_sha256"]): r for r in groups}
    one = hashlib.sha256(b"one two three four five six").hexdigest()
    assert by[1, one]["keep_id"] == 2 and by[1, one]["group_size"] == 4 and sum(r["kept"] for r in groups if r["text_sha256"] == one) == 1
    assert sum(r["kept"] for r in groups if r["text_sha256"] == hashlib.sha256(b"").hexdigest()) == 1
    assert len({r["group"] for r in near}) == len(kept)
    assert {r["row"]["doc_id"] for r in found if r["spans"]} == {1, 2, None}
    assert all(r["n_removed"] > 0 for r in cleaned if r["row"]["doc_id"] in (5, 6))
    assert {r["lang_pred"] for r in langs if r["row"]["doc_id"] in (3, 4, 7)} == {"und"}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in plan) and len(mixed) >= 1
    assert [r["start"] for r in sorted(index, key=lambda r: r["start"])][0] == 0


def test_empty_tables(none, spark):
    for found in operators(none, spark):
        assert found.count() == 0
