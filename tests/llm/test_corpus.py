"""The corpus operators against brute force, round trips and held-out accuracy, on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseworks.llm import audio, common, decontaminate, gru, html_extract, langid, lines, lm_score, minhash, packing, queries, repeats, warc
from caseworks.llm.components import components
from caseworks.llm.suffix_order import suffix_order
from tests.compare import rows, sql_rows

SF = "/root/testdata/sf0.001"
BASE = "It was the best of times, it was the worst of times, and nobody in the town could say which of the two it had been. "


def fixture_docs(spark, extra: bool = True):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    long = prose(4000)
    data = [(1, None), (2, ""), (3, "  \n\t"), (4, "a"), (5, BASE * 3), (6, BASE * 3), (7, BASE * 3 + "!"), (8, "x" * 400), (9, "x" * 70), (10, long), (11, long.replace(words[3], "zzzzz")), (12, "ÀÉ ñandú. " * 20), (13, "12 34 -- 56")]
    data += [(20 + i, prose(60)) for i in range(20)] + [(50 + i, BASE + prose(30)) for i in range(5)]
    df = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    return (df.withColumns({"block": F.lit(1), "h": F.lit("clash"), "id": F.lit(0), "a": F.lit(2)}) if extra else df), data


def empty(df):
    return df.where("doc_id < 0")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names, want = sql_rows(SF, queries.SQL[name])
    assert sorted(df.columns) == names and rows(df) == want


# 1 ---------------------------------------------------------------------------------------------------------------


def test_html_blocks():
    page = "<html><head><title>t<p></title><style>p{}</style></head><body><p>A&amp;B <b>x</b>y<br>z\n z<script>var p='<p>no</p>'</script><p>two</body>"
    assert [b.text for b in html_extract.blocks_of(page)] == ["A&B xy z z", "two"]
    assert html_extract.blocks_of(None) == [] == html_extract.blocks_of("")
    assert [b.text for b in html_extract.blocks_of("a < b <i>c")] == ["a < b c"]


def test_html_other_designs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    body = ["The first sentence of a story.", "A second paragraph goes on at length, with commas, and ends here."]
    other = ["Home", "About us", "Contact", "We use cookies. Accept?", "Buy shoes now", "Your name", "Great post! Bob", "Copyright 2020"]
    made = [(9000 + i, "u", p) for i, p in enumerate(html_extract.layouts(body, other, 5)[:3])] + [(9100, None, None), (9101, "u", "")]
    all_pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(made, "page_id long, url string, html string")).withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract_main_text(all_pages).collect()}
    assert all(got[9000 + i].text == " ".join(body) for i in range(3))
    assert (got[9100].text, got[9100].n_chars, got[9101].n_chars) == ("", 0, 0)
    for r in pages.collect():
        blocks = html_extract.blocks_of(r.html)
        want = " ".join(b.text for b, y in zip(blocks, html_extract.weak_labels(blocks), strict=True) if y)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert html_extract.extract_main_text(all_pages.where("page_id < 0")).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20 + "</p>"
    data = [(5, "http://a/x?y#z", big), (3, "http://b", big), (9, None, big), (4, "u\r\nEvil: 1", None), (7, "http://c", "short"), (8, "http://d", "short")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w", keep_payload=True)).collect()}
    assert len(got) == 6
    for i, _, h in data:
        r, b = got[f"<urn:capture:{i}>"], (h or "").encode()
        assert r.request.kind == "request" and r.metadata.kind == "metadata"
        assert (r.response.payload_bytes, r.response.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert r.response.kind == ("revisit" if i in (5, 9) else "response")
        assert r.response.refers_to == ("<urn:capture:3>" if i in (5, 9) else None)
        if r.response.kind == "response":
            assert bytes(r.response.payload) == b
    warc.write_warc(pages.where("page_id < 0"), f"file://{tmp_path}/e")
    assert warc.read_records(spark, f"file://{tmp_path}/e").count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------


def test_warc_rows_of_one_page_id(spark, tmp_path):
    page = "<p>" + "words " * 40 + "</p>"
    data = [(1, "u", page), (1, "u", page), (2, "u", page), (3, "v", "<p>a</p>"), (3, "v", "<p>b</p>")]
    path = f"file://{tmp_path}/warc"
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string"), path)
    got = warc.assemble(warc.read_records(spark, path)).select("response.kind", "response.payload_digest", "response.refers_to").collect()
    assert sorted(r.kind for r in got) == ["response"] * 4 + ["revisit"]
    assert sorted(r.payload_digest for r in got) == sorted(hashlib.sha256(h.encode()).hexdigest() for _, _, h in data)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 %% 3", "en"), (10**6 + 2, "", None)], "doc_id long, text string, lang string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    got = {r.doc_id: r for r in langid.identify(both, ["doc_id", "lang"]).collect()}
    assert all(got[10**6 + i].lang_pred == "und" and got[10**6 + i].score == 0 for i in range(3))
    held = [r for r in got.values() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id < 10**6]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty(docs), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.limit(3), [], np.zeros((0, langid.DIMS)), ["doc_id"]).collect()} == {"und"}


def test_binding():
    grams, counts = langid.gram_counts("Ab, AB!")
    assert counts.sum() == 5  # ' ab', 'ab ', 'b a', ' ab', 'ab '
    v = langid.gram_vectors(grams)
    a, b, s = (langid.letter_vector(ord(c)) for c in "ab ")
    code = sum(ord(c) << (21 * (2 - i)) for i, c in enumerate("ab "))
    assert (v[list(grams).index(code)] == np.roll(a, 2) * np.roll(b, 1) * s).all()


# 4 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df, data = fixture_docs(spark)
    special = "see <|endoftext|> here"
    df = df.unionByName(spark.createDataFrame([(99, special)], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack(df).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in [*data, (99, special)]}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        ps.sort(key=lambda r: r.start)
        assert [p.start for p in ps] == list(np.cumsum([0, *[p.length for p in ps]])[:-1]) and sum(p.length for p in ps) == len(ids[i])
    for ps in by_seq.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == list(np.cumsum([0, *[p.length for p in ps]])[:-1]) and sum(p.length for p in ps) <= 1024
    assert sum(sum(p.length for p in ps) < 1024 for ps in by_seq.values()) <= df.rdd.getNumPartitions()
    assert packing.pack(empty(df)).count() == 0


def test_bm25_prefers_like_documents():
    docs = [np.array(x) for x in ([1, 2, 3, 4], [9, 8, 7, 6], [1, 2, 3, 5], [9, 8, 7, 5], [20, 21, 22, 23])]
    s = packing.Shard(docs)
    assert s.scores(s.terms[0])[[1, 2, 3, 4]].argmax() == 1


# 5 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_order(s):
    assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_removed(data):
    first: dict[bytes, int] = {}
    for i, x in sorted(data, key=lambda r: r[0]):
        b = (x or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = {}
    for i, x in data:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("block_docs", [4, 1000])
def test_repeats(spark, block_docs):
    df, data = fixture_docs(spark)
    want = brute_removed(data)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.remove_repeats(df, True, block_docs).collect()}
    assert got == want
    assert repeats.remove_repeats(empty(df)).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def test_contamination_spans_and_rounds(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "Xx, ONE two-three; four five SIX seven eight nine ten! yy"), (2, None), (3, "one two three"), (4, "Short item!"), (5, "shorter item"), (6, " ".join(["one"] * 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit(1))
    bench = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (10, "--")], "item_id long, text string")
    for limit in (decontaminate.ROUND_BYTES, 10):
        got = {r.doc_id: r for r in decontaminate.find_contamination(df, bench, ["doc_id"], limit).collect()}
        assert [(s.start, s.end) for s in got[1].spans] == [(4, 53)] and got[1]["items"] == [7] and got[1].n_words == 12
        assert docs[0][1][4:53] == "ONE two-three; four five SIX seven eight nine ten"
        assert got[4]["items"] == [8] and [(x["first"], x["last"]) for x in got[4].runs] == [(0, 2)]
        assert not got[5]["items"] and not got[3]["items"] and got[2].n_words == 0 and got[6].n_words == 30
    assert decontaminate.find_contamination(df, bench.limit(0), ["doc_id"]).where(F.size("items") > 0).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_classes(data):
    sets = {i: minhash.shingles(t) for i, t in data}
    df = Counter(k for i in sets for k in (sets[i][0] >> np.uint64(16)).tolist())
    w = {i: (k, minhash.weights(c, np.array([df[x] for x in (k >> np.uint64(16)).tolist()], np.int64), len(data)).astype(np.float32)) for i, (k, c) in sets.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    text = {i: t or "" for i, t in data}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (text[i] == text[j] or (len(w[i][0]) and len(w[j][0]) and minhash.weighted_jaccard(w[i], w[j]) >= 0.8)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block_docs", [4, 1000])
def test_near_duplicates(spark, block_docs):
    df, data = fixture_docs(spark)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block_docs=block_docs).collect()}
    assert got == brute_classes(data)
    assert got[7] == 5 and got[11] == 10 and got[50] == 50
    assert minhash.near_duplicates(empty(df)).count() == 0


def test_chain_and_many_clusters(spark):
    """A chain whose least document is like one end only, and many clusters that share a long notice."""
    rng = np.random.default_rng(4)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    base, notice = words(200), words(90)
    changed = lambda at: " ".join("x" if i in at else w for i, w in enumerate(base))
    data = [(1, changed({150, 160})), (2, changed({160})), (3, changed({30, 160})), (4, changed({30, 60, 100, 160})), (5, changed({30, 60, 100, 130, 180}))]
    for k in range(12):
        own = notice + words(40)
        data += [(100 + 10 * j + 1000 * (j % 2) + k, " ".join([*own, *words(j)])) for j in range(4)]
    rng.shuffle(data)
    df = spark.createDataFrame([(int(i), str(t)) for i, t in data], "doc_id long, text string")
    want = brute_classes([(int(i), str(t)) for i, t in data])
    assert 12 < len(set(want.values())) < 17
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block_docs=7).collect()} == want


def test_samples_follow_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = (keys[:300], rng.random(300) + 0.5), (keys[100:], rng.random(300) + 0.5)
    s = minhash.signatures(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([300, 300]))
    assert abs((s[0] == s[1]).mean() - minhash.weighted_jaccard(a, b)) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 55), (70, 71)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in (50, 55, 60)} == {50} and {got[i] for i in range(100, 140)} == {100}
    assert components(spark.createDataFrame(edges, "x long, y long").limit(0), "x", "y").count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = step >> 3
            change += step if nibble & 4 else 0
            change += step >> 1 if nibble & 2 else 0
            change += step >> 2 if nibble & 1 else 0
            value = max(-32768, min(32767, value + (-change if nibble & 8 else change)))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[nibble])))
            out.append(value)
    return out


def test_codecs():
    mu, a = audio.LOOKUP[audio.MULAW], audio.LOOKUP[audio.ALAW]
    assert (mu[0xFF], mu[0x80], mu[0x00], mu[0x7F]) == (0, 32124, -32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    data = np.random.default_rng(2).integers(0, 256, (7, 64), dtype=np.uint8)
    assert audio.decode_adpcm(data).tolist() == [scalar_adpcm(bytes(b)) for b in data]
    flat = audio.resample(np.full(50, 1000, np.int16))
    assert len(flat) == 100 and np.abs(flat.astype(int) - 1000).max() <= 1


def test_media(spark):
    df, data = fixture_docs(spark)
    stored = audio.encode_media(df, ["doc_id"])
    got = {r.doc_id: r for r in audio.decode_media(stored, ["doc_id", "n_bytes"], keep_pcm=True).collect()}
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for i, t in data:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert bytes(audio.parse_wav(media[i])[1]) == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert r.feature == audio.feature(np.frombuffer(r.pcm, np.int16))
    assert got[5].feature == got[6].feature
    assert {audio.NAMES[c] for c in audio.NAMES} >= {r.codec for r in got.values()}


# 9 ---------------------------------------------------------------------------------------------------------------


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "\x0b neverseen ")], "doc_id long, text string"))
    marked = docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).withColumn("block", F.lit(5))
    got = {r.doc_id: r for r in lm_score.score_documents(marked, 60).collect()}
    up = {c: c + 32 for c in range(65, 91)}
    split = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(up)), "\0"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    c = Counter(w for i, d in split.items() if not held[i] for w in d)
    n, v = sum(c.values()), len(c)
    for i, d in split.items():
        r, base = got[i], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(d), sum(c[w] > 0 for w in d), n, held[i])
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    test = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert lm_score.score_documents(marked.where("doc_id < 0")).count() == 0


def test_scores_follow_from_the_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 7 == 2)
    score = lambda df: {r.doc_id: r.score for r in lm_score.score_documents(df, 100).collect()}
    assert score(docs.coalesce(1)) == score(docs.repartition(8, "text"))


def test_state_is_carried_and_probabilities_sum_to_one(monkeypatch):
    p = gru.initial(np.arange(1, 71, dtype=float))
    docs = [np.array([5, 9, 2, 7] * 40 + [1]), np.array([1]), np.array([8] * 30 + [1])]
    windows = gru.log_likelihood(p, docs)
    assert np.allclose(windows, gru.log_likelihood(p, docs, lanes=1), rtol=1e-5)
    monkeypatch.setattr(gru, "STEPS", 1000)
    assert np.allclose(windows, gru.log_likelihood(p, docs), rtol=1e-5)
    state = np.random.default_rng(1).standard_normal((70, gru.HIDDEN)).astype(np.float32)[:1].repeat(70, 0)
    assert abs(np.exp(gru._output(p, state, np.arange(70), None)[0]).sum() - 1) < 1e-4


# 10 --------------------------------------------------------------------------------------------------------------


def test_shuffles_freed_restores_the_setting(spark):
    before = spark.conf.get(common.FREE_SHUFFLES, None)
    with pytest.raises(ValueError), common.shuffles_freed(spark):
        assert spark.conf.get(common.FREE_SHUFFLES) == "true"
        raise ValueError
    assert spark.conf.get(common.FREE_SHUFFLES, None) == before
    # a table that was written with its shuffles freed can be derived and written again
    dealt = spark.range(1000).repartition(4, "id")
    assert common.materialize(dealt, "once").count() == common.materialize(dealt, "twice").count() == dealt.count() == 1000


def brute_lines(data):
    pat = re.compile(r"(?s)(?=(.{8})).")  # every run of eight characters
    first, order = {}, []
    for i, x in sorted(data, key=lambda r: r[0]):
        for k, raw in enumerate((x or "").split("\n") if x is not None else []):
            s = raw.strip(" \t\r")
            if s and s not in first:
                first[s] = (i, k)
                order.append(s)
    sets = [set(pat.findall(s.lower())) if len(s) >= lines.MIN_CHARS else None for s in order]
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(order)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    best: dict[int, tuple] = {}
    for i, s in enumerate(order):
        best[find(i)] = min(best.get(find(i), first[s]), first[s])
    place = {s: best[find(i)] for i, s in enumerate(order)}
    return {i: None if x is None else "\n".join(raw for k, raw in enumerate(x.split("\n")) if not raw.strip(" \t\r") or place[raw.strip(" \t\r")] == (i, k)) for i, x in data}


def test_lines(spark):
    line = "The quick brown fox jumps over the lazy dog near the old river bank"
    data = [(1, f"{line}\nshort\n\nshort"), (2, line.replace("old", "odd") + "\nshort\n" + line), (3, None), (4, ""), (5, "\n \n"), (6, line + " " + line[::-1]), (7, "y" * 5000 + "\n" + "y" * 5000)]
    data += [(10 + i, f"line number {i} speaks of {'abcdefghij'[i % 10] * 9} and of nothing else at all\n{line}.") for i in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"id": F.lit(1), "line": F.lit("clash"), "line_no": F.lit(0), "n_lines0": F.lit(0)})
    got = {r.doc_id: r.clean for r in lines.dedup_lines(df.select("doc_id", "text", "id", "line", "line_no")).collect()}
    assert got == brute_lines(data)
    assert lines.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_lines_of_chains_and_patterns(spark):
    """A chain whose ends are alike by its middle only, and many clusters that share a long pattern: what goes is what
    the full Jaccard of all pairs takes away, nine tenths of it at least, and nothing else."""
    rng = np.random.default_rng(6)
    signs = lambda n: "".join(rng.choice(list("abcdefghijkl"), n))
    base, pattern = signs(300), signs(150)
    data = ["".join("x" if i in at else c for i, c in enumerate(base)) for at in ({50}, {50, 90}, {50, 90, 130}, {50, 90, 130, 170}, {50, 90, 130, 170, 210})]
    for _ in range(15):
        own = pattern + signs(60)
        data += [own, own + "!", own + signs(8)]
    rng.shuffle(data)
    data = [(i, str(x)) for i, x in enumerate(data)]
    got = {r.doc_id: r.clean for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = {i for i, x in brute_lines(data).items() if x == ""}
    gone = {i for i, x in got.items() if x == ""}
    assert len(want) >= 30 and gone <= want and len(gone) >= 0.9 * len(want)


def test_lines_of_rows_with_one_id(spark):
    df = spark.createDataFrame([(1, "a line that stands alone here"), (1, "another text\na line that stands alone here"), (None, "x"), (2, "x"), (3, "y"), (3, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.clean) for r in lines.dedup_lines(df).collect())
    assert sum("alone" in x for i, _, x in got if i == 1) == 1
    assert [x for i, _, x in got if i == 3] == ["y", "y"] and (0, "x", "x") in got and (2, "x", "") in got


CLASHES = ["clean", "gone", "items", "runs", "spans", "n_words", "score", "lang_pred", "block", "band", "id", "line", "class", "first"]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES), name


def test_lines_of_unspaced_script(spark):
    rng = np.random.default_rng(5)
    signs = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    long, some, url = signs(300), signs(90), "https://example.org/" + "".join(rng.choice(list("abcdef0123456789"), 200))
    near = ["total due", "total due!", "total dues", "abcdefg", "abcdefg!"]
    data = list(enumerate([long, long[:5] + "x" + long[5:], some, some[:3] + "y" + some[3:], url, url[:9] + "z" + url[9:], "y" * 400, "y" * 30, signs(80), *near]))
    df = spark.createDataFrame(data, "doc_id long, text string")

    def brute(i):
        grams = lambda s: {s[k : k + 8] for k in range(len(s) - 7)}
        return any(len(grams(data[i][1]) & grams(x)) >= 0.8 * len(grams(data[i][1]) | grams(x)) for _, x in data[:i] if len(x) >= 8 and len(data[i][1]) >= 8)

    got = {r.doc_id for r in lines.dedup_lines(df).where("n_removed > 0").collect()}
    # 7 is 30 times one letter and 6 is 400 times: one run each, but lines are signed by length, so these two don't meet
    assert got == {i for i in range(len(data)) if brute(i)} - {7} and {1, 3, 5} <= got


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == columns and 0 < kept.count() <= before, name
        assert kept.select("doc_id").distinct().count() == kept.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
