"""The training-data operators against brute force, round trips and defined edge cases, on small tables."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from densigrid.llm import ann_forest, bpe, graph, langid, media_copies, order_minhash, pfair, quality_cnn, suffix_dedup, url_rules, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 30)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None, "x")


def test_forest_finds_the_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, x[0].tolist()), (301, None), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (305, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = ann_forest.usable(df, "vec_id", "embedding")
    got = ann_forest.search(ann_forest.build_index(use, 5, shard_rows=128, leaf_rows=16), use.where("vec_id % 50 == 0"), 5, budget=1.0).toPandas()
    n = np.vstack([x, x[:1]])
    n /= np.linalg.norm(n, axis=1)[:, None]
    for q, g in got.groupby("query_id"):
        s = n @ n[q]
        s[q] = -2
        assert list(g.sort_values("rank").vec_id) == sorted(range(301), key=lambda i: (-round(s[i], 12), i))[:5]
    assert ann_forest.search(ann_forest.build_index(use.limit(0), 5), use.limit(0), 5).count() == 0


def test_warc_round_trip_and_salvage(spark):
    pages = spark.createDataFrame([(1, "http://a", bytearray(b"same")), (2, "http://b", bytearray(b"same")), (3, None, None), (None, "u", bytearray(b"x\r\n\r\ny"))], "id long, url string, payload binary")
    rows = {r["record_id"]: r for r in warc.read_archives(warc.write_archives(pages)).where("kind = 'record'").collect()}
    assert (rows[1]["record_type"], rows[1]["refers_to"], rows[1]["payload_bytes"], rows[2]["record_type"]) == ("revisit", 2, 4, "response")
    assert rows[3]["payload_bytes"] == 0 and bytes(rows[None]["payload"]) == b"x\r\n\r\ny"
    parts = []
    for i in range(4):
        import base64

        body = b"page %d" % i * 50
        plain = warc.encode_record(i, body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None)
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        parts.append(c.compress(plain) + c.flush())
    broken = parts[0] + parts[1][:40] + b"\0\0" + parts[1][42:] + b"junk" + parts[2] + parts[3][:-9]
    found = list(warc.salvage(warc.Source(io.BytesIO(broken), len(broken))))
    assert [f.get("record_id") for f in found if f["kind"] == "record"] == [0, 2, 3]  # of the last member only the end is lost, its record is whole
    gaps = [(f["start"], f["stop"]) for f in found if f["kind"] == "gap"]
    assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1]) + 4), (len(broken) - len(parts[3]) + 9, len(broken))]


def test_url_rules(spark):
    urls = ["http://A.com/en/1", "https://x.example.com/en/7?q", "ftp://notcom/en/", "nothing", None, "http://bad.site/spam/1", "http://bad.site/spam/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://bad.site/spam/{i}", True) for i in range(20)] + [(f"http://good.site/ok/{i}", False) for i in range(20)], "url string, blocked boolean")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labelled, rules).collect()}
    assert got[0] == ("a.com", "/en/1", "com/en/", "block") and got[1] == ("x.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("notcom", "/en/", None, "allow") and got[3] == got[4] == ("", "", None, "allow")
    assert got[5][3] == got[6][3] == "block"


def test_langid_learns_and_rejects(spark):
    rng = np.random.default_rng(2)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(40))
    rows = [row(i, make("abcdef"), "aa") for i in range(30)] + [row(100 + i, make("uvwxyz"), "uu") for i in range(30)] + [row(200, None, None), row(201, "12 34", "aa")]
    df = docs(spark, rows)
    model = langid.train(df)
    out = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert all(out[i]["_lang"] == "aa" and out[100 + i]["_lang"] == "uu" and not out[i]["_rejected"] for i in range(30))
    assert out[200]["_lang"] == out[201]["_lang"] == "und" and out[200]["_score"] == 0
    assert langid.decide(model, "ЖЩЪЫ ЭЮЯ ДБГ" * 20)[2]
    assert langid.train(df.limit(0)) is None and langid.predict(df, None).where("_lang = 'und'").count() == len(rows)


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    import json

    own, lib = bpe.Bpe(json.load(open(path))), tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    texts = ["", "It's  A\tTEST!!", "<|endoftext|>a<|startoftext|>", "haha" * 100, "ΣΑΣ é É 漢字 😀"] + ["".join(rng.choice(list("aabthein's !?éß0\n"), 30)) for _ in range(500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(own.encode(t)).decode() == lib.decode(ids, skip_special_tokens=False)
    assert len(own.encode(None)) == 0


def test_quality_network_learns():
    rng = np.random.default_rng(5)
    good = [prose(rng, 60).encode() for _ in range(120)]
    bad = [prose(rng, 30).encode() + b" $$$ %%% ### " * 20 for _ in range(120)]
    net = quality_cnn.train(good[:90] + bad[:90], [1] * 90 + [0] * 90)
    s = net.scores(good[90:] + bad[90:] + [b""])
    assert s[:30].min() > s[30:60].max() and 0 <= s[60] <= 1
    assert (quality_cnn.train([], []).scores([b"a"]) == 0.5).all()
    data = bytes(range(256)) * 5
    parts = quality_cnn.chunks_of(data)
    assert all(data[i * quality_cnn.STEP : i * quality_cnn.STEP + 256] == bytes(p[: len(data) - i * quality_cnn.STEP]) for i, p in enumerate(parts))


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    base = [prose(rng, 200) for _ in range(12)]
    rows = [row(i, t) for i, t in enumerate(base)]
    rows += [row(100 + i, t.replace(" ", "  ", 3).upper()) for i, t in enumerate(base[:4])]
    rows += [row(200 + i, t + " tail end") for i, t in enumerate(base[:4])]
    rows += [row(300, None), row(301, ""), row(302, "!!"), row(303, "two words"), row(304, "two words"), row(305, base[5][: len(base[5]) // 2])]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs(spark, rows)).collect()}
    want = {i: i for i in [*range(12), 300, 301, 302, 303, 305]} | {304: 303} | {100 + i: i for i in range(4)} | {200 + i: i for i in range(4)}
    assert got == want
    kept = order_minhash.one_of_each(docs(spark, rows + rows[:2]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    assert order_minhash.classes(docs(spark, [])).count() == 0


def test_near_duplicates_of_a_base_in_a_large_group(spark):
    rng = np.random.default_rng(16)
    base = prose(rng, 1000).split(" ")
    rows = [row(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        for at in rng.choice(198, 18, replace=False) * 5:
            words[at] = f"edit{i}at{at}"
        rows.append(row(i, " ".join(words)))
    grams = [order_minhash.shingles(w) for w in order_minhash.word_hashes([r[1].encode() for r in rows])]
    assert all(order_minhash.aligned(grams[0], g) >= 0.8 for g in grams)
    assert not any(order_minhash.aligned(grams[1], g) >= 0.8 for g in grams[2:])
    assert {r["class_id"] for r in order_minhash.classes(docs(spark, rows)).collect()} == {0}
    for a, b in [(0, 1), (1, 2), (3, 4)]:
        x, y = (np.unpackbits(np.frombuffer(order_minhash.bitmap(grams[k]), dtype=np.uint8)) for k in (a, b))
        assert (x != y).sum() <= len(set(grams[a].tolist()) ^ set(grams[b].tolist()))


def test_one_row_of_each_class_where_ids_repeat(spark):
    rng = np.random.default_rng(17)
    a, b, c = (prose(rng, 100) for _ in range(3))
    # Id 2 names a copy of a and two texts of their own; each class keeps one row.
    rows = [row(1, a), row(2, a + " end"), row(2, b), row(2, c), row(2, c), row(3, c + " end"), row(4, None), row(4, ""), row(None, a)]
    kept = order_minhash.one_of_each(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] in (1, 2, 3)) == sorted([(1, a), (2, b), (2, c)])
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and sum(r["doc_id"] is None for r in kept) == 1


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        out.append((len(data), sum(gone), bytes(b for b, g in zip(data, gone) if not g)))
    return out


def test_suffix_ranks_sort_suffixes():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 6, 7, 50, 300):
        for letters in (1, 2, 9):
            s = rng.integers(1, letters + 1, n)
            order = np.argsort(suffix_dedup.suffix_ranks(s.astype(np.int64), 100), kind="stable")
            keys = [tuple(s[i : i + 100]) for i in order]
            assert keys == sorted(keys)


def test_repeated_passages(spark):
    rng = np.random.default_rng(8)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = [prose(rng, 20) + shared[i % 4] + prose(rng, 20) for i in range(40)]
    texts += ["é" * 120, "xé" + "é" * 110, None, "", "short", texts[3], "ab" * 200, prose(rng, 5) + shared[0][50:180]]
    texts += [prose(rng, 3) + shared[1] for _ in range(30)]
    got = {r["doc_id"]: r for r in suffix_dedup.cleaned(docs(spark, [row(i, t) for i, t in enumerate(texts)])).collect()}
    for i, (n, removed, kept) in enumerate(brute_repeats(texts)):
        assert (got[i]["_n_bytes"], got[i]["_n_removed"], got[i]["_kept_sha256"]) == (n, removed, hashlib.sha256(kept).hexdigest()), i
    assert got[42]["_kept"] is None and got[43]["_kept"] == ""
    twice = docs(spark, [row(1, shared[0]), row(1, shared[0]), row(None, shared[0])])
    assert sorted(r["_n_removed"] for r in suffix_dedup.cleaned(twice).collect()) == [0, len(shared[0]), len(shared[0])]
    assert suffix_dedup.cleaned(docs(spark, [])).count() == 0


def test_media_copies(spark):
    rng = np.random.default_rng(9)
    draw = lambda: np.kron(rng.integers(0, 255, (12, 12)), np.ones((8, 8)))
    a, b = draw(), draw()
    rows = [(0, a), (1, a[8:88, 4:90]), (2, np.clip(a * 0.8 + 20, 0, 255)), (3, b)]
    df = spark.createDataFrame([(i, bytearray(media_copies.encoded(m))) for i, m in rows] + [(4, None), (5, bytearray(b"no image"))], "id long, media binary")
    got = {r["id"]: (r["class_id"], r["n_links"] > 0) for r in media_copies.classes(df).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (3, False), 4: (4, False), 5: (5, False)}


def test_pfair_keeps_windows_and_rows(spark):
    rows = [row(i, "t", source="a" if i % 3 else "b") for i in range(600)] + [row(600 + i, "t", source=None) for i in range(40)] + [row(5, "again", source="a")]
    out = pfair.schedule(docs(spark, rows), {"a": 3, "b": 1}).toPandas()
    assert len(out) == len(rows) and out._place.is_unique
    assert ((out._slot >= out._release) & (out._slot < out._deadline)).all()
    first = out[out._phase == 0].drop_duplicates(["source", "_block"])
    for t in range(1, int(first._slot.max()) + 1, 7):
        assert abs((first[first.source == "a"]._slot < t).sum() - t * 0.75) < 1 + 1e-9
    assert pfair.mixed(docs(spark, rows)).columns == docs(spark, rows).columns and pfair.mixed(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n, each, weights", [(20, 2200, None), (600, 3, None), (3, 4000, {"s0": 0.123457, "s1": 0.71, "s2": 0.0005})])
def test_pfair_keeps_exact_targets(spark, n, each, weights):
    df = spark.range(n * each).selectExpr("id AS doc_id", f"concat('s', id % {n}) AS source")
    out = pfair.schedule(df, weights, block_rows=1).toPandas()
    assert len(out) == n * each and sorted(out._place) == list(range(n * each))
    assert ((out._slot >= out._release) & (out._slot < out._deadline)).all()
    first = out[out._phase == 0]
    share = {s: w / sum(weights.values()) for s, w in weights.items()} if weights else {f"s{i}": 1 / n for i in range(n)}
    assert set(share) == set(out.source)
    slots = np.arange(first._slot.max() + 2)
    for s, w in share.items():
        served = np.searchsorted(np.sort(first._slot[first.source == s].to_numpy()), slots)
        assert np.abs(served - w * slots).max() < 1 + 1e-9


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    rows = [row(i, prose(rng, 80), source=f"s{i % 3}") for i in range(40)]
    rows += [row(100, rows[0][1]), row(101, None), row(102, "123")]
    df = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        df = out
    assert sorted(r["doc_id"] for r in df.collect()) == list(range(40))
    pytest.importorskip("public_tokenizers")
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").where("n_tokens > 0").count() == 40


def test_pipeline_result_keeps_the_mix(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(22)
    rows = [row(i, prose(rng, 60), source="abc"[0 if i < 200 else 1 if i < 280 else 2]) for i in range(360)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas().sort_values("place")
    assert len(out) == 360 and list(out.place) == list(range(360))
    for n in range(12, 240, 12):
        assert all(abs((out.source[:n] == s).sum() - n / 3) < 2 * 4 for s in "abc")
    placed = {r["doc_id"]: r["_place"] for r in pfair.schedule(docs(spark, rows)).collect()}
    assert dict(zip(out.doc_id, out.place)) == placed
