"""The training-data operators against brute force, and their edge cases: clashing columns, large ids, hot keys and damage."""

import base64
import hashlib
import io
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from densigrid.llm import ann_forest, bpe, common, graph, langid, media_copies, order_minhash, pfair, quality_cnn, queries, suffix_dedup, url_rules, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
CLASHES = "row _ r0 i0 _lang _score _rejected n_tokens doc part file start p c at lo hi j name seq block _place _kept _n_removed node comp key id text_id h kept _hot _salt".split()


def prose(rng, n, words=WORDS):
    return " ".join(str(rng.choice(words)) + str(rng.integers(0, 30)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None)


def clashing(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHES))


# Nearest neighbours


def test_shipped_forest_scans_little_and_finds_most(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(1500, 64))
    x[700:720] = x[3]  # repeated vectors
    use = ann_forest.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    index, asked = ann_forest.build_index(use, 5), use.where("vec_id % 20 = 0")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    for q, g in ann_forest.search(index, asked, 5).toPandas().groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -2
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5] and np.allclose(g["score"], s[g["vec_id"]])
        hit, total = hit + len(set(best) & set(g["vec_id"])), total + 5
    assert hit / total >= 0.9
    assert ann_forest.scanned_share(index, asked) < 0.2


def test_queue_takes_the_likeliest_leaves_first():
    rng = np.random.default_rng(32)
    x = ann_forest.unit(rng.normal(size=(400, 16)))
    f = ann_forest.Forest.grow(x, (1, 2), trees=6, leaf_rows=8)
    q = ann_forest.unit(rng.normal(size=(1, 16)))[0]
    # All leaves by the likelihood of their whole path
    along = f.normals @ q * ann_forest.RHO
    scale = f.spread * math.sqrt(1 - ann_forest.RHO**2)
    leaves = []
    for t in range(6):
        for leaf in range(1 << f.depth):
            cost = 0.0
            for level in range(f.depth):
                node = leaf >> (f.depth - level)
                cost -= ann_forest.log_share((along[t, level] - f.cuts[level][t, node]) / scale)[leaf >> (f.depth - level - 1) & 1]
            leaves.append((cost, t, leaf))
    count, want = np.zeros(400, dtype=int), None
    for k, (_, t, leaf) in enumerate(sorted(leaves), 1):
        count[f.rows[t, f.bounds[t, leaf] : f.bounds[t, leaf + 1]]] += 1
        if k % ann_forest.LOOK == 0 and (count >= 3).sum() >= 60:
            want = set(np.flatnonzero(count >= 3).tolist())
            break
    assert set(f.candidates(q, 0.15, 3).tolist()) == want


def test_router_sends_queries_to_few_shards(spark):
    rng = np.random.default_rng(33)
    x = rng.normal(size=(600, 8))
    use = ann_forest.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    index = ann_forest.build_index(use, 3, shard_rows=20)
    shards, router = index[0].select("cell").distinct().count(), index[1][8]
    unit = ann_forest.unit(x[:40])
    assert shards > 16 and all(len(set(router.probes(u, 4))) == 4 for u in unit)
    assert np.mean([c in router.probes(u, 8) for u, c in zip(unit, router.cell(unit).tolist())]) > 0.9
    assert sum(r["n"] for r in index[0].select(F.size("ids").alias("n")).collect()) == 600


# WARC


def record(i, size=40, text=None):
    body = (text or f"page {i} ".encode() * size)
    return warc.encode_record(i, body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None)


def zipped(data):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def salvaged(data, keep=True):
    return list(warc.salvage(warc.Source(io.BytesIO(data), len(data)), keep))


def ids(found):
    return [f["record_id"] for f in found if f["kind"] == "record"]


def test_large_ids_stay_whole_numbers(spark):
    big = 2**60
    pages = spark.createDataFrame([(big + 1, "u", bytearray(b"same")), (big + 3, "u", bytearray(b"same")), (None, "u", bytearray(b"x")), (-big - 1, None, None)], "id long, url string, payload binary")
    got = {r["record_id"]: r["refers_to"] for r in warc.read_archives(warc.write_archives(pages)).where("kind = 'record'").collect()}
    assert got == {big + 1: big + 3, big + 3: None, None: None, -big - 1: None}


@pytest.mark.parametrize("bad", [0, 25, 49])
def test_damage_within_one_member_loses_one_record(bad):
    parts = [record(i) for i in range(50)]
    at = sum(map(len, parts[:bad])) + len(parts[bad]) - 20
    plain = bytearray(b"".join(parts))
    plain[at] ^= 1
    want = [i for i in range(50) if i != bad]
    for data in (zipped(bytes(plain)), bytes(plain)):
        found = salvaged(data)
        assert ids(found) == want
        gaps = [f for f in found if f["kind"] == "gap"]
        assert len(gaps) == 1 and gaps[0]["reason"] == "block digest"
        begin = gaps[0].get("inner_start", gaps[0]["start"])
        stop = gaps[0].get("inner_stop", gaps[0]["stop"])
        assert (begin, stop) == (sum(map(len, parts[:bad])), sum(map(len, parts[: bad + 1])))


def test_broken_headers_and_lengths_in_a_member():
    parts = [record(i) for i in range(6)]
    parts[1] = parts[1].replace(b"Content-Length: ", b"Content-Length: x", 2)
    parts[3] = parts[3].replace(b"WARC/1.1", b"WARX/1.1")
    for data in (zipped(b"".join(parts)), b"".join(parts)):
        assert ids(salvaged(data)) == [0, 2, 4, 5]


def test_cut_and_broken_members_keep_what_inflates():
    rng = np.random.default_rng(34)
    noisy = [record(i, text=rng.bytes(3000)) for i in range(40)]  # hardly compressed, so damage stays local
    one, other = zipped(b"".join(noisy)), zipped(record(100))
    cut = salvaged(one[:-9])
    assert ids(cut)[:39] == list(range(39)) and cut[-1]["kind"] == "gap"
    half = ids(salvaged(one[: len(one) // 2] + other))
    assert half[-1] == 100 and half[:15] == list(range(15))
    broken = bytearray(one)
    broken[len(one) // 2] ^= 0xFF
    found = ids(salvaged(bytes(broken) + other))
    assert found[:15] == list(range(15)) and found[-1] == 100 and len(set(found)) == len(found)


def test_records_larger_than_the_window():
    rng = np.random.default_rng(35)
    big = record(1, text=rng.bytes(3 * warc.WINDOW + 5))
    for data in (record(0) + big + record(2), zipped(record(0) + big + record(2)), zipped(record(0)) + zipped(big) + zipped(record(2))):
        found = salvaged(data)
        assert ids(found) == [0, 1, 2] and len(found[1]["payload"]) == 3 * warc.WINDOW + 5
        assert [f["payload"] for f in salvaged(data, keep=False)] == [None] * 3
        assert [f["payload_digest"] for f in salvaged(data, keep=False)] == [f["payload_digest"] for f in found]
    assert [f["kind"] for f in salvaged(b"")] == ["gap"] and [f["kind"] for f in salvaged(b"nothing here" * 9)] == ["gap"]


# URL rules


def brute_tokens(url):
    if url is None or "://" not in url:
        return set()
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    tail = rest[len(host) :]
    path = tail.split("#")[0].split("?")[0]
    query = tail.split("#")[0].split("?", 1)[1] if "?" in tail.split("#")[0] else ""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return {f"h={x}" for x in lower.split(".") if x} | {f"p={x}" for x in path.split("/") if x} | {f"q={y}" for x in query.split("&") if (y := x.split("=")[0])}


def test_url_rules_against_brute_force(spark):
    rng = np.random.default_rng(36)
    make = lambda: f"http://{rng.choice(['a', 'b', 'News'])}.{rng.choice(['org', 'net', 'xyz'])}/{rng.choice(['x', 'y', 'ads'])}/{rng.integers(0, 4)}?{rng.choice(['id', 'ref'])}={rng.integers(0, 9)}#f"
    urls = [make() for _ in range(300)]
    labels = [("ads" in u and "ref" in u) or (".xyz" in u and rng.random() < 0.8) for u in urls]
    support, confidence, rows = 0.05, 0.6, 10
    sets = [(brute_tokens(u), b) for u, b in zip(urls, labels)]
    least = max(support, rows / len(sets))
    rules = {}
    for k in range(1, 7):
        seen = Counter(c for s, _ in sets for c in itertools.combinations(sorted(s), k))
        bad = Counter(c for s, b in sets if b for c in itertools.combinations(sorted(s), k))
        rules |= {c: bad[c] / seen[c] for c in bad if bad[c] >= least * len(sets) - 1e-9 and bad[c] / seen[c] >= confidence}
    assert len(rules) > 5
    mined = url_rules.mine(spark.createDataFrame(list(zip(urls, labels)), "url string, blocked boolean"), support, confidence, rows)
    assert {tuple(r["items"]): round(r["confidence"], 9) for r in mined.collect()} == {c: round(v, 9) for c, v in rules.items()}
    pages = [*enumerate(urls + [make() for _ in range(100)]), (900, None), (901, "no scheme"), (902, urls[0]), (902, urls[0])]
    got = url_rules.judge(clashing(spark.createDataFrame(pages, "page_id long, url string")), spark.createDataFrame(list(zip(urls, labels)), "url string, blocked boolean"), [], support, confidence).collect()
    assert len(got) == len(pages)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert verdicts == {i: "block" if any(set(c) <= brute_tokens(u) for c in rules) else "allow" for i, u in pages}


# Language ID


def brute_entropy(train, text):
    """Interpolated Kneser-Ney with dictionaries of strings, one language."""
    norm = lambda t: langid.codes(t).view("<u4").tobytes().decode("utf-32-le")
    texts = [norm(t) for t in train]
    grams = [Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1)) for n in range(1, langid.ORDER + 1)]
    weight = []
    for n in range(langid.ORDER):
        if n == langid.ORDER - 1:
            weight.append(dict(grams[n]))
        else:
            before = Counter(g[1:] for g in grams[n + 1])
            weight.append({g: before.get(g, 1) for g in grams[n]})
    total, kinds = [defaultdict(float) for _ in weight], [Counter() for _ in weight]
    for n, w in enumerate(weight):
        for g, v in w.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1
    base = 1 / max(256, len(grams[0]))

    def p(g):
        n = len(g) - 1
        lower = p(g[1:]) if n else base
        if g[:-1] not in total[n]:
            return lower
        t = total[n][g[:-1]]
        return max(weight[n].get(g, 0) - langid.DISCOUNT, 0) / t + langid.DISCOUNT * kinds[n][g[:-1]] / t * lower

    out, c = 0.0, norm(text)
    for i in range(len(c)):
        g = c[max(0, i - langid.ORDER + 1) : i + 1]
        # A character never seen has the floor's probability, times the weights of the contexts that were seen.
        out += math.log(p(g)) if g[-1] in grams[0] else math.log(langid.FLOOR) + sum(math.log(langid.DISCOUNT * kinds[n][x] / total[n][x]) for n in range(1, len(g)) if (x := g[-1 - n : -1]) in total[n])
    return -out / len(c)


def test_model_equals_dictionaries():
    rng = np.random.default_rng(37)
    train = ["".join(rng.choice(list("abcde f"), 60)) for _ in range(30)]
    model = langid.fit({"x": train})
    for text in ["abc de", "fade a bead", "abXcd", "", "eeeeeeeee", train[0]]:
        assert math.isclose(model.entropies(text)[0], brute_entropy(train, text), rel_tol=1e-4)


def test_rejection_and_score_are_calibrated():
    rng = np.random.default_rng(38)
    lex = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(300)] for lang, letters in (("a", "abcdefghij"), ("b", "cdefghijkl"))}
    make = lambda lang, n: " ".join(rng.choice(lex[lang], n))
    model = langid.fit({x: [make(x, 80) for _ in range(60)] for x in lex})
    langid.calibrate(model, {x: [make(x, int(rng.integers(5, 120))) for _ in range(100)] for x in lex})
    fresh = [(x, langid.decide(model, make(x, int(rng.integers(5, 120))))) for x in lex for _ in range(300)]
    assert sum(d[2] for _, d in fresh) <= 3
    assert np.mean([x == d[0] for x, d in fresh]) > 0.98
    assert abs(np.mean([d[1] for _, d in fresh]) - np.mean([x == d[0] for x, d in fresh])) < 0.03
    assert all(langid.decide(model, "".join(rng.choice(list("mnopqrstuvwxyz "), 200)))[2] for _ in range(20))


def test_long_texts_are_learned_and_scored_whole(monkeypatch):
    rng = np.random.default_rng(39)
    text = "".join(rng.choice(list("abc d"), 5000))
    whole, counts = langid.fit({"x": [text]}).entropies(text), langid.count_grams([text])
    monkeypatch.setattr(langid, "SLICE", 700)
    assert np.allclose(langid.fit({"x": [text]}).entropies(text), whole)
    for a, b in zip(counts, langid.count_grams([text])):
        assert all((x == y).all() for x, y in zip(a, b))


# Quality


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(40)
    net = quality_cnn.Net(rng.normal(size=(256, quality_cnn.EMBED)), rng.normal(size=(quality_cnn.WIDTH, quality_cnn.EMBED, quality_cnn.FILTERS)) / 5, rng.normal(size=quality_cnn.FILTERS), rng.normal(size=2 * quality_cnn.FILTERS), 0.1)
    for text in [b"", b"short", rng.bytes(256), rng.bytes(257), rng.bytes(1500)]:
        pooled = []
        step = quality_cnn.STEP
        for lo in range(0, max(1, len(text) - (quality_cnn.CHUNK - step)), step):
            chunk = text[lo : lo + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
            values = [net.bias + sum(net.emb[chunk[i + w]] @ net.conv[w] for w in range(quality_cnn.WIDTH)) for i in range(quality_cnn.CHUNK - quality_cnn.WIDTH + 1)]
            pooled.append(np.tanh(np.max(values, axis=0)))
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ net.out + net.shift
        assert math.isclose(net.scores([text])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_every_chunk_of_a_long_text_is_learned_from():
    rng = np.random.default_rng(41)
    # The only difference is in one chunk far inside long texts.
    plain = [prose(rng, 4000).encode() for _ in range(20)]
    marked = [t[:13_000] + b"@@@@@@@@@@ @@@@@@@@@@@@" + t[13_000:] for t in plain]
    net = quality_cnn.train(plain[:16] + marked[:16], [1] * 16 + [0] * 16)
    assert (net.scores(plain[16:]) > net.scores(marked[16:])).all()


# Near duplicates


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(42)
    texts = [prose(rng, int(rng.integers(20, 120))) for _ in range(60)]
    for _ in range(60):
        words = texts[rng.integers(0, len(texts))].split(" ")
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"new{rng.integers(0, 99)}"
        texts.append(" ".join(words))
    grams = [order_minhash.shingles(w) for w in order_minhash.word_hashes([t.encode() for t in texts])]
    parent = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if plain_similarity(grams[i].tolist(), grams[j].tolist()) >= order_minhash.SIMILARITY:
                a, b = (min(k for k in range(len(texts)) if parent[k] == parent[x]) for x in (i, j))
                parent = [min(a, b) if parent[k] in (parent[i], parent[j]) else parent[k] for k in range(len(texts))]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(clashing(docs(spark, [row(i, t) for i, t in enumerate(texts)])).drop("id")).collect()}
    assert got == dict(enumerate(parent)) and len(set(parent)) < 110


def plain_similarity(a, b):
    """L / (n + m - L) by the common subsequence of all places."""
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return 0.0
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            best[j], last = (last + 1 if x == y else max(best[j], best[j - 1])), best[j]
    return best[-1] / (len(a) + len(b) - best[-1])


def test_banded_alignment_equals_plain_tables():
    rng = np.random.default_rng(43)
    for _ in range(150):
        n, m, k, band = (int(rng.integers(lo, hi)) for lo, hi in ((1, 50), (1, 50), (1, 40), (1, 15)))
        a, b = rng.integers(0, k, n).tolist(), rng.integers(0, k, m).tolist()
        table = np.zeros((n + 1, m + 1), dtype=int)
        for i in range(n):
            for j in range(m):
                hit = a[i] == b[j] and abs(i - j) <= band
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + hit)
        assert order_minhash._banded(a, b, band) == table[n, m]


def test_long_texts_and_scripts_without_blanks(spark):
    rng = np.random.default_rng(44)
    han = "".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 600))
    long = prose(rng, 20_000)
    rows = [row(1, han), row(2, han[:300] + "。" + han[300:]), row(3, han[::-1]), row(4, long), row(5, long + " end"), row(6, "“" + long.replace(" ", " — ") + "”")]
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4}
    assert [len(w) for w in order_minhash.word_hashes(["漢字かな hello wörld “quoted” x１２".encode(), "한국어 단어".encode(), b"", "é".encode()])] == [8, 2, 0, 1]


# Repeated passages


def brute_late(items):
    """Windows (text number, place) that equal an earlier one of the same key, in the order of (doc, start)."""
    seen, late = {}, set()
    every = sorted((d, lo + k, key, text[k : k + suffix_dedup.LENGTH], i, k) for i, (key, d, lo, n, text) in enumerate(items) for k in range(n))
    for d, at, key, window, i, k in every:
        if (key, window) in seen:
            late.add((d, at))
        seen[key, window] = True
    return late


@pytest.mark.parametrize("room", [1 << 20, 1500])
def test_thinned_texts_and_windows_against_brute_force(monkeypatch, room):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", room)
    rng = np.random.default_rng(45)
    base = [bytes(rng.integers(97, 100, 160, dtype=np.uint8)) for _ in range(4)]
    items = []
    for i in range(120):
        text = base[rng.integers(0, 4)]
        cut = int(rng.integers(0, 30))
        tail = bytes(rng.integers(97, 100, int(rng.integers(0, 20)), dtype=np.uint8))
        text = (text[cut:] + tail)[: int(rng.integers(105, 170))]
        items.append((int(rng.integers(1, 4)), i // 2, 1000 * (i % 2), len(text) - 99, text))
    cols = {"a": np.array([x[0] for x in items], dtype=np.uint64), "doc": np.array([x[1] for x in items]), "file": np.zeros(120, dtype=np.int64), "row": np.array([x[1] for x in items]),
            "lo": np.array([x[2] for x in items]), "n": np.array([x[3] for x in items]), "rel": np.full(120, 40)}
    late, left, texts, whole = suffix_dedup.thinned(cols, [x[4] for x in items])
    flat = lambda c: {(d, lo + k) for d, lo, n in zip(c["doc"].tolist(), c["lo"].tolist(), c["n"].tolist()) for k in range(n)}
    assert flat(late) | flat(left) == {(d, lo + k) for _, d, lo, n, _ in items for k in range(n)} and not flat(late) & flat(left)
    rest = {k: v[~whole] for k, v in left.items()}
    more, windows, _ = suffix_dedup.as_windows(rest, [t for t, w in zip(texts, whole) if not w])
    # Equal windows of other keys may be met as well, and are repeats all the same.
    least, most = brute_late(items), brute_late([(0, *x[1:]) for x in items])
    assert least <= flat(late) | flat(more) <= most and (room == 1500 or not len(more["n"]))
    assert all(len(t) == n + 99 for t, n in zip(texts, left["n"].tolist()))


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        out.append((len(data), sum(gone), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def test_hot_passages_in_many_contexts(spark):
    rng = np.random.default_rng(46)
    line = prose(rng, 12)[:80]  # too short to be a repeat alone, with other letters around it each time
    page = prose(rng, 60)
    texts = [prose(rng, 2) + line + str(rng.choice(["", "x", "yy"])) + prose(rng, 2) for _ in range(400)]
    texts += [page[int(rng.integers(0, 60)) :] + str(i % 7) for i in range(300)]
    texts += [page] * 30 + ["ab" * 3000, "ab" * 2000, "é" * 300, None, ""]
    got = suffix_dedup.cleaned(docs(spark, [row(i, t) for i, t in enumerate(texts)]).repartition(3)).collect()
    want = brute_repeats(texts)
    assert len(got) == len(texts)
    for r in got:
        assert (r["_n_bytes"], r["_n_removed"], r["_kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


# Images


def test_copies_against_all_pairs(spark):
    rng = np.random.default_rng(47)
    vectors = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(40)] + [(40, None), (41, [0.0] * 64)], "id long, vec array<double>")
    media = queries.vector_pictures(vectors).collect()
    found = media_copies.describe([media_copies.decoded(bytes(r["media"]) if r["media"] is not None else None) for r in media])
    links = {(media[i]["id"], media[j]["id"]) for j in range(len(media)) for i in range(j) if media_copies.agree(*found[i], *found[j]) >= media_copies.INLIERS}
    assert len({a // 2 for a, b in links if a // 2 == b // 2}) >= 36 and all(a // 2 == b // 2 for a, b in links)
    named = queries.vector_pictures(vectors).select("*", F.lit(1).alias("node"), F.lit("k").alias("key"))
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in media_copies.classes(named).collect()}
    met = sum(got[b][0] == got[a][0] for a, b in links)
    assert met >= 0.9 * len(links) and len(got) == 84
    assert all(got[2 * i] == (2 * i, 0) for i in (40, 41))


def test_small_crops_of_large_images_and_equal_images(spark):
    rng = np.random.default_rng(48)
    a = np.kron(rng.integers(0, 255, (60, 60)), np.ones((8, 8)))
    many = [(i, a[8 * i : 8 * i + 120, 5 * i : 5 * i + 120]) for i in range(1, 12)]
    rows = [(0, a), *many, (20, np.kron(rng.integers(0, 255, (60, 60)), np.ones((8, 8)))), (21, a)]
    df = spark.createDataFrame([(i, bytearray(media_copies.encoded(m))) for i, m in rows] + [(22, None), (23, bytearray(b"P5 2")), (None, None), (0, bytearray(media_copies.encoded(a)))], "id long, media binary")
    got = {r["id"]: r["class_id"] for r in media_copies.classes(df).collect()}
    assert got == {i: 0 for i in [*range(12), 21]} | {20: 20, 22: 22, 23: 23}


# Mixing


def simulated(rows, weight, block_rows):
    """Earliest deadline first, slot by slot, with fractions."""
    from fractions import Fraction

    left = {s: -(-n // block_rows) for s, n in rows.items()}
    served, base, start, out, phase, place = dict.fromkeys(left, 0), dict.fromkeys(left, 0), 0, {}, 0, 0
    for slot in range(sum(left.values())):
        live = {s: Fraction(str(weight(s))) for s in left if base[s] < left[s]}
        total = sum(live.values())
        best = min((math.ceil((served[s] - base[s] + 1) * total / w), s) for s, w in live.items() if served[s] < left[s] and math.floor((served[s] - base[s]) * total / w) <= slot - start)
        s = best[1]
        k = served[s] - base[s]
        out[s, served[s]] = (phase, start + math.floor(k * total / live[s]), start + best[0], slot, place)
        place += min(block_rows, rows[s] - served[s] * block_rows)
        served[s] += 1
        if served[s] == left[s]:
            base, start, phase = dict(served), slot + 1, phase + 1
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 1, "c": 0.37}, {"a": 1e6, "b": 1}, {"a": 1, "b": 1, "c": 1}])
def test_schedule_equals_a_simulation(spark, weights):
    rng = np.random.default_rng(49)
    sizes = dict(zip(weights, rng.integers(30, 300, len(weights)).tolist()))
    df = spark.createDataFrame([(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string")
    want = simulated({f"s{s}": n for s, n in sizes.items()}, lambda s: weights[s[1:]], 4)
    got = pfair.schedule(clashing(df), weights).toPandas()
    for r in got.itertuples():
        v = dict(zip(got.columns, r[1:]))
        phase, release, due, slot, place = want["s" + v["source"], v["_block"]]
        assert (v["_phase"], v["_release"], v["_deadline"], v["_slot"]) == (phase, release, due, slot) and place <= v["_place"] < place + 4
    assert sorted(got["_place"]) == list(range(len(got)))


def test_two_thousand_sources_keep_their_targets():
    rows = {f"s{i:04}": 40 for i in range(2000)}
    weight = lambda s: 1 + int(s[1:]) % 3
    made = list(pfair.plan(rows, weight, 4))
    cells = [x for x in made if x[0] == pfair.CELL]
    assert all(x[10] <= x[12] < x[11] for x in cells)
    total = sum(map(weight, rows))
    first = [x for x in cells if x[1] == 0]
    assert len(first) > 3000 and [x[12] for x in first] == list(range(len(first)))
    served = dict.fromkeys(rows, 0)
    for t, x in enumerate(first, 1):
        served[x[2]] += 1
        if t % 97 == 0:
            assert all(abs(served[s] * total - weight(s) * t) < total for s in rows)
    ends = {s: 0 for s in rows}
    for x in made:
        if x[0] == pfair.SPAN:
            assert x[7] == ends[x[2]]
            ends[x[2]] = x[8]
    assert set(ends.values()) == {10}


# Helpers, clashes and the pipeline


def test_salted_join_gives_the_plain_result(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL ELSE id END AS k")
    right = spark.range(0, 900).selectExpr("id AS k", "id * 10 AS v")
    for how in ("inner", "left"):
        got = sorted(map(str, common.salted_join(left, right, "k", "id", 1000, how).select("id", "k", "v").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))


def test_components_with_a_hot_centre(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    links = spark.createDataFrame([(500, i) for i in range(300)] + [(i, i + 1) for i in range(600, 700)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(links).collect()}
    assert got == {i: 0 for i in [*range(300), 500]} | {i: 600 for i in range(600, 701)}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_clashing_columns_pass_through(spark):
    rng = np.random.default_rng(51)
    big = 2**60 + 1
    rows = [row(big + i, prose(rng, 60), source=f"s{i % 2}") for i in range(12)] + [row(None, None, None, None), row(big, prose(rng, 60))]
    df = clashing(docs(spark, rows))
    model = langid.train(df)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    made = {
        "langid": (langid.predict(df, model), {"_lang", "_score", "_rejected", "_entropy"}),
        "quality": (quality_cnn.score(df, quality_cnn.train([], [])), {"_score"}),
        "bpe": (bpe.tokens(df, path, digests_only=False), {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}),
        "suffix": (suffix_dedup.cleaned(df), {"_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_spans", "_kept"}),
        "schedule": (pfair.schedule(df), set(pfair.RESULTS)),
        "mixed": (pfair.mixed(df), set()),
        "one_of_each": (order_minhash.one_of_each(df), set()),
    }
    for name, (out, new) in made.items():
        assert set(out.columns) == set(df.columns) | new and len(out.columns) == len(set(out.columns)), name
        got = out.collect()
        assert len(got) == len(rows), name
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows), name
        assert all(r[c] == f"{c}!" for r in got for c in CLASHES if c not in new), name
    empty = df.limit(0)
    for out in (langid.predict(empty, model), bpe.tokens(empty, path), suffix_dedup.cleaned(empty), pfair.schedule(empty), order_minhash.one_of_each(empty)):
        assert out.count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = np.random.default_rng(52)
    shared = [prose(rng, 40) for _ in range(3)]
    rows = [row(i, prose(rng, 70) + " " + (shared[i % 3] if i % 4 == 0 else "") + " " + prose(rng, 10), source="abc"[i % 3 if i < 90 else 0]) for i in range(120)]
    rows += [row(200 + i, rows[i][1] + (" tail" if i % 2 else "")) for i in range(15)] + [row(300, None), row(301, "123 !!")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = langid.train(docs(spark, rows))
    kept = [r for r in rows if not langid.decide(model, r[1])[2]]
    grams = [order_minhash.shingles(w) for w in order_minhash.word_hashes([r[1].lower().encode() for r in kept])]
    first = []
    for j in range(len(kept)):  # copies follow what they copy, and only resemble that
        if not any(plain_similarity(grams[i].tolist(), grams[j].tolist()) >= 0.8 for i in first):
            first.append(j)
    kept = [kept[j] for j in first]
    seen, texts = set(), {}
    for r in sorted(kept):
        data = r[1].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        texts[r[0]] = bytes(b for b, g in zip(data, gone) if not g).decode()
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        ids_ = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids_), hashlib.sha256(np.array(ids_, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids_, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    sizes = Counter(r[3] for r in kept)
    plan = simulated({f"s{s}": n for s, n in sizes.items()}, lambda s: 1, 4)
    by_source = defaultdict(list)
    for r in kept:
        by_source[r[3]].append((hashlib.md5(f"11:{r[0]}".encode()).hexdigest(), r[0]))
    place = {i: plan[f"s{s}", k // 4][4] + k % 4 for s, held in by_source.items() for k, (_, i) in enumerate(sorted(held))}
    assert {r["doc_id"]: r["place"] for r in got} == place


def test_bpe_of_long_texts_and_repeated_rows(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tokenizers = pytest.importorskip("tokenizers")
    rng = np.random.default_rng(53)
    long = prose(rng, 20_000) + "a" * 5000
    lib = tokenizers.Tokenizer.from_file(path)
    want = len(lib.encode(long, add_special_tokens=False).ids)
    got = bpe.tokens(docs(spark, [row(1, long), row(1, long), row(2, "")]), path).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, want, want]
