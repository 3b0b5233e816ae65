"""Fill-in-middle, conversation repair and secret scans against brute force, with their edge cases."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from densigrid.llm import conversation_repair, fill_in_middle, queries, secret_scan


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


CLASHES = "row r0 i0 key base tokens spans live copied _form _units n_hex conv seg pos start end hash".split()


def clashing(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHES if c not in df.columns))


# Fill-in-middle


def test_ropes_split_and_join_like_strings(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "LEAF", 5)
    rng = random.Random(3)
    for units in (fill_in_middle.Units(), fill_in_middle.Units(r"\S+\s*")):
        for _ in range(60):
            text = "".join(rng.choice("ab é😀\n ") for _ in range(rng.randrange(0, 120)))
            ends = list(units.ends(text))
            rope = units.rope(text)
            assert str(rope) == text and rope.units == len(ends) and rope.points == len(text)
            k = rng.randrange(0, len(ends) + 1)
            low, high = units.split(rope, k)
            assert str(low) == text[: ends[k - 1] if k else 0] and low.units == k and high.units == len(ends) - k and str(low) + str(high) == text
            back = fill_in_middle.joined(high, low)
            p = rng.randrange(0, len(text) + 1)
            assert [str(x) for x in fill_in_middle.split_points(back, p)] == [str(back)[:p], str(back)[p:]]

            def balanced(r):
                return r.left is None or (abs(r.left.height - r.right.height) <= 1 and balanced(r.left) and balanced(r.right))

            assert balanced(back) and balanced(low) and balanced(high)


def plainly(text, id_):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return "plain", n, None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", n, a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", n, a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_texts_are_rearranged_and_restored(spark):
    rng = random.Random(4)
    texts = [None, "", "x", "a<S>b", "<", "S>", "é😀" * 3000, "long " * 60000, "same", "same"] + ["".join(rng.choice("ab<SPM>é \n😀") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, "a<S>b")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = fill_in_middle.inverted(fill_in_middle.transformed(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["_form"], r["_units"], r["_prefix_chars"], r["_middle_chars"], r["_output"]) == plainly(r["text"], r["doc_id"])
        assert r["_restored"] == (r["text"] or "") and r["row"] == "row!" and r["seg"] == "seg!"
    digests = fill_in_middle.digests(docs).collect()
    assert sorted((str(r["doc_id"]), r["_output_sha256"], r["_restored_sha256"]) for r in digests) == sorted((str(i), sha(plainly(t, i)[4]), sha(t or "")) for i, t in rows)
    assert {r["_form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(docs.limit(0)).count() == 0


def test_words_as_units_and_other_sentinels(spark):
    plan = fill_in_middle.Plan("7", plain=0, spm=50, units=fill_in_middle.Units(r"\w+\W*"), sentinels=("[[p]]", "[[s]]", "[[m]]"))
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i))) for i in range(1, 40)], "doc_id long, text string")
    for r in fill_in_middle.inverted(fill_in_middle.transformed(docs, plan), plan).collect():
        assert r["_restored"] == r["text"] and r["_units"] == r["doc_id"] and r["_form"] in ("psm", "spm")
        assert r["text"][: r["_prefix_chars"]] == "" or r["text"][: r["_prefix_chars"]][-1] == " " or r["_prefix_chars"] == len(r["text"])


# Conversations


def brute(rows):
    """The least (cost, audit) over all edits of (role, text) rows, with the roles and texts that they give."""
    seen, must, cut = set(), [], []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        must.append(not body or (role, text) in seen)
        cut.append(bool(body) and body[-1] not in ".!?")
        seen.add((role, text))
    gap = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    for edits in itertools.product(*(("D",) if m else ("D", "K", "Ru", "Ra") for m in must)):
        for extra in itertools.product(gap, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for x in extra[k]:
                    cost, audit = cost + 3, audit + "I"
                    out.append((x, "user" if x == "u" else "assistant", ""))
                if k < len(rows):
                    e = edits[k]
                    audit += e[0]
                    cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if cut[k] and e != "D" else 0)
                    if e != "D":
                        role = rows[k][0] if e == "K" else {"u": "user", "a": "assistant"}[e[1]]
                        out.append((role[:1], role, rows[k][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for _, r, t in out))
    return best


def test_edits_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", " ", "d?"])) for _ in range(rng.randrange(1, 4))]
        got = conversation_repair._whole([{"turn": 1, "role": r, "text": t, "blank": not t.strip(), "cut": bool(t.strip()) and t.strip()[-1] not in ".!?"} for r, t in rows], True)
        cost, audit, text = brute(rows)
        assert (got["cost"], got["audit"], got["sha256"]) == (cost, audit, sha(text)), rows
        assert conversation_repair.as_text([(x["edit"], x["role"], x["text"]) for x in got["lines"]]) == (text or None)


def test_ways_stay_few_and_long_conversations_are_linear():
    rng = random.Random(6)
    rows = [(rng.choice("sua") if k % 50 else "", rng.random() < 0.1, rng.random() < 0.2) for k in range(30000)] + [("u", False, False)] * 30000 + [("", True, False)] * 30000
    conversation_repair._layer.cache_clear()
    ends = conversation_repair.viterbi(rows)
    assert conversation_repair._layer.cache_info().currsize < 2000
    cost, audit = ends[3]
    assert len(audit) - audit.count("I") == len(rows) and cost >= 4 * 30000


def together(rows):
    """Summaries of all conversations of (conv, turn, role, text), each worked out in memory."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, held in by.items():
        own = []
        for has, turn, role, text in sorted(held, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode())):
            body = text.strip(" \t\n\x0b\x0c\r")
            own.append({"turn": turn if has else None, "role": role, "text": text, "blank": not body, "cut": bool(body) and body[-1] not in ".!?"})
        got = conversation_repair._whole(own, False)
        out[c] = tuple(got[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"))
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_conversations_over_many_tasks(spark, parts):
    rng = random.Random(7)
    big = 2**60
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""])
    text = lambda: rng.choice(["yes.", "no", "why?", None, "", "\t", "é😀.", "x" * 50]) + rng.choice(["", " ", "1!"]) if rng.random() < 0.9 else None
    text = lambda: (rng.choice(["yes.", "no", "why?", "", "\t", "é😀.", "x" * 50]) + str(rng.randrange(60)) + rng.choice(["", ".", " !"])) if rng.random() < 0.9 else rng.choice([None, " "])  # noqa: E731, F811
    rows = [(c, rng.choice([k, k, k + 1, None]), role(), text()) for c in [None, big, big + 1, *range(30)] for k in range(rng.randrange(1, 9))]
    rows += [(77, k // 2 * 2, role(), text()) for k in range(1500)] + [(78, None, "user", "same.")] * 120 + [(79, 5, "user", None)] * 40
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(clashing(df)).collect()}
        want = together(rows)
        assert got == want
        turns = defaultdict(list)
        for r in conversation_repair.repaired_turns(df).orderBy("seg", "n").collect():
            turns[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
        assert {c: ("".join(e for e, _, _ in x), sha(conversation_repair.as_text(x) or "")) for c, x in turns.items()} == {c: (w[6], w[7]) for c, w in want.items()}
        assert conversation_repair.repair(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damage_and_conversations_without_rows(spark, tmp_path):
    import zlib

    rows = [(c, k, ["user", "assistant"][k % 2], f"Text {c} {k}. Yes!") for c in range(60) for k in range(3)] + [(None, 1, "user", "Hi."), (5000, None, None, None)]
    gone = next(c for c in itertools.count(6000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, k, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if k is None else k}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        damaged += [] if fault == 0 else [(c, k, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    want = together(damaged)
    got = {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", sha(""))) for c in {r[0] for r in rows}} and gone not in want


# Secrets


PLAIN = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"), "owned": re.compile("[A-Za-z0-9+/_=-]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "owned": 20}


def scanned(rows):
    spans, owners, repositories = [], defaultdict(set), defaultdict(set)
    for repository, owner, text in rows:
        own = []
        for kind, (name, pattern) in enumerate(PLAIN.items()):
            for m in pattern.finditer(text or ""):
                value = m[1] if name == "assign" else m[0]
                alive = bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value) and len(set(value)) >= 10)
                if len(value) >= LEAST[name] and (kind < 3 or alive):
                    own.append((m.start(), kind, m.end(), value, alive))
                    owners[value].add(owner)
                    repositories[value].add(repository)
        spans.append(sorted(own))
    out = []
    for own in spans:
        base = [s for s in own if s[1] < 3]
        own = [s for s in own if s[1] < 3 or not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        copied = lambda s: len(owners[s[3]]) >= 3 or len(repositories[s[3]]) >= 30
        live = [s for s in own if s[4] and not copied(s)]
        text = lambda xs: ",".join(f"{list(PLAIN)[s[1]]}:{s[0]}:{s[2]}" for s in xs)
        out.append((*(sum(s[1] == k for s in base) for k in range(3)), sha(text(base)), text([s for s in own if s[1] < 3 or s in live]), text(live), text([s for s in own if copied(s)])))
    return out


def test_secrets_and_their_owners_against_brute_force(spark):
    rng = random.Random(8)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexes, base64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    shared = [some(hexes, 40), some(base64, 30), "AKIA" + some("ABCDEFGH0123456789", 16)]
    parts = [
        lambda: 'Token = "%s"' % some(hexes, 40), lambda: f"api_key:{some(base64, 12)}", lambda: "password=short", lambda: "token=token: abcdefgh1", lambda: "PASSWD : 'x'", lambda: "AKIA" + some("ABC123", rng.randrange(10, 22)),
        lambda: some(hexes, rng.randrange(20, 30)), lambda: some(base64, rng.randrange(15, 40)), lambda: rng.choice(shared), lambda: f"secret={rng.choice(shared)}", lambda: "a" * 30, lambda: "1" * 30,
        lambda: "étoile 😀 ", lambda: "plain words here", lambda: "toKenſ=abcdefg12", lambda: "ſecret=abcdefg12",
    ]
    rows = [(i, f"o{rng.randrange(6)}", " ".join(rng.choice(parts)() + rng.choice([" ", "\n", ", "]) for _ in range(rng.randrange(0, 8)))) for i in range(300)]
    copy = some(base64, 24) + "1aB2cD3eF"
    rows += [(1000 + i, "hot", f"x {copy} y") for i in range(35)] + [(2000, None, None), (None, None, ""), (2001, "o1", " ".join(some(hexes, 26) for _ in range(3000))), (7, "o1", "token = abcdef123456 é"), (7, "o1", "token = abcdef123456 é")]
    docs = clashing(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, repository long, owner string, text string"))
    got = [tuple(r[c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "live", "copied")) for r in secret_scan.scan(docs).orderBy("n").collect()]
    want = scanned(rows)
    for g, w, r in zip(got, want, rows, strict=True):
        assert g == w, r
    assert any("owned" in w[4] for w in want) and any(w[6] for w in want) and "key!" in tuple(secret_scan.scan(docs).first())
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secrets_stay_in_sql_functions(spark):
    docs = spark.createDataFrame([(1, 1, "o", "token = abcdef123456")], "n long, repository long, owner string, text string")
    plan = secret_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 1000)], "x array<int>")
    for r in df.select("x", secret_scan.running(F.col("x")).alias("s")).collect():
        assert r["s"] == list(itertools.accumulate(r["x"]))
