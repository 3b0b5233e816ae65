"""The registered query of each operator: whole tables in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.llm import ann_forest, bpe, conversation_repair, fill_in_middle, langid, media_copies, order_minhash, pfair, quality_cnn, secret_scan, suffix_dedup, url_rules, warc
from densigrid.llm.common import table, text_bucket

URL_POLICY = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.5
QUALITY_CUT = 0.3


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rp_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    rows = ann_forest.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann_forest.search(ann_forest.build_index(rows, 5), rows.where(F.col("vec_id") % 50 == 0), 5)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "url", F.encode("html", "UTF-8").alias("payload"))
    found = warc.read_archives(warc.write_archives(pages, min_bytes=0), keep_payload=False)
    return found.where("kind = 'record'").select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page; labelled pages of low quality or toxic content are the blocked ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    labelled = pages.join(labels, "page_id").select("url", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    return url_rules.judge(pages, labelled, URL_POLICY, MIN_SUPPORT, MIN_CONFIDENCE).select("page_id", "host", "path", "rule", "verdict", "mined")


def op4_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned without those of remainder 2."""
    docs = table(spark, sf_dir, "documents")
    held = text_bucket("doc_id", 4) == 2
    model = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep_text=False).select(
        "doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"),
    )


def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokens(docs, vocabulary_path(), keep_text=False)


def op6_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = text_bucket("doc_id", 5) == 0
    net = quality_cnn.train(*quality_cnn.training_rows(docs, table(spark, sf_dir, "labels").where(~held)))
    scored = quality_cnn.score(docs, net, keep_text=False)
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that start earlier."""
    found = suffix_dedup.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", *(F.col(f"_{x}").alias(x) for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


def drawn(vec: list | None) -> object:
    """A gray picture of a vector (None without finite components): coarse blocks of its components, and finer ones of products of two."""
    import numpy as np

    v = np.array([x for x in (vec if vec is not None else []) if x is not None and np.isfinite(x)], dtype=np.float64)
    side = int(np.sqrt(len(v)))
    if side < 2 or not v.any():
        return None
    v = v[: side * side] / np.abs(v).max()
    v /= np.sqrt((v * v).mean())
    coarse = v.reshape(side, side)
    fine = np.outer(np.r_[v[::3], v[1::3], v[2::3]], v)[: 2 * side, : 2 * side]
    img = np.kron(coarse, np.ones((8, 8)))
    img[: 4 * len(fine), : 4 * fine.shape[1]] += 0.6 * np.kron(np.clip(fine, -2, 2), np.ones((4, 4)))
    return 127.5 + 40 * img


def edited(img, i: int):
    """A crop of three quarters to nine tenths of a side, with other brightness and contrast, slight noise, and for every other id a quarter turn; all by the id."""
    import numpy as np

    rng = np.random.default_rng([i & 0x7FFFFFFF, 2])
    h, w = img.shape
    ch, cw = (int(n * rng.uniform(0.75, 0.9)) for n in (h, w))
    top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
    out = (img[top : top + ch, left : left + cw] - 127.5) * rng.uniform(0.7, 1.1) + 127.5 + rng.uniform(-15, 15) + rng.normal(0, 1.0, (ch, cw))
    return np.rot90(out) if i % 2 else out


def vector_pictures(vectors: DataFrame) -> DataFrame:
    """(id, media): two images for each vector (id, vec), its picture with the id 2 id and an edited copy of it with 2 id + 1."""

    def draw(batches):
        import pandas as pd

        for rows in batches:
            for lo in range(0, len(rows), 256):
                ids, media = [], []
                for i, vec in zip(rows["id"].iloc[lo : lo + 256].tolist(), rows["vec"].iloc[lo : lo + 256]):
                    img = drawn(vec)
                    ids += [2 * i, 2 * i + 1]
                    media += [None, None] if img is None else [media_copies.encoded(img), media_copies.encoded(edited(img, i))]
                yield pd.DataFrame({"id": ids, "media": media})

    return vectors.mapInPandas(draw, "id long, media binary")


def op9_local_descriptor_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among two images for each of the embeddings, its picture and an edited copy; the tables hold no media."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    found = media_copies.classes(vector_pictures(vectors))
    return found.select(F.floor(F.col("id") / 2).cast("long").alias("vec_id"), F.pmod("id", F.lit(2)).cast("int").alias("copy"), "class_id", "n_links")


def mix_weight(source: str | None) -> int:
    """The target weight of a source in the mix of op10: 1 to 5, by the last letter of its name."""
    return 1 + ord((source or "x")[-1]) % 5


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phase, block, window, slot and place in the mix, with weights of 1 to 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.schedule(docs, mix_weight).select("doc_id", "source", *(F.col(f"_{x}").alias(x) for x in ("phase", "block", "release", "deadline", "slot", "place")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three by its id, rearranged and restored."""
    found = fill_in_middle.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_units").alias("n"), *(F.col(f"_{x}").alias(x) for x in ("form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row of four damaged, by the id and turn; nulls are one space."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(damaged(rows)).withColumnRenamed("conv_id", "found_id")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document stands for a repository, its source for the owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("repository"), F.col("source").alias("owner"))
    return secret_scan.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "live", "copied")


def queries() -> dict:
    found = [op1_rp_forest_search, op2_warc_salvage, op3_url_association_rules, op4_kneser_ney_langid, op5_backtracking_bpe, op6_byte_cnn_quality, op7_order_minhash, op8_suffix_array_dedup, op9_local_descriptor_copies, op10_pfair_mixing,
             op11_fill_in_middle, op12_conversation_repair, op13_secret_ownership]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_salvage": WARC_SQL, "op10_pfair_mixing": MIX_SQL, "op11_fill_in_middle": MIDDLE_SQL, "op12_conversation_repair": REPAIR_SQL, "op13_secret_ownership": SECRETS_SQL,
    }


# The digest's base32: each five hex digits are four base32 digits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
n AS (SELECT page_id, payload_bytes, h, list_transform(range(0, 40, 5), lambda i: CAST(('0x' || substr(h, CAST(i + 1 AS BIGINT), 5)) AS BIGINT)) AS v FROM d),
b AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(v, lambda x:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 15) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 10) & 31 AS BIGINT) + 1, 1) ||
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 5) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM n),
m AS (SELECT h, max(page_id) AS main FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = main THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = main THEN NULL ELSE main END AS refers_to
FROM b JOIN m USING (h)
"""

# The schedule slot by slot; a state holds, by source, the blocks served and those served before the phase.
MIX_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END AS name, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, source, name, row_number() OVER (PARTITION BY name ORDER BY h) - 1 AS seq FROM d),
src AS (SELECT name, count(*) AS n, (count(*) + 3) // 4 AS blocks, 1 + ord(CASE WHEN coalesce(max(source), '') = '' THEN 'x' ELSE right(max(source), 1) END) % 5 AS w FROM n GROUP BY name),
l AS (SELECT list(name ORDER BY name) AS names, list(blocks ORDER BY name) AS blocks, list(w ORDER BY name) AS w, sum(blocks) AS slots FROM src),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS start, list_transform(blocks, lambda x: CAST(0 AS BIGINT)) AS base, list_transform(blocks, lambda x: CAST(0 AS BIGINT)) AS served,
    CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline FROM l
  UNION ALL
  SELECT t, phase, start, base, list_transform(range(1, len(served) + 1), lambda i: CAST(served[i] + (CASE WHEN i = pick.i THEN 1 ELSE 0 END) AS BIGINT)), pick.i, served[pick.i], start + pick.rel, start + pick.due
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(served) + 1), lambda i: served[i] < blocks[i] AND (served[i] - base[i]) * whole // w[i] <= t - start),
      lambda i: {'due': CAST(((served[i] - base[i] + 1) * whole + w[i] - 1) // w[i] AS BIGINT), 'i': i, 'rel': CAST((served[i] - base[i]) * whole // w[i] AS BIGINT)})) AS pick
    FROM (SELECT *, CAST(list_sum(list_transform(range(1, len(served) + 1), lambda i: CASE WHEN base[i] < blocks[i] THEN w[i] ELSE 0 END)) AS BIGINT) AS whole
      FROM (SELECT slot + 1 AS t, CASE WHEN ended THEN phase + 1 ELSE phase END AS phase, CASE WHEN ended THEN slot + 1 ELSE start END AS start, CASE WHEN ended THEN served ELSE base END AS base, served, blocks, w
        FROM (SELECT edf.*, l.*, len(list_filter(range(1, len(served) + 1), lambda i: served[i] = l.blocks[i] AND base[i] < l.blocks[i])) > 0 AS ended FROM edf, l WHERE edf.slot + 1 < l.slots)))))
SELECT n.doc_id, n.source, CAST(e.phase AS INTEGER) AS phase, e.block, e.release, e.deadline, e.slot, row_number() OVER (ORDER BY e.slot, n.seq) - 1 AS place
FROM n JOIN (SELECT edf.*, names[s] AS name FROM edf, l WHERE slot >= 0) e ON n.name = e.name AND n.seq // 4 = e.block
"""

# Lengths and places are in code points.
MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS BIGINT), 8) AS BIGINT)) AS v FROM d),
f AS (SELECT doc_id, t, n, least(v[1] % (n + 1), v[2] % (n + 1)) AS lo, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v[3] % 100 >= 90 THEN 'plain' WHEN v[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, lo, hi, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

# The CRC bit by bit; then one step a row of a conversation, holding the cheapest (cost, audit) of each of the four states.
REPAIR_SQL = """
WITH RECURSIVE d AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, CAST(i AS BIGINT), 1)) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), [CAST(0 AS BIGINT) for b in range(8)]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 20 AS fault FROM d),
w AS (SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE fault <> 0),
o AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM w),
r AS (SELECT g, turn, k, role, text, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY k) AS before, body = '' AS blank,
  row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 AS again, body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM o),
n AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS rows FROM r GROUP BY g),
v AS (
  SELECT g, CAST(0 AS BIGINT) AS k, [{'c': CAST(0 AS BIGINT), 'a': ''}, {'c': 1000000000, 'a': ''}, {'c': 3, 'a': 'I'}, {'c': 6, 'a': 'II'}] AS b FROM n
  UNION ALL
  SELECT g, k, [s0, s1, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}]),
    list_min([s3, {'c': s2.c + 3, 'a': s2.a || 'I'}, {'c': s0.c + 6, 'a': s0.a || 'II'}, {'c': s1.c + 6, 'a': s1.a || 'II'}])] AS b
  FROM (SELECT g, k, {'c': b[1].c + 4, 'a': b[1].a || 'D'} AS s0,
      list_min([{'c': b[2].c + 4, 'a': b[2].a || 'D'}, {'c': b[1].c + more + (CASE WHEN i = 's' THEN 0 ELSE 1000000000 END), 'a': b[1].a || 'K'}]) AS s1,
      list_min([{'c': b[3].c + 4, 'a': b[3].a || 'D'}] || list_transform([b[1], b[2], b[4]], lambda x: {'c': x.c + more + u, 'a': x.a || (CASE WHEN u = 0 THEN 'K' ELSE 'R' END)})) AS s2,
      list_min([{'c': b[4].c + 4, 'a': b[4].a || 'D'}, {'c': b[3].c + more + a, 'a': b[3].a || (CASE WHEN a = 0 THEN 'K' ELSE 'R' END)}]) AS s3
    FROM (SELECT v.g, r.k, v.b, r.i, CASE WHEN i = 'u' THEN 0 ELSE 3 END AS u, CASE WHEN i = 'a' THEN 0 ELSE 3 END AS a, CASE WHEN blank OR again THEN 1000000000 WHEN cut THEN 3 ELSE 0 END AS more FROM v JOIN r ON v.g = r.g AND v.k + 1 = r.k))),
e AS (SELECT v.g, list_min([b[1], b[4]]) AS best FROM v JOIN n ON v.g = n.g AND v.k = n.rows),
t AS (
  SELECT g, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS k, 0 AS state, CAST(NULL AS VARCHAR) AS line, best.a AS audit FROM e
  UNION ALL
  SELECT g, pos + 1, kk, CASE WHEN x = 'D' THEN state WHEN nrole[1] = 's' THEN 1 WHEN nrole[1] = 'u' THEN 2 ELSE 3 END, CASE WHEN x <> 'D' THEN nrole || ':' || CASE WHEN x = 'I' THEN '' ELSE text END END, audit
  FROM (SELECT t.g, t.pos, t.state, t.audit, x, kk, r.text, CASE WHEN x = 'K' THEN r.role WHEN t.state = 2 THEN 'assistant' ELSE 'user' END AS nrole
    FROM (SELECT *, audit[pos] AS x, CASE WHEN audit[pos] = 'I' THEN k ELSE k + 1 END AS kk FROM t WHERE pos <= length(audit)) t LEFT JOIN r ON r.g = t.g AND r.k = t.kk)),
h AS (SELECT g, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS sha FROM t GROUP BY g)
SELECT x.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(e.best.c, 0) AS cost, coalesce(e.best.a, '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM d) x LEFT JOIN n USING (g) LEFT JOIN e USING (g) LEFT JOIN h USING (g)
"""

# Places of matches from the lengths of matches and of what is between them; a text's spans depend on it and on who holds its secrets.
SECRETS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24), (3, 'owned', '[A-Za-z0-9+/_=-]+', 0, 20)) v(kind, name, pattern, grp, least)),
l AS (
  SELECT rid, 0 AS kind, regexp_extract_all(t, (SELECT pattern FROM p WHERE kind = 0)) AS own, regexp_extract_all(t, (SELECT pattern FROM p WHERE kind = 0), 1) AS val, string_split_regex(t, (SELECT pattern FROM p WHERE kind = 0)) AS gap FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS x, x, string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(t, '[0-9a-f]+') AS x, x, string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]+') AS x, x, string_split_regex(t, '[A-Za-z0-9+/_=-]+') FROM d),
u AS (SELECT rid, kind, unnest(range(1, len(own) + 1)) AS i, unnest(own) AS own, unnest(val) AS val, unnest(gap[1:len(own)]) AS gap FROM l WHERE len(own) > 0),
m AS (SELECT u.rid, u.kind, name, val, sum(length(gap) + length(own)) OVER (PARTITION BY u.rid, u.kind ORDER BY i) AS "end", length(own) AS n, least FROM u JOIN p USING (kind)),
a AS (SELECT rid, kind, name, val, CAST("end" - n AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end",
  regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 10 AS alive FROM m WHERE length(val) >= least),
s AS (SELECT * FROM a WHERE kind < 3 OR alive),
o AS (SELECT val, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS repositories, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners FROM s JOIN d USING (rid) GROUP BY val),
c AS (SELECT s.*, owners >= 3 OR repositories >= 30 AS copied, alive AND owners < 3 AND repositories < 30 AS live FROM s JOIN o USING (val)
  WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.kind < 3 AND b.start < s."end" AND s.start < b."end")),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live) AS spans,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE live) AS live, string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE copied) AS copied FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, '') AS live, coalesce(copied, '') AS copied
FROM d LEFT JOIN g USING (rid)
"""
