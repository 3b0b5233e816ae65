"""Near-duplicate documents by order MinHash, verified by banded alignment.

Words are runs of letters, marks and digits in lower case; a letter of a script that is written without blanks is a word of its own. A k-mer is ``SHINGLE`` words, labelled with how often it came before in its text. Under each
of ``BANDS`` hash functions the ``MINIMA`` labelled k-mers of least hash are taken, put back in text order and hashed to a key: two texts
agree in a key with a chance that follows their edit similarity, order included. Texts of equal words are one node. First, nodes that share a
key are compared with a leader of that key, where they are not in one component yet: n comparisons a round for a group of n nodes.
A second round has other leaders, and groups that share two keys, which are smaller and purer. Then all other pairs that share a key and are in
different components are tried, in blocks of ``BLOCK`` nodes: a bitmap of each node bounds how many k-mers a pair can have in common, and the pairs that
this bound admits are aligned. So no link between two texts that share a key is lost.

Two texts are linked when an alignment of their k-mers in text order, within a band around the diagonal, pairs L of n and m k-mers with
L / (n + m - L) >= SIMILARITY. The band is as wide as any alignment that good can need. Components of the links are the classes.

Defined cases: null and empty texts, and texts without a word, are classes of their own; texts of fewer than ``SHINGLE`` words are one k-mer; a class is named
by its least doc_id; rows with a null doc_id get the class of their text, null if no other id is in it; repeated rows share a class;
long texts are compared whole; other columns are ignored (kept by ``one_of_each``, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.llm.common import discard, extended, hot_keys, packed, salted_join, shuffled, unpacked, written
from densigrid.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, MINIMA = 16, 4
BLOCK, BITMAP = 64, 2048  # nodes of a block of the last step, bits of a node's bitmap
SHIFTS = (tuple(range(1, 9)),)  # rounds after the first: how far apart the two bands of a pair of keys are

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, (BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, (BANDS, 1), dtype=np.uint64)
_PLANES = 0x32000  # code points that may be letters
# Ranges of scripts that are written without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han)
UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x31FFF)]
NONE, LETTER, ALONE = 0, 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@cache
def letter_kinds() -> np.ndarray:
    """Of each code point whether it is no letter, part of a word, or a word of its own; the last entry stands for all beyond."""
    out = np.zeros(_PLANES + 1, dtype=np.uint8)
    for i in range(_PLANES):
        c = chr(i)
        out[i] = LETTER if c.isalnum() or unicodedata.category(c)[0] == "M" else NONE
    for lo, hi in UNSPACED:
        part = out[lo : hi + 1]
        part[part == LETTER] = ALONE
    return out


def _byte_kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of the letter that each byte of valid UTF-8 belongs to."""
    kinds = letter_kinds()
    out = kinds[:128][buf & 127]
    lead = np.flatnonzero(buf >= 0xC0)
    out[buf >= 0x80] = NONE
    if len(lead):
        size = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)
        point = (buf[lead].astype(np.int64) & (0x7F >> size))
        for k in (1, 2, 3):
            own = size > k
            point[own] = point[own] << 6 | (buf[lead[own] + k] & 0x3F)
        kind = kinds[np.minimum(point, _PLANES)]
        out[lead] = kind
        for k in (1, 2, 3):
            own = size > k
            out[lead[own] + k] = kind[own]
    return out


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text (in lower case, UTF-8)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    kind = _byte_kinds(buf)
    at = np.flatnonzero(kind)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    if not len(at):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    own = kind[at]
    new = np.r_[True, at[1:] != at[:-1] + 1] | ((own == ALONE) & (buf[at] >= 0xC0)) | ((own == LETTER) & np.r_[False, own[:-1] == ALONE])
    first = np.flatnonzero(new)
    lengths = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    h = _mix(np.add.reduceat(_BYTE[buf[at]] * _PLACE[place & 1023], first) + lengths.astype(np.uint64))
    return np.split(h, np.searchsorted(at[first], bounds[:-1]))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of a text, in text order; one k-mer for 1 to SHINGLE - 1 words."""
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return _mix((words * _TURN[: len(words)]).sum(keepdims=True))
    out = words[: len(words) - SHINGLE + 1] * _TURN[0]
    for i in range(1, SHINGLE):
        out = out + words[i : len(words) - SHINGLE + 1 + i] * _TURN[i]
    return _mix(out)


def labelled(grams: np.ndarray) -> np.ndarray:
    """K-mer hashes with the number of earlier occurrences worked in."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return grams
    start = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    out = grams.copy()
    out[order] = np.where(nth > 0, _mix(s + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), s)
    return out


def order_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys: of each, the MINIMA least labelled k-mers in text order."""
    lab = labelled(grams)
    v = _mix(lab[None, :] * _BAND + _ADD)
    if len(lab) > MINIMA:
        at = np.sort(np.argpartition(v, MINIMA - 1, axis=1)[:, :MINIMA], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(lab)), (BANDS, len(lab)))
    out = _ADD[:, 0].copy()
    for i in range(at.shape[1]):
        out = _mix(out * np.uint64(0x165667B19E3779F9) + lab[at[:, i]])
    return out


def _banded(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence whose places differ by ``band`` at most: one bit for each place of the band, which moves along with ``y``."""
    where: dict[int, list[int]] = {}
    for i, h in enumerate(x):
        where.setdefault(h, []).append(i)
    wide = {h: sum(1 << i for i in at) for h, at in where.items() if len(at) > 32}  # symbols of many places, as bits
    width = 2 * band + 1
    full = (1 << width) - 1
    v, base, found = full, -band, 0  # a bit that is off: a place that ends a common subsequence; bit 0 is place ``base``
    for j, h in enumerate(y):
        at = where.get(h)
        if at is None:
            continue
        lo = j - band
        if h in wide:
            hits = (wide[h] >> lo if lo > 0 else wide[h] << -lo) & full
        else:
            hits = sum(1 << i - lo for i in at if 0 <= i - lo < width)
        if not hits:
            continue
        if lo > base:
            step = min(lo - base, width)
            found += step - (v & ((1 << step) - 1)).bit_count()
            v = (v >> step) | (full >> (width - step) << (width - step))
            base = lo
        u = v & hits
        v = ((v + u) | (v - u)) & full
    return found + width - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, need: float = SIMILARITY) -> float:
    """L / (n + m - L) of the best alignment within the band, or 0.0 where ``need`` is out of reach. Bit-parallel over the band."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < need * max(n, m):
        return 0.0
    least = need / (1 + need) * (n + m)
    band = int(n + m - 2 * least) + 1
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[head:][::-1][: k - head] != b[head:][::-1][: k - head])
    tail = int(differ[0]) if len(differ) else k - head
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if len(x) and len(y):
        if common + len(np.intersect1d(x, y)) + max(0, len(x) - len(np.unique(x))) < least:
            return 0.0
        common += _banded(x.tolist(), y.tolist(), band)
    return common / (n + m - common)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (doc_id, node, keys, words, text_id): node is the digest of the words, null without any; words are 32-bit hashes."""
    spec = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.md5(text_col).alias("text_id"))

    def sign(texts: list) -> tuple:
        nodes, keys, words = [], [], []
        for lo in range(0, len(texts), 512):
            for w in word_hashes([t.lower().encode() if isinstance(t, str) else b"" for t in texts[lo : lo + 512]]):
                nodes.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None)
                keys.append(order_keys(shingles(w)).view(np.int64) if len(w) else None)
                words.append((w >> np.uint64(32)).astype(np.uint32).tobytes() if len(w) else None)
        return nodes, keys, words

    return written(extended(spec, ["text"], "node binary, keys array<bigint>, words binary", sign, drop=("text",)), "omh-signatures")


def verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of nodes that align, with their similarity; sequences (node, words)."""
    left = sequences.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    right = sequences.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    met = pairs.join(shuffled(left), "b").join(shuffled(right), "a").select("a", "b", "wa", "wb")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: shingles(np.frombuffer(x, dtype=np.uint32).astype(np.uint64))
        for rows in batches:
            held: tuple = (None, None)
            sims = []
            for a, wa, wb in zip(rows["a"], rows["wa"], rows["wb"], strict=True):
                if held[0] != a:
                    held = (a, read(wa))
                sims.append(aligned(held[1], read(wb)))
            out = pd.DataFrame({"a": rows["a"], "b": rows["b"], "similarity": sims})
            yield out[out["similarity"] >= SIMILARITY]

    return met.mapInPandas(check, "a binary, b binary, similarity double")


def link_nodes(signed: DataFrame) -> DataFrame | None:
    """Components (node, comp) of the nodes of signatures() that are linked; None when no two nodes share a key."""
    one = signed.where(F.col("node").isNotNull())
    # Texts of n and m k-mers can only be that similar if n >= SIMILARITY * m, so their size classes are at most one apart.
    size = F.greatest(F.lit(1), F.floor(F.octet_length("words") / 4) - SHINGLE + 1)
    of_node = one.select("node", "keys", size.alias("size")).groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))
    keyed = of_node.select("node", "size", F.explode("keys").alias("key")).distinct()
    single = _shared(keyed, "omh-shared")
    if single.limit(1).count() == 0:
        return None
    needed = single.select("node").distinct()
    sequences = written(one.select("node", "words").join(shuffled(needed), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "omh-words")
    comps = _round(single, sequences, None, 0)
    # The second round asks for any two of a node's keys at once: its groups are smaller and purer. It only spares work; the last step tries what it leaves.
    known = written(of_node.join(shuffled(needed), "node", "left_semi"), "omh-known")
    for r, shifts in enumerate(SHIFTS, 1):
        two = F.array(*(F.xxhash64(F.lit(d), F.lit(i), F.col("keys")[i], F.col("keys")[(i + d) % BANDS]) for d in shifts for i in range(BANDS)))
        rows = _shared(known.select("node", "size", F.explode(two).alias("key")), "omh-shared")
        comps = _round(rows, sequences, comps, r)
        discard(rows)
    discard(known)
    pairs = written(_rest(single, sequences, comps), "omh-pairs")
    fresh = written(verified(pairs, sequences), "omh-links")
    discard(pairs, single, sequences)
    return _joined(fresh, comps)


def _joined(links: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Components of the new ``links`` and those known before."""
    if comps is not None and links.limit(1).count() == 0:
        discard(links)
        return comps
    out = components(links.select("a", "b") if comps is None else links.select("a", "b").union(comps.select("node", "comp")), "omh-components")
    discard(links, comps)
    return out


def bitmap(grams: np.ndarray) -> bytes:
    """For each of BITMAP buckets of k-mer hashes, whether an odd number of k-mers fall in it."""
    return np.packbits((np.bincount((grams % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


_MEMBER = np.dtype([("node", "V16"), ("comp", "<u8", (2,)), ("size", ">i4"), ("bits", "<u8", (BITMAP // 64,))])


def _admitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of two blocks, in different components, that can align well enough.

    Buckets in which bitmaps differ hold k-mers without a partner; L paired k-mers of n and m leave n + m - 2 L without.
    """
    n, m = x["size"].astype(np.float64)[:, None], y["size"].astype(np.float64)[None, :]
    ok = (x["comp"][:, None] != y["comp"][None, :]).any(axis=2) & (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-6)
    i, j = np.nonzero(ok)
    alone = np.bitwise_count(x["bits"][i] ^ y["bits"][j]).sum(axis=1, dtype=np.int64)
    good = alone * (1 + SIMILARITY) <= (1 - SIMILARITY) * (x["size"][i] + y["size"][j]) + 1e-6
    return i[good], j[good]


def _rest(rows: DataFrame, sequences: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that share a key, are in different components and can align well enough."""
    total = rows.count()
    at = rows.select("node", "size", "key").join(shuffled(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    # Large components of a group have blocks of their own, which needn't meet each other; the others share blocks.
    own = F.col("n") > BLOCK
    open_keys = of_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("pooled")).where(F.col("comps") > 1)
    dealt = written(
        of_comp.join(shuffled(open_keys), "key").select("key", "comp", F.when(own, F.col("comp")).alias("whose"), F.ceil(F.when(own, F.col("n")).otherwise(F.col("pooled")) / BLOCK).alias("blocks")), "omh-open",
    )

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"node": part["node"], "bits": [bitmap(shingles(np.frombuffer(w, dtype=np.uint32).astype(np.uint64))) for w in part["words"]]})

    mine = at.withColumn("own", F.struct("key", "comp")).drop("comp", "key")
    placed = salted_join(mine, dealt.withColumn("own", F.struct("key", "comp")), "own", "node", total).withColumn("place", F.pmod(F.xxhash64("node"), F.col("blocks")))
    marked = sequences.join(shuffled(placed.select("node").distinct()), "node", "left_semi").mapInPandas(mark, "node binary, bits binary")
    # A size's four bytes, the first of them highest.
    member = F.concat("node", "comp", F.unhex(F.lpad(F.hex("size"), 8, "0")), "bits")
    blocks = placed.join(shuffled(marked), "node").groupBy("key", "whose", "place").agg(F.collect_list(member).alias("members"))
    blocks = written(blocks.withColumn("block", F.coalesce(F.hex("whose"), F.lit(""))).select("key", "whose", "block", "place", "members"), "omh-blocks")
    side = lambda x: blocks.select("key", *(F.col(c).alias(c + x) for c in ("whose", "block", "place", "members")))
    first, second = F.struct("block1", "place1"), F.struct("block2", "place2")
    met = side("1").join(shuffled(side("2")), "key").where((first <= second) & (F.col("whose1").isNull() | F.col("whose2").isNull() | (F.col("whose1") != F.col("whose2"))))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for one, two in zip(part["members1"], part["members2"], strict=True):
                x, y = (np.frombuffer(b"".join(z), dtype=_MEMBER) for z in (one, two))
                i, j = _admitted(x, y)
                a, b = [x["node"][k].tobytes() for k in i], [y["node"][k].tobytes() for k in j]
                yield pd.DataFrame({"a": [min(p) for p in zip(a, b)], "b": [max(p) for p in zip(a, b)]})

    return met.select("members1", "members2").mapInPandas(meet, "a binary, b binary").distinct()


def _shared(keyed: DataFrame, label: str) -> DataFrame:
    """The rows (node, size, key) whose key has several nodes, written."""
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    return written(keyed.join(shuffled(groups), "key").select("node", "size", "key"), label)


def _round(rows: DataFrame, sequences: DataFrame, comps: DataFrame | None, r: int) -> DataFrame:
    """Components after each key's leader is compared with the nodes of its key that are in other components."""
    at = rows.withColumn("comp", F.col("node")) if comps is None else rows.join(shuffled(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # First one order for all keys, so a group mostly has one leader; then an order for each key.
    turn = F.xxhash64("node", F.lit(r)) if r == 0 else F.xxhash64("node", "key", F.lit(r))
    order = F.struct(turn.alias("h"), F.col("node").alias("leader"), F.col("comp").alias("leader_comp"), F.col("size").alias("leader_size"))
    leaders = at.groupBy("key").agg(F.min(order).alias("top"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") != F.col("c1"))
    near = (F.least("size", "top.leader_size") >= SIMILARITY * F.greatest("size", "top.leader_size")) & (F.col("comp") != F.col("top.leader_comp"))
    total = rows.count()
    pairs = (
        salted_join(at, leaders.select("key", "top"), "key", "node", total, hot=hot_keys(rows, "key", total)).where(near)
        .select(F.least("node", "top.leader").alias("a"), F.greatest("node", "top.leader").alias("b")).distinct()
    )
    asked = written(pairs, "omh-pairs")
    fresh = written(verified(asked, sequences), "omh-links")
    discard(asked)
    return _joined(fresh, comps)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, text_id, comp) of every row of ``docs``; comp is null without words."""
    signed = signatures(docs, id_col, text_col)
    comps = link_nodes(signed)
    rows = signed.select("doc_id", "node", "text_id")
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    # Rows without words stay out of the join, where they would meet in one task; a node of very many copies is dealt to several.
    met = salted_join(rows.where(F.col("node").isNotNull()), comps, "node", "doc_id", signed.count(), "left")
    met = met.select("doc_id", "node", "text_id", F.coalesce("comp", "node").alias("comp"))
    out = written(met.union(rows.where(F.col("node").isNull()).withColumn("comp", F.col("node"))), "omh-rows")
    discard(signed, comps)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``: the least doc_id of its class, its own without words."""
    rows = _components(docs, id_col, text_col)
    has = F.col("comp").isNotNull()
    names = rows.where(has).groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    met = salted_join(rows.where(has), names, "comp", "doc_id", rows.count(), "left")
    return met.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).union(rows.where(~has).select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs`` (doc_id, text, ...), the first by id and then by text; rows with a null id stay."""
    rows = _components(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    # Rows without words are a class for each id.
    alone = F.when(F.col("comp").isNull(), F.col("doc_id"))
    first = rows.groupBy("comp", alone.alias("alone")).agg(F.min(F.struct("doc_id", "node", "text_id")).alias("top"))
    kept = first.select(F.col("top.doc_id").alias("kept"), F.col("top.text_id").alias("kept_text"))
    own = docs.where(F.col("doc_id").isNotNull()).select(packed(docs), F.col("doc_id").alias("id"), F.md5("text").alias("text_id"))
    met = own.join(shuffled(kept), (F.col("id") == F.col("kept")) & F.col("text_id").eqNullSafe(F.col("kept_text")), "left_semi").dropDuplicates(["id", "text_id"])
    return unpacked(met, docs).unionByName(docs.where(F.col("doc_id").isNull()))
