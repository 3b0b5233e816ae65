"""Removal of repeated passages by difference-cover suffix arrays.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (in a document of smaller id, or earlier in the same one) is
removed; all strings are judged on the input. The strings are windows of ``LENGTH`` bytes. Which windows are equal is decided by suffix order alone; hashes
only bring together what may be equal:

1. Copy. The documents are written once, in files that later steps open by number and row, so texts are never shuffled.
2. Scan. The least hash among the ``GRAM``-byte grams of a window is its anchor, so equal windows have equal anchors at the same place. Windows in a row
   with one anchor are a run, and a run's bytes are its context.
3. Prefilter. Runs meet by anchor, without their bytes. Those whose anchor occurs in no other run have no repeats and leave.
4. Suffix arrays. The contexts of an anchor meet in one part. The texts of a part are sorted by the difference-cover algorithm: triples at places 1 and 2
   modulo 3 are sorted and named, the names are sorted by recursion, the remaining suffixes are merged in, and adjacent suffixes are compared on
   their first ``LENGTH`` bytes. The recursion ends where names cover ``LENGTH`` bytes. The earliest of equal windows stays.

An anchor of many runs is hot. Where many of its runs lie in one batch of a scan, or of a file, a suffix array over these removes
their repeats before anything is moved (windows that repeat an earlier one of the batch are repeats of the whole). What is left of a hot anchor is cut by the windows'
distance to the anchor into pieces of ``PIECE`` windows, which meet by the bytes that all windows of a piece share. Pieces that are hot even so
go on as single windows, which are sorted by their bytes and compared with their neighbours. No step gathers all runs of a hot anchor in one task.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` keep all bytes; rows with null or repeated ids are put in the order (id, nulls last, then
text) and the first counts as the earlier one; long texts are scanned whole, in overlapping parts; an empty table gives an empty result; other columns are kept,
and replaced only where they are named as a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densigrid.llm.common import blocks_of, discard, file_store, packed, unpacked, written

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1  # grams in a window
PIECE = 24  # windows of a piece; they share LENGTH - PIECE + 1 bytes
HOT_BATCH, HOT = 8, 64  # runs of one anchor in a batch, and in all, that make it hot
BUFFER = 1 << 21  # bytes that a scan works on at a time; longer texts go in overlapping parts
BATCH_BYTES = 6 << 20  # bytes of text in a batch of the scan
ARRAY_BYTES = 3 << 19  # bytes of text in one suffix array
PART_BYTES = 4 << 20  # text behind one part of a shuffle
LEAST_PARTS = 256
ROW_GROUP = 8 << 20  # bytes of the copied files that are read at a time

_RNG = np.random.default_rng(20240502)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = np.uint64(22)

# Kinds of rows: windows known to be repeats; runs or pieces; markers of keys that are hot; runs of anchors that are hot in their batch; runs of hot anchors;
# single windows
REPEAT, OPEN, MARK, SPREAD, PIECES, WINDOW = range(6)
RUNS = "part int, kind int, file int, a binary, doc binary, row binary, lo binary, n binary, rel binary"
SPANS = RUNS + ", bytes binary"
_RUNS, _SPANS = ([x.split(" ")[0] for x in k.split(", ")] for k in (RUNS, SPANS))
Cols = dict[str, np.ndarray]  # a = anchor or key, doc = order of the document, file and row = where it is, lo = first window, n = windows, rel = distance to the anchor
_KEYS = ("a", "doc", "file", "row", "lo", "n", "rel")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 16 + 8 bytes from each place."""
    h, width, eight = _BYTE[buf], 1, None
    while width < 16:
        h = _mix(h[:-width] * _MUL[width.bit_length()] + h[width:])
        width *= 2
        if width == 8:
            eight = h
    return _mix(h[: len(h) - 8] * _MUL[6] + eight[16:])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def runs_of(parts: list[tuple[int, int, bytes]]) -> Cols:
    """Runs of windows with one anchor in texts (number, place of the text in its document, bytes): a, i = number, lo, n, rel."""
    buf = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    ends = np.cumsum(sizes)
    h = gram_hashes(buf)
    least = sliding_least((h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64), REACH)
    anchor = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + LENGTH <= ends[owner]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(anchor)]
    lo, hi = lo[whole[lo]], hi[whole[lo]]
    number, base = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int64)
    start = ends - sizes
    return {"a": h[anchor[lo]], "i": number[owner[lo]], "lo": lo - start[owner[lo]] + base[owner[lo]], "n": hi - lo, "rel": anchor[lo] - lo}


def _pick(cols: Cols, which: np.ndarray) -> Cols:
    return {k: v[which] for k, v in cols.items()}


def _joined(parts: list[Cols]) -> Cols:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {k: np.zeros(0, dtype=np.uint64 if k == "a" else np.int64) for k in _KEYS}


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by ``keys``, which are the first of their keys."""
    out = np.zeros(len(keys[0]), dtype=bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _sizes(key: np.ndarray) -> np.ndarray:
    """For each row how many rows have its key."""
    _, place, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[place]


def _planes(v: np.ndarray) -> bytes:
    """Whole numbers by byte planes, the low bytes of all first: high planes hardly change, so that they compress to nothing."""
    return np.ascontiguousarray(v.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(cells) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel() for b in cells]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _packed(part: np.ndarray, kind: int, cols: Cols, texts: list[bytes] | None = None) -> Iterator[tuple]:
    """Rows of RUNS (SPANS with texts): one for each part and file. Repeats need no key, and markers nothing else."""
    order = np.lexsort((cols["lo"], cols["row"], cols["file"], part))
    bounds = np.flatnonzero(_first_of(part[order], cols["file"][order]))
    for lo, hi in zip(bounds, np.r_[bounds[1:], len(order)]):
        at = order[lo:hi]
        key = b"" if kind == REPEAT else cols["a"][at].tobytes()
        where = [b""] * 5 if kind == MARK else [_planes(cols["doc"][at]) if kind != REPEAT else b"", *(_planes(cols[k][at]) for k in ("row", "lo")), cols["n"][at].astype(np.uint8).tobytes(), cols["rel"][at].astype(np.uint8).tobytes()]
        row = (int(part[at[0]]), kind, int(cols["file"][at[0]]), key, *where)
        yield row if texts is None else (*row, b"".join(texts[i] for i in at))


def _unpacked(rows: pd.DataFrame) -> Cols:
    small = lambda c: np.frombuffer(b"".join(rows[c]), dtype=np.uint8).astype(np.int64)
    n = small("n")
    each = [len(x) for x in rows["n"]]
    doc = _whole(rows["doc"])
    return {"a": np.frombuffer(b"".join(rows["a"]), dtype=np.uint64) if len(doc) else np.zeros(len(n), dtype=np.uint64), "doc": doc if len(doc) else np.zeros(len(n), dtype=np.int64),
            "file": np.repeat(rows["file"].to_numpy(dtype=np.int64), each), "row": _whole(rows["row"]), "lo": _whole(rows["lo"]), "n": n, "rel": small("rel")}


def _marks(rows: pd.DataFrame) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(rows.loc[rows["kind"] == MARK, "a"]), dtype=np.uint64))


def _texts(cols: Cols, blob: bytes) -> list[bytes]:
    ends = np.cumsum(cols["n"] + LENGTH - 1)
    return [blob[e - n - LENGTH + 1 : e] for e, n in zip(ends.tolist(), cols["n"].tolist())]


def _names(*symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, from 1, of the tuples of symbols at each place (equal tuples share one), and the places in that order."""
    out, bound = symbols[0], int(symbols[0].max(initial=0)) + 1
    for s in symbols[1:]:
        width = int(s.max(initial=0)) + 1
        if bound * width >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            bound = int(out.max(initial=0)) + 1
        out, bound = out * width + s, bound * width
    order = np.argsort(out)
    ranked = out[order]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]]) if len(order) else 0
    return out, order


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, order) of the suffixes of ``s`` (symbols >= 1) by their first ``depth`` symbols at least; those that agree in so many may be in any order,
    or share a rank. Difference cover {1, 2} modulo 3."""
    n = len(s)
    t = np.concatenate([s, np.zeros(3, dtype=np.int64)])
    if depth <= 3 or n < 6:
        out, order = _names(t[:n], t[1 : n + 1], t[2 : n + 2])
        for _ in range(n if n < 6 else 0):  # short strings: by doubling until whole suffixes are ranked
            out, order = _names(out, np.concatenate([out[3:], np.zeros(min(3, n), dtype=np.int64)])[:n])
        return out, order
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    triple = _names(t[sample], t[sample + 1], t[sample + 2])[0]
    # One string of names: those of places 1 mod 3, an end sign, those of places 2 mod 3
    names = np.concatenate([triple[: len(one)], [0], triple[len(one) :]]) + 1
    inner, inner_order = suffix_order(names, -(-depth // 3))
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[one], rank[two] = inner[: len(one)], inner[len(one) + 1 :]
    width = int(rank.max()) + 1
    z = zero[_names(t[zero] * width + rank[zero + 1])[1]]
    # The sample in order, and its places 1 and 2 alone
    by = inner_order[inner_order != len(one)]
    merged = sample[by - (by > len(one))]
    kind = merged % 3
    order1, order2 = merged[kind == 1], merged[kind == 2]
    # Where the others fall among the sample: symbol and rank against places 1, two symbols and rank against places 2
    symbols = int(t.max()) + 1
    key1 = lambda i: t[i] * width + rank[i + 1]
    pair = lambda i: t[i] * symbols + t[i + 1]
    if symbols * symbols * width < 1 << 62:
        key2 = lambda i: pair(i) * width + rank[i + 2]
    else:
        pairs = np.unique(np.concatenate([pair(order2), pair(zero)]))
        key2 = lambda i: np.searchsorted(pairs, pair(i)) * width + rank[i + 2]
    # Suffixes that agree to ``depth`` may stand in any order; a running maximum evens out what lies beyond it.
    rising = np.maximum.accumulate
    before = rising(np.searchsorted(rising(key1(order1)), key1(z)) + np.searchsorted(rising(key2(order2)), key2(z)))
    order = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(z))
    order[place] = z
    free = np.ones(n, dtype=bool)
    free[place] = False
    order[free] = merged
    ranks = np.empty(n, dtype=np.int64)
    ranks[order] = np.arange(n)
    return ranks, order


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    return suffix_order(s, depth)[0]


def window_classes(texts: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, classes): flat numbers of all windows in suffix order (text i gives ``starts[i]``, from its first bytes on) and, beside them, the class of
    equal ones."""
    joined = np.frombuffer(b"".join(x + b"\0" for x in texts), dtype=np.uint8).astype(np.int64) + 2
    sizes = np.array([len(x) + 1 for x in texts])
    begin = np.cumsum(sizes) - sizes
    joined[begin + sizes - 1] = 1  # the sign between texts
    at = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    number = np.full(len(joined), -1, dtype=np.int64)
    number[at] = np.arange(len(at))
    at = suffix_order(joined, LENGTH)[1]
    order = number[at]
    wanted = order >= 0
    at, order = at[wanted], order[wanted]
    flat = (joined - 2).astype(np.uint8).tobytes() + bytes(8)
    eight = np.ndarray(len(flat) - 7, dtype="<u8", buffer=flat, strides=(1,))  # eight bytes from each place
    same = np.ones(len(at) - 1, dtype=bool)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:  # adjacent prefixes
        left = np.flatnonzero(same)
        v = eight[at[left] + k], eight[at[left + 1] + k]
        same[left] = v[0] == v[1]
    return order, np.cumsum(np.r_[False, ~same]) if len(at) else order


def _runs_left(cols: Cols, texts: list[bytes], late: np.ndarray) -> tuple[Cols, Cols, list[bytes]]:
    """Repeats, and the runs that are left with their texts, for a flag on each window."""
    n = cols["n"]
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    new = np.flatnonzero(_first_of(owner, late))
    size = np.diff(np.r_[new, len(owner)])
    i, d = owner[new], step[new]
    out = _pick(cols, i)
    out["lo"], out["rel"], out["n"] = out["lo"] + d, out["rel"] - d, size
    gone = late[new] if len(new) else np.zeros(0, dtype=bool)
    left = np.flatnonzero(~gone)
    return _pick(out, np.flatnonzero(gone)), _pick(out, left), [texts[i[k]][d[k] : d[k] + size[k] + LENGTH - 1] for k in left.tolist()]


def _one_array(cols: Cols, texts: list[bytes]) -> tuple[Cols, Cols, list[bytes]]:
    """Of equal windows in the texts the earliest stays: (repeats, runs left, their texts), by one suffix array."""
    n = cols["n"]
    order, group = window_classes(texts, n)
    owner = np.repeat(np.arange(len(n)), n)
    start = np.repeat(cols["lo"], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    by = np.lexsort((start[order], cols["doc"][owner[order]], group))
    late = np.zeros(len(owner), dtype=bool)
    late[order[by]] = ~_first_of(group[by])
    return _runs_left(cols, texts, late)


def thinned(cols: Cols, texts: list[bytes]) -> tuple[Cols, Cols, list[bytes], np.ndarray]:
    """(repeats, runs left, their texts, whole): suffix arrays over texts that meet by the key a, those of a key in one array where they fit.

    ``whole`` says of each run left whether all texts of its key were in one array, so that no repeat among them is left. First the texts of a key are sorted as
    suffixes from their anchor on, then by what is before it, and compared with their neighbours: of equal ones the earliest goes on. Groups that are too large for one array
    are cut in that order, and go again as long as that takes out an eighth of them.
    """
    done, kept, kept_texts, kept_whole = [], [], [], []
    todo: list[tuple[Cols, list[bytes]]] = [(cols, texts)] if len(texts) else []
    while todo:
        cols, texts = todo.pop()
        doc, lo = cols["doc"].tolist(), cols["lo"].tolist()
        keys = [(a, t[r:], t[:r], d, x) for a, t, r, d, x in zip(cols["a"].tolist(), texts, np.maximum(cols["rel"], 0).tolist(), doc, lo)]
        order = sorted(range(len(texts)), key=keys.__getitem__)
        same = [k > 0 and keys[i][:3] == keys[order[k - 1]][:3] for k, i in enumerate(order)]
        order, same = np.array(order, dtype=np.int64), np.array(same)
        done.append(_pick(cols, order[same]))
        order = order[~same]
        alone = _sizes(cols["a"][order]) == 1
        kept.append(_pick(cols, order[alone]))
        kept_texts += [texts[i] for i in order[alone].tolist()]
        kept_whole.append(np.ones(alone.sum(), dtype=bool))
        order = order[~alone]
        if not len(order):
            continue
        cols, texts = _pick(cols, order), [texts[i] for i in order.tolist()]
        first = np.flatnonzero(_first_of(cols["a"]))
        size = np.cumsum(np.array([0, *(len(x) + 1 for x in texts)]))
        lo, again = 0, []
        ends = np.r_[first[1:], len(texts)]
        for end, after in zip(ends, np.r_[ends[1:], -1]):
            # Keys are added to an array as long as they fit.
            if after >= 0 and size[after] - size[lo] <= ARRAY_BYTES:
                continue
            if size[end] - size[lo] <= ARRAY_BYTES:
                chunks, all_in = [(lo, end)], True
            else:  # one large key
                cuts = np.searchsorted(size, np.arange(size[lo], size[end], ARRAY_BYTES))
                chunks, all_in = [(x, y) for x, y in zip(cuts, np.r_[cuts[1:], end]) if x < y], False
            found = [_one_array(_pick(cols, np.arange(x, y)), texts[x:y]) for x, y in chunks]
            done += [f[0] for f in found]
            left, left_texts = _joined([f[1] for f in found]), [t for f in found for t in f[2]]
            if not all_in and sum(map(len, left_texts)) < (size[end] - size[lo]) * 7 // 8:
                again.append((left, left_texts))
            else:
                kept.append(left)
                kept_texts += left_texts
                kept_whole.append(np.full(len(left_texts), all_in))
            lo = end
        todo += again
    return _joined(done), _joined(kept), kept_texts, np.concatenate(kept_whole) if kept_whole else np.zeros(0, dtype=bool)


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little")


def as_windows(cols: Cols, texts: list[bytes]) -> tuple[Cols, Cols, list[bytes]]:
    """(repeats, windows, their texts): runs as single windows, sorted by their bytes; the earliest of equal ones stays. The key is a hash of the window."""
    n = cols["n"]
    if not len(n):
        return _joined([]), _joined([]), []
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    out = _pick(cols, owner)
    out["lo"], out["n"], out["rel"] = out["lo"] + step, np.ones(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=np.int64)
    each = [texts[i][d : d + LENGTH] for i, d in zip(owner.tolist(), step.tolist())]
    order = sorted(range(len(each)), key=lambda i: (each[i], out["doc"][i], out["lo"][i]))
    first = np.array([k == 0 or each[i] != each[order[k - 1]] for k, i in enumerate(order)])
    order = np.array(order, dtype=np.int64)
    left = order[first]
    kept = [each[i] for i in left.tolist()]
    windows = _pick(out, left)
    windows["a"] = np.array([_key(x) for x in kept], dtype=np.uint64)
    return _pick(out, order[~first]), windows, kept


def _by_key(a: np.ndarray, parts: int) -> np.ndarray:
    return (a % np.uint64(parts)).astype(np.int64)


def scan(docs: DataFrame, parts: int) -> DataFrame:
    """RUNS of all documents (doc, text, file, row), by part of their anchors; repeats among the runs of an anchor that is hot in its batch are out already."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found, held, size, seen, own = [], [], 0, 0, []
            for doc, text, file, row in zip(rows["doc"].tolist(), rows["text"], rows["file"].tolist(), rows["row"].tolist(), strict=True):
                if seen >= BATCH_BYTES:
                    yield collected(found, held, own)
                    found, held, size, seen, own = [], [], 0, 0, []
                data = text.encode() if isinstance(text, str) else b""
                if len(data) < LENGTH:
                    continue
                own.append((doc, file, row, data))
                for at in range(0, len(data) - LENGTH + 1, BUFFER - LENGTH + 1):
                    part = data[at : at + BUFFER]
                    if size + len(part) > BUFFER:
                        found.append(runs_of(held))
                        held, size = [], 0
                    held.append((len(own) - 1, at, part))
                    size, seen = size + len(part), seen + len(part)
            yield collected(found, held, own)

    def collected(found: list, held: list, own: list) -> pd.DataFrame:
        if held:
            found.append(runs_of(held))
        out: list = []
        if found:
            cols = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            i = cols.pop("i")
            for k, name in enumerate(("doc", "file", "row")):
                cols[name] = np.array([o[k] for o in own], dtype=np.int64)[i]
            hot = _sizes(cols["a"]) >= HOT_BATCH
            out += _packed(_by_key(cols["a"][~hot], parts), OPEN, _pick(cols, ~hot))
            at = np.flatnonzero(hot)
            many = _pick(cols, at)
            late, left, _, _ = thinned(many, [own[d][3][x : x + n + LENGTH - 1] for d, x, n in zip(i[at].tolist(), many["lo"].tolist(), many["n"].tolist())])
            out += _packed(late["row"] % parts, REPEAT, late)
            hot = _sizes(left["a"]) >= HOT_BATCH
            out += _packed(_by_key(left["a"][~hot], parts), OPEN, _pick(left, ~hot))
            many = _pick(left, hot)
            out += _packed(_by_key(_mix(many["a"] ^ (many["doc"] + 1).astype(np.uint64) * _MUL[3]), parts), SPREAD, many)
            keys = np.unique(many["a"])
            marks = {k: np.zeros(len(keys), dtype=np.int64) for k in _KEYS} | {"a": keys}
            out += _packed(_by_key(keys, parts), MARK, marks)
        return pd.DataFrame(out, columns=_RUNS)

    return docs.mapInPandas(work, RUNS)


def prefiltered(runs: DataFrame) -> DataFrame:
    """RUNS without those whose anchor has no other run: OPEN ones of rare anchors, and PIECES of hot ones; repeats pass."""

    def work(at, rows: pd.DataFrame) -> pd.DataFrame:
        cols, out = _unpacked(rows[rows["kind"] == OPEN]), rows.loc[rows["kind"] == REPEAT, _RUNS].values.tolist()
        n, marked = _sizes(cols["a"]), np.isin(cols["a"], _marks(rows))
        hot = marked | (n >= HOT)
        for kind, found in ((OPEN, _pick(cols, ~hot & (n > 1))), (PIECES, _pick(cols, hot)), (PIECES, _unpacked(rows[rows["kind"] == SPREAD]))):
            out += _packed(np.zeros(len(found["a"]), dtype=np.int64), kind, found)
        return pd.DataFrame(out, columns=_RUNS)

    return runs.groupBy("part").applyInPandas(work, RUNS)


class Files:
    """The copied documents: Parquet files by number, with columns doc and text, and row, all columns of the documents."""

    def __init__(self, docs: DataFrame):
        path = docs.written_to
        store, inner = file_store(path)
        from pyarrow import fs

        names = [f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if re.fullmatch(r"part-\d+-.*\.parquet", f.base_name)]
        self.path, self.count = path, len(names)
        self.tail = re.fullmatch(r"part-\d+(-.*)", names[0])[1] if names else ""

    def groups(self, number: int, columns: list[str]) -> Iterator[tuple[int, pa.Table]]:
        """(first row, rows) of the row groups of a file."""
        store, inner = file_store(f"{self.path}/part-{number:05d}{self.tail}")
        with store.open_input_file(inner) as f:
            file, at = pq.ParquetFile(f), 0
            for g in range(file.num_row_groups):
                rows = file.read_row_group(g, columns=columns)
                yield at, rows
                at += len(rows)


def by_file(rows: DataFrame, files: Files, work: Callable[[int, pd.DataFrame], Iterator], schema, arrow: bool = False) -> DataFrame:
    """``work`` (number, RUNS of the file) for each file that ``rows`` name, as a stream; a task holds the rows of one file."""
    spread = rows.repartitionByRange(max(1, files.count), "file").sortWithinPartitions("file")

    def run(batches: Iterator) -> Iterator:
        held, number = [], None
        for batch in batches:
            part = batch.to_pandas() if arrow else batch
            for k, own in part.groupby("file", sort=False):
                if k != number and held:
                    yield from work(number, pd.concat(held))
                    held = []
                number = int(k)
                held.append(own)
        if held:
            yield from work(number, pd.concat(held))

    return (spread.mapInArrow if arrow else spread.mapInPandas)(run, schema)


def fetched(runs: DataFrame, files: Files, parts: int) -> DataFrame:
    """SPANS by part of their keys: runs of rare anchors with their bytes, pieces of hot ones, and single windows of hot pieces."""

    def cut(cols: Cols, texts: list[bytes]) -> tuple[Cols, list[bytes]]:
        got, out = [], []
        for i, (a, n, rel, text) in enumerate(zip(cols["a"].tolist(), cols["n"].tolist(), cols["rel"].tolist(), texts)):
            at, end = rel, rel - n  # windows have distances at, at - 1, ..., end + 1 to the anchor
            while at > end:
                slot = at // PIECE
                stop = max(end, slot * PIECE - 1)
                lo, size = rel - at, at - stop
                piece = text[lo : lo + size + LENGTH - 1]
                core = piece[at - slot * PIECE : at - slot * PIECE - PIECE + 1 + LENGTH]
                got.append((i, _key(a.to_bytes(8, "little"), bytes([slot]), core), lo, size, at))
                out.append(piece)
                at = stop
        if not got:
            return _joined([]), []
        i, a, lo, n, rel = (np.array(x, dtype=t) for x, t in zip(zip(*got), (np.int64, np.uint64, np.int64, np.int64, np.int64)))
        cols = _pick(cols, i)
        return cols | {"a": a, "lo": cols["lo"] + lo, "n": n, "rel": rel}, out

    def work(number: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        wanted = {kind: _unpacked(rows[rows["kind"] == kind]) for kind in (OPEN, PIECES)}
        wanted = {kind: _pick(c, np.argsort(c["row"], kind="stable")) for kind, c in wanted.items()}
        for first, docs in files.groups(number, ["text"]):
            text, out = docs.column("text"), []
            for kind, cols in wanted.items():
                i, j = np.searchsorted(cols["row"], [first, first + len(docs)])
                mine = _pick(cols, np.arange(i, j))
                data, texts = (None, b""), []
                for r, lo, n in zip(mine["row"].tolist(), mine["lo"].tolist(), mine["n"].tolist()):
                    if data[0] != r:
                        data = (r, (text[r - first].as_py() or "").encode())
                    texts.append(data[1][lo : lo + n + LENGTH - 1])
                if kind == OPEN:
                    out += _packed(_by_key(mine["a"], parts), OPEN, mine, texts)
                    continue
                hot = _sizes(mine["a"]) >= HOT_BATCH
                late, left, left_texts, _ = thinned(_pick(mine, hot), [texts[k] for k in np.flatnonzero(hot)])
                out += _packed(late["row"] % parts, REPEAT, late, [b""] * len(late["a"]))
                mine, texts = _joined([_pick(mine, ~hot), left]), [texts[k] for k in np.flatnonzero(~hot)] + left_texts
                pieces, texts = cut(mine, texts)
                hot = _sizes(pieces["a"]) >= HOT_BATCH
                cold = np.flatnonzero(~hot)
                out += _packed(_by_key(pieces["a"][cold], parts), OPEN, _pick(pieces, cold), [texts[k] for k in cold])
                keys = np.unique(pieces["a"][hot])
                out += _packed(_by_key(keys, parts), MARK, {k: np.zeros(len(keys), dtype=np.int64) for k in _KEYS} | {"a": keys}, [b""] * len(keys))
                late, windows, texts = as_windows(_pick(pieces, hot), [texts[k] for k in np.flatnonzero(hot)])
                out += _packed(late["row"] % parts, REPEAT, late, [b""] * len(late["a"]))
                out += _packed(_by_key(windows["a"], parts), WINDOW, windows, texts)
            yield pd.DataFrame(out, columns=_SPANS)

    return by_file(runs, files, work, SPANS)


def compared(spans: DataFrame, parts: int) -> DataFrame:
    """SPANS: REPEAT from the suffix arrays, and WINDOW rows of what is too hot for one; repeats and windows pass."""

    def work(at, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == OPEN]
        out = rows.loc[rows["kind"].isin((REPEAT, WINDOW)), _SPANS].values.tolist()
        if len(own):
            cols = _unpacked(own)
            texts = _texts(cols, b"".join(own["bytes"]))
            marked = np.isin(cols["a"], _marks(rows))
            meet = np.flatnonzero(~marked & (_sizes(cols["a"]) > 1))
            late, left, left_texts, whole = thinned(_pick(cols, meet), [texts[k] for k in meet])
            out += _packed(np.zeros(len(late["a"]), dtype=np.int64), REPEAT, late, [b""] * len(late["a"]))
            open_ = np.flatnonzero(~whole)
            rest = _joined([_pick(cols, marked), _pick(left, open_)])
            late, windows, texts = as_windows(rest, [texts[k] for k in np.flatnonzero(marked)] + [left_texts[k] for k in open_])
            out += _packed(np.zeros(len(late["a"]), dtype=np.int64), REPEAT, late, [b""] * len(late["a"]))
            out += _packed(_by_key(windows["a"], parts), WINDOW, windows, texts)
        return pd.DataFrame(out, columns=_SPANS)

    return spans.groupBy("part").applyInPandas(work, SPANS)


def single(windows: DataFrame) -> DataFrame:
    """RUNS: REPEAT for all but the earliest of equal windows."""

    def work(at, rows: pd.DataFrame) -> pd.DataFrame:
        cols = _unpacked(rows)
        late, _, _ = as_windows(cols, _texts(cols, b"".join(rows["bytes"])))
        return pd.DataFrame(list(_packed(np.zeros(len(late["a"]), dtype=np.int64), REPEAT, late)), columns=_RUNS)

    return windows.where(F.col("kind") == WINDOW).groupBy("part").applyInPandas(work, RUNS)


def cut_out(data: bytes, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed spans (start, stop) of a text for removed windows."""
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n + LENGTH - 1, -1)
    gone = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    change = np.flatnonzero(gone[1:] != gone[:-1])
    return change[0::2], change[1::2]


def _kept(data: bytes, start: np.ndarray, stop: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip(np.r_[0, stop], np.r_[start, len(data)]))


def _whole_letters(data: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole UTF-8 letters."""
    inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in zip(start.tolist(), stop.tolist()):
        while inner(a):
            a += 1
        while inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array([x for x, _ in out], dtype=np.int64), np.array([x for _, x in out], dtype=np.int64)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, row): the documents packed, with a number: the id, or, where ids are null or repeat, a number in the order of id and text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), packed(docs))
    n = own.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("m")).first()
    twice = own.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).limit(1).count()
    if n["n"] == n["m"] and not twice and dict(own.dtypes)["id"] in ("int", "bigint"):
        return own.select(F.col("id").cast("long").alias("doc"), "text", "row")
    ranged = written(own.orderBy(F.col("id").asc_nulls_last(), "text", F.xxhash64("row")).withColumn("doc", F.monotonically_increasing_id()), "suffix-order")
    return ranged.select("doc", "text", "row")


def _copied(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder, compressed well and in small row groups."""
    import uuid

    from densigrid.llm.common import shared_dir

    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/suffix-docs-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("maxRecordsPerFile", 0).parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.written_to = path
    return out


def repeats(docs: DataFrame, files: Files) -> DataFrame:
    """REPEAT rows (RUNS) of the copied documents (doc, text), by file."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, blocks_of(size, PART_BYTES)) | 1
    number = F.regexp_extract("_metadata.file_name", "^part-(\\d+)-", 1).cast("int")
    numbered = docs.select("doc", "text", number.alias("file"), F.col("_metadata.row_index").alias("row"))
    near = written(prefiltered(scan(numbered, parts)), "suffix-near")
    met = written(compared(fetched(near.where(F.col("kind") != REPEAT), files, parts), parts), "suffix-met")
    late = lambda df: df.where(F.col("kind") == REPEAT).select(*_RUNS)
    out = written(late(near).union(late(met)).union(single(met)), "suffix-repeats")
    discard(near, met)
    return out


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with _n_bytes, _n_removed, _n_spans, _kept_sha256 (of the bytes kept) and, if asked for, _spans and _kept, the text
    that is left when spans are shrunk to whole letters; without the text column otherwise."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = docs if with_text else docs.drop(text_col)
    own = _ordered(docs, id_col, text_col)
    if not with_text:
        own = own.withColumn("row", F.col("row").dropFields(text_col))
    copy = _copied(own)
    files = Files(copy)
    late = repeats(copy, files)
    # Every file is named, whether it has repeats or not.
    number = F.regexp_extract("_metadata.file_name", "^part-(\\d+)-", 1).cast("int")
    empty = {"part": F.lit(0), "kind": F.lit(REPEAT), "file": F.col("file")}
    every = copy.select(number.alias("file")).distinct().select(*(empty.get(c, F.lit(b"")).alias(c) for c in _RUNS))
    more = "_n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string" + ", _spans array<struct<start:bigint,stop:bigint>>, _kept string" * with_text
    schema = T.StructType([T.StructField("row", own.schema["row"].dataType), *T.StructType.fromDDL(more).fields])
    kinds = to_arrow_schema(schema)
    names = [f.name for f in schema.fields[1:]]

    def work(at: int, rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        cols = _unpacked(rows)
        order = np.argsort(cols["row"], kind="stable")
        where, lo, n = cols["row"][order], cols["lo"][order], cols["n"][order]
        for first, group in files.groups(at, ["text", "row"]):
            got = []
            for r, text in enumerate(group.column("text").to_pylist(), first):
                data = (text or "").encode()
                i, j = np.searchsorted(where, [r, r + 1])
                start, stop = cut_out(data, lo[i:j], n[i:j]) if j > i else (lo[:0], lo[:0])
                found = [len(data), int((stop - start).sum()), len(start), hashlib.sha256(_kept(data, start, stop)).hexdigest()]
                if with_text:
                    found += [[{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())], None if text is None else _kept(data, *_whole_letters(data, start, stop)).decode()]
                got.append(found)
            if got:
                made = [pa.array([g[k] for g in got], type=kinds.field(name).type) for k, name in enumerate(names)]
                table = pa.table([group.column("row").cast(kinds.field("row").type), *made], names=["row", *names])
                yield from table.combine_chunks().to_batches()

    out = by_file(late.union(every), files, work, schema, arrow=True)
    return unpacked(out, columns, {c: F.col(c) for c in names})
