"""Secrets in texts, and who owns them: hashes of candidates are counted by distinct repositories and owners over the whole corpus, which tells examples that many have
copied from credentials that are one owner's. SQL functions only.

Null texts count as empty ones and give zeros and empty strings. Null repositories and owners count as one of that name each. Repeated rows give repeated results.
Extra columns pass through, but for the text. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.common import packed, salted_join, unpacked, written

# The contract's patterns, fixed values: pattern, group that is the secret, least length of that group.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = [*BASE, "owned"]
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"  # what may be a credential though no base pattern finds it,
DISTINCT = 10  # if it has digits, letters and so many different characters
COPIED, COPIED_WITHIN = 3, 30  # a secret that so many owners, or so many repositories, hold is an example
BLOCK = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _sums(xs: Column) -> Column:
    """Running sums of a short list."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")))["out"]


def running(xs: Column) -> Column:
    """Running sums of a list: within blocks, and of the blocks' totals, so that no step copies a long list."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK)), lambda b: _sums(F.slice(xs, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))))
    whole = _let(blocks, lambda bs: _let(_sums(F.transform(bs, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(
        F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.when(i == 0, 0).otherwise(F.get(ends, i - 1)))))))
    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, value being a group's text: their lengths and those of what is between give the places."""
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    sizes = F.struct(F.transform(every(0), F.length).alias("own"), F.transform(F.split(text, pattern, -1), F.length).alias("between"), every(group).alias("value"))

    def placed(x: Column) -> Column:
        shifted = F.slice(F.concat(F.array(F.lit(0)), x["own"]), F.lit(1), F.size(x["own"]))
        steps = F.transform(shifted, lambda own, i: own + F.get(x["between"], i))
        return _let(running(steps), lambda at: F.transform(at, lambda s, i: F.struct(s.alias("start"), (s + F.get(x["own"], i)).alias("end"), F.get(x["value"], i).alias("value"))))

    return _let(sizes, placed)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, hash, alive>> of the base patterns' matches, by start and kind; kinds are places in KINDS."""
    def spans(kind: int, pattern: str, group: int, least: int) -> Column:
        # where a match is a whole run, only runs that are long enough are matched
        sought = pattern if group else pattern[:-1] + "{%d,}" % (least - len(pattern.partition("[")[0]))
        kept = F.filter(matches(text, sought, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(kept, lambda m: _span(m, kind))

    return F.array_sort(F.concat(*(spans(kind, *rule) for kind, rule in enumerate(BASE.values()))))


def _span(m: Column, kind: int) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.sha2(m["value"].cast("binary"), 256).alias("hash"), alive(m["value"]).alias("alive"))


def alive(value: Column) -> Column:
    """Whether a string looks like a credential in use: digits, letters, and DISTINCT different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def tokens(text: Column) -> Column:
    """As base_spans(), of the long tokens that look like credentials."""
    return F.transform(F.filter(matches(text, TOKEN), lambda m: alive(m["value"])), lambda m: _span(m, len(BASE)))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners): how many different ones hold each candidate. Repeats go before rows are shuffled, and each count is of rows made distinct first."""
    different = lambda c: F.count_distinct(F.struct(c))  # noqa: E731  # a struct, so that null counts too
    return candidates.groupBy("hash").agg(different("repository").alias("repositories"), different("owner").alias("owners"))


def _apart(spans: DataFrame) -> DataFrame:
    """The spans without tokens that overlap a base span: what has begun before ends by the start, what begins later does so from the end on."""
    base = lambda c: F.when(F.col("kind") < len(BASE), F.col(c))
    ahead = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    met = spans.withColumns({"last": F.max(base("end")).over(ahead), "next": F.min(base("start")).over(back)})
    clear = (F.coalesce("last", "start") <= F.col("start")) & (F.coalesce("next", "end") >= F.col("end"))
    return met.where(base("kind").isNotNull() | clear).drop("last", "next")


def scan(docs: DataFrame, text: str = "text", repository: str = "repository", owner: str = "owner") -> DataFrame:
    """``docs`` without its text, repository and owner, with n_assign, n_access, n_hex, base_sha256 (of the base patterns' spans), spans (those and the owned ones), and which
    of them are live or copied. Spans are kind:start:end in code points, by start and kind, comma-joined.

    A secret is copied if COPIED owners or COPIED_WITHIN repositories hold it, and live if not and if it looks like a credential. An owned span is a live token apart
    from the base spans. What a text's spans are depends on the text and on the corpus alone, so they are worked out once a text.
    """
    kept = docs.drop(text, repository, owner)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(packed(kept), F.sha2(whole.cast("binary"), 256).alias("key"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), base_spans(whole).alias("base"), tokens(whole).alias("tokens"))
    found = written(read, "secrets")
    hit = found.where((F.size("base") > 0) | (F.size("tokens") > 0))
    each = hit.select("repository", "owner", F.explode(F.transform(F.concat("base", "tokens"), lambda s: s["hash"])).alias("hash"))
    by_text = hit.groupBy("key").agg(F.any_value(F.concat("base", "tokens")).alias("all")).select("key", F.explode("all").alias("s")).select("key", "s.*")
    total = hit.agg(F.sum(F.size("base") + F.size("tokens"))).first()[0] or 0
    owned = salted_join(_apart(by_text), ownership(each), "hash", "key", total)
    copied = (F.col("owners") >= COPIED) | (F.col("repositories") >= COPIED_WITHIN)
    span = F.struct("start", "kind", "end")
    marks = owned.select("key", span.alias("s"), copied.alias("copied"), (~copied & F.col("alive")).alias("live"))
    gathered = marks.groupBy("key").agg(*(F.array_sort(F.collect_list(F.when(test, F.col("s")))).alias(name) for name, test in (
        ("spans", (F.col("s.kind") < len(BASE)) | F.col("live")), ("live", F.col("live")), ("copied", F.col("copied")))))
    lists = gathered.select("key", *(listed(F.col(c)).alias(c) for c in ("spans", "live", "copied")))
    rows = salted_join(hit.select("row", "key", "base"), lists, "key", "row", total, "left")
    rest = found.where((F.size("base") == 0) & (F.size("tokens") == 0)).select("key", "row", "base", *(F.lit("").alias(c) for c in ("spans", "live", "copied")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": count(i) for i, k in enumerate(BASE)}
    more = {**counts, "base_sha256": F.sha2(listed(F.col("base")).cast("binary"), 256), **{c: F.coalesce(c, F.lit("")) for c in ("spans", "live", "copied")}}
    return unpacked(rows.unionByName(rest), kept, more)
