"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is searched for candidates of several kinds. The base kinds are always findings;
the further kinds match anything that looks like a credential and become findings only when the
corpus says so. For that, each candidate value's hash is aggregated over all documents: by how many
distinct owners (``source``) and repositories (owner and ``lang``) it is held. A value of few owners
is owner-specific and looks live; one that many owners hold is a copied example. The repositories
are returned beside the owners; the verdict uses owners alone, as one owner's copies in several
repositories are still one owner's secret. Copies of a text
are scanned where they lie but counted once per owner and repository, and both aggregations combine
before they shuffle.

A private key is its whole block, to the END line; its value is the body without white space, never
the header, which all keys of a type share. A block without an END line is its header and the lines
of 16 and more base64 characters after it; a header without a body is no candidate.

Positions follow from cutting the text at the matches: the pieces between matches and the matches
themselves alternate, so a match starts where the lengths before it add up to.

Defined cases: a null or empty text has no candidates; null owners count as one owner; rows that
repeat are scanned each for itself; a text of any length is scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.llm.common import stored, text_column
from tablesync.operators.chunking import fresh_names
from tablesync.session import broadcast_if_small

# Kinds in order, pattern, the group whose length counts, and its least length. Runs
# that are too short are left out by the pattern where that changes no other match.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
FURTHER = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----((?:[^-]++|-(?!----))*+(?=-----END [A-Z ]*PRIVATE KEY-----)"
            r"|(?:(?:\s|\\[nr])++(?:[A-Za-z0-9+/=]{16,}+|(?:Proc-Type|DEK-Info):\x20[^\s\\]++))*+)(?:-----END [A-Z ]*PRIVATE KEY-----)?", 1, 1),
    ("prefixed", r"(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|rk)[_-][A-Za-z0-9_-]{16,}", 0, 19),
    ("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", 0, 32),
)
KINDS = BASE + FURTHER
# White space, written out or escaped, is no part of these kinds' values: line breaks differ between copies.
SPACELESS = ("key",)
# Values of these kinds have a small letter, and a capital or digit, anywhere: a look-ahead would search each run twice.
MIXED = ("opaque",)


@dataclass(frozen=True)
class Ownership:
    example_owners: int = 3  # a value held by so many owners is an example


SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
BLOCK = 64  # entries whose running sum is built by appending to an array
TEXT_BLOCK = 512  # code points


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(steps: Column, levels: int = 3) -> Column:
    """For each entry of a non-empty array the sum of the entries before it.

    Appending to one array copies it each time, so entries are summed in blocks, and the sums of the
    blocks likewise: the work of a text with a hundred thousand matches still grows with their number.
    """
    def appended(values):
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    if levels == 1:
        return appended(steps)["out"]
    firsts = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))

    def joined(blocks):
        offsets = sums_before(F.transform(blocks, lambda b: b["at"]), levels - 1)
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["out"], lambda x: x + o)))

    return let(F.transform(firsts, lambda i: appended(F.slice(steps, i, BLOCK))), joined)


def placed(kind: int) -> Column:
    """Matches of one kind with their places, from the columns ``found``, ``part`` and ``gaps`` of the kind."""
    found, part, gaps = (F.col(f"{c}{kind}") for c in ("found", "part", "gaps"))
    if KINDS[kind][0] in SPACELESS:
        part = F.transform(part, lambda v: F.regexp_replace(v, r"(?:\s|\\[nr])+", ""))
    valid = lambda v: F.length(v) >= KINDS[kind][3]
    if KINDS[kind][0] in MIXED:
        valid = lambda v: (F.length(v) >= KINDS[kind][3]) & v.rlike("[a-z]") & v.rlike("[A-Z0-9]")
    gaps = F.slice(gaps, F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda g, f: (g + F.length(f)).cast("long"))
    starts = F.zip_with(let(steps, lambda s: sums_before(s)), gaps, lambda at, g: at + g)
    matches = F.zip_with(found, part, lambda f, v: F.struct(F.length(f).alias("size"), v.alias("value")))
    rows = F.zip_with(starts, matches, lambda at, m: F.struct(
        at.alias("start"), F.lit(kind).alias("kind"), (at + m["size"]).alias("end"), m["value"].alias("value")))
    return F.when(F.size(found) > 0, F.filter(rows, lambda r: valid(r["value"]))).otherwise(F.array().cast(SPANS))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repository, a key of the text, and all candidates in order.

    Matches are stored before they are placed, and stored again with their places: an expression used
    twice would search the text, or place the matches, twice.
    """
    owner = F.coalesce(docs["source"].cast("string"), F.lit(""))
    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), owner.alias("owner"),
        F.concat_ws("/", owner, F.coalesce(docs["lang"].cast("string"), F.lit(""))).alias("repository"), text_column(docs).alias("_text"),
    )
    matched = texts.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"found{k}") for k, (_, p, _, _) in enumerate(KINDS)])
    cut = matched.select(
        "doc_id", "owner", "repository", F.xxhash64("_text").alias("text_key"), *[f"found{k}" for k in range(len(KINDS))],
        *[(F.when(F.size(f"found{k}") > 0, F.regexp_extract_all("_text", F.lit(p), F.lit(g))) if g else F.col(f"found{k}")).alias(f"part{k}")
          for k, (_, p, g, _) in enumerate(KINDS)],
        *[F.when(F.size(f"found{k}") > 0, F.transform(F.split("_text", p, -1), F.length)).alias(f"gaps{k}") for k, (_, p, _, _) in enumerate(KINDS)],
    )
    rows = stored(cut, "secret-matches")
    found = F.array_sort(F.concat(*[placed(k) for k in range(len(KINDS))]))
    return stored(rows.select("doc_id", "owner", "repository", "text_key", found.alias("found")), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners, repositories and rows of each candidate value, by hash.

    Grouping by value and repository first leaves one row per value and repository, so a value that
    a third of all documents hold is combined before it is shuffled.
    """
    each = found.select("owner", "repository", F.explode("found.value").alias("value")).select(
        F.xxhash64("value").alias("hash"), "owner", "repository"
    )
    held = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return held.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_rows"))


def verdicts(found: DataFrame, rule: Ownership) -> DataFrame:
    """One row per text and finding: its span, the owners of its value and whether it looks live.

    Texts that are copies of each other have the same candidates and are judged once.
    """
    each = found.select("text_key", F.explode("found").alias("s")).distinct().withColumn("hash", F.xxhash64("s.value"))
    known = each.join(ownership(found), "hash").withColumn("live", F.col("n_owners") < rule.example_owners)
    return known.filter((F.col("s.kind") < len(BASE)) | F.col("live"))


def judged(found: DataFrame, rule: Ownership) -> DataFrame:
    """Per text: its findings, and those of them whose value looks live, both in order."""
    return verdicts(found, rule).groupBy("text_key").agg(
        F.array_sort(F.collect_list("s")).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("live"), F.col("s")))).alias("live"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )


def kept_pieces(found: DataFrame, rule: Ownership) -> DataFrame:
    """Per text with live findings: the pieces ``(start, end)`` before each group of overlapping spans, and
    where the last group ends."""
    live = verdicts(found, rule).filter("live").select("text_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    earlier = W.partitionBy("text_key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    cut = live.withColumn("_reach", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    piece = F.when(F.col("start") >= F.col("_reach"), F.struct(F.col("_reach").alias("start"), F.col("start").alias("end")))
    return cut.groupBy("text_key").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("end").alias("rest"))


def scan(docs: DataFrame, rule: Ownership = Ownership()) -> DataFrame:
    """One row per document: base counts and digest, all spans, live-looking and example findings."""
    found = scanned(docs)
    spans = judged(found.filter(F.size("found") > 0), rule).withColumnRenamed("text_key", "_key")
    held = found.filter(F.size("found") > 0)
    some = held.join(spans, held["text_key"] == spans["_key"], "left")
    none = found.filter(F.size("found") == 0).select("*", F.lit(None).cast("long").alias("_key"), F.array().cast(SPANS).alias("spans"),
                                                    F.array().cast(SPANS).alias("live"),
                                                    *[F.lit(None).cast("long").alias(c) for c in ("most_owners", "most_repositories")])
    both = some.union(none).select("doc_id", F.col("found"), *[F.coalesce(c, F.array().cast(SPANS)).alias(c) for c in ("spans", "live")], "most_owners", "most_repositories")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        "doc_id", *[count(k).alias(f"n_{BASE[k][0]}") for k in range(len(BASE))],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        listed(F.col("live")).alias("live_spans"), F.size("live").cast("long").alias("n_live"),
        (F.size("spans") - F.size("live")).cast("long").alias("n_example"), "most_owners", "most_repositories",
    )


def between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text cut into blocks; only the blocks they touch are read."""
    first = F.floor(start / TEXT_BLOCK)
    some = F.slice(blocks, (first + 1).cast("int"), (F.floor(end / TEXT_BLOCK) - first + 1).cast("int"))
    return F.substring(F.array_join(some, ""), (start - first * TEXT_BLOCK + 1).cast("int"), (end - start).cast("int"))


def mask(docs: DataFrame, rule: Ownership = Ownership(), mark: str = "[SECRET]") -> DataFrame:
    """The documents with live-looking values replaced, all columns kept.

    Only texts with a live finding are joined with their pieces; overlapping spans become one mark. The
    pieces are read from blocks of the text and joined once, so many findings in one text cost
    no more each than few.
    """
    key, (key_name, pieces_name, rest_name) = F.xxhash64(text_column(docs)), fresh_names(docs, "_key", "_pieces", "_rest")
    found = scanned(docs).filter(F.size("found") > 0)
    live = kept_pieces(found, rule).select(*[F.col(a).alias(b) for a, b in (("text_key", key_name), ("pieces", pieces_name), ("rest", rest_name))])
    live = broadcast_if_small(stored(live, "live-spans"), 50_000)
    joined = docs.join(live, key == live[key_name], "left")
    blocks = F.regexp_extract_all(docs["text"], F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    kept = let(blocks, lambda b: F.concat(F.transform(F.col(pieces_name), lambda p: between(b, p["start"], p["end"])), F.array(
        between(b, F.col(rest_name), F.length(docs["text"]).cast("long")))))
    text = F.when(F.col(pieces_name).isNull(), docs["text"]).otherwise(F.array_join(kept, mark))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
