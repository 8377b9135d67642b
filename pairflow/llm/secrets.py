"""Secret scans, with DataFrame functions only.

Spans come from Java regular expressions: a text's matches and the pieces between them give the positions as
running sums of lengths, in code points. Candidates are then judged by corpus-wide ownership: the hash of every
candidate value is aggregated to the number of distinct owners and of distinct repositories it occurs in. A
live-looking credential is a value that looks random and is specific to its owners: one owner holds it, in
however many documents, or up to MAX_OWNERS owners that are at most MAX_OWNER_SHARE of all. Any other value is a
copied example or a plain word.

A value looks random by its letters and digits (of a key block: of its body). They carry at least RANDOM_BITS,
which is their length times their entropy, and CHARACTER_BITS each; and they mix letters with digits, or are
digits alone, or are letters that change case as no camel-case name does, or hold five consonants in a row.

Kinds: assign, access and hex are the base kinds, whose spans always stay. The method adds provider (prefixed
provider tokens), pem (private key blocks) and entropy (long mixed strings, kept only if ownership makes them
live-looking).

Owners are the source column, repositories the id column; the owner of a row without one is unknown, so each such
document counts as an owner of its own. Counts per value
combine before they are shuffled, so a value in a third of all rows is no hot group.

Results for odd input: null and empty texts have zero counts, empty spans and the digest of the empty string;
repeated rows get a row each; rows with a null id are judged among themselves; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.llm import keys
from pairflow.workspace import materialize

KINDS = ["assign", "access", "hex", "provider", "pem", "entropy"]
BASE_KINDS = KINDS[:3]
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Equal to the plain patterns followed by dropping short matches: runs are maximal.
_PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "provider": r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    # Possessive, so that a run of any length is read once and without recursion. A key block may begin with header lines.
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]*PRIVATE KEY-----",
    "entropy": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+",
}
# A text without such a part has no match of the kind.
_NEEDS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}",
    "provider": r"gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ", "pem": "PRIVATE KEY-----", "entropy": "[A-Za-z0-9+/_-]{32}",
}
SPAN = "array<struct<start:int,end:int,kind:int,value:bigint,random:boolean>>"
MAX_OWNERS = 3
MAX_OWNER_SHARE = 0.001
RANDOM_BITS = 20.0
CHARACTER_BITS = 2.0


def _value(kind: str, match: Column) -> Column:
    return F.regexp_extract(match, _ASSIGN, 1) if kind == "assign" else match


def looks_random(kind: str, match: Column) -> Column:
    value = F.regexp_replace(match, "-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----", "") if kind == "pem" else _value(kind, match)
    times = lambda v: F.transform(
        F.filter(F.array_distinct(F.split(v, "")), lambda c: c != ""), lambda c: F.length(v) - F.length(F.replace(v, c, F.lit(""))))
    # length x entropy = n log n - sum of k log k over the characters, k times each
    bits = lambda v: F.length(v) * F.log2(F.length(v)) - F.aggregate(
        times(v), F.lit(0.0), lambda acc, k: acc + k * F.log2(k))
    changes = lambda v: F.size(F.regexp_extract_all(v, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])"), F.lit(0)))
    mixed = lambda v: v.rlike("[0-9]") | (3 * changes(v) >= F.length(v)) | v.rlike("(?i)[bcdfghjklmnpqrstvwxz]{5}")
    # In lambdas, so that each step is computed once.
    dense = lambda v, b: (b >= RANDOM_BITS) & (b >= CHARACTER_BITS * F.length(v))
    plain = F.array(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    return F.exists(plain, lambda v: (F.length(v) > 0) & mixed(v) & F.exists(F.array(bits(v)), lambda b: dense(v, b)))


def _spans(kind: str) -> Column:
    """Spans of a kind in `_t`, leftmost and not overlapping."""
    pattern = F.lit(_PATTERNS[kind])
    both = F.arrays_zip(
        F.split("_t", _PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all("_t", pattern, F.lit(0)).alias("hit"))
    step = F.aggregate(
        F.filter(both, lambda x: x["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS {SPAN})").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                F.lit(KINDS.index(kind)).alias("kind"), F.xxhash64(_value(kind, x["hit"])).alias("value"),
                looks_random(kind, x["hit"]).alias("random"),
            ))).alias("out")),
        lambda acc: acc["out"])
    if kind == "assign":  # the whole match is consumed, then short values are dropped
        short = F.filter(
            F.arrays_zip(step.alias("s"), F.regexp_extract_all("_t", pattern, F.lit(1)).alias("v")),
            lambda x: F.length(x["v"]) >= 6)
        step = F.transform(short, lambda x: x["s"])
    need = F.col("_t").contains(_NEEDS[kind]) if kind in ("access", "pem") else F.col("_t").rlike(_NEEDS[kind])
    return F.when(need, step).otherwise(F.expr(f"cast(array() AS {SPAN})"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """_id, owner, _spans (of all kinds) and _key (digest of the text, null without spans) of every row."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"),
        F.col(f"`{owner_col}`").cast("string").alias("owner"))
    spans = rows.withColumn("_spans", F.concat(*[_spans(k) for k in KINDS]))
    return spans.select("_id", "owner", "_spans", F.when(F.size("_spans") > 0, F.md5(F.col("_t").cast("binary"))).alias("_key"))


def n_owners(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """One row: n_all, the number of owners; rows without one are not counted."""
    return docs.select(F.col(f"`{owner_col}`").cast("string").alias("owner")).agg(F.count_distinct("owner").alias("n_all"))


def ownership(spans: DataFrame, owners: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, live; from (owner, repository, value, random) of every candidate and n_owners()."""
    # Two distinct counts would copy every row: repositories are first counted within their owner.
    known = spans.select("value", "random", "repository", F.struct(
        "owner", F.when(F.col("owner").isNull(), F.col("repository")).alias("alone")).alias("owner")).groupBy("value", "owner", "repository").agg(F.max("random").alias("random"))
    owned = known.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("random").alias("random"))
    counts = owned.groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("random").alias("random"))
    few = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_owners") <= MAX_OWNER_SHARE * F.col("n_all"))
    return counts.crossJoin(F.broadcast(owners)).select(
        "value", "n_owners", "n_repositories", (F.col("random") & ((F.col("n_owners") == 1) | few)).alias("live"))


def judged(spans: DataFrame, owners: DataFrame) -> DataFrame:
    """n_live, n_copied and live_spans of each distinct (_id, _key) that has candidates; from found() and n_owners()."""
    candidates = spans.filter(F.size("_spans") > 0).select("_id", "_key", "owner", F.explode("_spans").alias("s")).select(
        "_id", "_key", "owner", "s", F.col("s.value").alias("value"), F.col("s.random").alias("random"))
    values = ownership(candidates.select(
        "owner", F.coalesce(F.col("_id"), F.xxhash64("_key")).alias("repository"), "value", "random"), owners)
    marked = candidates.select("_id", "_key", "s", "value").distinct().join(values, "value")
    return marked.groupBy("_id", "_key").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"),
        F.collect_list(F.when(F.col("live"), F.col("s"))).alias("live_spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of every row."""
    # Positions and digests are written once; texts are read once and never shuffled.
    rows = materialize(found(docs, id_col, text_col, owner_col), "spans")
    verdicts = judged(rows, n_owners(docs, owner_col)).withColumnsRenamed({"_id": "_vid", "_key": "_vkey"})
    joined = rows.join(verdicts, F.col("_id").eqNullSafe(F.col("_vid")) & (F.col("_key") == F.col("_vkey")), "left")
    entropy = KINDS.index("entropy")
    live = F.coalesce("live_spans", F.expr(f"cast(array() AS {SPAN})"))
    kept = F.concat(F.filter("_spans", lambda s: s["kind"] != entropy), F.filter(live, lambda s: s["kind"] == entropy))
    n = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["kind"] < len(BASE_KINDS))
    return joined.select(
        F.col("_id").alias("doc_id"), *[n(k) for k in BASE_KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(kept).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """docs with the live-looking spans of their texts replaced by <secret>; copied examples stay.

    Rows to change meet the documents as a broadcast if they are few (checked), else in a shuffle join.
    """
    rows = materialize(found(docs, id_col, text_col, owner_col).filter(F.size("_spans") > 0), "spans")
    changes = keys.sized(judged(rows, n_owners(docs, owner_col)).filter("n_live > 0").select(
        F.col("_id").alias("_secret_id"), F.col("_key").alias("_secret_key"), F.col("live_spans").alias("_secret_spans")), "live", 100_000)
    text, spans = docs[text_col].cast("string"), changes["_secret_spans"]
    joined = docs.join(changes, docs[id_col].cast("long").eqNullSafe(changes["_secret_id"])
                       & (F.md5(F.coalesce(text, F.lit("")).cast("binary")) == changes["_secret_key"]), "left")
    # Overlapping spans (a hex value inside an assignment) are cut once: each starts where the last has ended.
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    cut = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<secret>"))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.when(spans.isNotNull(), cut).otherwise(text)
    return joined.select(*[changed.alias(c) if c == text_col else docs[c] for c in docs.columns])
