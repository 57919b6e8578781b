"""Secret scans by an incremental ledger of blobs, in DataFrame functions only.

A version of a file is a path and its text; the text's SHA-256 names the blob.
The ledger has a row for each time that a blob was scanned: the keys (kind and
version) of the rules it was scanned by, and what they found. Only pairs of a
blob and a rule that no row has are scanned, whatever the number of paths and
versions that hold the blob, and findings are joined back to all of them.

Java's matcher gives no positions, so a text is split at the matches, and the
lengths of what stands between and of the matches are summed up, in blocks, so
that texts of many matches stay near linear.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import HOT, stash

#: Blobs to scan that are broadcast (about 100 bytes each), so that no text of
#: another blob is shuffled; beyond, blobs and texts meet in a shuffle.
TODO = 200_000
#: Into how many parts the rows of a blob of many paths are dealt.
PARTS = 64
_BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; of those whose group ``group`` is shorter than
    ``least``, none counts. A changed pattern needs another version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


#: The contract's kinds. A greedy run of at least so many characters is the
#: maximal run, so the least length may stand in the pattern of the last two.
BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: What the method adds: public formats of keys and tokens.
RULES = (
    *BASE,
    Rule("private_key", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]{16,}"),
)
LEDGER = "blob binary, rules array<string>, found array<struct<at:int,end:int,rule:string>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable isn't
    copied into the lambdas that read it."""
    return F.transform(F.array(value), body)[0]


def _spans(part: Column, rule: Rule) -> Column:
    """at, end, rule of the matches that count. part: gaps (lengths between the
    matches), sizes (of the matches), counts (whether each does)."""
    block = lambda xs, b: F.slice(xs, b * _BLOCK + 1, _BLOCK)
    last = F.floor((F.size(part["sizes"]) - 1) / _BLOCK).cast("int")
    zero = F.lit(0)

    def starts(sums: Column) -> Column:
        return F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def of_block(b: Column, begin: Column) -> Column:
        one = F.arrays_zip(block(part["gaps"], b).alias("gap"), block(part["sizes"], b).alias("size"), block(part["counts"], b).alias("counts"))
        empty = F.struct(begin.alias("pos"), F.array().cast("array<struct<at:int,end:int,rule:string>>").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            at = acc["pos"] + m["gap"]
            span = F.struct(at.alias("at"), (at + m["size"]).alias("end"), F.lit(rule.key).alias("rule"))
            return F.struct((at + F.coalesce(m["size"], zero)).alias("pos"), F.when(m["counts"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(one, empty, step, lambda acc: acc["out"])

    add = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    blocks = F.sequence(zero, last)
    sums = F.transform(blocks, lambda b: add(block(part["gaps"], b)) + add(block(part["sizes"], b)))
    return _let(starts(sums), lambda begins: F.flatten(F.transform(blocks, lambda b: of_block(b, begins[b]))))


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of blob, text, rules (keys to scan by)."""
    t = F.col("text")
    chars = lambda xs: F.transform(xs, F.char_length)

    def part(r: Rule) -> Column:
        group = lambda g: F.regexp_extract_all(t, F.lit(r.pattern), F.lit(g))
        counts = F.transform(group(r.group), lambda v: F.char_length(v) >= r.least)
        found = F.struct(chars(F.split(t, r.pattern, -1)).alias("gaps"), chars(group(0)).alias("sizes"), counts.alias("counts"))
        return F.when(F.array_contains("rules", r.key) & t.rlike(r.pattern), found)

    # a generator keeps the optimizer from copying the matches into the lambdas
    parts = blobs.select("blob", "rules", F.explode(F.array(F.struct(*[part(r).alias(f"p{i}") for i, r in enumerate(rules)]))).alias("parts"))
    none = F.array().cast("array<struct<at:int,end:int,rule:string>>")
    each = [F.when(F.col(f"parts.p{i}").isNull(), none).otherwise(_spans(F.col(f"parts.p{i}"), r)) for i, r in enumerate(rules)]
    return parts.select("blob", "rules", F.concat(*each).alias("found"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """blob, text, rules: each blob of the versions once, with the keys of the
    rules by which the ledger has it not scanned yet; none if it has all."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    base = versions.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    once = lambda df, *more: df.groupBy("blob").agg(F.first("text").alias("text"), *more)
    if ledger is None or ledger.isEmpty():
        return once(base).withColumn("rules", keys)
    known = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("known"))
    todo = base.select("blob").distinct().join(known, "blob", "left").select("blob", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    todo = stash(todo, "todo")
    if todo.count() <= TODO:
        return once(base.join(F.broadcast(todo), "blob"), F.first("rules").alias("rules"))
    return once(base).join(todo, "blob")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger's new rows, written and read again; to be appended to it.

    Null is the empty text. If a run dies before its rows are appended, the
    next one scans the same pairs again; rows appended twice do no harm.
    """
    return stash(_scanned(unseen(versions, ledger, rules, text_col), rules), "scanned")


def _rows_of_blobs(paths: DataFrame, values: DataFrame) -> DataFrame:
    """paths joined to the values of their blobs. The rows of a blob of many
    paths are dealt by path too, and its value is repeated for each part; what
    is broadcast are names of such blobs, at most ``HOT`` of them."""
    sizes = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(sizes.where(F.col("n") > paths.count() // HOT).select("blob", F.lit(True).alias("hot")))
    own = [c for c in paths.columns if c != "blob"]
    dealt = paths.join(hot, "blob", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64(*own), F.lit(PARTS)).cast("int")).otherwise(0)).drop("hot")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(values.join(hot, "blob", "left").withColumn("part", F.explode(parts)).drop("hot"), ["blob", "part"]).drop("part")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found (array of at, rank of the rule, end, in order) for each
    version of each path, from a ledger that has scanned them all."""
    keys = [r.key for r in rules]
    rank = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    own = F.array_distinct(F.filter(F.flatten(F.collect_list("found")), lambda f: f["rule"].isin(keys)))
    found = ledger.groupBy("blob").agg(own.alias("found")).select("blob", F.explode(F.array("found")).alias("found"))
    found = found.select("blob", F.array_sort(F.transform("found", lambda f: F.struct(f["at"].alias("at"), rank[f["rule"]].alias("rank"), f["end"].alias("end")))).alias("found"))
    paths = stash(versions.select(F.col(id_col).alias("doc_id"), blob_of(F.col(text_col)).alias("blob")), "paths")
    return _rows_of_blobs(paths, found)


def secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row.

    Positions count code points. Null and empty texts have no spans, and the
    hash of the empty string; very long texts are scanned whole; malformed
    UTF-8 is one U+FFFD a fault. Repeated rows are one blob and give a row
    each; an empty table gives an empty result. Columns other than the id and
    text are not looked at. ``rules`` begins with ``BASE``; a ledger of earlier
    scans spares its pairs.
    """
    new = scan(docs, ledger, rules, text_col)
    found = findings(docs, new if ledger is None else ledger.unionByName(new), rules, id_col, text_col)
    names = F.array(*[F.lit(r.kind) for r in rules])
    joined = lambda xs: F.array_join(F.transform(xs, lambda f: F.concat_ws(":", names[f["rank"]], f["at"], f["end"])), ",")
    count = lambda i: F.size(F.filter("found", lambda f: f["rank"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(joined(F.filter("found", lambda f: f["rank"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
