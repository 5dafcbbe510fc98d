"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that must occur
in any text it matches.  The index holds, for the trigrams that the rules need, a
posting for each text they occur in (lower-cased).  A query in disjunctive form is a
list of sets of trigrams; a set's trigrams are looked up in the index, and the texts in
all of its postings are the rule's candidates, which are then verified with the
expression.  Rules without a mandatory trigram scan every text instead.
DataFrame functions only; no rule, trigram or text gathers in one task.

Defined results: a null text counts as empty and has no spans; each row of the
table gives one row, repeated rows and null ids included; columns besides doc_id
and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams
from .common import table


@dataclass(frozen=True)
class Rule:
    """``kind`` names it; ``keep`` is SQL over ``m`` (the match) and ``v`` (group 2) that drops failing matches."""

    kind: str
    pattern: str
    keep: str = "true"
    group: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = (
    Rule("assign", ASSIGN, "length(v) >= 6", 2),
    # runs are taken whole, so asking for the least length in the expression gives the same matches as dropping short ones
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def _quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(rule: Rule, order: int, text: str = "text") -> Column:
    """The rule's matches in ``text``, leftmost and non-overlapping: array of (start, place of the kind, kind, end), in code points."""
    p = _quoted(rule.pattern)
    body = f"""if(size(x.m) = 0, cast(array() as array<struct<start:int,ord:int,kind:string,stop:int>>),
      aggregate(sequence(0, size(x.m) - 1),
        named_struct('at', 0, 'out', cast(array() as array<struct<start:int,ord:int,kind:string,stop:int>>)),
        (a, i) -> named_struct('at', a.at + length(x.p[i]) + length(x.m[i]), 'out', if({rule.keep.replace("(v)", "(x.g[i])").replace("(m)", "(x.m[i])")},
          concat(a.out, array(named_struct('start', a.at + length(x.p[i]), 'ord', {order}, 'kind', '{rule.kind}', 'stop', a.at + length(x.p[i]) + length(x.m[i])))), a.out)),
        a -> a.out))"""
    # each let-binding is a one-element array that transform maps over
    parts = f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'p', split({text}, {p}, -1), 'g', regexp_extract_all({text}, {p}, {rule.group}))"
    return F.expr(f"transform(array({parts}), x -> {body})[0]")


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def keyed(texts: DataFrame) -> DataFrame:
    """Rows with a key that equal rows share: the id and two hashes of the text."""
    return texts.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), "text").alias("b")))


def build_index(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings (trigram, key) of the ``wanted`` lower-case trigrams."""
    low = texts.select("key", F.lower("text").alias("low"))
    found = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("low"), t))
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): for each text the rules of whose queries some set of trigrams has a posting of it for each trigram."""
    sets = [(r.kind, t) for r in rules for t in trigrams.sets_of(trigrams.query_of(r.pattern))]
    looked_up = [(kind, i, len(t), x) for i, (kind, t) in enumerate(sets) for x in sorted(t)]
    terms = index.sparkSession.createDataFrame(looked_up, "kind string, term int, needs int, trigram string")  # as many rows as the rules have
    met = index.distinct().join(F.broadcast(terms), "trigram").groupBy("key", "kind", "term", "needs").count().where(F.col("count") == F.col("needs"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, key, spans): all rules' spans of each row, by start and then by the rules' order."""
    order = {r.kind: i for i, r in enumerate(rules)}
    indexed = [r for r in rules if trigrams.query_of(r.pattern) is not True]
    full = [r for r in rules if r not in indexed]
    none = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,stop:int>>)")
    texts = keyed(texts_of(documents))
    every = texts.select("doc_id", "key", F.concat(none, *[spans_of(r, order[r.kind]) for r in full]).alias("scanned"))
    if indexed:
        wanted = sorted(set().union(*(trigrams.trigrams_in(trigrams.query_of(r.pattern)) for r in indexed)))
        hits = candidates(build_index(texts, wanted), indexed)
        tried = texts.join(hits, "key")
        found = F.concat(*[F.when(F.array_contains("kinds", r.kind), spans_of(r, order[r.kind])).otherwise(none) for r in indexed])
        checked = tried.select("key", found.alias("verified")).where(F.size("verified") > 0).dropDuplicates(["key"])
        every = every.join(checked, "key", "left")
    else:
        every = every.withColumn("verified", none)
    return every.select("doc_id", "key", F.sort_array(F.concat("scanned", F.coalesce("verified", none))).alias("spans"))


def report(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    kinds = [r.kind for r in base]
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    basic = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(basic), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with every span replaced by ``[secret:kind]``; overlapping spans go as one, named by the first; n_chars follows."""
    found = scan(documents, rules).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    cut = F.expr(
        """aggregate(spans, named_struct('at', 0, 'out', ''),
          (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.stop), 'out', a.out),
            named_struct('at', s.stop, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), '[secret:', s.kind, ']'))),
          a -> concat(a.out, substring(text, a.at + 1)))"""
    )
    columns = documents.columns
    held = documents.select(F.struct(*[documents[f"`{c}`"] for c in columns]).alias("row"))  # the table's own columns, whatever their names
    held = held.select("row", F.col("row.doc_id").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    out = keyed(held).join(found, "key", "left")
    changed = F.col("spans").isNotNull()
    out = out.withColumn("cut", F.when(changed, cut).otherwise(F.col("row.text")))
    new = {"text": F.col("cut"), "n_chars": F.when(changed, F.length("cut").cast(dict(documents.dtypes).get("n_chars", "long"))).otherwise(F.col("row").getField("n_chars")) if "n_chars" in columns else None}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))


def _oracle() -> str:
    def one(i: int, r: Rule) -> str:
        p = "'" + r.pattern.replace("'", "''") + "'"
        keep = f"length(regexp_extract_all(t, {p}, {r.group})[i]) >= 6" if r.group else "true"
        return f"""SELECT n, '{r.kind}' AS kind, {i} AS ord, s, s + length(m) AS e FROM (
  SELECT n, regexp_extract_all(t, {p}, 0)[i] AS m,
    coalesce(list_sum([length(x) for x in regexp_split_to_array(t, {p})[1:i]]), 0) + coalesce(list_sum([length(x) for x in regexp_extract_all(t, {p}, 0)[1:i-1]]), 0) AS s,
    {keep} AS ok
  FROM (SELECT n, t, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i FROM d)) WHERE ok"""

    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(one(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT n, {counts},
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({kinds})) AS base,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) AS spans FROM s GROUP BY n)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""


ORACLE = _oracle()
