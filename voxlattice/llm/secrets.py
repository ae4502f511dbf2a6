"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query of trigrams that any match must hold. A pass over the texts
makes postings of just the queries' trigrams; intersecting them leaves candidates, whose whole texts are verified
with the expression itself. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of the pattern whose given group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs are maximal, so this finds the same spans as [0-9a-f]+ of 24 characters or more
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE
MARK = "[REDACTED]"


def _exact(node) -> set[str] | None:
    """All strings a parsed element can match, lower-cased, if they are few; None otherwise."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        found = {chr(a).lower() for o, a in arg if o is sre.LITERAL}
        return found if len(found) <= 6 and all(o is sre.LITERAL for o, _ in arg) else None
    if op is sre.SUBPATTERN:
        return _joined([_exact(x) for x in arg[-1]])
    if op is sre.BRANCH:
        ways = [_joined([_exact(x) for x in w]) for w in arg[1]]
        return None if None in ways else set().union(*ways)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        once = _joined([_exact(x) for x in arg[2]])
        return None if once is None else once | {""} if arg[0] == 0 else once
    return None


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    if None in parts:
        return None
    found = {""}
    for p in parts:
        found = {a + b for a in found for b in p}
        if len(found) > 64:
            return None
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams of the lower-cased text, one of which any text with a match holds; [] if none is mandatory."""
    runs, run = [], []
    for part in [*(_exact(x) for x in sre_parser.parse(pattern)), None]:
        if part is None or len(_joined([*run, part]) or "x" * 65) > 64:
            runs += [_joined(run)] if run else []
            run = [part] if part is not None else []
        else:
            run.append(part)
    wanted = [[frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in r] for r in runs if all(len(s) >= 3 for s in r)]
    if not wanted:
        return []
    clauses = [frozenset().union(*c) for c in product(*wanted)] if len(wanted) < 4 else [frozenset().union(*c) for c in product(*wanted[:3])]
    return sorted({c for c in clauses if not any(o < c for o in clauses)}, key=sorted)


#: Letters of running text from the commonest to the rarest; digits and signs are rarer still. Fixed values.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: Trigrams looked up of each clause: its rarest ones. Two of a word's trigrams rarely stand apart from the word.
LOOKED_UP = 2


def _rarest(clause: frozenset[str]) -> frozenset[str]:
    """The clause's trigrams that running text holds least; any text with all of the clause holds these."""
    rare = lambda t: -sum(_COMMON.find(c) if c in _COMMON else len(_COMMON) for c in t)
    return frozenset(sorted(clause, key=lambda t: (rare(t), t))[:LOOKED_UP])


def candidates(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str, text: str) -> DataFrame:
    """(doc, h, rules array<int>): texts that may match, from the intersected postings and, for rules without trigrams, a scan."""
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    clauses = sorted({(k, _rarest(c)) for k, q in queries.items() for c in q}, key=lambda x: (x[0], sorted(x[1])))
    vocabulary = sorted({t for _, c in clauses for t in c})
    rows = docs.select(F.col(doc_id).alias("doc"), C.text_key(text).alias("h"), F.col(text).alias("body"), F.lower(F.col(text)).alias("low"))
    scans = [F.when(F.col("body").rlike(rules[k].pattern), F.lit(k)) for k, q in queries.items() if not q]
    held = [F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(vocabulary)]
    index = rows.select("doc", "h", F.array_compact(F.array(*held)).alias("held") if held else F.array().cast("array<int>").alias("held"), F.array_compact(F.array(*scans)).alias("scans") if scans else F.array().cast("array<int>").alias("scans"))
    postings = index.select("doc", "h", F.explode("held").alias("trigram"))
    spark = docs.sparkSession
    need = [(vocabulary.index(t), n, k, i, (1 << len(c)) - 1) for n, (k, c) in enumerate(clauses) for i, t in enumerate(sorted(c))]
    query = spark.createDataFrame(need, "trigram int, clause int, rule int, bit int, mask long") if need else None
    full = index.where(F.size("scans") > 0).select("doc", "h", F.explode("scans").alias("rule"))
    if query is not None:
        met = postings.join(F.broadcast(query), "trigram").groupBy("doc", "h", "clause", "rule", "mask").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("got")).where("got = mask")
        full = full.union(met.select("doc", "h", "rule"))
    return full.groupBy("doc", "h").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _found(k: int, rule: Rule) -> Column:
    """Every match of a rule in `body`: characters since the match before, its own and its group's."""
    p = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all("body", p, F.lit(0)), F.regexp_extract_all("body", p, F.lit(rule.group))
    sizes = F.zip_with(whole, part, lambda a, b: F.struct(F.length(a).alias("len"), F.length(b).alias("part")))
    gaps = F.split("body", rule.pattern, -1)
    out = F.zip_with(gaps, sizes, lambda g, m: F.struct(F.lit(k).alias("kind"), F.length(g).alias("gap"), m["len"].alias("len"), m["part"].alias("part")))
    return F.when(F.array_contains("rules", F.lit(k)), F.filter(out, lambda x: x["len"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,part:int>>"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, spans array<struct<start,kind,end,upto>>) of the texts with a secret, by start, then rule.

    Positions are code points, end exclusive; upto is the largest end of the spans before, null at the first.
    """
    wanted = C.materialise(candidates(docs, rules, doc_id, text), "secret-candidates")
    rows = docs.select(F.col(doc_id).alias("doc"), C.text_key(text).alias("h"), F.col(text).alias("body")).where(F.col(text).isNotNull())
    picked = rows.join(C.small(wanted).withColumnsRenamed({"doc": "_d", "h": "_h"}), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).drop("_d", "_h").dropDuplicates(["doc", "h"])
    hits = picked.select("doc", "h", F.posexplode(F.flatten(F.array(*[_found(k, r) for k, r in enumerate(rules)]))).alias("at", "m")).select("doc", "h", "at", "m.*")
    by_rule = Window.partitionBy("doc", "h", "kind").orderBy("at")
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(by_rule).cast("long")).withColumn("start", F.col("end") - F.col("len"))
    least = F.array(*[F.lit(r.least) for r in rules])
    hits = hits.where(F.col("part") >= F.get(least, F.col("kind")))
    before = Window.partitionBy("doc", "h").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("upto", F.max("end").over(before))
    return hits.groupBy("doc", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "upto"))).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id and `spans array<struct<kind string, start long, end long>>`, by start, then rule.

    A null or empty text has none. Rows may repeat: each gives a row. Null ids are kept.
    """
    found = spans(docs, rules, doc_id, text).withColumnsRenamed({"doc": "_d", "h": "_h"})
    names = F.array(*[F.lit(r.kind) for r in rules])
    keys = docs.select(F.col(doc_id), C.text_key(text).alias("h"))
    out = keys.join(found, keys[doc_id].eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    listed = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:long,kind:int,end:long,upto:long>>")), lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(doc_id, listed.alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = MARK, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows with every secret replaced by a mark (overlapping spans by one) and, where that column exists, the length renewed."""
    found = C.small(C.materialise(spans(docs, rules, doc_id, text), "secret-spans"))
    own = lambda c: F.col(f"row.`{c}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("key"))
    rows = rows.join(found, own(doc_id).eqNullSafe(F.col("doc")) & (F.col("key") == F.col("h")), "left")
    body = own(text)
    at = lambda x: F.coalesce(x["upto"], F.lit(0).cast("long"))
    kept = F.transform("spans", lambda x: F.when(x["start"] >= at(x), F.concat(F.substring(body, (at(x) + 1).cast("int"), (x["start"] - at(x)).cast("int")), F.lit(mark))).otherwise(F.lit("")))
    tail = F.substring(body, (F.array_max(F.transform("spans", lambda x: x["end"])) + 1).cast("int"), F.length(body))
    clean = F.when(F.col("spans").isNull(), body).otherwise(F.concat(F.array_join(kept, ""), tail))
    out = {c: own(c) for c in docs.columns} | {text: clean}
    if n_chars in docs.columns:
        out[n_chars] = F.when(F.col("spans").isNull(), own(n_chars)).otherwise(F.length(clean)).cast(docs.schema[n_chars].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])
