"""Secret scan over a trigram inverted index.

1. Each rule's regular expression is read into a Boolean query over trigrams: an AND of
   clauses, each an OR of sets of trigrams; every match holds all of one set (``trigram_query``).
2. The index has one posting (trigram, document) for each trigram that any query asks for,
   over the lower-cased whole texts; it is written to the shared folder.
3. Postings are intersected: a document is a rule's candidate if, for each of the rule's clauses,
   it has postings for all trigrams of a set. Rules without a mandatory trigram take every document.
4. Candidates are verified with the regular expression itself; matches become spans. Only
   documents that may be candidates are shuffled to meet their rules (``common.maybe_in``).

Documents: a null text counts as empty; rows that repeat a doc_id and text repeat their
result; a null doc_id is kept. Only doc_id and text are read. No rows in, no rows out.
"""

from __future__ import annotations


from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, maybe_in, packed, row_key, same_key, whole, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # characters; shorter matches are dropped after matching


# fixed values of the contract, in its order. A run of one character class is matched whole, so its
# least length may stand in the pattern itself; a short value after a key has to be matched and dropped.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# well-known public token formats
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

# a set of alternative literals longer than this is cut to the trigrams it has
_ALTERNATIVES = 32


def _pieces(tree) -> list[list[str] | None]:
    """A sequence of pieces: a list of all strings a part can be, or None where it can be much else."""
    out: list[list[str] | None] = []
    for op, arg in tree:
        if op is _c.LITERAL:
            out.append([chr(arg).lower()])
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            out.append(sorted({chr(a).lower() for _, a in arg}))
        elif op is _c.SUBPATTERN:
            out.extend(_pieces(arg[-1]))
        elif op is _c.BRANCH:
            options = [_joined(_pieces(b)) for b in arg[1]]
            out.append(sorted({x for o in options for x in o}) if all(o is not None for o in options) else None)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            least, most, part = arg
            inner = _joined(_pieces(part))
            if inner is None:
                out.append(None)
            elif (least, most) == (0, 1):
                out.append(sorted({"", *inner}))
            else:
                out.extend([inner] * min(least, 3))
                if least != most or least > 3:
                    out.append(None)
        else:
            out.append(None)
    return out


def _joined(pieces: list[list[str] | None]) -> list[str] | None:
    if any(p is None for p in pieces):
        return None
    strings = ["".join(x) for x in product(*pieces)] if pieces else [""]
    return sorted(set(strings)) if len(strings) <= _ALTERNATIVES else None


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Clauses (AND), each of alternative trigram sets (OR): the lower-cased text of a match has all trigrams of one.

    Neighbouring pieces are joined while the alternatives stay few; a string's trigrams are its set,
    and a set that holds another one is absorbed by it. Strings under three characters ask for nothing."""
    clauses: set[frozenset[frozenset[str]]] = set()

    def close(strings: list[str]) -> None:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):
            clauses.add(frozenset(x for x in sets if not any(y < x for y in sets)))

    run = [""]
    for p in [*_pieces(_parser.parse(pattern)), None]:
        joined = None if p is None else sorted({a + b for a in run for b in p})
        if joined is None or len(joined) > _ALTERNATIVES:
            close(run)
            run = [""] if p is None else p
        else:
            run = joined
    close(run)
    return sorted(clauses, key=lambda c: sorted(map(sorted, c)))


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, _h): one row per document for each listed trigram its text has."""
    low = F.lower(whole())
    has = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return (docs.select("doc_id", row_key().alias("_h"), low.alias("_low"))
            .select("doc_id", "_h", F.explode(has).alias("trigram")).distinct())


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[frozenset[str]]]]) -> DataFrame:
    """(doc_id, _h, rules): documents whose postings satisfy all clauses of a rule's query."""
    spark = postings.sparkSession
    terms = spark.createDataFrame(
        [(t, rule, i, j, len(alt), len(q)) for rule, q in queries.items() for i, clause in enumerate(q)
         for j, alt in enumerate(sorted(clause, key=sorted)) for t in sorted(alt)],
        "trigram string, rule string, clause int, alt int, size int, clauses int")
    sets = (postings.join(F.broadcast(terms), "trigram")  # one row per trigram of the rules
            .groupBy("doc_id", "_h", "rule", "clause", "alt", "clauses", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size"))
    return (sets.groupBy("doc_id", "_h", "rule", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
            .groupBy("doc_id", "_h").agg(F.collect_set("rule").alias("rules")))


_MATCH = "array<struct<kind:string,order:int,idx:int,gap:int,len:int,ok:boolean>>"


def _matches(rule: Rule, order: int) -> Column:
    """Array of (kind, order, idx, gap, len, ok): each match with the characters between it and the one before."""
    text, pat = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pat, F.lit(0))
    counted = F.regexp_extract_all(text, pat, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    return F.transform(
        F.arrays_zip(found.alias("m"), counted.alias("c"), F.slice(gaps, 1, F.size(found)).alias("g")),
        lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), F.lit(order).alias("order"), i.alias("idx"),
                              F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"),
                              (F.length(x["c"]) >= rule.least).alias("ok")))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, _h, kind, order, start, end): the spans of every document, once per distinct row.

    ``start`` and ``end`` count code points, end exclusive."""
    docs = columns_of(docs, "doc_id", "text")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    keyed = docs.select("doc_id", row_key().alias("_h"), whole().alias("text"))

    def matched(df: DataFrame, columns: list[Column]) -> DataFrame:
        return df.select("doc_id", "_h", F.explode(F.concat(*columns)).alias("m")).select("doc_id", "_h", "m.*")

    scans = [_matches(r, i) for i, r in enumerate(rules) if r.kind not in indexed]
    found = [matched(keyed, scans)] if scans else []
    if indexed:
        grams = sorted({t for q in indexed.values() for c in q for alt in c for t in alt})
        postings = written(trigram_index(docs, grams), "trigram-index")
        cand = written(candidates(postings, indexed), "secret-candidates")
        near = same_key(keyed.where(maybe_in(cand)), cand, "inner")
        none = F.array().cast(_MATCH)
        found.append(matched(near, [F.when(F.array_contains("rules", r.kind), _matches(r, i)).otherwise(none)
                                    for i, r in enumerate(rules) if r.kind in indexed]))
    found = reduce(DataFrame.unionByName, found).dropDuplicates(["doc_id", "_h", "kind", "idx"])
    seq = Window.partitionBy("doc_id", "_h", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(seq)
    return (found.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
            .where("ok").select("doc_id", "_h", "kind", "order", "start", "end"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; a document without spans, and every
    other column, as it is. A column n_chars follows the text."""
    spans = secret_spans(docs, rules)
    earlier = Window.partitionBy("doc_id", "_h").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (spans.withColumn("seen", F.coalesce(F.max("end").over(earlier), F.lit(0)))
              .groupBy("doc_id", "_h")
              .agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("seen"), F.struct("seen", "start")))).alias("_gaps"),
                   F.max("end").alias("_last")))
    pieces = written(pieces, "secret-pieces")
    d, may = packed(docs), maybe_in(pieces)
    whole_ones = d.where(~may).select("_row.*")  # no shuffle for these
    d = same_key(d.where(may), pieces, "left")
    parts = F.transform("_gaps", lambda g: F.concat(
        F.substr(F.col("text"), (g["seen"] + 1).cast("int"), (g["start"] - g["seen"]).cast("int")), F.lit(mask)))
    clean = F.concat(F.array_join(parts, ""), F.substr(F.col("text"), (F.col("_last") + 1).cast("int")))
    changed = F.col("_row").withField("text", clean)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    return whole_ones.unionByName(
        d.select(F.when(F.col("_last").isNull(), F.col("_row")).otherwise(changed).alias("_row")).select("_row.*"))


def span_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans."""
    base = {r.kind for r in BASE_RULES}
    named = F.struct("start", "order", F.concat_ws(":", "kind", "start", "end").alias("name"))
    agg = (secret_spans(docs, rules).groupBy("doc_id", "_h")
           .agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*base), named))),
                                         lambda x: x["name"]), ",").alias("_base"),
                F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"]), ",").alias("spans"),
                F.count(F.lit(1)).alias("n_spans")))
    d = same_key(docs.select("doc_id", row_key().alias("_h")), agg, "left")
    zero = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)).cast("long") for k in ("assign", "access", "hex")}
    return d.select("doc_id", *[v.alias(k) for k, v in zero.items()],
                    F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
