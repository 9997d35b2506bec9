"""Secret scan over a trigram inverted index, in DataFrame functions only.

From each regex a Boolean trigram query is derived: what every match must hold.  The index has the
posting list of each queried trigram for each block of documents; a block holds about BLOCK
documents, so that no posting list grows with the corpus.  Posting lists are intersected and united as
the query says, and the regex runs over the candidates only.  A rule without mandatory trigrams (a run
of hexadecimal digits) scans every text.

The trigrams of the index are those that the rules ask for, taken from lower-cased text, so that a
query may admit too much, never too little; the regex decides.  For each mandatory string they are a
cover, not all that it has: each costs a search of every text.  Texts are searched where they are; what
moves are posting lists and, to the texts, the candidates' ids (broadcast up to BROADCAST of them).

Defined results: null texts have no spans.  Texts of any length are scanned whole; spans of a text are
summed in chunks of CHUNK, so that their time doesn't grow with the square of their number.  Documents with equal ids (null counts as one id) are each
other's candidates but are judged one by one, and each row gets its row.  Other columns aren't read
(scan) or are kept (redact), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import NULL_ID, materialise
from quarry.llm.trigrams import query, trigrams

BLOCK = 4096
CHUNK = 256
#: Candidates (16 bytes each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 20


@dataclass(frozen=True)
class Rule:
    """least: code points that `group` of a match must have."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: Fixed values of the contract, in the order of listing; \x20 is a space.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

_HEAD = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_TAIL = r"-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: A line of a key's header, of its characters, or a blank one; indented or not.
_LINE = r"[ \t]*(?:[A-Za-z0-9-]+:[^\n]*|[A-Za-z0-9+/=\\]*)[ \t\r]*"


def _without_end(many: str, end: str) -> str:
    """What follows the head of a key whose end is missing: key characters on its line, then lines of header, key or nothing, and
    the key characters with which the next line begins.  many: how a group repeats; end: the end of the text."""
    return rf"[A-Za-z0-9+/=\\]*(?:[ \t]+[A-Za-z0-9+/=\\]{{16,}}){many}(?:[ \t\r]*\n(?:{_LINE}\n){many}(?:{_LINE}{end}|[ \t]*[A-Za-z0-9+/=\\]{{16,}})?)?"


#: A private key goes from its head to the next end of one, whatever stands between; without an end, as _without_end says.
#: No repeat of a secret's own characters has an upper bound, so that no tail of a long one stays.
OWN = (
    Rule("private_key", rf"{_HEAD}(?:(?s:.*?){_TAIL}|{_without_end('*', r'\Z')})"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer) {1,4}[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("login_url", r"://[A-Za-z0-9._%+-]*:[^\x00-\x20/@]+@"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("shop", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32,}"),
)

RULES = BASE + OWN

#: What runs in Spark instead of a rule and finds the same: a run of 16 or more is a maximal run of 16 or more; repeats that give
#: nothing back, and so need no stack, however long a key is.
FASTER = {
    "hex": r"[0-9a-f]{16,}",
    "private_key": rf"{_HEAD}(?:(?:[^-]++|-(?!{_TAIL[1:]}))*+{_TAIL}|{_without_end('*+', r'\z')})",
}


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def index(docs: DataFrame, id: str, text: str) -> DataFrame:
    """_block, _gram, _docs: the ids, once each, of the documents of the block that hold the trigram."""
    grams = sorted({g for r in RULES for part in query(r.regex) for s in part for g in trigrams(s)})
    n_blocks = max(8, -(-docs.count() // BLOCK))
    # the one-element array makes the lower-cased text once, not once for each trigram
    held = F.transform(F.array(F.lower(text)), lambda low: F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(low, g)))[0]
    held = docs.select(F.coalesce(id, F.lit(NULL_ID)).alias("_k"), held.alias("_grams"))
    held = held.select("_k", F.pmod(F.xxhash64("_k"), F.lit(n_blocks)).alias("_block"), F.explode("_grams").alias("_gram"))
    return held.groupBy("_block", "_gram").agg(F.collect_set("_k").alias("_docs"))


def _wanted(regex: str) -> str | None:
    """SQL over _m, a block's map of posting lists, for the ids that the query admits."""
    parts = []
    for strings in query(regex):
        either = []
        for s in sorted(strings):
            lists = [f"coalesce(_m[{_sql(g)}], array())" for g in trigrams(s)]
            both = lists[0]
            for x in lists[1:]:
                both = f"array_intersect({both}, {x})"
            either.append(both)
        any_of = either[0]
        for x in either[1:]:
            any_of = f"array_union({any_of}, {x})"
        parts.append(any_of)
    out = parts[0] if parts else None
    for x in parts[1:]:
        out = f"array_intersect({out}, {x})"
    return out


def candidates(postings: DataFrame) -> DataFrame:
    """_k (id), _rules (bits of the rules, by their place in RULES, whose query the document meets)."""
    blocks = postings.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_gram", "_docs"))).alias("_m"))
    found = [F.expr(f"transform({w}, d -> struct(d AS k, {1 << k}L AS bit))") for k, r in enumerate(RULES) if (w := _wanted(r.regex))]
    each = blocks.select(F.explode(F.flatten(F.array(*found))).alias("x")).select("x.k", "x.bit")
    return each.groupBy(F.col("k").alias("_k")).agg(F.bit_or("bit").alias("_rules"))


def _spans(k: int, rule: Rule, text: str) -> list[tuple[str, Column]]:
    """Steps, each over the one before, to _f{k}: array of (start, kind's place, end)."""
    p, c = _sql(FASTER.get(rule.kind, rule.regex)), f"_f{k}"
    may = f"(_rules & {1 << k}) != 0" if query(rule.regex) else f"{text} RLIKE {p}"
    group = f"regexp_extract_all({text}, {p}, {rule.group})" if rule.group else f"regexp_extract_all({text}, {p}, 0)"
    parts = f"struct(split({text}, {p}, -1) AS g, regexp_extract_all({text}, {p}, 0) AS m, {group} AS v)"
    made = f"CASE WHEN {may} THEN {parts} END"
    lens = f"CASE WHEN size({c}.m) > 0 THEN transform({c}.m, (m, i) -> struct(length({c}.g[i]) AS g, length(m) AS m, length({c}.v[i]) AS v)) END"
    chunks = f"transform(sequence(0, (size({c}) - 1) div {CHUNK}), i -> slice({c}, i * {CHUNK} + 1, {CHUNK}))"
    total = "aggregate(x, 0L, (s, y) -> s + y.g + y.m)"
    based = f"struct({c} AS c, aggregate({c}, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + {total}))) AS b)"
    within = f"aggregate(x, struct({c}.b[i] AS at, array() AS out), (a, y) -> named_struct('at', a.at + y.g + y.m, 'out', concat(a.out, array(named_struct('s', a.at + y.g, 'k', {k}, 'e', a.at + y.g + y.m, 'v', y.v)))), a -> a.out)"
    within = within.replace("array() AS out", "cast(array() AS array<struct<s: bigint, k: int, e: bigint, v: int>>) AS out")
    spans = f"coalesce(filter(flatten(transform({c}.c, (x, i) -> {within})), y -> y.v >= {rule.least}), array())"
    return [(c, F.expr(e)) for e in (made, lens, chunks, based, spans)]


def _found(rows: DataFrame, text: str) -> DataFrame:
    """rows (with _k) and _spans: array of (s, k, e, v) by start, then kind."""
    wanted = materialise(candidates(index(rows, "_k", text)))
    if wanted.count() <= BROADCAST:  # else a join that can spill, and that Spark may split
        wanted = F.broadcast(wanted)
    df = rows.join(wanted, "_k", "left").withColumn("_rules", F.coalesce("_rules", F.lit(0).cast("bigint")))
    steps = [_spans(k, r, text) for k, r in enumerate(RULES)]
    for at in zip(*steps, strict=True):
        df = df.withColumns(dict(at))
    return df.withColumn("_spans", F.array_sort(F.flatten(F.array(*[f"_f{k}" for k in range(len(RULES))])))).drop(*[f"_f{k}" for k in range(len(RULES))], "_rules")


def _of_kind(k: int):
    return lambda s: s["k"] == k


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_k"), F.coalesce("text", F.lit("")).alias("_t"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["k"]], s["s"].cast("string"), s["e"].cast("string"))), ",")
    df = _found(rows, "_t").select("_id", "_spans")
    return df.select(
        F.col("_id").alias("doc_id"),
        *[F.size(F.filter("_spans", _of_kind(k))).cast("bigint").alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(said(F.filter("_spans", lambda s: s["k"] < len(BASE))), 256).alias("base_sha256"),
        said(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by the mark, n_chars to match, all columns kept."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_k"), F.coalesce("text", F.lit("")).alias("_t"))
    df = _found(rows, "_t")
    # what is left between spans: from the largest end so far to the next start
    pieces = """aggregate(_spans, struct(0L AS at, cast(array() AS array<string>) AS out), (a, s) ->
        named_struct('at', greatest(a.at, s.e), 'out', CASE WHEN s.s > a.at OR size(a.out) = 0 THEN concat(a.out, array(substring(_t, cast(a.at + 1 AS int), cast(greatest(s.s - a.at, 0) AS int)))) ELSE a.out END),
        a -> concat(a.out, array(substring(_t, cast(a.at + 1 AS int)))))"""
    text = F.when(F.size("_spans") > 0, F.array_join(F.expr(pieces), mark)).otherwise(F.col("_row.text"))
    df = df.select("_row", text.alias("_new"))
    own = {"text": F.col("_new"), "n_chars": F.when(F.col("_row.text").isNull() | (F.col("_new") == F.col("_row.text")), F.col("_row.n_chars")).otherwise(F.length("_new").cast("bigint")) if "n_chars" in docs.columns else None}
    return df.select(*[(own[c] if c in own else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
