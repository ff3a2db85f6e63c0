"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: an OR over the strings it must contain, each an
AND over that string's trigrams. `postings` lists, for the trigrams that any rule asks for, the documents that hold
them; `candidates` intersects the lists; only candidates are verified with the expression itself. A rule without
mandatory trigrams (runs of hexadecimal digits) scans every text.

Defined cases: null text is empty and has no secrets; rows that repeat, or share a doc_id, are judged row by row;
a null doc_id is looked up like any other; an empty table gives no rows; extra columns are ignored by `scan` and
kept by `redacted`.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import stored, table

#: kind, expression (Java and RE2 read it alike), group that must be long enough, and its least length.
BASE_RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),      # the runs of [0-9a-f]+ that are long enough
]
ADDED_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("repository", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("map_key", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
]
RULES = BASE_RULES + ADDED_RULES
#: Alternatives an expression may expand to before its literal run is closed.
ALTERNATIVES = 16


def _strings(node) -> set[str] | None:
    """All strings a parsed node can match, if these are few; None otherwise."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(c) for _, c in arg}
    if op is sre.SUBPATTERN:
        return _joined(arg[3])
    if op is sre.BRANCH:
        parts = [_joined(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _joined(arg[2])
        return inner if inner is None or arg[0] else inner | {""}
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Lower-case trigrams a match must hold: any of the sets, whole; None if nothing is mandatory."""
    runs, run = [], {""}
    for node in parser.parse(pattern):
        more = _strings(node)
        if more is not None and len(run) * len(more) <= ALTERNATIVES:
            run = {a + b for a in run for b in more}
        else:
            runs, run = [*runs, run], more or {""}
    usable = [r for r in [*runs, run] if min(map(len, r)) >= 3]
    if not usable:
        return None
    best = max(usable, key=lambda r: min(map(len, r)))
    return sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in map(str.lower, best)}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index, limited to the trigrams that are asked for: (trigram, doc_id)."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): documents whose posting lists satisfy the query of at least one rule, and which."""
    spark = docs.sparkSession
    clauses = [(kind, f"{kind}{i}", t, len(c)) for kind, pattern, *_ in rules
               for i, c in enumerate(trigram_query(pattern) or []) for t in sorted(c)]
    wanted = spark.createDataFrame(clauses, "rule string, clause string, trigram string, needed int")
    index = postings(docs, sorted({t for _, _, t, _ in clauses}))
    met = (index.join(F.broadcast(wanted), "trigram")       # fixed size: it follows from the rules alone
           .groupBy("doc_id", "rule", "clause", "needed").agg(F.collect_set("trigram").alias("got"))
           .where(F.size("got") == F.col("needed")))
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _found(kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Spans (start, order, kind, end) of one rule in the column `text`.

    The pieces between the matches and the matches themselves have known lengths; their running sum is the place.
    """
    text = F.col("text")
    lens = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    judged = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(lens)), F.arrays_zip(lens.alias("n"), judged.alias("g")),
                       lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["g"].alias("g")))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")),
                       lambda acc, s: F.struct(
                           (acc["at"] + s["gap"] + s["n"]).alias("at"),
                           F.when(s["g"] >= least, F.array_append(acc["spans"], F.struct(
                               (acc["at"] + s["gap"]).alias("start"), F.lit(order).alias("kind_no"),
                               F.lit(kind).alias("kind"), (acc["at"] + s["gap"] + s["n"]).alias("end"))))
                           .otherwise(acc["spans"]).alias("spans")),
                       lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """`docs` (doc_id, text and any others) with __found: all spans of all rules, by start and then rule."""
    found = stored(candidates(docs.select("doc_id", "text"), rules)).select(
        F.col("doc_id").alias("__id"), F.col("rules").alias("__rules"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]), "left")
    parts = []
    for i, (kind, pattern, group, least) in enumerate(rules):
        part = _found(kind, pattern, group, least, i)
        if trigram_query(pattern) is not None:
            part = F.when(F.array_contains("__rules", kind), part).otherwise(F.array().cast(_SPANS))
        parts.append(part)
    return joined.withColumn("__found", F.array_sort(F.concat(*parts))).drop("__id", "__rules")


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans, for every row."""
    rows = spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "__found")
    base = F.filter("__found", lambda s: s["kind_no"] < len(BASE_RULES))
    kinds = F.transform("__found", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k, *_ in BASE_RULES]
    return rows.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
                       _written(F.col("__found")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span overwritten by `mark` (overlapping spans by one); n_chars follows."""
    rows = spans(docs)
    merged = F.aggregate("__found", F.array().cast("array<struct<start:int,end:int>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
        .otherwise(F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    # from the last span to the first, so that places stay valid
    text = F.aggregate(F.reverse("__cut"), F.col("text"), lambda t, s: F.concat(
        F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["end"] + 1, F.length(t))))
    hit = rows.withColumn("__cut", F.when(F.size("__found") > 0, merged))
    new = F.when(F.col("__cut").isNotNull(), text).otherwise(F.col("text"))
    out = {"text": new} | ({"n_chars": F.when(F.col("__cut").isNotNull(), F.length(new).cast(dict(docs.dtypes)["n_chars"]))
                            .otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return hit.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op9_secrets(spark, sf_dir):
    """Secrets of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def one(i, kind, pattern, group, least):
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {i} AS kind_no, '{kind}' AS kind, s.start AS start, s.start + s.n AS stop FROM (
            SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda k: {{
                'start': CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT),
                'n': length(m[k]), 'g': length(g[k])}})) AS s
            FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g,
                  string_split_regex(text, '{p}') AS p FROM documents WHERE regexp_matches(text, '{p}'))) WHERE s.g >= {least}"""
    return "WITH hits AS (" + " UNION ALL ".join(one(i, *r) for i, r in enumerate(RULES)) + f"""),
    per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE_RULES)}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans FROM hits GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id"""


OP9_SQL = _sql()
