"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A ledger lists the (blob, rule version) pairs
that have been scanned, with their findings; a scan reads only the blobs that are not in it yet, once each however many
paths hold them, and the findings are joined back to all paths. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, private, table


@dataclass(frozen=True)
class Rule:
    """A pattern; of its matches those count whose `group` has `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    #: What can be told cheaply: a character class or such by which each match begins, and text that each match holds.
    begins: str = ""
    holds: str = ""


#: In the order by which spans with an equal start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, begins="[PpSsTtAa]"),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20, holds="AKIA"),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24),  # runs are maximal, so the shorter ones need not be matched
)
RULE_VERSION = "1"


def _address_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def content_address(versions: DataFrame) -> DataFrame:
    """versions with blob, the SHA-256 of its whole text; a null text is the empty blob. A column `blob` is replaced."""
    return versions.withColumn("blob", _address_of("text"))


def _may_match(rules: tuple[Rule, ...]) -> Column:
    """Is there a match of any rule, of whatever length? False for a null text."""
    found = F.lit(False)
    for r in rules:
        one = F.col("text").rlike(f"(?={r.begins})(?:{r.pattern})" if r.begins else r.pattern)
        found = found | (F.contains("text", F.lit(r.holds)) & one if r.holds else one)
    return F.coalesce(found, F.lit(False))


def find_spans(texts: DataFrame, key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kind, kind_order, start, end): the spans, in code points, in each text.

    For each rule a text is cut at its leftmost non-overlapping matches; the running length of the pieces and matches
    gives the positions. Texts without a match are dropped before anything is cut.
    """
    texts = texts.where(_may_match(rules))
    cuts = F.array(*[
        F.struct(
            F.lit(r.kind).alias("kind"), F.lit(k).alias("kind_order"), F.lit(r.least).alias("least"),
            F.transform(F.split("text", r.pattern, -1), F.char_length).alias("gaps"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.char_length).alias("hits"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.char_length).alias("sizes"),
        )
        for k, r in enumerate(rules)
    ])
    each = texts.select(key, F.explode(cuts).alias("c")).where("size(c.hits) > 0")
    each = each.withColumn("kind_order", F.col("c.kind_order")).dropDuplicates([key, "kind_order"])  # of rows that share a key, one counts
    pieces = each.select(
        key, "c.kind", "kind_order", "c.least", F.posexplode(F.arrays_zip(F.col("c.gaps").alias("gap"), F.col("c.hits").alias("hit"), F.col("c.sizes").alias("size"))).alias("at", "p")
    )
    so_far = Window.partitionBy(key, "kind_order").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum((F.col("p.gap") + F.coalesce("p.hit", F.lit(0))).cast("bigint")).over(so_far)
    return pieces.withColumn("end", ends).where("p.size >= least").select(key, "kind", "kind_order", (F.col("end") - F.col("p.hit")).alias("start"), "end")


def scan_unseen(versions: DataFrame, path: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings for every row of `versions`, and the ledger with what was new.

    versions has `path` (any orderable id) and text; rows may repeat. ledger has (blob, rule_version, findings), one row
    for each blob seen, findings an array of (kind, kind_order, start, end). Returns versions with blob and findings,
    and the grown ledger. Only ids and digests are shuffled to find the unseen blobs; of the rows that share a blob one
    is scanned. A blob is scanned again when the rule version changes.
    """
    none = "cast(array() as array<struct<kind:string,kind_order:int,start:bigint,end:bigint>>)"
    ids = cut(content_address(versions.select(path, "text")).select(path, "blob"))
    known = ledger.where(F.col("rule_version") == version).select("blob", "findings") if ledger is not None else None
    fresh = ids.groupBy("blob").agg(F.min(path).alias("one"), F.count("*").alias("n"))
    if known is not None:
        fresh = fresh.join(known.select("blob"), "blob", "left_anti")
    fresh = cut(fresh)
    # The rows of the chosen ids: a repeated id may bring other blobs along, which are scanned once as well.
    rows = versions.select(path, "text").where("text is not null").join(fresh.select("one").distinct(), F.col(path).eqNullSafe(F.col("one")), "left_semi")
    spans = find_spans(content_address(rows), "blob", rules)
    found = spans.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("kind", "kind_order", "start", "end"))).alias("findings"))
    found = cut(found)
    new = fresh.select("blob").join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("findings", F.expr(none)).alias("findings"))
    hits = found if known is None else found.union(known.where(F.size("findings") > 0)).dropDuplicates(["blob"])
    joined = ids.join(cut(hits) if known is not None else hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.expr(none)))
    return joined, new if ledger is None else ledger.select("blob", "rule_version", "findings").union(new)


def _is(kind: str):
    return lambda x: x == kind


def digests(found: DataFrame, *columns: str) -> DataFrame:
    """Counts by kind and the spans as text, in order of start and kind."""
    order = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["kind_order"].alias("kind_order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.col("findings.kind")
    count = [F.size(F.filter(kinds, _is(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in RULES]
    return found.withColumn("spans", spans).select(*columns, *count, F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding replaced by a mark and n_chars counted anew; all rows stay, null texts as they are.

    Only the rows that may have a finding meet the findings; the others pass without a shuffle. Other columns, whatever
    their names, stay as they are; rows with null or repeated ids are judged by their own texts.
    """
    found, _ = scan_unseen(docs, "doc_id")
    blob, findings, address, clean = private(docs, "_blob", "_findings", "_address", "_clean")
    hits = cut(found.where(F.size("findings") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("findings").alias(findings)))
    rows = docs.where(_may_match(RULES)).withColumn(address, _address_of("text")).join(hits, F.col(address) == F.col(blob), "left")
    merged = F.aggregate(
        F.array_sort(F.transform(findings, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.col("text").substr(a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.col("text").substr(a["at"].cast("int") + 1, F.length("text"))),
    )
    out = rows.withColumn(clean, F.when(F.col(findings).isNull(), F.col("text")).otherwise(merged))
    made = {"text": F.col(clean), "n_chars": F.when(F.col(findings).isNull(), F.col("n_chars")).otherwise(F.length(clean)) if "n_chars" in docs.columns else None}
    columns = [made[c].cast(kind).alias(c) if c in made else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return out.select(*columns).union(docs.where(~_may_match(RULES)))


def op6_query(spark, sf_dir: str) -> DataFrame:
    found, _ = scan_unseen(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return digests(found, "doc_id")


def two_versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of a first commit of all documents, and of a second that adds a password to every seventh."""
    path = F.col("doc_id").cast("string")
    text = F.coalesce("text", F.lit(""))
    edited = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(text, F.lit(' password = "hunter2hunter2"'))).otherwise(text)
    return docs.select(F.concat(F.lit("1/"), path).alias("path"), "text"), docs.select(F.concat(F.lit("2/"), path).alias("path"), edited.alias("text"))


def rescan_query(spark, sf_dir: str) -> DataFrame:
    """Findings of every path of two commits. The second scan knows the ledger of the first and reads only new blobs."""
    first, second = two_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    _, ledger = scan_unseen(first, "path")
    ledger = cut(ledger)
    found, grown = scan_unseen(first.union(second), "path", ledger)
    added = cut(grown.join(ledger.select("blob"), "blob", "left_anti").select("blob").distinct())
    marked = digests(found, "path", "blob").join(added.withColumn("new", F.lit(True)), "blob", "left")
    return marked.select("path", F.coalesce("new", F.lit(False)).alias("scanned_again"), "n_assign", "n_access", "n_hex", "spans")


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SQL = (
    r"""
WITH b AS ({texts}),
r(kind, k, pat, least) AS (VALUES ('assign', 0, '"""
    + _ASSIGN
    + r"""', 6), ('access', 1, '()(AKIA[A-Z0-9]+)', 20), ('hex', 2, '()([0-9a-f]+)', 24)),
m AS (SELECT doc_id, 'assign' AS kind, 0 AS k, 6 AS least, regexp_split_to_array(t, '"""
    + _ASSIGN
    + r"""') AS g, regexp_extract_all(t, '"""
    + _ASSIGN
    + r"""') AS h, regexp_extract_all(t, '"""
    + _ASSIGN
    + r"""', 2) AS s FROM b
UNION ALL SELECT doc_id, 'access', 1, 20, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM b
UNION ALL SELECT doc_id, 'hex', 2, 24, regexp_split_to_array(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM b),
p AS (SELECT doc_id, kind, k, least, unnest(range(1, len(h) + 1)) AS i, g, h, s FROM m WHERE len(h) > 0),
q AS (SELECT doc_id, kind, k, least, i, length(h[i]) AS hl, length(s[i]) AS sl, sum(length(g[i]) + length(h[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM p),
f AS (SELECT doc_id, kind, k, CAST(e - hl AS BIGINT) AS st, CAST(e AS BIGINT) AS en FROM q WHERE sl >= least),
a AS (SELECT doc_id, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) AS spans, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2 FROM f GROUP BY 1)
SELECT {columns}, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       coalesce(spans, '') AS spans
FROM b LEFT JOIN a ON a.doc_id = b.doc_id
"""
)


def _sql(texts: str, columns: str) -> str:
    return _SQL.replace("{texts}", texts).replace("{columns}", columns)


OP6_SQL = _sql("SELECT doc_id, coalesce(text, '') AS t FROM documents", "b.doc_id, sha256(coalesce(spans, '')) AS base_sha256")
RESCAN_SQL = _sql(
    "SELECT '1/' || doc_id AS doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT '2/' || doc_id, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' password = \"hunter2hunter2\"' ELSE '' END FROM documents",
    "b.doc_id AS path, b.t NOT IN (SELECT coalesce(text, '') FROM documents) AS scanned_again",
)
