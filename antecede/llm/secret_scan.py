"""Secret scan with multipart linking, in DataFrame operations only.

Strong patterns (assignments, access identifiers, long hexadecimal strings) are reported wherever they stand.  Weak candidates
(user names, bare 40-character keys, endpoints) are reported only if a complementary part lies within ``scope``
code points: an interval join of the parts of a document on the scope cells that they touch.

Each document is searched once, where it lies; what is shuffled are lengths of gaps and matches, from which a running sum
makes offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.rows import whole_row
from antecede.session import materialize

# The patterns.  kind, pattern, group of the value, its least and most length, what a text must hold to be
# searched, the role of a match, the role that must lie near for a weak one.
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
KINDS = (
    ("assign", rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None, KEYWORD, "secret", None),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, None, "AKIA", "identifier", None),
    ("hex", r"[0-9a-f]{32,}", 0, 32, None, r"[0-9a-f]{32}", None, None),
    ("login", r"""(?i:user(?:name)?|login|client_id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 1, 3, None,
     KEYWORD, None, "secret"),
    ("pair", r"[A-Za-z0-9+/]{40,}", 0, 40, 40, "AKIA", None, "identifier"),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9/_.~%?&=#+-]*)?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?",
     0, 7, None, KEYWORD, None, "secret"),
)
NAMES = [k[0] for k in KINDS]
BASE = 3  # the first kinds are strong
SCOPE = 200
FOUND = "array<struct<kind:int,at:int,gap:bigint,size:bigint,kept:boolean>>"


def matches(text: Column, kind: int) -> Column:
    """Leftmost matches that do not overlap: the length of the gap before each, its own, and whether it counts.

    ``\\G`` ties each find to the end of the one before, so the search is linear in the text.
    """
    _, pattern, group, least, most, hint, _, _ = KINDS[kind]
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    parts = F.arrays_zip(*(
        F.regexp_extract_all(text, whole, F.lit(g)).alias(n) for n, g in (("gap", 1), ("all", 2), ("value", 2 + group))
    ))
    size = lambda p: F.length(p["value"])
    found = F.transform(parts, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("at"), F.length(p["gap"]).cast("long").alias("gap"),
        F.length(p["all"]).cast("long").alias("size"),
        ((size(p) >= least) & (size(p) <= most if most else F.lit(True))).alias("kept"),
    ))
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(FOUND))


def spans_of(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, kind, start, end of all reported spans of ``rows`` (row, text), code points, end exclusive."""
    found = rows.select("row", F.explode(F.concat(*(matches(F.col("text"), k) for k in range(len(KINDS))))).alias("f")).select("row", "f.*")
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    placed = materialize(
        found.withColumn("end", end).where("kept").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    strong, weak = placed.where(F.col("kind") < BASE), placed.where(F.col("kind") >= BASE)
    value = lambda i: F.array(*(F.lit(k[i]) for k in KINDS))[F.col("kind")]
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    parts = strong.select("row", F.col("start").alias("from"), F.col("end").alias("to"), value(6).alias("role")).where("role IS NOT NULL")
    parts = parts.withColumn("cell", cells(F.col("from"), F.col("to")))
    near = weak.withColumn("role", value(7)).withColumn(
        "cell", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope)
    )
    linked = near.join(parts, ["row", "role", "cell"]).where(
        (F.col("from") <= F.col("end") + scope) & (F.col("to") >= F.col("start") - scope)
    )
    return strong.unionByName(linked.select("row", "kind", "start", "end").distinct())


def numbered_rows(docs: DataFrame) -> DataFrame:
    """The rows a scan works on, each with a number that holds as long as the input is read in the same files and splits."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text; others ignored).

    ``spans``: kind:start:end by start, then kind, comma-joined; ``base_sha256``: the digest of the same of the strong
    kinds.  A null text is empty.  Rows with a null or repeated doc_id are scanned each.  Spans may overlap.  An empty
    table gives an empty result.
    """
    rows = materialize(numbered_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select(
        "row", "doc_id", F.when(F.col("text").rlike("|".join(k[5] for k in KINDS[:BASE])), F.col("text")).alias("text")
    ))
    spans = spans_of(rows.where("text IS NOT NULL"), scope)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    by_row = spans.groupBy("row").agg(listed.alias("all"))
    name = F.array(*map(F.lit, NAMES))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["kind"] < BASE)
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("row", "doc_id").join(by_row, "row", "left").withColumn("all", F.coalesce("all", empty)).select(
        "doc_id", *(count(k).alias(f"n_{NAMES[k]}") for k in range(BASE)),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (spans that overlap or touch, by one) and n_chars to match.

    Documents stay, all their columns too; a null text stays null.  Only texts with a finding are rewritten.
    """
    rows = materialize(numbered_rows(docs.select(whole_row(docs).alias("row of the input"), "text")))
    spans = spans_of(rows.select("row", F.coalesce("text", F.lit("")).alias("text")), scope)
    by_start = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    islands = opens.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    previous = lambda i: F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(F.lit(0))
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    kept = F.transform("cuts", lambda c, i: part(previous(i), c["start"]))
    rest = part(F.element_at("cuts", -1)["end"], F.length("text"))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), rest))
    was = lambda c: F.col("row of the input")[c]
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return rows.join(cuts, "row", "left").withColumn("clean", text).select(
        *(F.when(F.col("cuts").isNull(), was(c)).otherwise(new[c]).alias(c) if c in new else was(c).alias(c) for c in docs.columns)
    )


def _sql_matches(kind: int) -> str:
    name, pattern, group, least, most, hint, _, _ = KINDS[kind]
    whole = rf"(?s)(.*?)({pattern})".replace("'", "''")
    get = lambda g: f"regexp_extract_all(text, '{whole}', {g})"
    value = f"length(value) >= {least}" + (f" AND length(value) <= {most}" if most else "")
    return f"""SELECT rid, {kind} AS kind, place, length(gap) AS gap, length(whole) AS size, {value} AS kept FROM (
        SELECT rid, generate_subscripts(gaps, 1) AS place, unnest(gaps) AS gap, unnest(wholes) AS whole, unnest("values") AS value FROM (
        SELECT rid, {get(1)} AS gaps, {get(2)} AS wholes, {get(2 + group)} AS "values"
        FROM docs WHERE regexp_matches(text, '{hint}')))"""


def scan_sql(scope: int = SCOPE) -> str:
    """The same for DuckDB, over ``documents``."""
    roles = " ".join(f"WHEN {i} THEN '{k[6]}'" for i, k in enumerate(KINDS) if k[6])
    needs = " ".join(f"WHEN {i} THEN '{k[7]}'" for i, k in enumerate(KINDS) if k[7])
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))
    item = f"CASE kind {names} END || ':' || start || ':' || stop"
    counts = ", ".join(f'coalesce(count(*) FILTER (kind = {k}), 0) AS n_{NAMES[k]}' for k in range(BASE))
    listed = lambda f: f"coalesce(string_agg({item}, ',' ORDER BY start, kind, stop){f}, '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_sql_matches(k) for k in range(len(KINDS)))}),
placed AS (
  SELECT rid, kind, stop - size AS start, stop FROM (
    SELECT *, CAST(sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY place) AS BIGINT) AS stop FROM found) WHERE kept),
strong AS (SELECT * FROM placed WHERE kind < {BASE}),
weak AS (
  SELECT * FROM placed w WHERE kind >= {BASE} AND EXISTS (
    SELECT 1 FROM strong s WHERE s.rid = w.rid AND CASE s.kind {roles} END = CASE w.kind {needs} END
    AND s.start <= w.stop + {scope} AND s.stop >= w.start - {scope})),
spans AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
listed AS (
  SELECT rid, {counts}, {listed(f" FILTER (kind < {BASE})")} AS base, {listed("")} AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{NAMES[k]}, 0) AS n_{NAMES[k]}" for k in range(BASE))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (rid)"""
