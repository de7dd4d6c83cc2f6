"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger holds, for each blob, the
rules (name@version) that have seen it and what they found. A scan takes any number of versions at any number of
paths, works out which (blob, rule version) pairs the ledger lacks, runs just those rules on those blobs, stores what is new
for the ledger, and joins the findings back to every path. load_ledger() and append_ledger() keep a ledger in a folder.

Addresses are compared, not texts. Where all blobs lack the same rules (a first scan, or a new rule), the texts are scanned where they are
read, copies in one partition once. Otherwise a bitmap of fixed size keeps back the texts that lack nothing, and of the others one copy of each
blob is shuffled to the rules that it lacks. The join back carries addresses and findings only, and is a plain equi-join with a stored
table of one row a blob, which adaptive execution splits where one blob is hot.

Defined results: a null text is the empty text; texts of any length are scanned whole; repeated rows are reported each; a null path is
reported as it is; matches of several kinds that start at the same place are listed in the order of the rules; an empty table gives no
rows; extra columns of versions stay with their row (names starting with ``_`` excepted).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored
from cinderlog.llm.words import unused


@dataclass(frozen=True)
class SecretRule:
    """group and least: the group of a match that must have so many characters. needs: one of these is in any match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns; spans of the first three are the base ones. Order is the order of kinds at the same start.
RULES = (
    SecretRule("assign", 1, r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    SecretRule("hex", 1, r"[0-9a-f]+", 0, 24),
    SecretRule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----BEGIN ",)),
    SecretRule("forge", 1, r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyJ",)),
)
_GAP = r"(?:\s|\\[nr]|[>#*/|])*"  # between lines, whatever stands before them; line ends may be escaped
#: A whole private key: to the END line that matches, or else through header fields and base64 lines.
PEM = SecretRule(
    "pem", 2,
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*-----END \1PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info|Comment|Content-Domain): [^\n\\]*)*(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}}(?![^\s\\\"']))*"
    rf"(?:(?<=[A-Za-z0-9+/]{{16}})(?:\s*\n|\\[nr]){_GAP}[A-Za-z0-9+/]+={{0,2}}(?=\s*(?:\n|\Z)|\\[nr]|[\"']))?)",
    0, 1, ("-----BEGIN ",),
)
#: What redaction takes out. RULES are what op1 reports, whose SQL has the header line as pem.
REDACTED = tuple(PEM if r.kind == "pem" else r for r in RULES)
BASE_KINDS = ("assign", "access", "hex")
FINDING = "struct<kind:string,start:bigint,end:bigint>"
LEDGER = f"blob_id string, rules array<string>, findings array<{FINDING}>"


def find(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the rules find: code points, end exclusive."""
    out = []
    for r in rules:
        if r.needs and not any(n in text for n in r.needs):
            continue
        pattern = r.pattern
        if pattern.endswith("]+") and r.group == 0 and pattern.count("+") == 1 and r.kind == "hex":
            pattern = f"{pattern[:-1]}{{{r.least},}}"  # a greedy run of one class: too short ones need no match
        for m in re.finditer(pattern, text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((r.kind, m.start(), m.end()))
    return out


def _scanner(rules):
    by_key = {r.key: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        done: set[str] = set()
        for whole in batches:
            blobs, keep = whole.column("blob_id").to_pylist(), []
            for blob in blobs:
                keep.append(blob not in done)
                if len(done) < REMEMBERED:
                    done.add(blob)
            b = whole.filter(pa.array(keep, pa.bool_()))
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find(text.as_py() or "", [by_key[k] for k in todo.as_py()])]
                for text, todo in zip(b.column("text"), b.column("rules"))
            ]
            yield pa.RecordBatch.from_arrays([b.column("blob_id"), b.column("rules"), pa.array(found, kind)], ["blob_id", "rules", "findings"])

    return scan


REMEMBERED = 100_000  # blobs of a partition that are known to be done
MARKS = 1 << 17  # rows of the bitmap of blobs at most
_PLACE, _BIT = "cast(conv(substring({0}, 1, 8), 16, 10) as bigint) % " + str(MARKS), "shiftleft(1L, cast(conv(substring({0}, 9, 2), 16, 10) as int) % 64)"
EMPTY = "cast(array() as array<string>)"


def _split(rows: DataFrame, blob: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose blob may be in keys (blob_id), and the others, by a bitmap of fixed size that is broadcast."""
    bits = keys.select(F.expr(_PLACE.format("blob_id")).alias("_w"), F.expr(_BIT.format("blob_id")).alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    marked = rows.join(F.broadcast(bits), F.expr(_PLACE.format(f"`{blob}`")) == F.col("_w"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.expr(_BIT.format(f"`{blob}`"))) != 0, F.lit(False))
    return marked.filter(hit).drop("_w", "_bits"), marked.filter(~hit).drop("_w", "_bits")


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs that the ledger lacks, stored. blobs: blob_id, text, in any number of copies."""
    current = F.array(*(F.lit(r.key) for r in rules))
    todo, schema = None, LEDGER
    if ledger is not None:
        seen = ledger.select("blob_id", F.explode("rules").alias("_r")).distinct().groupBy("blob_id").agg(F.collect_set("_r").alias("_seen"))
        lacking = F.array_sort(F.array_except(current, F.coalesce("_seen", F.expr(EMPTY))))
        todo = stored(blobs.select("blob_id").distinct().join(seen, "blob_id", "left").select("blob_id", lacking.alias("rules")), "todo")
        kinds = [r.rules for r in todo.select("rules").distinct().limit(2).collect()]
        if len(kinds) == 1:  # all lack the same
            todo, current = None, F.array(*map(F.lit, kinds[0])) if kinds[0] else F.expr(EMPTY)
            blobs = blobs if kinds[0] else blobs.limit(0)
    if todo is None:
        found = blobs.withColumn("rules", current).select("blob_id", "text", "rules").mapInArrow(_scanner(rules), schema)
        whole = F.any_value(F.struct("rules", "findings")).alias("x")  # copies in other partitions have found the same
        return stored(found.groupBy("blob_id").agg(whole).select("blob_id", "x.rules", "x.findings"), "scanned")
    todo = todo.filter(F.size("rules") > 0)
    some, _ = _split(blobs, "blob_id", todo)
    one = some.join(todo, "blob_id").dropDuplicates(["blob_id"])
    return stored(one.select("blob_id", "text", "rules").mapInArrow(_scanner(rules), schema), "scanned")


def load_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, with one row for each blob and scan; None if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def append_ledger(path: str, fresh: DataFrame) -> None:
    """Adds the rows that a scan has made (they are stored already, so nothing is scanned again)."""
    fresh.select("blob_id", "rules", "findings").write.mode("append").parquet(path)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions without the text, with blob_id and the findings of all current rules; the new ledger rows, stored)."""
    content = F.coalesce(F.col(text), F.lit(""))
    versions = versions.drop("blob_id", "findings", "_text")  # columns of these names are replaced
    addressed = versions.withColumns({"blob_id": F.sha2(content, 256), "_text": content})
    fresh = scan_unseen(addressed.select("blob_id", F.col("_text").alias("text")), ledger, rules)
    known = fresh if ledger is None else fresh.unionByName(ledger.select("blob_id", "rules", "findings"))
    hits = known.filter(F.size("findings") > 0)
    if ledger is not None:  # several entries for a blob, some perhaps of rules since replaced
        kinds = [r.kind for r in rules]
        hits = (
            hits.select("blob_id", "rules", F.explode("findings").alias("f"))
            .filter(F.col("f.kind").isin(kinds) & F.arrays_overlap("rules", F.array(*(F.lit(r.key) for r in rules))))
            .filter(F.exists("rules", lambda k: k.isin([r.key for r in rules]) & (F.split(k, "@")[0] == F.col("f.kind"))))
            .select("blob_id", "f").distinct().groupBy("blob_id").agg(F.collect_list("f").alias("findings"))
        )
    hits = stored(hits.select("blob_id", "findings"), "hits")
    report = addressed.drop("_text", text).join(hits, "blob_id", "left")
    order = F.array(*(F.lit(r.kind) for r in rules))
    ordered = F.transform(
        F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["kind"]).alias("k"), f["end"].alias("end"), f["kind"].alias("kind")))),
        lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")),
    )
    return report.withColumn("findings", F.coalesce(ordered, F.expr(f"cast(array() as array<{FINDING}>)"))), fresh


def joined_spans(findings):
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op1_blob_ledger(spark, sf_dir: str) -> DataFrame:
    """Two scans with a ledger: all versions under the base rules, then under all rules, which runs just those that the ledger lacks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, ledger = scan_versions(docs, None, tuple(r for r in RULES if r.kind in BASE_KINDS))
    report, _ = scan_versions(docs, ledger, RULES)
    n = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))
    return report.select("doc_id", *map(n, BASE_KINDS), F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"))


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with each span (overlapping ones merged) replaced by a mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redactor(found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans = b.schema.get_field_index("text"), b.column(found).to_pylist()
            dirty = [i for i, s in enumerate(spans) if s]
            if dirty:
                texts = b.column(at).to_pylist()
                for i in dirty:
                    texts[i] = redact(texts[i], [(f["start"], f["end"]) for f in spans[i]])
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.drop_columns([found])

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by a mark; columns and rows stay. n_chars, if there, counts the new text.

    Only rows whose blob may hold a finding are joined with the findings; the others stay where they are.
    """
    blob, found = unused(docs.columns, "_blob"), unused(docs.columns, "_found")
    addressed = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256))
    fresh = scan_unseen(addressed.select(F.col(blob).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text")), None, REDACTED)
    hits = stored(fresh.filter(F.size("findings") > 0).select("blob_id", "findings"), "hits")
    some, others = _split(addressed, blob, hits)
    dirty = some.join(hits.select(F.col("blob_id").alias(blob), F.col("findings").alias(found)), blob, "left").select(*docs.columns, found)
    clean = dirty.mapInArrow(_redactor(found), docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return others.select(*docs.columns).union(clean)


def _spans_sql() -> str:
    """Spans by cutting the text at matches: a match starts after the pieces and matches before it."""
    patterns = {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6),
        "access": (r"AKIA[A-Z0-9]+", r"(AKIA[A-Z0-9]+)", 20),
        "hex": (r"[0-9a-f]{24,}", r"([0-9a-f]{24,})", 24),
        "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
        # what must stand before a match is matched with it and isn't in the span
        "forge": (r"(?:^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1),
    }
    parts = []
    for k, (kind, (whole, group, least)) in enumerate(patterns.items()):
        before = f"+ length(m[i]) - length(regexp_extract(m[i], '{group}', 1))" if kind == "forge" else ""
        parts.append(
            f"SELECT doc_id, rid, {k} AS k, '{kind}' AS kind, s {before} AS s, s + length(m[i]) AS e FROM (SELECT doc_id, rid, m, i, "
            f"CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT doc_id, rid, regexp_extract_all(text, '{whole}') AS m, regexp_split_to_array(text, '{whole}') AS p, unnest(range(1, len(regexp_extract_all(text, '{whole}')) + 1)) AS i FROM t)) "
            f"WHERE length(regexp_extract(m[i], '{group}', 1)) >= {least}"
        )
    return " UNION ALL ".join(parts)


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
f AS ({_spans_sql()}),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (rid)
"""
