"""Secret scans with a ledger of content-addressed blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A ledger
says which rule versions have scanned which blob, so a scan reads only texts
with a pair that the ledger lacks, each blob once however many paths and
versions hold it, and only with the rules it lacks. Findings belong to blobs and
are joined back to all paths.

A finding's place comes from the pieces between matches: a rule's matches split
the text, and running lengths of pieces and matches give starts and ends in
code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.llm.common import BROADCAST_ROWS, broadcast_if_small, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; those whose group ``group`` is under ``least`` long drop."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns. The base kinds come first, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run of 16 or more is the only way a run of one or more passes
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def blob_id(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _per_rule(rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the rule that the column ``rule`` numbers."""
    out = F.when(F.col("rule") == 0, value(rules[0]))
    for i, r in enumerate(rules[1:], 1):
        out = out.when(F.col("rule") == i, value(r))
    return out


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end): all findings of ``texts`` (blob, text, todo), with the rules whose bits todo has set;
    rule is a number in ``rules``."""
    wants = lambda i, r: (F.col("todo").bitwiseAND(1 << i) != 0) & F.col("text").rlike(r.pattern)
    hit = F.array_compact(F.array(*[F.when(wants(i, r), F.lit(i)) for i, r in enumerate(rules)]))
    rows = texts.select("blob", "text", F.explode(hit).alias("rule"))
    parts = rows.select(
        "blob", "rule",
        F.arrays_zip(
            _per_rule(rules, lambda r: F.transform(F.split("text", r.pattern, -1), F.length)).alias("before"),
            _per_rule(rules, lambda r: F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length)).alias("match"),
            _per_rule(rules, lambda r: F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length)).alias("value"),
        ).alias("parts")).dropDuplicates(["blob", "rule"])  # a repeated row brings its text again; only lengths are shuffled
    each = parts.select("blob", "rule", F.posexplode("parts").alias("n", "p")).select("blob", "rule", "n", "p.*")
    upto = Window.partitionBy("blob", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # the matches of one rule in one text
    each = each.withColumn("end", F.sum(F.col("before") + F.coalesce("match", F.lit(0))).over(upto).cast("long"))
    least = _per_rule(rules, lambda r: F.lit(r.least))
    return each.where(F.col("match").isNotNull() & (F.col("value") >= least)).select(
        "blob", "rule", (F.col("end") - F.col("match")).alias("start"), "end")


def scan(versions: DataFrame, path_col: str, text_col: str, rules: tuple[Rule, ...] = RULES,
         ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan every version (one row each) of every path: (paths, findings, ledger).

    paths: (path_col, blob), a row per row of ``versions``. findings: (blob, kind, version, start, end) of the pairs
    scanned now; add them to those of earlier scans. ledger: (blob, rules), the names of the rules that have scanned the
    blob, the given ledger included. A null text is the empty blob. Repeated rows have one set of findings. An empty table gives
    empty results. Other columns are not read.
    """
    paths = stored(versions.select(F.col(path_col), blob_id(F.col(text_col)).alias("blob")))
    blobs = paths.groupBy("blob").agg(F.min(path_col).alias("first"), F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(r.name) for r in rules])
    known = blobs.select("blob", F.lit(None).cast("array<string>").alias("rules")) if ledger is None else (
        blobs.select("blob").join(ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules")), "blob", "left"))
    done = F.coalesce("rules", F.array().cast("array<string>"))
    todo = sum((F.when(F.array_contains(done, F.lit(r.name)), F.lit(0)).otherwise(F.lit(1 << i)) for i, r in enumerate(rules)), F.lit(0)).cast("long")
    texts = versions.select(F.col(path_col).alias("path"), blob_id(F.col(text_col)).alias("blob"), F.col(text_col).alias("text"))
    # one path of each blob that several have; rows equal in path and text may still come twice
    many = broadcast_if_small(stored(blobs.where("n > 1").select("blob", "first", F.lit(True).alias("many"))))
    texts = texts.join(many, "blob", "left").where(F.col("many").isNull() | F.col("path").eqNullSafe(F.col("first")))
    if ledger is None:
        texts = texts.withColumn("todo", F.lit((1 << len(rules)) - 1).cast("long"))
    else:
        texts = texts.join(broadcast_if_small(stored(known.select("blob", todo.alias("todo")).where("todo > 0"))), "blob")
    kinds, numbers = (F.array(*[F.lit(getattr(r, x)) for r in rules]) for x in ("kind", "version"))
    found = stored(find(texts.where("text IS NOT NULL").select("blob", "text", "todo"), rules))
    findings = found.select("blob", F.get(kinds, F.col("rule")).alias("kind"), F.get(numbers, F.col("rule")).alias("version"), "start", "end")
    everything = known.select("blob", F.array_union(F.coalesce("rules", F.array().cast("array<string>")), names).alias("rules"))
    if ledger is not None:
        everything = everything.unionByName(ledger.join(blobs.select("blob"), "blob", "left_anti").select("blob", "rules"))
    return paths, findings, everything


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_by_path(paths: DataFrame, findings: DataFrame, path_col: str, rules: tuple[Rule, ...] = RULES,
                    base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(path_col, n_<base kind>..., n_spans, base_sha256, spans) for every row of ``paths``: counts, the SHA-256 of the base kinds' spans
    as kind:start:end joined by commas in order of start and then of the rules, and all spans joined likewise."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", F.array_position(order, F.col("kind")).alias("at"), "kind", "end")
    per_blob = stored(findings.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("all")))
    if (per_blob.agg(F.sum(F.size("all"))).first()[0] or 0) <= BROADCAST_ROWS:  # so that a blob of many paths stays spread
        per_blob = F.broadcast(per_blob)
    spans = F.coalesce("all", F.array().cast("array<struct<start:bigint,at:bigint,kind:string,end:bigint>>"))
    out = paths.join(per_blob, "blob", "left").withColumn("all", spans)
    of = lambda kinds: F.filter("all", lambda s: s["kind"].isin(*kinds))
    return out.select(
        path_col, *[F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base], F.size("all").cast("long").alias("n_spans"),
        F.sha2(_joined(of([r.kind for r in base])).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def document_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                     base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The secrets of every row of ``docs``; see ``scan`` and ``secrets_by_path``.

    Two scans share a ledger: the first has the base rules; the second has all rules and reads what the ledger lacks, which
    is every text with the rules that have come since.
    """
    _, first, ledger = scan(docs, id_col, text_col, base)
    paths, second, _ = scan(docs, id_col, text_col, rules, stored(ledger))
    return secrets_by_path(paths, first.unionByName(second), id_col, rules, base)
