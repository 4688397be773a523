"""One query per operator over its whole table, with production parameters; SQL where it can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.llm import decontam, divergence, exact, html, licenses, lines, maxent, merkle, mixing, pii, quality, secrets, simhash
from trustfold.llm.common import table


#: Key of the registered query. A production run takes its key from a secret store.
PII_KEY = b"example key, not for production!"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with valid personal values replaced, and how many of each kind."""
    out = pii.protect(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS])


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents: lines and whole texts whose bigram Dice coefficient with a template is 0.8 or more."""
    return licenses.licenses(table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat an earlier line, exactly or within 2 edits."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the item and the alignment score."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the model trained on those that are not held out, beside a smoothed word model."""
    return maxent.language_model_scores(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; each distinct text is scanned once."""
    return secrets.document_secrets(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; at most 5% of a language's good documents are rejected."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, at most 3 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=3)


#: What a leaf of the manifest covers, in this order.
MERKLE_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_leaf() -> Column:
    """The leaf of a copy in which texts of ids with an even CRC-32 have lost their line ends; a null id is not among them."""
    cut = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(cut, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.leaf_digest(*[text if f == "text" else F.col(f) for f in MERKLE_FIELDS])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tampered copy of all documents proved against their manifest."""
    return merkle.audit(table(spark, sf_dir, "documents"), tampered_leaf(), MERKLE_FIELDS)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of each language from one another, and the words that set each apart from its language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of those equal but for white space."""
    return exact.duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_licenses": op2_licenses,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_exact_dedup": op13_exact_dedup,
}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _licenses_sql() -> str:
    values = ", ".join(f"({i}, {_text(name)}, {_text(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    normal = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "unnest(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    s = licenses.SCORE
    return f"""
WITH t AS (SELECT template, license, {normal.format("text")} AS w FROM (VALUES {values}) v(template, license, text)),
tg AS (SELECT template, license, size, gram, count(*) AS times
       FROM (SELECT template, license, len(w) - 1 AS size, {grams.format("w")} AS gram FROM t) GROUP BY ALL),
units AS (
  SELECT DISTINCT doc_id, text, line, unit FROM (
    SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, text, -1, text FROM documents WHERE contains(text, chr(10)))),
u AS (SELECT row_number() OVER () AS id, doc_id, line, {normal.format("unit")} AS w FROM units),
ug AS (SELECT id, doc_id, line, n, gram, count(*) AS here
       FROM (SELECT id, doc_id, line, len(w) - 1 AS n, {grams.format("w")} AS gram FROM u WHERE len(w) BETWEEN 2 AND 200) GROUP BY ALL),
pairs AS (SELECT id, doc_id, line, template, license, 2.0 * sum(least(here, times)) / (n + size) AS dice
          FROM ug JOIN tg USING (gram) GROUP BY id, doc_id, line, n, template, license, size)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, template, CAST(dice AS DOUBLE) AS dice FROM pairs WHERE dice >= {s}
QUALIFY row_number() OVER (PARTITION BY id ORDER BY dice DESC, template) = 1"""


def _secrets_sql() -> str:
    found = []
    for i, r in enumerate(secrets.RULES):
        p = _text(r.pattern)
        found.append(
            f"SELECT doc_id, rid, {i} AS ord, {_text(r.kind)} AS kind, {r.least} AS minimum, regexp_split_to_array(text, {p}) AS pieces, "
            f"regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {r.group}) AS v FROM d WHERE regexp_matches(text, {p})")
    base = ", ".join(_text(r.kind) for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {_text(r.kind)}) AS n_{r.kind}" for r in secrets.BASE_RULES)
    kept = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
e AS (SELECT rid, ord, kind, minimum, length(v[n]) AS size, length(m[n]) AS chars,
             list_sum(list_transform(pieces[1:n], lambda x: length(x))) + list_sum(list_transform(m[1:n], lambda x: length(x))) AS stop
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM f)),
s AS (SELECT rid, ord, kind, stop - chars AS start, kind || ':' || CAST(CAST(stop - chars AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span
      FROM e WHERE size >= minimum),
g AS (SELECT rid, {counts}, count(*) AS n_spans, string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE kind IN ({base})) AS base,
             string_agg(span, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, {kept}, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


def _quality_sql(rate: float = 0.05, error: float = 0.05) -> str:
    rules = quality.RULES
    steps = range(1, len(rules) + 1)
    hit = lambda r, c: f"(100 * {rules[r].part} > {c} * {rules[r].whole})"
    entries = " UNION ALL ".join(
        f"SELECT stratum, {r} AS rule, {i} AS step, {c} AS cutoff, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad, "
        f"count(*) FILTER (WHERE good AND {hit(r, c)}) AS k, count(*) FILTER (WHERE NOT good AND {hit(r, c)}) AS b FROM half GROUP BY stratum"
        for r, rule in enumerate(rules) for i, c in enumerate(rule.cutoffs))
    caught = lambda s, t: " OR ".join(
        f"coalesce({t}.rank_{r} <= {s} AND 100 * {rule.part} > {t}.cutoff_{r} * {rule.whole}, false)" for r, rule in enumerate(rules))
    pivot = ", ".join(f"max(cutoff) FILTER (WHERE rule = {r}) AS cutoff_{r}, max(rank) FILTER (WHERE rule = {r}) AS rank_{r}" for r in range(len(rules)))
    sums = ", ".join(f"count(*) FILTER (WHERE good AND ({caught(s, 'p')})) AS k_{s}, count(*) FILTER (WHERE NOT good AND ({caught(s, 'p')})) AS b_{s}" for s in (0, *steps))
    more = ", ".join(f"(b_{s} - b_{s - 1}) * n_good > (k_{s} - k_{s - 1}) * n_bad" for s in steps)
    keep = ", ".join(f"CASE WHEN more[rank_{r}] THEN {c}_{r} END AS {c}_{r}" for r in range(len(rules)) for c in ("cutoff", "rank"))
    tail = lambda k: (
        f"CASE WHEN n_good = 0 OR {k} >= n_good * {rate} THEN 1.0 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n_good + 1) "
        f"- lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({rate}) + (n_good - i) * ln({1 - rate})))) END")
    passed = " ".join(f"WHEN NOT ({tail(f'k_{s}')} <= {error} / strata) THEN {s - 1}" for s in steps)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{word}') AS w FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM w WHERE len(w) >= 3),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY rid),
st AS (
  SELECT d.rid, d.doc_id, d.stratum, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM st),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT base.*, good, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1) < '8' AS design FROM base JOIN lab USING (doc_id) WHERE NOT base_failed),
half AS (SELECT * FROM labelled WHERE design),
cand AS (SELECT *, b * n_good - k * n_bad AS gap FROM ({entries})),
best AS (SELECT * FROM cand WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gap DESC, step) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gap DESC, rule) AS rank FROM best),
p AS (SELECT stratum, {pivot} FROM ranked GROUP BY stratum),
sums AS (SELECT p.*, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad, {sums}
         FROM half JOIN p ON half.stratum IS NOT DISTINCT FROM p.stratum GROUP BY ALL),
helpful AS (SELECT stratum, {keep} FROM (SELECT *, [{more}] AS more FROM sums)),
held AS (SELECT h.stratum, {", ".join(f"p.{c}_{r}" for r in range(len(rules)) for c in ("cutoff", "rank"))}, count(*) AS n_good,
                {", ".join(f"count(*) FILTER (WHERE {caught(s, 'p')}) AS k_{s}" for s in steps)}
         FROM labelled h LEFT JOIN helpful p ON h.stratum IS NOT DISTINCT FROM p.stratum WHERE NOT design AND good GROUP BY ALL),
used AS (SELECT *, CASE {passed} ELSE {len(rules)} END AS certified FROM (SELECT *, count(*) OVER () AS strata FROM held))
SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed,
       NOT base_failed AND NOT ({caught('u.certified', 'u')}) AS kept
FROM base LEFT JOIN used u ON base.stratum IS NOT DISTINCT FROM u.stratum"""


def _merkle_sql(levels: int = 14) -> str:
    """Level by level, all nodes at once; good for groups of up to 3^levels rows and as many groups."""
    hash_of = "sha256(" + " || ".join(
        f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) END" for f in MERKLE_FIELDS) + ")"
    ctes = [
        "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t)",
        "d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
        "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc FROM documents, crc)",
        f"pairs AS (SELECT doc_id, source, {hash_of} AS leaf, {hash_of.replace('CAST(text AS VARCHAR)', 'seen_text').replace('text IS NULL', 'seen_text IS NULL')} AS seen "
        "FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen_text FROM d))",
        "lf AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM pairs)",
        "g0 AS (SELECT tree, pos, leaf AS h FROM lf)"]

    def grow(n: str):
        side = lambda a, b: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN {a} AND {b}), '')"
        for k in range(levels):
            ctes.append(f"{n}s{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r FROM {n}{k})")
            ctes.append(f"{n}{k + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {n}s{k} GROUP BY tree, pos // 3)")

    grow("g")
    ctes.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS source FROM g{levels})")
    grow("t")
    ctes.append(f"p0 AS (SELECT lf.*, g{levels}.h AS subroot, t0.pos AS top, seen AS f, '' AS p FROM lf JOIN g{levels} USING (tree) JOIN t0 ON t0.source = lf.tree)")
    at = 0
    for n, key, place in (("g", "s.tree = p.tree", "p.pos"), ("t", "true", "p.top")):
        for k in range(levels):
            ctes.append(f"p{at + 1} AS (SELECT p.* EXCLUDE (f, p), CASE WHEN c = 1 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p "
                        f"FROM p{at} p JOIN {n}s{k} s ON {key} AND s.pos = {place} // {3 ** k})")
            at += 1
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{at} p, t{levels}"""


SQL: dict[str, str] = {
    "op11_merkle": _merkle_sql(),
    "op2_licenses": _licenses_sql(),
    "op7_secrets": _secrets_sql(),
    "op9_quality_rules": _quality_sql(),
    "op12_divergence": r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM w),
c AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT rid) AS d FROM (SELECT rid, lang, source, unnest(words) AS t FROM w) GROUP BY ALL),
k AS (SELECT lang, t, sum(n)::HUGEINT AS n FROM c GROUP BY lang, t HAVING sum(d) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, t)) c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.t, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (n.total + 2 * terms) AS p,
             1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * terms) AS q
      FROM n JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.t = k.t),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER o AS INTEGER) AS rank FROM r
WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER o <= 10""",
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d""",
    "op4_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source),
steps AS (  -- sources in the order in which they reach their caps as the water level rises
  SELECT *, 3.0 * source_size AS cap,
         sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3.0 * source_size) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS used_w
  FROM src WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(arg_min((total - used) / (all_w - used_w), cap / w) FILTER (w * (total - used) / (all_w - used_w) <= cap) AS DOUBLE) AS lv
  FROM steps),
targets AS (
  SELECT source, source_size, CAST(CASE WHEN source_size = 0 THEN 0 ELSE least(cap, w * lv) END AS DOUBLE) AS target FROM steps, level),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
upto AS (
  SELECT s.*, t.source_size, t.target, t.copies AS whole, t.target - t.copies * t.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS at_hash
  FROM sized s JOIN whole t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT source, min(hash) AS below FROM upto WHERE rest > 0 AND upto > rest GROUP BY source),
taken AS (
  SELECT u.*, u.whole + CASE WHEN c.below IS NULL THEN 0 WHEN u.hash < c.below THEN 1
         WHEN u.hash = c.below AND u.upto - u.rest <= u.rest - (u.upto - u.at_hash) THEN 1 ELSE 0 END AS copies
  FROM upto u LEFT JOIN cut c ON u.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM taken""",
}
