"""The thin queries of this subpackage, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (
    chat_format, decontaminate, jaccard_join, language_id, license_scan, mixing, personal_data, prefix_trie, quality_rules, repeat_spans, secret_scan, structure_sql, turn_repair, url_filter,
)

__all__ = ["QUERIES", "SQL"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(rows.unionByName(probe), keep_text=False)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("expressions")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.RULES[:3]]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("findings", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_by_host(_table(spark, sf_dir, "documents")).drop("source")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.strip_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def grafted(convs: DataFrame) -> DataFrame:
    """convs (conv_id, turns) rebuilt: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32 of c's decimals, modulo 9.

    A null conv_id stays as it is.
    """
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = convs.select(c.alias("_base"), F.col("turns").alias("_first"))
    both = convs.withColumns({"_base": c - c % 5, "_h": h}).join(first, "_base", "left")
    head = F.coalesce(F.slice("_first", 1, F.col("_h")), F.expr(f"cast(array() as {prefix_trie.TURNS})"))
    tail = F.when(F.size("turns") > F.col("_h"), F.slice("turns", F.col("_h") + 1, F.size("turns"))).otherwise(F.expr(f"cast(array() as {prefix_trie.TURNS})"))
    return both.select("conv_id", F.when(c.isNull(), F.col("turns")).otherwise(F.concat(head, tail)).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(grafted(prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("findings", lambda x: x["kind"].isin(*personal_data.BASE))
    return found.select("doc_id", *map(count, personal_data.BASE), F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes it a user's; nulls are one space."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_fault"))
    rows = rows.where("_fault <> 0").withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = turn_repair.audit_conversations(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left")
    zero = {x: F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 finds of the base phrases alone, which SQL can say."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def verbatim_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that op8 finds without an edit, which SQL can say."""
    return op8_decontaminate(spark, sf_dir).where("distance = 0 and not short").select("doc_id", "item_id", "item_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_url_filter, op3_jaccard_join, op4_chat_format, op5_license_scan, op6_secret_scan, op7_language_id, op8_decontaminate, op9_quality_rules, op10_suffix_dedup,
        op11_prefix_trie, op12_personal_data, op13_turn_repair, license_base_places, verbatim_benchmark_items,
    )
}

SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sized GROUP BY source
), queue AS (
  SELECT doc_id, d.source, size, source_size, cap, weight, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('17:' || doc_id || ':' || size), 1, 15), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM sized d JOIN sources s ON s.source IS NOT DISTINCT FROM d.source
), turns AS (
  SELECT weight, size, stop + k * source_size AS upto FROM queue, (VALUES (0), (1)) AS v(k) WHERE size > 0
), events AS (
  SELECT (upto - size) / weight AS moment, 0::DOUBLE AS whole, weight AS active, (upto - size)::DOUBLE AS origin FROM turns
  UNION ALL SELECT upto / weight, size::DOUBLE, -weight, -(upto - size)::DOUBLE FROM turns
), sums AS (
  SELECT moment, whole, active, origin, sum(whole) OVER w AS a, sum(active) OVER w AS b, sum(origin) OVER w AS c FROM events WINDOW w AS (ORDER BY moment, active ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT CASE WHEN b - active > 0 THEN least((budget - (a - whole) + (c - origin)) / (b - active), moment) ELSE moment END AS t
  FROM sums, (SELECT 0.75::DOUBLE * sum(cap) AS budget FROM sources) WHERE a + moment * b - c >= budget ORDER BY moment, active LIMIT 1
), shared AS (SELECT q.*, least(cap, (SELECT t FROM cut) * weight) AS target FROM queue q)
SELECT doc_id, size, source_size, target, stop / weight AS finish,
       CAST(least(greatest(round(target)::BIGINT - (stop - size), 0), size) + least(greatest(round(target)::BIGINT - (stop - size + source_size), 0), size) AS BIGINT) AS taken
FROM shared
""",
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS place FROM pages
), cut AS (
  SELECT page_id,
         CASE WHEN place > 0 THEN translate(regexp_extract(substr(u, place + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN place > 0 THEN regexp_extract(substr(u, place + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN '.' || host LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN '.' || host LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN '.' || host LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN '.' || host LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
""",
    "op3_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = d.doc_id
""",
    "op4_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(t) + len(regexp_extract_all(t, '<\|+(?:im_start|im_end)\|+>'))) AS BIGINT) AS formatted_chars, false AS rewrites
FROM said GROUP BY conv_id
""",
    "op6_secret_scan": " ".join(
        [
            "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), cut AS (",
            " UNION ALL ".join(
                f"SELECT doc_id, '{r.kind}' AS kind, {k} AS rank, {r.least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS s FROM texts"
                for k, r in enumerate(secret_scan.RULES)
                for p in [r.pattern.replace("'", "''")]
            ),
            r"""), found AS (
  SELECT doc_id, kind, rank, CAST(list_sum(list_transform(list_slice(s, 1, i), lambda x: length(x))) + list_sum(list_transform(list_slice(m, 1, i), lambda x: length(x))) AS BIGINT) AS stop, length(m[i]) AS size
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0) WHERE length(g[i]) >= least
), spans AS (SELECT doc_id, kind, rank, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM found)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (span IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
        ]
    ),
    "op9_quality_rules": r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times
  FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) > 7))
), covered AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(gap, 8))) AS BIGINT) AS n FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM windows WHERE times > 1) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON c.doc_id = b.doc_id
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source),
totals AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) AS squares, sum(n * n) AS sizes FROM hosts),
fits AS (SELECT mean, mean * (1 - mean) AS within, (squares - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - sizes / n - (k - 1)) AS between, n - sizes / n - (k - 1) > 0 AS room FROM totals),
prior AS (SELECT mean, CASE WHEN room AND between > 0 THEN least(greatest(within / between - 1, 1), 1e6) WHEN within > 0 THEN 1e6 ELSE 1 END AS strength FROM fits)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (SELECT (h.f + mean * strength) / (h.n + strength) <= 0.5 FROM prior) AS kept
FROM judged j JOIN hosts h ON h.source IS NOT DISTINCT FROM j.source
""",
    "op10_suffix_dedup": r"""
WITH bytes AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS d, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT r, i, md5(d[i + 1:i + 200]) AS s FROM (SELECT r, d, unnest(range(0, n - 199)) AS i FROM bytes)),
hits AS (SELECT r, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
runs AS (
  SELECT r, min(i) AS low, max(i) + 200 AS high FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true)::INT AS fresh FROM hits)) GROUP BY r, g
), pieces AS (SELECT r, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low) AS a, low AS b FROM (SELECT r, low, high FROM runs UNION ALL SELECT r, n, n FROM bytes)),
kept AS (SELECT r, sha256(unhex(string_agg(hex(d[a + 1:b]), '' ORDER BY a))) AS kept_sha256 FROM pieces JOIN bytes USING (r) GROUP BY r),
cut AS (SELECT r, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM bytes JOIN kept USING (r) LEFT JOIN cut USING (r)
""",
    "license_base_places": r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases AS (SELECT * FROM (VALUES ('mit license', 2, 'mit'), ('apache license', 2, 'apache'), ('general public license', 3, 'gpl')) AS v(phrase, n, label)),
places AS (
  SELECT r, i - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM split) JOIN phrases ON array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase
), found AS (SELECT r, count(*) AS n, min(place) AS low, max(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM split LEFT JOIN found USING (r)
""",
    "verbatim_benchmark_items": r"""
WITH texts AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, trim(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS t FROM benchmark)
SELECT doc_id, item_id, CAST(length(i.t) AS INTEGER) AS item_chars FROM texts d JOIN items i ON contains(d.t, i.t) WHERE length(i.t) >= 24
""",
    "op11_prefix_trie": structure_sql.PREFIX_TRIE,
    "op12_personal_data": structure_sql.PERSONAL_DATA,
    "op13_turn_repair": structure_sql.TURN_REPAIR,
}
