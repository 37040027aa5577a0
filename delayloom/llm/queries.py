"""One query per operator over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, near_dedup, nearest, packing, periodic_runs, personal_data, quality_model, quality_rules, sharding, spelling, suffix_dedup, token_counts


WORD = r"[^\x20\x09-\x0D]+"


def vocabulary() -> tuple[str, str, str]:
    """Tokenizer file, rank file and pattern of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *vocabulary())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    forest = quality_rules.fit_quality_forest(documents, _table(spark, sf_dir, "labels"))
    return quality_rules.quality_verdicts(documents, forest)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary()[1])


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality_model.fit_quality_model(documents, _table(spark, sf_dir, "labels"))
    out = quality_model.score_documents(documents, model)
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), 75)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _letter_lost(doc_id, run: str) -> str:
    """The run, one letter short where 97 divides the checksum of id and run; a null id reads as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, sf_dir, "documents"), _letter_lost))


def periods_planted(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)``; where 10 divides the id's checksum, the words from one on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    chosen = documents.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    chosen = chosen.withColumn("a", (g % F.nullif(n, F.lit(0))).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), n), " ")
    return chosen.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(periods_planted(_table(spark, sf_dir, "documents")), 12)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("top.less"), F.col("top.period")
    return out.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.personal_data(_table(spark, sf_dir, "documents"))
    listed = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long) as n_{k}") for k in personal_data.KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(F.expr(listed("filter(spans, s -> s.base)")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_mixing, op3_line_dedup, op4_packing, op5_quality_rules, op6_suffix_dedup, op7_token_counts, op8_quality_model, op9_nearest, op10_near_dedup, op11_spelling, op12_periodic_runs, op13_personal_data)}



def _crc32(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of the UTF-8 bytes of a text expression."""
    bytes_ = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {byte}), 4294967295)"


ORACLE_SQL = {
    "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, (place % 3 + 1)::BIGINT AS weight, source_size * 3 AS most FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
v AS (SELECT level FROM l WHERE level <= most::DOUBLE / weight ORDER BY most::DOUBLE / weight, place LIMIT 1),
t AS (SELECT source, source_size, place, least(most::DOUBLE, (SELECT level FROM v) * weight) AS target FROM w),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.doc_id, place, target, turn * source_size + ahead + part AS start_, least({mixing.PACKET}, size - part) AS words
      FROM q CROSS JOIN (VALUES (0), (1), (2)) AS turns(turn), unnest(range(0, size, {mixing.PACKET})) AS parts(part)),
o AS (SELECT doc_id, words, coalesce(sum(words) OVER (ORDER BY (start_ + words)::DOUBLE / target, place, start_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_ FROM p),
k AS (SELECT doc_id, sum(greatest(0, least(words, (SELECT sum(source_size) FROM s)::BIGINT - before_))) AS taken FROM o GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON k.doc_id = q.doc_id""",
    "op3_line_dedup": r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, line_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, sum(w) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM n WHERE w > 0),
ahead AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 29 AND b.c - a.c + a.w >= 30 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.pos BETWEEN b.pos - 29 AND b.pos AND b.c - a.c + a.w >= 30 GROUP BY ALL),
runs AS (SELECT * FROM ahead UNION SELECT * FROM back),
texts AS (SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.pos) AS body FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.s AND r.e GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM texts) WHERE k > 1),
gone AS (SELECT DISTINCT l.doc_id, l.line_no FROM later x JOIN l ON l.doc_id = x.doc_id AND l.pos BETWEEN x.s AND x.e),
kept AS (SELECT n.doc_id, count(*) FILTER (w > 0) AS n_lines, count(g.line_no) AS n_removed, string_agg(n.line, chr(10) ORDER BY n.line_no) FILTER (g.line_no IS NULL) AS text FROM n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.line_no = n.line_no GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_removed, 0)::INTEGER AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, (len(h) // 2 - 99)::BIGINT)) AS s, h FROM d WHERE len(h) >= 200),
k AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM w),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
isl AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true)::INT AS new FROM later),
num AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM isl),
spans AS (SELECT doc_id, i, min(s) AS a, max(s) + 100 AS b FROM num GROUP BY ALL),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, list((p, a) ORDER BY a) AS parts FROM gaps GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
          CASE WHEN c.doc_id IS NULL THEN d.h ELSE array_to_string(list_transform(c.parts, lambda x: substr(d.h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), '') || substr(d.h, 2 * c.tail + 1) END AS h
         FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept""",
    "op10_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, x.b FROM r JOIN both_ x ON r.b = x.a),
m AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
    "op11_spelling": rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS k FROM
  (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, k, {_crc32("(doc_id || ':' || run)")} AS h FROM r),
v AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
c AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM c a JOIN c b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.d UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.d),
b AS (SELECT word, near, n AS near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * v.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * v.n THEN b.near_n END AS form_n
      FROM v LEFT JOIN b ON b.word = v.word AND b.k = 1),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM t JOIN f e ON e.word = t.root AND e.form IS NULL JOIN f ON f.word = t.word""",
    "op12_periodic_runs": rf"""
WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
c AS (SELECT *, len(ws) AS n, h // 10 AS g FROM b),
e AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM c WHERE h % 10 = 0 AND n > 0),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM c WHERE NOT (h % 10 = 0 AND n > 0)
      UNION ALL SELECT doc_id, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word, i FROM (SELECT *, unnest(range(n)) AS i FROM e)),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND l.i < r.i),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, k),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
a AS (SELECT doc_id, count(*) AS n_runs, arg_min(r, {{'l': -length, 's': start, 'p': period}}) AS top, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS left_ FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(a.n_runs, 0)::BIGINT AS n_runs, a.top.start::BIGINT AS start, a.top.length::BIGINT AS length, a.top.period::BIGINT AS period,
  (1000 * a.top.length // a.top.period)::BIGINT AS exponent_milli, coalesce(a.runs, sha256('')) AS runs_sha256, sha256(coalesce(t.left_, '')) AS collapsed_sha256
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}
