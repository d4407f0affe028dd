"""The thin queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm import chat, debruijn, decontam, langid, lloyd, mixing, quality, runs, secret_scan, simhash, suffixes, tokens, warc
from rastra.llm.common import SPACE, new_path, stored, table


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_row").alias("row"))


def op3_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, after = chat.from_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.REPLY, after, repeats=True).withColumn("errors", F.array_join("errors", "; "))


def op4_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.MEASURES, (~quality.kept("base")).alias("base_failed"), quality.kept("v2").alias("kept"), "fail_bits")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 removes, from a ledger that is written once."""
    rows = stored(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality.ablation(rows, "v2")


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(spark, table(spark, sf_dir, "documents"))


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    signed = pages.select("page_id", F.col("url").alias("uri"), warc.payload(F.col("html")).alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    again = stored(warc.revisits(signed, "page_id", "digest", "size"), "revisits")
    records = signed.join(again, ["page_id", "digest"], "left")
    few = pages.select(F.substring(warc.payload(F.col("html")), 1, warc.SAMPLE_BYTES)).limit(warc.SAMPLE_PAGES).collect()
    path = new_path(spark, "archives")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    records = records.select(text("page_id").alias("record_id"), text("uri").alias("uri"), F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    warc.write_archives(records, path, warc.trained_dictionary([bytes(r[0]) for r in few]))
    read, kind = warc.read_archives(spark, path, with_payload=False), pages.schema["page_id"].dataType
    name = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return read.select(name("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", name("refers_to").alias("refers_to"), "error")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", secret_scan.summary(F.col("text")).alias("found")).select("doc_id", "found.*")


def op10_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    model = langid.fit(docs.where("not held_out"))
    found = docs.select("doc_id", "held_out", langid.language(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector's cluster and squared distance, with the sums of distances and the digest of its final centroid."""
    found = lloyd.cluster(table(spark, sf_dir, "embeddings"))
    centroids = found.centroids.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
    return found.assigned.join(F.broadcast(centroids), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 35-word windows that start at two or more places, as counts and a digest."""
    return debruijn.without_repeats(table(spark, sf_dir, "documents"), finish=lambda text: F.sha2(text, 256)).withColumnRenamed("kept", "kept_sha256")


def _with_runs(doc_id: Column, text: Column) -> Column:
    """The text whose words go in circles from some word on, in the documents whose id has a crc32 that ends in 0."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def in_circles(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)), " ")

    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, in_circles(w)).otherwise(""))
    return F.when(h % 10 == 0, F.get(planted, F.lit(0))).otherwise(text)


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of periodic runs of each document, its longest, and digests of all runs and of the text without their repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_simhash_pivots, op2_pfair_mix, op3_tool_call_links, op4_suffix_groups, op5_rule_ledger, rule_ablation, op6_benchmark_containment, op7_section_tokens, op8_warc_zstd, op9_secret_scan, op10_language_centroids, op11_weighted_lloyd, op12_debruijn_spans, op13_harmonic_runs)}

#: The ledger's measurements and failure bits as table b.
_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS k(k) WHERE c >= 2 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN p USING (rid)),
b AS (SELECT *, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > word_chars AS INT)
             + 8 * CAST(2 * n_dup_lines > n_lines AS INT) + 16 * CAST(word_chars < 2 * n_words OR word_chars > 25 * n_words AS INT) AS fail_bits FROM m)
"""



def _lloyd_sql() -> str:
    """The rounds of op11 one after another, as tables a1, c1, a2, c2, ... of assignments and centroids."""
    parts = [
        """k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "d AS MATERIALIZED (SELECT q, count(*) AS w FROM k GROUP BY q)",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS INT) AS c, q FROM k ORDER BY sha256('3:' || vec_id), q LIMIT 8)",
    ]
    for n in range(1, lloyd.ROUNDS + 2):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT d.q, any_value(w) AS w, min({{'d': list_sum(list_transform(list_zip(d.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.c}}) AS b FROM d, c{n - 1} AS c GROUP BY d.q)""")
        if n <= lloyd.ROUNDS:
            parts.append(f"""m{n} AS (SELECT b.c AS c, i, sum(w * q[i]) AS s, sum(w) AS w FROM a{n}, range(1, 65) AS r(i) GROUP BY b.c, i)""")
            parts.append(f"""c{n} AS MATERIALIZED (SELECT c.c, coalesce(any_value(m.q), any_value(c.q)) AS q FROM c{n - 1} AS c
LEFT JOIN (SELECT c, list(CAST((s - ((s % w) + w) % w) // w AS BIGINT) ORDER BY i) AS q FROM m{n} GROUP BY c) AS m ON m.c = c.c GROUP BY c.c)""")
    n = lloyd.ROUNDS + 1
    return f"""WITH {", ".join(parts)},
t AS (SELECT b.c AS c, CAST(sum(w * b.d) AS BIGINT) AS cluster_inertia FROM a{n} GROUP BY b.c)
SELECT vec_id, CAST(a.b.c AS INT) AS cluster, CAST(a.b.d AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(f.q, ',')) AS centroid_sha256
FROM k JOIN a{n} AS a ON k.q = a.q JOIN c{n - 1} AS f ON f.c = a.b.c JOIN t ON t.c = a.b.c
"""


ORACLE_SQL: dict[str, str] = {
    "op11_weighted_lloyd": _lloyd_sql(),
    "op12_debruijn_spans": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
g AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS c FROM w) WHERE c > 1),
o AS MATERIALIZED (SELECT DISTINCT rid, i + k AS i FROM g, range(35) AS r(k)),
s AS (SELECT d.rid, string_agg(x.w, ' ' ORDER BY x.i) AS kept, count(x.w) AS n
      FROM d JOIN (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) AS x ON x.rid = d.rid ANTI JOIN o ON o.rid = x.rid AND o.i = x.i GROUP BY d.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.rid = d.rid
""",
    "op13_harmonic_runs": r"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
     flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1))) AS bits FROM documents),
h AS (SELECT rid, doc_id, ws, len(ws) AS n, xor(list_reduce(list_prepend(4294967295, bits), lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM b),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM p),
x AS MATERIALIZED (SELECT rid, unnest(ws) AS w, unnest(range(n)) AS i FROM t),
e AS (SELECT l.rid, l.i, r.i - l.i AS p FROM x AS l JOIN x AS r ON l.rid = r.rid AND l.w = r.w AND l.i < r.i),
g AS (SELECT rid, p, min(i) AS s, count(*) + p AS len FROM (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM e) GROUP BY rid, p, k HAVING count(*) >= greatest(p, 12 - p)),
r AS MATERIALIZED (SELECT rid, s, len, min(p) AS p FROM g GROUP BY rid, s, len),
o AS (SELECT DISTINCT rid, unnest(range(s + p, s + len)) AS i FROM r),
c AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN o USING (rid, i) GROUP BY rid),
m AS (SELECT rid, CAST(count(*) AS BIGINT) AS n, min({'l': -len, 's': s, 'p': p}) AS b, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM r GROUP BY rid)
SELECT doc_id, coalesce(m.n, 0) AS n_runs, b.s AS start, -b.l AS length, b.p AS period, -1000 * b.l // b.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN m ON m.rid = t.rid LEFT JOIN c ON c.rid = t.rid
""",
    "op3_tool_call_links": r"""
WITH c AS (SELECT conv_id, turn, 'reply-' || turn AS call_id, text,
                  row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * n ORDER BY turn) - 1 AS BIGINT) AS level FROM c),
r AS (SELECT conv_id, turn, 'reply-' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'assistant'),
a AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, coalesce(l.call_id, r.call_id) AS call_id, level, l.text, result,
             CASE WHEN l.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
      FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.call_id = r.call_id)
SELECT conv_id, turn, call_id, level, status, '' AS errors,
       '{"arguments":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}' END
       || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
       || ',"name":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '"reply"' END
       || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json FROM a
""",
    "op5_rule_ledger": _LEDGER
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS INT) AS fail_bits FROM b
""",
    "rule_ablation": _LEDGER
    + """, r AS (SELECT unnest(['few_words', 'repetition', 'symbols', 'repeated_lines', 'word_length']) AS rule, unnest([1, 2, 4, 8, 16]) AS bit)
SELECT rule, CAST(count(*) FILTER (WHERE fail_bits & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE fail_bits = bit) AS BIGINT) AS removed_by_it_alone,
       CAST(count(*) FILTER (WHERE fail_bits & ~bit = 0) AS BIGINT) AS kept_without_it FROM b CROSS JOIN r GROUP BY rule
""",
    "op6_benchmark_containment": r"""
WITH n AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, rid, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS ws FROM n),
g AS (SELECT DISTINCT side, id, rid, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM w)),
s AS (SELECT id, rid, g, count(*) OVER (PARTITION BY rid) AS n FROM g WHERE side = 'i')
SELECT d.id AS doc_id, s.id AS item_id, round(count(*) / max(s.n), 6) AS containment
FROM g AS d JOIN s ON d.g = s.g WHERE d.side = 'd' GROUP BY d.id, d.rid, s.id, s.rid HAVING count(*) >= 0.8 * max(s.n)
""",
    "op8_warc_zstd": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM f
""",
}
