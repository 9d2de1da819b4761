"""The registered queries of the operators; each reads its whole table with production parameters."""

from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(slug):
    def keep(fn):
        QUERIES[slug] = fn
        return fn

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks():
    """The packing tokenizer's vocabulary as a rank file, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_token_counts")
def op1(spark, sf_dir):
    from plotlink.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    from plotlink.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op3_packing")
def op3(spark, sf_dir):
    from plotlink.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), ranks=ranks())


@query("op4_language_id")
def op4(spark, sf_dir):
    from plotlink.llm.language_id import language_id

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    out = language_id(docs, docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query("op5_decontaminate")
def op5(spark, sf_dir):
    from plotlink.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_quality_rules")
def op6(spark, sf_dir):
    from plotlink.llm.quality_rules import quality

    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed").alias("rules_failed"))


@query("op7_line_templates")
def op7(spark, sf_dir):
    from plotlink.llm.line_templates import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query("op8_secret_ledger")
def op8(spark, sf_dir):
    from plotlink.llm import secret_ledger as s

    versions = s.versioned(table(spark, sf_dir, "documents"))
    return s.digest(s.findings(versions, spark.read.parquet(s.extended(versions, None))))


@query("op9_jaccard_join")
def op9(spark, sf_dir):
    from plotlink.llm.jaccard_tree import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op10_chat_format")
def op10(spark, sf_dir):
    from plotlink.llm import chat_format as c

    extra = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
                         AS t(conv_id, turn, role, text)""")
    return c.digests(c.examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


@query("op11_filter_audit")
def op11(spark, sf_dir):
    from plotlink.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_whitening")
def op12(spark, sf_dir):
    from plotlink.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op13_quality_votes")
def op13(spark, sf_dir):
    from plotlink.llm.quality_votes import quality_votes

    held_out = lambda: F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # held-out rows keep their labels to themselves
    out = quality_votes(docs, docs.filter(~held_out()), labels.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i AS st, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w)),
ranked AS (SELECT doc_id, st, row_number() OVER (PARTITION BY h ORDER BY doc_id, st) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(st, st + 19)) AS p FROM ranked WHERE rn > 1),
each AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS c FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def _sets(table_name, key, k):
    """Distinct k-word shingles, A-Z in lower case; a shorter sequence is one."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT DISTINCT {key}, array_to_string(ws[i:i + {k} - 1], ' ') AS g FROM (
        SELECT {key}, ws, unnest(generate_series(1, greatest(len(ws) - {k} + 1, 1))) AS i
        FROM (SELECT {key}, {_WORDS.replace("coalesce(text, '')", lower)} AS ws FROM {table_name}) WHERE len(ws) > 0)"""


def _exact_sets(table_name, key, n):
    """Distinct sequences of n words, of the rows that have as many."""
    return f"SELECT * FROM ({_sets(table_name, key, n)}) WHERE len(string_split(g, ' ')) = {n}"


_SHORTER = " UNION ".join(f"SELECT * FROM ({_exact_sets('documents', 'doc_id', n)}) WHERE {n} IN (SELECT len(string_split(g, ' ')) FROM b)" for n in range(1, 5))

SQL["op5_decontaminate"] = f"""
WITH b AS MATERIALIZED ({_sets('benchmark', 'item_id', 5)}), d AS ({_sets('documents', 'doc_id', 5)} UNION {_SHORTER}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item FROM met JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""


def _spans_sql():
    from plotlink.llm.secret_ledger import RULES

    one = """SELECT doc_id, {order} AS r, '{kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS st, length(m[i]) AS len
        FROM (SELECT doc_id, g, m, v, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, string_split_regex(text, '{p}') AS g,
              regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM t)) WHERE length(v[i]) >= {least}"""
    return " UNION ALL ".join(one.format(order=i, kind=r.kind, p=r.pattern.replace("'", "''"), group=r.group, least=r.least) for i, r in enumerate(RULES))


SQL["op8_secret_ledger"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({_spans_sql()}),
a AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
      string_agg(kind || ':' || st || ':' || (st + len), ',' ORDER BY st, r) FILTER (r < 3) AS base, string_agg(kind || ':' || st || ':' || (st + len), ',' ORDER BY st, r) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM t LEFT JOIN a USING (doc_id)"""

SQL["op9_jaccard_join"] = f"""
WITH RECURSIVE d AS MATERIALIZED ({_sets('documents', 'doc_id', 4)}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT a AS doc_id, a AS node FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_node, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS least_node FROM reach GROUP BY doc_id) USING (doc_id)"""


def _escaped_sql(x):
    for pattern, to in (("&(amp;|lt;|#91;|#10;)", r"&amp;\1"), ("<(/?s>)", r"&lt;\1"), (r"\[(/?INST\])", r"&#91;\1")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


SQL["op10_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS last,
      length({_escaped_sql('text')}) + length(replace({_escaped_sql('role')}, chr(10), '&#10;')) + 8 AS size FROM c),
r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = last))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""

SQL["op11_filter_audit"] = f"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END) AS fails FROM w),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a JOIN one b ON b.x <> a.x JOIN one c ON c.x NOT IN (a.x, b.x)
           JOIN one d ON d.x NOT IN (a.x, b.x, c.x) JOIN one e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, i::INT AS step, filter_order[i] AS letter, filter_order[1:i - 1] AS earlier FROM orders, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone, fails = letter AS alone FROM s, m),
a AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a"""
