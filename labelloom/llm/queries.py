"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bloom_lm, chat, decontaminate, exact_dedup, fuzzy_lines, jaccard_join, licenses, mil_quality, raking, repair_dawg, simhash_tiles, token_alignment, warc
from labelloom.llm.common import id_crc, materialize, table
from labelloom.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def is_past(docs: DataFrame):
    """Half of all documents stand for those seen before."""
    return id_crc(docs["doc_id"]) % 2 == 0


@query("op4_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.deduplicate(docs, is_past(docs))


@query("op9_ngram_jaccard_join", r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    links AS (
      SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x
                        JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
      JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
      WHERE 100 * common >= 75 * (p.n + q.n - common)),
    reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN sizes s USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id)""")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> mil_quality.AttentionModel:
    """Fitted on ``docs`` without the third that is held out."""
    labels = table(spark, sf_dir, "labels")
    return mil_quality.fit(docs, labels.where(id_crc("doc_id") % 3 != 1))


@query("op10_attention_quality")
def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = mil_quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_spaced_seed_decontamination", r"""
    WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                         lambda x : x <> '') AS w FROM documents),
    items AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                     lambda x : x <> '') AS v FROM benchmark),
    dw AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs),
    iw AS (SELECT item_id, unnest(v) AS t, generate_subscripts(v, 1) AS q FROM items),
    diagonals AS (SELECT doc_id, item_id, p - q AS d, list(q) AS qs FROM dw JOIN iw USING (t)
                  GROUP BY ALL HAVING count(*) >= 6),
    hits AS (
      SELECT doc_id, item_id, d FROM (SELECT *, unnest(qs) AS q FROM diagonals)
      WHERE list_has_all(qs, [q, q + 1, q + 2, q + 4, q + 5, q + 6])
         OR list_has_all(qs, [q, q + 1, q + 3, q + 4, q + 6, q + 7]) GROUP BY ALL),
    steps AS (
      SELECT doc_id, item_id, d, len(v) AS n, q, CASE WHEN v[q] = w[q + d] THEN 1 ELSE -1 END AS gain
      FROM (SELECT *, unnest(range(greatest(1, 1 - d), least(len(v), len(w) - d) + 1)) AS q
            FROM hits JOIN docs USING (doc_id) JOIN items USING (item_id))),
    sums AS (SELECT *, sum(gain) OVER (PARTITION BY doc_id, item_id, d ORDER BY q) AS s FROM steps),
    runs AS (SELECT doc_id, item_id, n, s - least(0, coalesce(min(s) OVER (
               PARTITION BY doc_id, item_id, d ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run
             FROM sums),
    found AS (SELECT doc_id, item_id, max(run) AS score FROM runs GROUP BY doc_id, item_id, n
              HAVING max(run) >= least(10, ceil(0.8 * n)))
    SELECT doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items,
           coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS items,
           CAST(coalesce(max(score), 0) AS BIGINT) AS score
    FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id""")
def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Sources closer to each other than they are, languages a little, topics equal; half of all tokens.
MIX_TARGETS = {"source": raking.tempered(0.5), "lang": raking.tempered(0.8), "topic": raking.tempered(0.0)}
MIX_FRACTION = 0.5


@query("op5_raked_mixture")
def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(raking.described(table(spark, sf_dir, "documents")), "mixture-documents")
    return raking.sample_mixture(docs, MIX_TARGETS, MIX_FRACTION)


CONTROL_TALK = """SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
                  (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"""


@query("op7_prefix_target_chat", r"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                      (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    pieces AS (
      SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]|ROLE))', '\1\\\2', 'g'))
             + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 ELSE length(url_encode(role)) + 14 END AS size
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    sums AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM pieces)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(so_far) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
    FROM sums GROUP BY conv_id""")
def op7_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.expand(talks.union(spark.sql(CONTROL_TALK))))


@query("op2_warc_archive", """
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
            (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
                 CAST(('0x' || substr(sha1(coalesce(html, '')), CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT)
                 >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest
          FROM pages)""")
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_dir(spark, "warc")
    warc.write_archive(pages, path)
    read = warc.read_archive(spark, path).where("last")
    return read.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


@query("op8_fuzzy_lines")
def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.judge_lines(table(spark, sf_dir, "documents"))


@query("op3_bloom_filter_lm")
def op3_bloom_filter_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"), id_crc("doc_id") % 7 == 2)


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    sure = F.filter("found", lambda f: f["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform(sure, lambda f: f["probability"])), F.lit(0.0)).alias("probability"))


@query("op13_simhash_tiles")
def op13_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.similar_classes(table(spark, sf_dir, "documents"))


@query("op12_repair_dawg", r"""
    WITH RECURSIVE crc_table AS (
      SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda c, x : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
      FROM range(256) r(n)),
    keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    kinds AS (
      SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x : ascii(x))),
                    lambda c, b : xor(c >> 8, t[CAST(1 + (xor(c, b) & 255) AS BIGINT)]))) % 20 AS kind FROM keyed, crc_table),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
    placed AS (
      SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before
      FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    faults AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
    found AS (
      SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
             list(struct_pack(i := left(role, 1), f := fault) ORDER BY pos DESC) AS turns
      FROM faults GROUP BY conv_id),
    costs AS (  -- best[1..4]: cheapest edits of the turns so far, from the end, after nothing, s, u and a
      SELECT conv_id, turns, 0 AS k, [struct_pack(c := 0, e := ''), struct_pack(c := 4, e := 'II'),
                                      struct_pack(c := 2, e := 'I'), struct_pack(c := 0, e := '')] AS best FROM found
      UNION ALL
      SELECT conv_id, turns, k + 1, list_transform([1, 2, 3, 4], lambda s : list_min([
               own[s], struct_pack(c := own[[3, 3, 4, 3][s]].c + 2, e := 'I' || own[[3, 3, 4, 3][s]].e),
               struct_pack(c := own[[4, 4, 3, 4][s]].c + 4, e := 'II' || own[[4, 4, 3, 4][s]].e)]))
      FROM (SELECT conv_id, turns, k, list_transform([1, 2, 3, 4], lambda s : list_min([
                     struct_pack(c := best[s].c + 3, e := 'D' || best[s].e),
                     struct_pack(c := best[[3, 3, 4, 3][s]].c + 2 + extra, e := 'R' || best[[3, 3, 4, 3][s]].e),
                     struct_pack(c := CASE WHEN turns[k + 1].i = ['u', 'u', 'a', 'u'][s] THEN best[[3, 3, 4, 3][s]].c + extra
                                           WHEN turns[k + 1].i = 's' AND s = 1 THEN best[2].c + extra ELSE 1000000 END,
                                 e := 'K' || CASE WHEN turns[k + 1].i = 's' THEN best[2].e ELSE best[[3, 3, 4, 3][s]].e END)])) AS own
            FROM (SELECT *, CASE turns[k + 1].f WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 1000000 END AS extra FROM costs)
            WHERE k < len(turns))),
    audits AS (SELECT conv_id, best[1].c AS cost, best[1].e AS audit FROM costs WHERE k = len(turns)),
    letters AS (
      SELECT conv_id, k, audit[k] AS letter, len(replace(audit[1:k], 'I', '')) AS pos, len(replace(audit[1:k], 'D', '')) AS made
      FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS k FROM audits)),
    kept AS (
      SELECT a.conv_id, k, made, letter, role, text,
             max(letter = 'K' AND made = 1 AND left(role, 1) = 's') OVER (PARTITION BY a.conv_id) AS led
      FROM letters a LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.pos = a.pos AND letter <> 'I'
      WHERE letter <> 'D'),
    repaired AS (
      SELECT conv_id, count(*) AS turns, sha256(string_agg(CASE letter WHEN 'K' THEN role
               ELSE CASE WHEN (made % 2 = 1) = coalesce(led, false) THEN 'assistant' ELSE 'user' END END || ':' ||
             CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS repaired_sha256 FROM kept GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, coalesce(r.turns, 0) AS turns, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12_repair_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair_dawg.repair_report(repair_dawg.plan_repair(repair_dawg.damage(talks), talks.select("conv_id")))


TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), TOKENIZER_A, TOKENIZER_B).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
