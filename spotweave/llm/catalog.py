"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import chat_format, decontamination, jaccard_join, language_id, license_scan, line_dedup, merkle, nearest, sentence_pieces, simhash, token_counts, turn_repair, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the rows whose crc32 of the id, modulo 3, is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language_id.fit(docs.where(~held))
    found = language_id.identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.count_tokens(docs, BYTE_BPE)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written and read back."""
    manifest = warc.write_archives(warc.decide_types(table(spark, sf_dir, "pages")))
    records = warc.read_archives(spark, manifest)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentence_pieces.encode_and_decode(docs, PIECE_BPE)
    same = F.col("decoded").eqNullSafe(F.regexp_replace("text", sentence_pieces.MARK, " "))
    return found.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.length("decoded").cast("long").alias("n_chars"), same.alias("round_trip"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and masked completions of all conversations with an assistant turn."""
    pairs = chat_format.preference_pairs(table(spark, sf_dir, "conversations"))
    found = chat_format.format_preferences(pairs)
    return found.select("conv_id", "n_prompt_turns", "prompt", "chosen_text", F.array_join("chosen_mask", ",").alias("chosen_mask"), "rejected_text", F.array_join("rejected_mask", ",").alias("rejected_mask"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on many sites."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 3-word shingles are similar by 0.9 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar_groups(docs, words=3, num=90, den=100).withColumnRenamed("id", "doc_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat("base_found", F.transform("matches", lambda m: m["label"]))))
    score = F.array_max(F.transform("matches", lambda m: m["score"]))
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"), F.array_max("base_starts").alias("last_word"),
        F.array_join("base_found", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(score, F.when(F.size("base_starts") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontamination.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(F.length(F.regexp_replace(F.hex("hit_words"), "0", "")), F.lit(0)).cast("long")
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each row of the embeddings whose id is divisible by 50."""
    return nearest.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, and roots folded from rows with line feeds taken out where the id's crc32 is even."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(docs, changed={"text": F.translate("text", "\n", "")}, where=even)
    return found.withColumnRenamed("id", "doc_id")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repairs of all conversations after damage to some of their rows."""
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints of 4-word shingles differ in 4 bits or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.similar_groups(docs).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_warc, op4_sentence_pieces, op5_chat_format, op6_line_dedup, op7_jaccard_join, op8_license_scan, op9_decontamination, op10_nearest, op11_merkle, op12_turn_repair, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op5_chat_format": OP5, "op6_line_dedup": OP6, "op7_jaccard_join": OP7, "op9_decontamination": OP9, "op11_merkle": OP11, "op12_turn_repair": OP12}


OP3 = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
hashed AS (SELECT page_id, octet_length(data) AS size, sha1(data) AS hex FROM rows),
low AS (SELECT *, min(page_id) OVER (PARTITION BY hex, size) AS first FROM hashed),
coded AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    list_sum(list_transform(range(0, 5), lambda b:
      ((strpos('0123456789abcdef', substr(hex, CAST((5 * i + b) // 4 + 1 AS INTEGER), 1)) - 1) // CAST(2 ** (3 - (5 * i + b) % 4) AS INTEGER)) % 2 * CAST(2 ** (4 - b) AS INTEGER))) + 1 AS INTEGER), 1)), 'string_agg', '') AS digest FROM low)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM coded
"""

OP5 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
cut AS (SELECT conv_id, turns[1:list_max(list_transform(turns, lambda x, i: CASE WHEN x.role = 'assistant' THEN i ELSE 0 END))] AS chosen FROM last
  WHERE list_contains(list_transform(turns, lambda x: x.role), 'assistant')),
paired AS (SELECT a.conv_id, a.chosen, list_concat(a.chosen[1:len(a.chosen) - 1], [{'role': 'assistant', 'text': coalesce(b.chosen[len(b.chosen)].text, '')}]) AS rejected
  FROM cut a LEFT JOIN cut b ON b.conv_id = xor(a.conv_id, 1)),
n AS (SELECT *, coalesce(list_min(list_filter(list_transform(chosen, lambda x, i: CASE WHEN x = rejected[i] THEN 1000000 ELSE i - 1 END), lambda v: v < 1000000)), len(chosen)) AS same FROM paired),
parts AS (SELECT conv_id, same, chosen[1:same] AS p, chosen[same + 1:] AS c, rejected[same + 1:] AS r FROM n)
SELECT conv_id, CAST(same AS BIGINT) AS n_prompt_turns,
  array_to_string(list_transform(p, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(c, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS chosen_text,
  array_to_string(list_filter(list_transform(c, lambda x, i: CASE WHEN x.role = 'assistant' THEN
    CAST(coalesce(list_sum(list_transform(c[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 13 + length(x.role) AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(c[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 23 + length(x.role) + length(x.text) AS BIGINT) END), lambda v: v IS NOT NULL), ',') AS chosen_mask,
  array_to_string(list_transform(r, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS rejected_text,
  array_to_string(list_filter(list_transform(r, lambda x, i: CASE WHEN x.role = 'assistant' THEN
    CAST(coalesce(list_sum(list_transform(r[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 13 + length(x.role) AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(r[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 23 + length(x.role) + length(x.text) AS BIGINT) END), lambda v: v IS NOT NULL), ',') AS rejected_mask
FROM parts
"""

OP6 = """
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
bad AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 10),
kept AS (SELECT l.doc_id, count(*) FILTER (l.line <> '') AS n_lines, count(bad.line) AS n_removed, string_agg(CASE WHEN bad.line IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN bad ON l.line = bad.line GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.s, dw.size, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items.ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items.ids, ','), '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * same >= 90 * (na.n + nb.n - same)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM ends UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.other = ends.a),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.doc_id = w.doc_id
"""

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: crc32 of a text without characters beyond ASCII: each byte into the register, then eight shifts.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({0}) + 1), lambda k: CAST(ascii(substr({0}, k, 1)) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

OP11 = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("replace(text, chr(10), '')")} AS now, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS even FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaves),
tree AS (SELECT source, 0 AS level, place, size, leaf AS h FROM numbered
  UNION ALL SELECT source, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM tree WHERE size > 1 GROUP BY source, level, place // 3, size),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM tree WHERE size = 1),
top AS (SELECT 0 AS level, place, size, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE size > 1 GROUP BY level, place // 3, size),
sides AS (SELECT source, level, place, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE size > 1 WINDOW w AS (PARTITION BY source, level, place // 3 ORDER BY place)),
top_sides AS (SELECT level, place, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE size > 1 WINDOW w AS (PARTITION BY level, place // 3 ORDER BY place)),
folded AS (SELECT doc_id, source, leaf, 0 AS level, place, CASE WHEN even THEN now ELSE leaf END AS h, '' AS way FROM numbered
  UNION ALL SELECT f.doc_id, f.source, f.leaf, f.level + 1, f.place // 3, sha256(s.l || f.h || s.r), f.way || s.l || s.r FROM folded f JOIN sides s ON s.source IS NOT DISTINCT FROM f.source AND s.level = f.level AND s.place = f.place),
at_top AS (SELECT f.doc_id, f.leaf, s.subroot, 0 AS level, s.place, f.h, f.way FROM (SELECT * FROM folded QUALIFY level = max(level) OVER (PARTITION BY source)) f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source),
rooted AS (SELECT * FROM at_top
  UNION ALL SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.place // 3, sha256(s.l || f.h || s.r), f.way || s.l || s.r FROM rooted f JOIN top_sides s ON s.level = f.level AND s.place = f.place)
SELECT f.doc_id, f.leaf, f.subroot, t.h AS root, sha256(f.way) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM rooted f JOIN (SELECT h, level FROM top WHERE size = 1) t ON f.level = t.level
"""

#: Damage; faults; then the least (cost, audit) of each state after each row: any insertions, then the row's own edit. States: 0 nothing
#: yet, 1 after s, 2 after u, 3 after a. Audits of one conversation and state that cost the same never begin with each other.
OP12 = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
f AS (SELECT *, {_CRC.format("name")} % 20 AS fate FROM r),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(0, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
j AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id),
heads AS (SELECT ids.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM ids LEFT JOIN sums ON ids.conv_id IS NOT DISTINCT FROM sums.conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')) AS v(p, q, cost, letters)),
edit AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(p, c, q)),
turned AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) AS v(p, q)),
steps AS (SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS letter FROM j, turned
  UNION ALL SELECT j.conv_id, i, p, q, CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'K' FROM j JOIN edit ON edit.c = j.c WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 't' THEN 6 ELSE 3 END, 'R' FROM j, turned WHERE fault NOT IN ('b', 'd')),
ways AS (SELECT s.conv_id, s.i, ins.p, s.q, s.cost + ins.cost AS cost, ins.letters || s.letter AS letters FROM steps s JOIN ins ON ins.q = s.p),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, struct_pack(cost := 0, audit := '') AS b FROM heads
  UNION ALL SELECT b.conv_id, b.i + 1, w.q, min(struct_pack(cost := b.b.cost + w.cost, audit := b.b.audit || w.letters)) FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.p = b.q GROUP BY b.conv_id, b.i, w.q),
done AS (SELECT b.conv_id, min(struct_pack(cost := b.b.cost + ins.cost, audit := b.b.audit || ins.letters)) AS b FROM best b JOIN heads h ON h.conv_id IS NOT DISTINCT FROM b.conv_id AND h.n = b.i JOIN ins ON ins.p = b.q AND ins.q IN (0, 3) GROUP BY b.conv_id),
letters AS (SELECT conv_id, k, substr(audit, k, 1) AS l, length(replace(substr(audit, 1, k), 'I', '')) AS i, length(replace(substr(audit, 1, k), 'D', '')) AS line
  FROM (SELECT conv_id, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS k FROM done)),
lines AS (SELECT l.conv_id, l.k, l.line, l.l, j.role, j.text, max(CASE WHEN l.l = 'K' AND l.line = 1 AND j.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM letters l LEFT JOIN j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i WHERE l.l <> 'D'),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (line - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS digest FROM lines GROUP BY conv_id)
SELECT h.conv_id, h.gaps, h.blank, h.duplicate, h.truncated, h.illegal, CAST(done.b.cost AS BIGINT) AS cost, done.b.audit AS audit, coalesce(fixed.digest, sha256('')) AS repaired_sha256
FROM heads h JOIN done ON done.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM h.conv_id
"""
