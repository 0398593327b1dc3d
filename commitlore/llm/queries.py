"""The queries of the text operators, each over its whole table, with SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from commitlore.llm import bpe, chat, contamination, fingerprint, langid, lm, mixing, near_dup, packing, passages, repair, toxicity, trie
from commitlore.llm.common import fold, table
from commitlore.session import stage

QUERIES: dict = {}
SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_source_mix(spark, sf_dir):
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL["op1_source_mix"] = r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS tie FROM documents
),
sources AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY 1)
),
ratios AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM sources),
levels AS (
  SELECT *, (words - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM ratios
  WINDOW before AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT source, source_size, least(cap, coalesce(max(level) FILTER (ratio >= level) OVER () * weight, cap)) AS target FROM levels
),
placed AS (
  SELECT k.*, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) END::BIGINT AS taken
FROM placed"""


@query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, fold("doc_id", 3) != 1)
    found = langid.languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = toxicity.toxic_scores(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


@query
def op4_packed_rows(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_lm_scores(spark, sf_dir):
    part = fold("doc_id", 5)
    role = F.when(part == 1, lm.SCORED).when(part == 0, lm.MIXTURE).otherwise(lm.MAIN)
    scored = lm.model_scores(table(spark, sf_dir, "documents").select("doc_id", "text", role.alias("role")))
    return scored.select("doc_id", (F.col("role") == lm.SCORED).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_chat_format(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    rows = chat.rows_to_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(probe).alias("prompt"), F.lit(probe).alias("response"))).alias("record"))
    chats = rows.unionByName(chat.canonical(own).select("conv_id", "layout", "turns"))
    chats = chat.read_back(chat.formatted(chats).select("conv_id", "layout", "formatted", "loss_spans"))
    said = F.array_join("loss_texts", "")
    lines = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op6_chat_format"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
    + len(regexp_extract_all(text, '<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<s>|</s>|\\[/?INST\\]|<</?SYS>>')) AS written FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written + length(role) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query
def op7_fingerprints(spark, sf_dir):
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


@query
def op8_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_contamination(spark, sf_dir):
    found = contamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contamination.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


SQL["op9_contamination"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
),
item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
item_windows AS (
  SELECT DISTINCT item, list_slice(w, i, i + 12) AS win, least(13, len(w)) AS n
  FROM item_words, unnest(range(1, greatest(2, len(w) - 11))) t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM words, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) t(i)
),
hits AS (SELECT d.doc_id, d.i, d.n, x.item FROM doc_windows d JOIN item_windows x ON d.n = x.n AND d.win = x.win),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) t(k) GROUP BY 1),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@query
def op10_repeated_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op13_byte_pairs(spark, sf_dir):
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """crc32 of a text of ASCII characters, in SQL."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    signs = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {signs}), lambda c, b: {bits}), 4294967295)"


def _plus(cost, initial: str, rest: str) -> str:
    """SQL for a cost in eight digits and edits' initials, one edit longer at the front: texts of this form sort by cost, then initials."""
    return f"lpad((left({rest}, 8)::INT + {cost})::VARCHAR, 8, '0') || '{initial}' || substr({rest}, 9)"


@query
def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.conversation_audits(repair.damaged(rows), rows)


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("key")} % 20 AS damage
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, unnest(range(0, CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, left(role, 1) AS r FROM hurt),
ended AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e
  FROM seen
),
told AS (
  SELECT conv_id, turn, role, text, i, r, count(*) OVER (PARTITION BY conv_id) AS n, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS r_before,
         CASE WHEN e = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ended
),
found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (r_before IS NOT NULL AND r_before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY 1
),
best(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, '00000000', '00000010II', '00000005I', '00000000' FROM (SELECT DISTINCT conv_id, n FROM told)
  UNION ALL
  SELECT conv_id, i, least(b0, {_plus(5, "I", "v2")}), least(b1, {_plus(5, "I", "v2")}), v2, v3 FROM (
    SELECT conv_id, i, b0, b1, least(b2, {_plus(5, "I", "b3")}) AS v2, least(b3, {_plus(5, "I", "b2")}) AS v3 FROM (
      SELECT t.conv_id, t.i,
             least({_plus(2, "D", "v0")}, CASE WHEN stays AND r = 's' THEN {_plus("extra", "K", "v1")} WHEN stays AND r = 'u' THEN {_plus("extra", "K", "v2")} END,
                   CASE WHEN stays THEN {_plus("extra + 1", "R", "v2")} END) AS b0,
             least({_plus(2, "D", "v1")}, CASE WHEN stays AND r = 'u' THEN {_plus("extra", "K", "v2")} END, CASE WHEN stays THEN {_plus("extra + 1", "R", "v2")} END) AS b1,
             least({_plus(2, "D", "v2")}, CASE WHEN stays AND r = 'a' THEN {_plus("extra", "K", "v3")} END, CASE WHEN stays THEN {_plus("extra + 1", "R", "v3")} END) AS b2,
             least({_plus(2, "D", "v3")}, CASE WHEN stays AND r = 'u' THEN {_plus("extra", "K", "v2")} END, CASE WHEN stays THEN {_plus("extra + 1", "R", "v2")} END) AS b3
      FROM best b JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM told) t
        ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1))
),
chosen AS (SELECT conv_id, left(v0, 8)::BIGINT AS cost, substr(v0, 9) AS audit FROM best WHERE i = 1),
edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS place
  FROM chosen, unnest(range(1, length(audit) + 1)) u(k)
),
given AS (
  SELECT e.*, t.role, CASE WHEN edit = 'I' THEN '' ELSE t.text END AS text,
         max(CASE WHEN place = 1 AND edit = 'K' AND t.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS first
  FROM edits e LEFT JOIN told t ON e.edit <> 'I' AND t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i WHERE edit <> 'D'
),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - first) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole
  FROM given GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query
def op11_prefix_trie(spark, sf_dir):
    turns = stage(trie.turn_digests(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(trie.rebuilt(turns))


SQL["op11_prefix_trie"] = rf"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
turns AS (SELECT conv_id, t, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS nth FROM told),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM told)),
rebuilt AS (
  SELECT i.conv_id, nth, t, words FROM ids i JOIN turns r ON r.conv_id = i.base AND nth <= h
  UNION ALL SELECT i.conv_id, nth, t, words FROM ids i JOIN turns r ON r.conv_id = i.conv_id AND nth > h
),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, words, string_agg(t, '') OVER w AS node, string_agg(t, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM ids
),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, CASE WHEN min(depth) > 0 THEN coalesce(min(parent), '') END AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved
  FROM paths GROUP BY 1
),
children AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT p.node, sum(CASE WHEN c.parent IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens
  FROM nodes u LEFT JOIN children c ON c.parent = u.node JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY 1
),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, node FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY 1
)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (node) LEFT JOIN children c ON c.parent = n.node LEFT JOIN nodes q ON q.node = n.parent LEFT JOIN ends e ON e.node = n.node"""
