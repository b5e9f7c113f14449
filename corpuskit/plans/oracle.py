"""DuckDB SQL equal to each registered query (the correctness oracle).

Regexes are the same strings as on the Spark side (RE2 and Java agree on
them).  DuckDB's ``'\\1'`` replaces Java's ``$1``.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.lexicon import DERIVED_TYPES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


TOKEN = lit(P.TOKEN)

# --- shared CTEs ------------------------------------------------------------------

LINES = f"""
lines_raw AS (
  SELECT doc_id, lang, source, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS line_no
  FROM (SELECT doc_id, lang, source, string_split_regex(text, {lit(P.LINE_BREAK)}) AS parts FROM documents)),
lines AS (
  SELECT * FROM lines_raw
  WHERE NOT regexp_matches(text, {lit(P.BLANK_LINE)})
    AND NOT starts_with(text, '<doc id=') AND NOT ends_with(text, '</doc>'))"""

SENTS = LINES + f""",
sents_raw AS (
  SELECT doc_id, lang, source, line_no, unnest(parts) AS sent0, generate_subscripts(parts, 1) - 1 AS sent_no
  FROM (SELECT doc_id, lang, source, line_no,
               string_split(regexp_replace(text, {lit(P.SENTENCE_BOUNDARY)}, '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS parts
        FROM lines)),
sents_all AS (SELECT doc_id, lang, source, line_no, sent_no, trim(sent0) AS sent FROM sents_raw),
sents AS (SELECT * FROM sents_all WHERE sent <> '' AND contains(sent, ' '))"""

TOKS = SENTS + f""",
toks AS (
  SELECT doc_id, lang, line_no, sent_no, unnest(tl) AS token, generate_subscripts(tl, 1) - 1 AS tok_no
  FROM (SELECT doc_id, lang, line_no, sent_no, regexp_extract_all(lower(sent), {TOKEN}) AS tl FROM sents)),
words AS (
  SELECT token AS w, count(*)::BIGINT AS f FROM toks
  WHERE token NOT IN {in_list(P.SPECIAL_TOKENS)} GROUP BY token)"""

_types = "[" + ", ".join(lit(t) for t in DERIVED_TYPES) + "]"
LEX = f"""
lex_words AS (
  SELECT DISTINCT w FROM (
    SELECT unnest(regexp_extract_all(lower(text), {lit(P.LETTER_RUN)})) AS w FROM documents WHERE lang = 'de')
  WHERE length(w) BETWEEN 2 AND 6),
lex_h AS (SELECT w, ('0x' || substr(md5(w), 1, 7))::BIGINT AS h FROM lex_words),
lex AS (
  SELECT CASE WHEN h % 7 = 0 THEN '1. ' || w
              WHEN h % 5 = 0 AND substr(w, 1, 1) <> 'ß' THEN upper(substr(w, 1, 1)) || substr(w, 2)
              ELSE w END AS base,
         CASE WHEN h % 3 = 0 THEN w || 'e'
              WHEN h % 11 = 0 THEN '2. ' || w || 's'
              ELSE w END AS word,
         {_types}[(h % 6) + 1] AS type
  FROM lex_h),
lex_exploded AS (SELECT base, word, unnest(string_split(type, ',')) AS type FROM lex),
nouns AS (
  SELECT * FROM lex_exploded
  WHERE type IN {in_list(P.NOUN_TYPES)} AND (word IS NULL OR word NOT IN {in_list(P.BANNED_WORDS)})),
small_all AS (
  SELECT DISTINCT lower(regexp_replace(base, {lit(P.HOMOGRAPH_NUMBER)}, '', 'g')) AS word FROM nouns),
small_list AS (
  SELECT word, length(word)::BIGINT AS length FROM small_all
  WHERE word IS NOT NULL AND NOT contains(word, ' ') AND length(word) > 1),
full_all AS (
  SELECT DISTINCT lower(regexp_replace(word, {lit(P.HOMOGRAPH_NUMBER)}, '', 'g')) AS word FROM nouns),
full_list AS (
  SELECT word, length(word)::BIGINT AS length FROM full_all
  WHERE word IS NOT NULL AND NOT contains(word, ' ') AND length(word) > 1),
dicts AS (
  SELECT word, length, 'small' AS kind FROM small_list WHERE length < (SELECT max(length) FROM small_list)
  UNION ALL
  SELECT word, length, 'full' AS kind FROM full_list WHERE length < (SELECT max(length) FROM full_list))"""

_ifx = in_list(P.DEFAULT_INTERFIXES)
# Compound split: enumerate every valid cut list by recursion over the edges,
# then take the lexicographic minimum with a large sentinel appended.
SPLITS = TOKS + "," + LEX + f""",
cand AS (
  SELECT w, p FROM (SELECT w, unnest(range(1, length(w) - 1)) AS p FROM words WHERE length(w) >= 3)
  WHERE substr(w, p + 1, 1) IN {_ifx}),
edges AS (
  SELECT w, j, p FROM (
    SELECT w, p, unnest(range(greatest(0, p - (SELECT max(length) FROM dicts WHERE kind = 'small')), p)) AS j FROM cand)
  WHERE substr(w, j + 1, p - j) IN (SELECT word FROM dicts WHERE kind = 'small')),
terms AS (
  SELECT w, p + 1 AS t FROM cand
  WHERE substr(w, p + 2) IN (SELECT word FROM dicts WHERE kind = 'full')),
paths(w, pos, cuts) AS (
  SELECT DISTINCT w, 0, []::INTEGER[] FROM edges WHERE j = 0
  UNION ALL
  SELECT e.w, e.p + 1, list_append(paths.cuts, e.p::INTEGER)
  FROM paths JOIN edges e ON e.w = paths.w AND e.j = paths.pos),
complete AS (
  SELECT paths.w, list_append(paths.cuts, 1000000) AS key
  FROM paths JOIN terms ON terms.w = paths.w AND terms.t = paths.pos
  WHERE len(paths.cuts) > 0),
best AS (SELECT w, min(key) AS key FROM complete GROUP BY w),
splits AS (SELECT w, list_slice(key, 1, len(key) - 1) AS cuts FROM best),
split_parts AS (
  SELECT w, cuts, flatten(list_transform(range(0, len(cuts) + 1), lambda i:
           CASE WHEN i < len(cuts)
                THEN [substr(w, (CASE WHEN i = 0 THEN 0 ELSE cuts[i] + 1 END) + 1,
                             cuts[i + 1] - (CASE WHEN i = 0 THEN 0 ELSE cuts[i] + 1 END)),
                      substr(w, cuts[i + 1] + 1, 1)]
                ELSE [substr(w, (CASE WHEN i = 0 THEN 0 ELSE cuts[i] + 1 END) + 1)] END)) AS parts
  FROM splits)"""

SPLIT_ROWS = SENTS + """,
split_keyed AS (
  SELECT doc_id, line_no, sent_no, sent, md5('4242:' || doc_id || ':' || line_no || ':' || sent_no) AS k FROM sents),
split_ranked AS (
  SELECT *, row_number() OVER (ORDER BY k, doc_id, line_no, sent_no) AS r,
         floor(0.99 * count(*) OVER ())::BIGINT AS n_train FROM split_keyed),
split_rows AS (
  SELECT doc_id, line_no::BIGINT AS line_no, sent_no::BIGINT AS sent_no, sent,
         CASE WHEN r <= n_train THEN 'train' ELSE 'test' END AS split,
         (CASE WHEN r <= n_train THEN r - 1 ELSE r - n_train - 1 END)::BIGINT AS row_idx
  FROM split_ranked)"""


def _entities_sql(col: str) -> str:
    names = ", ".join(f"{lit(n)}: {lit(c)}" for n, c in P.HTML_ENTITIES)
    name = f"regexp_extract(x, {lit(P.HTML_ENTITY_HEAD)}, 1)"
    code = (f"CASE WHEN regexp_matches({name}, '^#[0-9]{{1,7}}$') THEN substr({name}, 2)::INTEGER "
            f"WHEN regexp_matches({name}, '^#[xX][0-9A-Fa-f]{{1,6}}$') THEN ('0x' || substr({name}, 3))::INTEGER END")
    char = (f"coalesce(MAP {{{names}}}[{name}], CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 "
            f"THEN chr({code}) END)")
    return (f"array_to_string(list_transform(string_split({col}, '&'), lambda x, i: CASE WHEN i = 1 THEN x "
            f"ELSE coalesce({char} || substr(x, length({name}) + 2), '&' || x) END), '')")


def _drop_blocks_sql(col: str) -> str:
    for block in P.HTML_DROP_BLOCKS:
        col = f"regexp_replace({col}, {lit(block)}, ' ', 'g')"
    return col


def with_(ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + body


ORACLE: dict[str, str] = {
    "lang_stats": with_(TOKS, """
SELECT s.lang, s.n_sentences, t.n_tokens, t.n_types
FROM (SELECT lang, count(*)::BIGINT AS n_sentences FROM sents GROUP BY lang) s
JOIN (SELECT lang, count(*)::BIGINT AS n_tokens, count(DISTINCT token)::BIGINT AS n_types FROM toks GROUP BY lang) t
USING (lang)"""),
    "corpus_lines": with_(LINES, "SELECT doc_id, lang, source, line_no::BIGINT AS line_no, text FROM lines"),
    "sentence_split": with_(SENTS, "SELECT doc_id, lang, line_no::BIGINT AS line_no, sent_no::BIGINT AS sent_no, sent FROM sents_all"),
    "sentence_filter": with_(SENTS, "SELECT doc_id, lang, line_no::BIGINT AS line_no, sent_no::BIGINT AS sent_no, sent FROM sents"),
    "sentence_text": with_(SENTS, """
SELECT doc_id, line_no::BIGINT AS line_no, string_agg(sent, chr(10) ORDER BY sent_no) AS text
FROM sents GROUP BY doc_id, line_no"""),
    "pretokenise": with_(TOKS, """
SELECT doc_id, line_no::BIGINT AS line_no, sent_no::BIGINT AS sent_no, tok_no::BIGINT AS tok_no, token FROM toks"""),
    "word_freq": with_(TOKS, "SELECT w, f FROM words"),
    "special_token_scan": f"""
WITH src AS (
  SELECT 'documents' AS origin, doc_id AS rec_id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, text FROM conversations
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
t AS (SELECT origin, unnest(regexp_extract_all(text, {lit(P.TOKEN_WITH_SPECIALS)})) AS token FROM src)
SELECT origin, token, (list_position({'[' + ', '.join(lit(s) for s in P.SPECIAL_TOKENS) + ']'}, token) - 1)::INTEGER AS token_id,
       count(*)::BIGINT AS n
FROM t WHERE token IN {in_list(P.SPECIAL_TOKENS)} GROUP BY ALL""",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "page_text": f"""
WITH t0 AS (SELECT page_id, """ + _drop_blocks_sql("html") + f""" AS t FROM pages),
t1 AS (SELECT page_id, regexp_replace(t, {lit(P.HTML_COMMENT)}, ' ', 'g') AS t FROM t0),
t2 AS (SELECT page_id, regexp_replace(t, {lit(P.HTML_BREAKS)}, chr(10), 'g') AS t FROM t1),
t3 AS (SELECT page_id, regexp_replace(t, {lit(P.HTML_TAG)}, '', 'g') AS t FROM t2),
t4 AS (SELECT page_id, """ + _entities_sql("t") + f""" AS t FROM t3),
t5 AS (SELECT page_id, regexp_replace(t, {lit(P.BLANK_RUN)}, ' ', 'g') AS t FROM t4),
l AS (SELECT page_id, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS line_no
      FROM (SELECT page_id, string_split(t, chr(10)) AS parts FROM t5))
SELECT page_id, line_no::BIGINT AS line_no, trim(x) AS text FROM l WHERE trim(x) <> ''""",
    "corpus_concat": """
SELECT 'documents' AS origin, doc_id AS rec_id, 0::BIGINT AS part, text FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
UNION ALL SELECT 'benchmark', item_id, 0::BIGINT, text FROM benchmark""",
    "corpus_interleave": """
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM documents GROUP BY lang)),
s AS (SELECT lang, row_number() OVER (ORDER BY lang) AS src, count(*) OVER () AS ns FROM (SELECT DISTINCT lang FROM documents))
SELECT r.lang, r.doc_id, r.rank::BIGINT AS rank, ((r.rank - 1) * s.ns + s.src - 1)::BIGINT AS position
FROM r JOIN s USING (lang) WHERE r.rank <= (SELECT m FROM m)""",
    "lexicon": with_(LEX, "SELECT base, word, type FROM lex"),
    "lexicon_explode": with_(LEX, "SELECT base, word, type FROM lex_exploded"),
    "noun_rows": with_(LEX, "SELECT base, word, type FROM nouns"),
    "word_list": with_(LEX, f"""
SELECT word, length(word)::BIGINT AS length FROM (
  SELECT DISTINCT lower(regexp_replace(word, {lit(P.HOMOGRAPH_NUMBER)}, '', 'g')) AS word FROM lex)
WHERE word IS NOT NULL"""),
    "small_dictionary": with_(LEX, "SELECT word, length FROM small_list"),
    "full_dictionary": with_(LEX, "SELECT word, length FROM full_list"),
    "length_buckets": with_(LEX, """
SELECT kind, length, count(*)::BIGINT AS n_words, min(word) AS first_word, max(word) AS last_word
FROM dicts GROUP BY kind, length"""),
    "dictionary_lookup": with_(TOKS + "," + LEX, """
SELECT w, w IN (SELECT word FROM dicts WHERE kind = 'small') AS in_small,
          w IN (SELECT word FROM dicts WHERE kind = 'full') AS in_full
FROM words"""),
    "compound_split": with_(SPLITS, """
SELECT w, len(cuts)::BIGINT AS n_cuts, array_to_string(cuts, ',') AS cuts, array_to_string(parts, ' ') AS parts
FROM split_parts"""),
    "compound_parts": with_(SPLITS, """
SELECT w, (generate_subscripts(parts, 1) - 1)::BIGINT AS part_no, unnest(parts) AS part FROM split_parts"""),
    "train_test_split": with_(SPLIT_ROWS, "SELECT doc_id, line_no, sent_no, split, row_idx FROM split_rows"),
    "epoch_shuffle": with_(SPLIT_ROWS, """
SELECT doc_id, line_no, sent_no, 1::BIGINT AS epoch,
       (row_number() OVER (ORDER BY md5('4242:1:' || doc_id || ':' || line_no || ':' || sent_no),
                                    doc_id, line_no, sent_no) - 1)::BIGINT AS position
FROM split_rows WHERE split = 'train'"""),
    "batch_assign": with_(SPLIT_ROWS, """
SELECT doc_id, line_no, sent_no, row_idx, (row_idx // 8)::BIGINT AS batch FROM split_rows WHERE split = 'test'"""),
}

ORACLE["compound_tokens"] = with_(SPLITS, """
SELECT t.doc_id, t.line_no::BIGINT AS line_no, t.sent_no::BIGINT AS sent_no, t.tok_no::BIGINT AS tok_no,
       (generate_subscripts(coalesce(s.parts, [t.token]), 1) - 1)::BIGINT AS part_no,
       unnest(coalesce(s.parts, [t.token])) AS piece
FROM toks t LEFT JOIN split_parts s ON s.w = t.token""")


# --- word-level ids, specials, padding, masking ---------------------------------------

IDS = SPLIT_ROWS + f""",
toks AS (
  SELECT doc_id, line_no, sent_no, unnest(tl) AS token, generate_subscripts(tl, 1) - 1 AS tok_no
  FROM (SELECT doc_id, line_no, sent_no, regexp_extract_all(lower(sent), {TOKEN}) AS tl FROM split_rows)),
words AS (
  SELECT token AS w, count(*)::BIGINT AS f FROM toks
  WHERE token NOT IN {in_list(P.SPECIAL_TOKENS)} GROUP BY token),
wv AS (SELECT w, (row_number() OVER (ORDER BY f DESC, w) + 4)::INTEGER AS id FROM words),
n_vocab AS (SELECT count(*) + 5 AS n FROM words),
sent_ids AS (
  SELECT r.doc_id, r.line_no, r.sent_no,
         coalesce(list(coalesce(wv.id, 3) ORDER BY t.tok_no) FILTER (WHERE t.token IS NOT NULL), []) AS ids
  FROM split_rows r LEFT JOIN toks t USING (doc_id, line_no, sent_no) LEFT JOIN wv ON wv.w = t.token
  GROUP BY r.doc_id, r.line_no, r.sent_no),
seqs AS (
  SELECT s.doc_id, s.line_no, s.sent_no, r.split, r.row_idx, s.ids,
         list_concat([1], s.ids[1:126], [2]) AS ids128,
         list_concat([1], s.ids[1:510], [2]) AS ids512
  FROM sent_ids s JOIN split_rows r USING (doc_id, line_no, sent_no))"""

_MASK_EXPR = """list_transform({ids}, lambda x, i: CASE
    WHEN x IN (0, 1, 2, 3, 4) THEN struct_pack(id := x, label := -100)
    WHEN ('0x' || substr(md5('4242:{epoch}:' || doc_id || ':' || line_no || ':' || sent_no || ':' || (i - 1)), 1, 6))::BIGINT >= {sel}
      THEN struct_pack(id := x, label := -100)
    WHEN ('0x' || substr(md5('4242:{epoch}:' || doc_id || ':' || line_no || ':' || sent_no || ':' || (i - 1)), 1, 6))::BIGINT < {mask}
      THEN struct_pack(id := 4, label := x)
    WHEN ('0x' || substr(md5('4242:{epoch}:' || doc_id || ':' || line_no || ':' || sent_no || ':' || (i - 1)), 1, 6))::BIGINT < {rnd}
      THEN struct_pack(id := (('0x' || substr(md5('r:4242:{epoch}:' || doc_id || ':' || line_no || ':' || sent_no || ':' || (i - 1)), 1, 6))::BIGINT % nv)::INTEGER, label := x)
    ELSE struct_pack(id := x, label := x) END)"""


def _mask(ids: str, epoch: int) -> str:
    from ..operators.mlm import MASK_T, RANDOM_T, SELECT_T
    return _MASK_EXPR.format(ids=ids, epoch=epoch, sel=SELECT_T, mask=MASK_T, rnd=RANDOM_T)


def _pad(ids: str, n: str) -> str:
    return f"list_concat({ids}, list_transform(range(greatest({n} - len({ids}), 0)), lambda z: 0))"


def _mask_bits(ids: str, n: str) -> str:
    return (f"list_concat(list_transform(range(len({ids})), lambda z: 1), "
            f"list_transform(range(greatest({n} - len({ids}), 0)), lambda z: 0))")


ORACLE.update({
    "vocab_lookup": with_(IDS, f"""
SELECT DISTINCT b.token, coalesce(wv.id, 3)::INTEGER AS id
FROM (SELECT unnest(regexp_extract_all(lower(text), {TOKEN})) AS token FROM benchmark) b LEFT JOIN wv ON wv.w = b.token"""),
    "truncate": with_(IDS, """
SELECT doc_id, line_no, sent_no, len(ids[1:126])::BIGINT AS n_ids, array_to_string(ids[1:126], ',') AS ids FROM seqs"""),
    "word_vocab": with_(IDS, f"""
SELECT id, w AS token, false AS special FROM wv
UNION ALL SELECT * FROM (VALUES {', '.join(f"({i}, {lit(t)}, true)" for i, t in enumerate(P.SPECIAL_TOKENS))}) v(id, token, special)"""),
    "token_ids": with_(IDS, """
SELECT doc_id, line_no, sent_no, len(ids)::BIGINT AS n_ids, array_to_string(ids, ',') AS ids FROM seqs"""),
    "add_specials": with_(IDS, """
SELECT doc_id, line_no, sent_no, len(ids128)::BIGINT AS n_ids, array_to_string(ids128, ',') AS input_ids FROM seqs"""),
    "pad_batch": with_(IDS, f"""
SELECT doc_id, line_no, sent_no, row_idx,
       array_to_string({_pad('ids128', 'm')}, ',') AS input_ids,
       array_to_string({_mask_bits('ids128', 'm')}, ',') AS attention_mask
FROM (SELECT *, max(len(ids128)) OVER (PARTITION BY row_idx // 1000) AS m FROM seqs WHERE split = 'train')"""),
    "pad_fixed": with_(IDS, f"""
SELECT doc_id, line_no, sent_no,
       array_to_string({_pad('ids512', '512')}, ',') AS input_ids,
       array_to_string({_mask_bits('ids512', '512')}, ',') AS attention_mask
FROM seqs WHERE split = 'test'"""),
    "length_views": with_(IDS, f"""
SELECT doc_id, line_no, sent_no, split, len(ids128)::BIGINT AS len_128, len(ids512)::BIGINT AS len_512,
       array_to_string({_pad('ids128', '128')}, ',') AS view_128,
       CASE WHEN split = 'test' THEN array_to_string({_pad('ids512', '512')}, ',') END AS view_512
FROM seqs"""),
    "mlm_mask": with_(IDS, f"""
SELECT doc_id, line_no, sent_no,
       array_to_string(list_transform(m, lambda x: x.id), ',') AS input_ids,
       array_to_string(list_transform(m, lambda x: x.label), ',') AS labels
FROM (SELECT doc_id, line_no, sent_no, {_mask(_pad('ids512', '512'), 0)} AS m
      FROM seqs, (SELECT n AS nv FROM n_vocab) WHERE split = 'test')"""),
    "mlm_epochs": with_(IDS, " UNION ALL ".join(f"""
SELECT doc_id, line_no, sent_no, {e}::BIGINT AS epoch,
       len(list_filter(m, lambda x: x.label <> -100))::BIGINT AS n_selected,
       len(list_filter(m, lambda x: x.id = 4))::BIGINT AS n_masked
FROM (SELECT doc_id, line_no, sent_no, {_mask('ids128', e)} AS m
      FROM seqs, (SELECT n AS nv FROM n_vocab) WHERE split = 'train')""" for e in (0, 1))),
    "decode_ids": with_(IDS + f""",
vocab AS (SELECT id, w AS token FROM wv UNION ALL
          SELECT * FROM (VALUES {', '.join(f"({i}, {lit(t)})" for i, t in enumerate(P.SPECIAL_TOKENS))}) v(id, token)),
dec AS (
  SELECT q.doc_id, q.line_no, q.sent_no, unnest(q.ids128) AS id, generate_subscripts(q.ids128, 1) AS pos FROM seqs q)""", """
SELECT dec.doc_id, dec.line_no, dec.sent_no, string_agg(vocab.token, ' ' ORDER BY dec.pos) AS text
FROM dec JOIN vocab USING (id) GROUP BY dec.doc_id, dec.line_no, dec.sent_no"""),
    "tokeniser_compare": with_(SPLITS + """,
per AS (
  SELECT toks.lang, toks.token AS w, coalesce(any_value(s.parts), [toks.token]) AS parts, count(*) AS f
  FROM toks LEFT JOIN split_parts s ON s.w = toks.token GROUP BY toks.lang, toks.token),
types AS (SELECT lang, count(DISTINCT part) AS n_part_types FROM (SELECT lang, unnest(parts) AS part FROM per) GROUP BY lang)""", """
SELECT per.lang, sum(f)::BIGINT AS n_pretokens, count(*)::BIGINT AS n_pretoken_types,
       sum(f * len(parts))::BIGINT AS n_compound_parts,
       round(sum(CASE WHEN len(parts) = 1 THEN f ELSE 0 END)::DOUBLE / sum(f), 6) AS share_unsplit,
       any_value(n_part_types)::BIGINT AS n_part_types
FROM per JOIN types USING (lang) GROUP BY per.lang"""),
    "row_loss": """
WITH r AS (SELECT vec_id AS row_id, label, embedding AS x, list_max(embedding)::DOUBLE AS m FROM embeddings WHERE label >= 0)
SELECT row_id,
       round(m + ln(list_sum(list_transform(x, lambda v: exp(v::DOUBLE - m)))) - x[label + 1]::DOUBLE, 6) AS loss,
       (list_position(x, list_max(x)) - 1 = label)::BIGINT AS correct
FROM r""",
    "mlm_eval": """
WITH r AS (SELECT vec_id // 4 AS seq_id, label, embedding AS x, list_max(embedding)::DOUBLE AS m FROM embeddings),
l AS (SELECT seq_id, CASE WHEN label >= 0 THEN m + ln(list_sum(list_transform(x, lambda v: exp(v::DOUBLE - m)))) - x[label + 1]::DOUBLE END AS loss,
             CASE WHEN label >= 0 THEN (list_position(x, list_max(x)) - 1 = label)::INTEGER END AS correct FROM r),
q AS (SELECT *, dense_rank() OVER (ORDER BY seq_id) - 1 AS seq FROM l),
b AS (SELECT seq // 8 AS batch, avg(loss) AS bl, sum(loss) AS sl, count(loss) AS nl, sum(correct) AS nc FROM q GROUP BY 1),
n AS (SELECT max(seq) + 1 AS n FROM q)
SELECT (SELECT n FROM n)::BIGINT AS n_seqs, sum(nl)::BIGINT AS n_scored,
       round(CASE WHEN (SELECT n FROM n) // 8 > 0 THEN exp(sum(bl) / ((SELECT n FROM n) // 8)) END, 6) AS perplexity,
       round(exp(sum(sl) / sum(nl)), 6) AS perplexity_exact,
       round(sum(nc)::DOUBLE / sum(nl), 6) AS accuracy
FROM b""",
    "normalise": with_(SENTS, """
SELECT doc_id, line_no::BIGINT AS line_no, sent_no::BIGINT AS sent_no, lower(sent) AS sent FROM sents"""),
    "lexicon_scan": with_(LEX, "SELECT base, word, type FROM lex"),
})

# --- Unigram seeds -------------------------------------------------------------------------

TRAIN_WORDS = SPLITS + """,
train_words AS MATERIALIZED (
  SELECT part AS w, sum(f)::BIGINT AS f, (row_number() OVER (ORDER BY part))::INTEGER AS wid FROM (
    SELECT unnest(coalesce(s.parts, [words.w])) AS part, words.f FROM words LEFT JOIN split_parts s ON s.w = words.w)
  GROUP BY part),
subs AS MATERIALIZED (
  SELECT wid, st, st + ln AS en, substr(w, st + 1, ln) AS piece, f
  FROM train_words, unnest(range(0, length(w))) AS a(st), unnest(range(1, 17)) AS b(ln)
  WHERE st + ln <= length(w))"""
SEEDS = TRAIN_WORDS + """,
counted AS (
  SELECT piece, sum(f)::BIGINT AS freq FROM subs GROUP BY piece),
kept AS (
  SELECT piece, freq, freq * length(piece) AS score FROM counted WHERE length(piece) = 1 OR freq >= 2),
ranked AS (
  SELECT *, CASE WHEN length(piece) = 1 THEN 0 ELSE row_number() OVER (PARTITION BY length(piece) = 1 ORDER BY score DESC, piece) END AS r
  FROM kept),
seeds AS MATERIALIZED (
  SELECT piece, freq, score FROM ranked WHERE length(piece) = 1
     OR r <= 1000000 - (SELECT count(*) FROM kept WHERE length(piece) = 1)),
seed_lp AS MATERIALIZED (
  SELECT *, ln(score) - ln((SELECT sum(score) FROM seeds)) AS lp, (row_number() OVER (ORDER BY piece))::INTEGER AS pno FROM seeds)"""

ORACLE["unigram_seed"] = with_(SEEDS, "SELECT piece, freq, score::BIGINT AS score, round(lp, 6) AS lp FROM seed_lp")

# Forward and backward sums of every word, one position a recursion step: the
# state of a word is the list of its sums so far.
ESTEP = SEEDS + """,
lat AS MATERIALIZED (SELECT wid, st::INTEGER AS st, en::INTEGER AS en, pno, lp FROM subs JOIN seed_lp USING (piece)),
by_end AS MATERIALIZED (SELECT wid, en, list(struct_pack(k := st, lp := lp)) AS es FROM lat GROUP BY wid, en),
by_start AS MATERIALIZED (SELECT l.wid, st, list(struct_pack(k := length(w) - en, lp := lp)) AS es
  FROM lat l JOIN train_words USING (wid) GROUP BY l.wid, st),
fwd(wid, n, p, a) AS (
  SELECT wid, length(w)::INTEGER, 0, [0.0::DOUBLE] FROM train_words
  UNION ALL
  SELECT wid, n, p + 1, list_append(a, m + ln(list_sum(list_transform(v, lambda x: exp(x - m)))))
  FROM (SELECT *, list_max(v) AS m FROM (
    SELECT fwd.wid, n, p, a, list_transform(g.es, lambda x: a[x.k + 1] + x.lp) AS v
    FROM fwd JOIN by_end g ON g.wid = fwd.wid AND g.en = p + 1))),
bwd(wid, n, p, a) AS (
  SELECT wid, length(w)::INTEGER, 0, [0.0::DOUBLE] FROM train_words
  UNION ALL
  SELECT wid, n, p + 1, list_append(a, m + ln(list_sum(list_transform(v, lambda x: exp(x - m)))))
  FROM (SELECT *, list_max(v) AS m FROM (
    SELECT bwd.wid, n, p, a, list_transform(g.es, lambda x: a[x.k + 1] + x.lp) AS v
    FROM bwd JOIN by_start g ON g.wid = bwd.wid AND g.st = n - p - 1))),
expected AS MATERIALIZED (
  SELECT pno, sum(w.f * exp(f.a[l.st + 1] + l.lp + b.a[b.n - l.en + 1] - f.a[f.n + 1])) AS c
  FROM lat l JOIN train_words w USING (wid) JOIN fwd f ON f.wid = l.wid AND f.p = f.n JOIN bwd b ON b.wid = l.wid AND b.p = b.n
  GROUP BY pno)"""
ORACLE["unigram_estep"] = with_(ESTEP, "SELECT piece, round(c, 4) AS c FROM expected JOIN seed_lp USING (pno)")


def _digamma(x: str) -> str:
    """digamma by the shift to x + 7 and its asymptotic series."""
    shift = " + ".join(f"1.0 / ({x} + {k})" for k in range(7))
    y = f"({x} + 7 - 0.5)"
    return (f"(ln({y}) + 1.0 / (24 * {y} ** 2) - 7.0 / (960 * {y} ** 4) + 31.0 / (8064 * {y} ** 6) "
            f"- 127.0 / (30720 * {y} ** 8) - ({shift}))")


ORACLE["unigram_mstep"] = with_(ESTEP + """,
kept_counts AS (SELECT piece, c FROM expected JOIN seed_lp USING (pno) WHERE c >= 0.5)""", f"""
SELECT piece, round(c, 4) AS c, round({_digamma('c')} - (SELECT {_digamma('t')} FROM (SELECT sum(c) AS t FROM kept_counts)), 6) AS lp
FROM kept_counts""")

# Best segmentation: as the forward sums, with the maximum and its way; equal
# scores go to the earlier start.
SEED_VOCAB = """,
vocab AS MATERIALIZED (
  SELECT piece, lp, (r + 4)::INTEGER AS id FROM (SELECT piece, lp, row_number() OVER (ORDER BY lp DESC, piece) AS r FROM seed_lp)
  WHERE r <= 49995)"""


def _viterbi(words: str) -> str:
    """Ways of all ``words (w, wid)`` over ``vocab``; 3 is an unknown character."""
    return f""",
vsubs AS (
  SELECT wid, st, st + ln AS en, substr(w, st + 1, ln) AS piece
  FROM {words}, unnest(range(0, length(w))) AS a(st), unnest(range(1, 17)) AS b(ln) WHERE st + ln <= length(w)),
vlat AS (
  SELECT wid, st, en, coalesce(id, 3) AS id, coalesce(lp, (SELECT min(lp) - 10 FROM vocab)) AS lp
  FROM vsubs LEFT JOIN vocab USING (piece) WHERE id IS NOT NULL OR en - st = 1),
vends AS MATERIALIZED (SELECT wid, en::INTEGER AS en, list(struct_pack(k := st::INTEGER, lp := lp, id := id)) AS es FROM vlat GROUP BY wid, en),
vit(wid, n, p, a, way) AS (
  SELECT wid, length(w)::INTEGER, 0, [0.0::DOUBLE], [[]::INTEGER[]] FROM {words}
  UNION ALL
  SELECT wid, n, p + 1, list_append(a, m.v), list_append(way, list_append(way[1 - m.nk], m.id))
  FROM (SELECT vit.wid, n, p, a, way,
               list_max(list_transform(g.es, lambda x: struct_pack(v := a[x.k + 1] + x.lp, nk := -x.k, id := x.id))) AS m
        FROM vit JOIN vends g ON g.wid = vit.wid AND g.en = p + 1)),
ways AS MATERIALIZED (
  SELECT w, wid, a[n + 1] AS score,
         list_filter(way[n + 1], lambda x, i: NOT (x = 3 AND i > 1 AND way[n + 1][greatest(i - 1, 1)] = 3)) AS ids
  FROM vit JOIN {words} USING (wid) WHERE p = n)"""


ORACLE["unigram_viterbi"] = with_(SEEDS + SEED_VOCAB + _viterbi("train_words") + """,
named AS (SELECT id, piece FROM vocab UNION ALL SELECT 3, '<unk>'),
spelled AS (
  SELECT wid, string_agg(piece, ' ' ORDER BY pos) AS tokens
  FROM (SELECT wid, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM ways) JOIN named USING (id) GROUP BY wid)""", """
SELECT w, array_to_string(ids, ',') AS ids, tokens, round(score, 6) AS score FROM ways JOIN spelled USING (wid)""")

ORACLE["corpus_perplexity"] = with_(SEEDS + SEED_VOCAB + """,
all_words AS MATERIALIZED (SELECT w, f, (row_number() OVER (ORDER BY w))::INTEGER AS wid FROM words)""" + _viterbi("all_words"), """
SELECT lang, count(*)::BIGINT AS n_words, sum(len(ids))::BIGINT AS n_pieces, round(exp(-sum(score) / sum(len(ids))), 4) AS perplexity
FROM toks JOIN ways ON ways.w = toks.token GROUP BY lang""")


def _encoded(where: str = "") -> str:
    """Up to ``seqs``: the wrapped ids of the sentences, by the seed vocabulary."""
    return SEEDS + SEED_VOCAB + _viterbi("train_words") + SPLIT_ROWS[len(SENTS):] + """,
word_parts AS (
  SELECT w, unnest(parts) AS part, generate_subscripts(parts, 1) AS j
  FROM (SELECT words.w, coalesce(s.parts, [words.w]) AS parts FROM words LEFT JOIN split_parts s ON s.w = words.w)),
word_ids AS MATERIALIZED (
  SELECT word_parts.w, flatten(list(ways.ids ORDER BY j)) AS ids FROM word_parts JOIN ways ON ways.w = part GROUP BY word_parts.w),
""" + f"""seqs AS (
  SELECT r.doc_id, r.line_no, r.sent_no, any_value(r.row_idx) AS row_idx,
         list_concat([1], coalesce(flatten(list(word_ids.ids ORDER BY tok_no) FILTER (WHERE t.token IS NOT NULL)), [])[1:126], [2]) AS ids128
  FROM split_rows r LEFT JOIN toks t ON t.doc_id = r.doc_id AND t.line_no = r.line_no AND t.sent_no = r.sent_no
       LEFT JOIN word_ids ON word_ids.w = t.token
  {where} GROUP BY r.doc_id, r.line_no, r.sent_no)"""


ORACLE["encode_docs"] = with_(_encoded("WHERE r.split = 'train'"), f"""
SELECT doc_id, line_no, sent_no,
       array_to_string({_pad('ids128', 'm')}, ',') AS input_ids,
       array_to_string({_mask_bits('ids128', 'm')}, ',') AS attention_mask
FROM (SELECT *, max(len(ids128)) OVER (PARTITION BY row_idx // 1000) AS m FROM seqs)""")

ORACLE["encode_stream"] = with_(_encoded(), """
SELECT doc_id, line_no, sent_no, array_to_string(ids128, ',') AS input_ids FROM seqs""")


def _text_lines(t0: str) -> str:
    """Markup CTE ``t0 (page_id, t)`` -> its non-empty text lines."""
    return f"""
t1 AS (SELECT page_id, regexp_replace(t, {lit(P.HTML_COMMENT)}, ' ', 'g') AS t FROM {t0}),
t2 AS (SELECT page_id, regexp_replace(t, {lit(P.HTML_BREAKS)}, chr(10), 'g') AS t FROM t1),
t3 AS (SELECT page_id, regexp_replace(t, {lit(P.HTML_TAG)}, '', 'g') AS t FROM t2),
t4 AS (SELECT page_id, {_entities_sql("t")} AS t FROM t3),
t5 AS (SELECT page_id, regexp_replace(t, {lit(P.BLANK_RUN)}, ' ', 'g') AS t FROM t4),
l AS (SELECT page_id, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS line_no
      FROM (SELECT page_id, string_split(t, chr(10)) AS parts FROM t5))
SELECT page_id, line_no::BIGINT AS line_no, trim(x) AS text FROM l WHERE trim(x) <> ''"""


def _replace_sql(col: str, *steps) -> str:
    for pattern, new in steps:
        col = f"regexp_replace({col}, {lit(pattern)}, {lit(new)}, 'g')"
    return col


# Wiki markup by rewriting: each round resolves the innermost templates, tables and
# links, until nothing changes (text without single braces or brackets in them).
_WIKI_ROUND = _replace_sql(
    "t", (r"\{\{[^{}\[\]]*\}\}", ""), (r"(?m)^[ \t:]*\{\|[^{}\[\]]*\n[ \t]*\|\}", ""),
    (r"(?i)\[\[ *(" + "|".join(P.WIKI_DROP_NAMESPACES) + r") *:[^\[\]{}]*\]\]", ""),
    (r"\[\[:?([^\[\]{}|]+)\|?\]\]", r"\1"), (r"\[\[[^\[\]{}|]*\|([^\[\]{}]+)\]\]", r"\1"))
_WIKI_SOURCE = """'{{Infobox' || chr(10) || '| lang = {{lang|' || lang || '}}' || chr(10) || '| from = [[' || source || ']]' ||
  chr(10) || '}}' || chr(10) || '''''''Page ' || doc_id || '''''''<ref name=a>{{cite|' || source || '}}</ref> &amp; [[' ||
  lang || '|the ' || lang || ' part]]<ref name=a />' || chr(10) || '== [[Text]] of it ==' || chr(10) || text || chr(10) ||
  '{| class="x"' || chr(10) || '|-' || chr(10) || '| {{n|1}} || [[' || source || ']]' || chr(10) || '|}' || chr(10) ||
  '* [[File:a.jpg|thumb|see [[' || source || '|it]] {{clear}}]]''''more'''' at [https://example.org/ the site]' ||
  chr(10) || '# open {{ end' || chr(10) || '<!-- [[x -->[[Category:' || lang || ']]__NOTOC__'"""
ORACLE["wikitext_lines"] = with_(f"""
w0 AS (SELECT doc_id AS page_id, {_WIKI_SOURCE} AS t FROM documents),
w1 AS (SELECT page_id, {_replace_sql("t", (P.WIKI_COMMENT, ""), (P.WIKI_EMPTY_BLOCKS, ""),
                                     *[(b, "") for b in P.WIKI_DROP_BLOCKS])} AS t FROM w0),
w2(page_id, k, t) AS (
  SELECT page_id, 0, t FROM w1
  UNION ALL SELECT page_id, k + 1, {_WIKI_ROUND} FROM w2 WHERE {_WIKI_ROUND} <> t),
w3 AS (SELECT page_id, arg_max(t, k) AS t FROM w2 GROUP BY page_id),
w4 AS (SELECT page_id, {_replace_sql("t", (P.WIKI_EXTERNAL, chr(92) + "1"), (P.WIKI_HEADING, chr(92) + "1"),
                                     (P.WIKI_EMPHASIS, ""), (P.WIKI_SWITCH, ""), (P.WIKI_LIST, ""))} AS t FROM w3),
w5 AS (SELECT page_id, {_drop_blocks_sql("t")} AS t FROM w4),""", _text_lines("w5").lstrip())


ABBREVIATIONS = LINES + f""",
titled AS (
  SELECT doc_id, lang, line_no::BIGINT AS line_no,
         regexp_replace(regexp_replace(text, '([.!?]) (\\p{{Lu}})', '\\1 Dr. \\2', 'g'),
                        ' (\\p{{Ll}}{{9,}}) ', ' ca. \\1 ', 'g') AS text
  FROM lines),
stops AS (
  SELECT lang, unnest(regexp_extract_all(regexp_replace(text, {lit(P.STOP_INSIDE)}, '.' || chr(1) || '\\1', 'g'),
                                         {lit(P.STOPPED_WORD)})) AS t FROM titled),
counts AS (
  SELECT lang, lower(regexp_replace(t, {lit(P.STOP_TAIL)}, '')) AS word,
         (count(*) FILTER (regexp_matches(t, {lit(P.STOP_TAIL)})))::BIGINT AS n_stop,
         (count(*) FILTER (NOT regexp_matches(t, {lit(P.STOP_TAIL)})))::BIGINT AS n_plain,
         (count(*) FILTER (ends_with(t, chr(1))))::BIGINT AS n_lower
  FROM stops GROUP BY ALL),
abbr AS (
  SELECT * FROM counts
  WHERE n_stop >= 5 AND n_stop * 20000 >= (SELECT sum(n_stop) FROM counts) AND n_stop * 10 >= (n_stop + n_plain) * 9
    AND (length(word) <= 4 OR contains(word, '.') OR n_lower * 10 >= n_stop))"""
ORACLE["abbreviation_list"] = with_(ABBREVIATIONS, "SELECT lang, word, n_stop, n_plain, n_lower FROM abbr")
ORACLE["sentence_split_learnt"] = with_(ABBREVIATIONS + f""",
gaps AS (
  SELECT doc_id, lang, line_no, unnest(parts) AS x, generate_subscripts(parts, 1) AS i
  FROM (SELECT *, string_split(regexp_replace(text, {lit(P.SENTENCE_GAP)}, '\\1\\2' || chr(10) || '\\3', 'g'), chr(10)) AS parts
        FROM titled)),
open_ends AS (
  SELECT g.*, (a.word IS NOT NULL)::BIGINT AS goes_on
  FROM gaps g LEFT JOIN abbr a ON a.lang IS NOT DISTINCT FROM g.lang
    AND a.word = lower(regexp_extract(g.x, {lit(P.LAST_STOPPED_WORD)}, 1))),
numbered AS (
  SELECT *, coalesce(sum(1 - goes_on) OVER (PARTITION BY doc_id, line_no ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_no FROM open_ends)""", """
SELECT doc_id, lang, line_no, sent_no, trim(string_agg(x, '' ORDER BY i)) AS sent FROM numbered
GROUP BY doc_id, lang, line_no, sent_no""")

# Every known character is a piece of its own, so unknown ids are the runs of unknown characters.
ORACLE["encode_unk"] = with_(TOKS + """,
letters AS (SELECT w, i, substr(w, i::BIGINT, 1) AS c FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
item_words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), """ + TOKEN + """)) AS w FROM benchmark),
known AS (SELECT DISTINCT substr(w, i::BIGINT, 1) AS c FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM item_words)),
flags AS (SELECT w, i, (c NOT IN (SELECT c FROM known)) AS unk FROM letters),
starts AS (SELECT w, (unk AND NOT lag(unk, 1, false) OVER (PARTITION BY w ORDER BY i)) AS s FROM flags)""", """
SELECT w, (count(*) FILTER (s))::BIGINT AS n_unk FROM starts GROUP BY w HAVING count(*) FILTER (s) > 0""")
